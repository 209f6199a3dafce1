"""Labels, features, scaling, weights, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import labels
from flowsieve.operators import prepare, sampling
from flowsieve.plans.base import flows, query, r6, table, with_views

RAW_LABEL = (
    "CASE source_row % 12 WHEN 0 THEN ' normal ' WHEN 1 THEN 'DOS' WHEN 2 THEN 'exploit' WHEN 3 THEN 'Backdoor'"
    " WHEN 4 THEN 'worm' WHEN 5 THEN '-' WHEN 6 THEN 'None' WHEN 7 THEN 'fuzzer' WHEN 8 THEN 'scanning probe'"
    " WHEN 9 THEN '' WHEN 10 THEN NULL ELSE 'Analysis' END"
)


@query(
    "normalize_labels",
    with_views(
        f"""SELECT source_row, attack_cat, CASE WHEN attack_cat = 'Normal' THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS label_binary
 FROM (SELECT source_row, CASE WHEN raw IS NULL OR trim(raw) IN ('', '-', 'None') THEN 'Normal' ELSE
 CASE lower(trim(raw)) WHEN 'normal' THEN 'Normal' WHEN 'dos' THEN 'DoS' WHEN 'exploit' THEN 'Exploits'
 WHEN 'backdoor' THEN 'Backdoors' WHEN 'worm' THEN 'Worms' WHEN 'fuzzer' THEN 'Fuzzers' WHEN 'analysis' THEN 'Analysis'
 ELSE concat(upper(left(trim(raw), 1)), lower(substr(trim(raw), 2))) END END AS attack_cat
 FROM (SELECT source_row, {RAW_LABEL} AS raw FROM flows_v))"""
    ),
)
def normalize_labels(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).selectExpr("source_row", f"{RAW_LABEL} AS attack_cat")
    return prepare.normalize_labels(raw).select("source_row", "attack_cat", "label_binary")


@query(
    "ground_truth",
    with_views(
        f"""SELECT truth, count(*) AS rows FROM (SELECT CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', 'nan', 'none', '-', 'unknown')
 THEN '' WHEN lower(trim(raw)) IN ('0', 'benign', 'normal') THEN 'Normal' ELSE 'Known-Attack' END AS truth
 FROM (SELECT {RAW_LABEL} AS raw FROM flows_v)) GROUP BY truth"""
    ),
)
def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).selectExpr(f"{RAW_LABEL} AS raw")
    return raw.groupBy(labels.truth_verdict(F.col("raw")).alias("truth")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "analyst_labels",
    with_views(
        f"""SELECT analyst_label, attack_category, count(*) AS rows FROM (SELECT CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', 'none')
 THEN 'unknown' WHEN lower(trim(raw)) = 'normal' THEN 'normal' ELSE 'known_attack' END AS analyst_label,
 CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', 'none', 'normal') THEN 'Normal' ELSE trim(raw) END AS attack_category
 FROM (SELECT {RAW_LABEL} AS raw FROM flows_v)) GROUP BY ALL"""
    ),
)
def analyst_labels(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).selectExpr(f"{RAW_LABEL} AS raw")
    return raw.groupBy(
        labels.default_analyst_label(F.col("raw")).alias("analyst_label"),
        labels.attack_category(F.col("raw")).alias("attack_category"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "drop_duplicates",
    f"""SELECT DISTINCT l_returnflag, l_linestatus, {r6('l_discount')} AS l_discount,
 CASE WHEN l_tax = 0 THEN NULL ELSE {r6('l_discount / l_tax')} END AS load FROM lineitem""",
)
def drop_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    discount, tax = F.col("l_discount"), F.col("l_tax")
    load = F.when(tax == 0, F.lit(float("inf"))).otherwise(discount / F.when(tax != 0, tax))
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", (discount + 0.0).alias("l_discount"), load.alias("load"))
    return prepare.drop_infinite_and_duplicates(df)


_CLASS = (
    "CASE WHEN attack_cat = 'Normal' AND source_row % 10 = 0 THEN 'Lateral' WHEN attack_cat = 'Normal' AND"
    " source_row % 2 = 0 THEN 'Beacon' ELSE attack_cat END"
)


@query(
    "class_partition",
    with_views(
        f"""SELECT attack_cat, count(*) AS rows, CASE WHEN attack_cat IN ('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')
 THEN 'known' WHEN attack_cat = 'Fuzzers' OR count(*) < 1000 THEN 'held_out' ELSE 'known' END AS pool
 FROM (SELECT {_CLASS} AS attack_cat FROM flows_v) GROUP BY attack_cat"""
    ),
)
def class_partition(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.class_partition(flows(spark, folder).selectExpr(f"{_CLASS} AS attack_cat"), small=1000)


@query(
    "assign_pool",
    with_views(
        f"""SELECT source_row, attack_cat, CASE WHEN attack_cat IN ('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')
 THEN 'known' WHEN attack_cat = 'Fuzzers' OR count(*) OVER (PARTITION BY attack_cat) < 1000 THEN 'held_out' ELSE 'known' END AS pool
 FROM (SELECT source_row, {_CLASS} AS attack_cat FROM flows_v)"""
    ),
)
def assign_pool(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.assign_pool(flows(spark, folder).selectExpr("source_row", f"{_CLASS} AS attack_cat"), small=1000)


@query(
    "assign_pool_nulls",
    with_views(
        f"""SELECT source_row, attack_cat, CASE WHEN attack_cat IN ('Normal', 'DoS', 'Exploits', 'Reconnaissance', 'Generic')
 THEN 'known' WHEN attack_cat = 'Fuzzers' OR count(*) OVER (PARTITION BY attack_cat) < 1000 THEN 'held_out' ELSE 'known' END AS pool
 FROM (SELECT source_row, CASE WHEN source_row % 4 > 0 THEN {_CLASS} END AS attack_cat FROM flows_v)"""
    ),
)
def assign_pool_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the rows has no class; they keep their rows."""
    rows = flows(spark, folder).selectExpr("source_row", f"CASE WHEN source_row % 4 > 0 THEN {_CLASS} END AS attack_cat")
    return prepare.assign_pool(rows, small=1000)


_CODES = """SELECT 'service' AS "column", value, row_number() OVER (ORDER BY appended, value) - 1 AS code FROM (
 SELECT DISTINCT service AS value, 0 AS appended FROM flows_v UNION ALL SELECT 'unk', 1)
 UNION ALL SELECT 'protocol', value, row_number() OVER (ORDER BY appended, value) - 1 FROM (
 SELECT DISTINCT protocol AS value, 0 AS appended FROM flows_v UNION ALL SELECT 'unk', 1)"""


@query("category_fit", with_views(_CODES))
def category_fit(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.category_fit(flows(spark, folder), ["service", "protocol"])


@query(
    "category_encode",
    with_views(
        """SELECT f.source_row, CAST(coalesce(a.code, (SELECT max(code) FROM codes WHERE "column" = 'service' AND value = 'unk')) AS DOUBLE) AS service_num,
 CAST(coalesce(b.code, (SELECT max(code) FROM codes WHERE "column" = 'protocol' AND value = 'unk')) AS DOUBLE) AS protocol_num
 FROM flows_v f LEFT JOIN codes a ON a."column" = 'service' AND a.value = f.service
 LEFT JOIN codes b ON b."column" = 'protocol' AND b.value = f.protocol""",
        (
            "codes",
            """SELECT 'service' AS "column", value, row_number() OVER (ORDER BY appended, value) - 1 AS code FROM (
 SELECT DISTINCT service AS value, 0 AS appended FROM flows_v WHERE attack_cat = 'DoS' AND service <> 'ssh' UNION ALL SELECT 'unk', 1)
 UNION ALL SELECT 'protocol', value, row_number() OVER (ORDER BY appended, value) - 1 FROM (
 SELECT DISTINCT protocol AS value, 0 AS appended FROM flows_v WHERE attack_cat = 'DoS' AND service <> 'ssh' UNION ALL SELECT 'unk', 1)""",
        ),
    ),
)
def category_encode(spark: SparkSession, folder: str) -> DataFrame:
    df = flows(spark, folder)
    codes = prepare.category_fit(df.where("attack_cat = 'DoS' AND service <> 'ssh'"), ["service", "protocol"])
    out = prepare.category_encode(df, codes, ["service", "protocol"])
    return out.select("source_row", "service_num", "protocol_num")


# Feature inputs derived from the flows, so that every formula has its columns.
FEATURE_INPUT = {
    "source_row": "source_row",
    "attack_cat": "attack_cat",
    "dur": "duration",
    "sbytes": "CAST(sent_bytes AS DOUBLE)",
    "dbytes": "CAST(received_bytes AS DOUBLE)",
    "spkts": "CAST(sent_pkts AS DOUBLE)",
    "dpkts": "CAST(received_pkts AS DOUBLE)",
    "sload": "sent_bytes * 8E0 / greatest(duration, 1E-6)",
    "dload": "received_bytes * 8E0 / greatest(duration, 1E-6)",
    "sttl": "CAST(source_row % 255 AS DOUBLE)",
    "dttl": "CAST((source_row * 3) % 128 AS DOUBLE)",
    "sloss": "CAST(source_row % 4 AS DOUBLE)",
    "dloss": "CAST(source_row % 3 AS DOUBLE)",
    "sjit": "duration * 0.5E0 - 1E0",
    "djit": "duration * 0.25E0",
    "synack": "CASE WHEN source_row % 2 = 0 THEN duration / 4E0 ELSE 0E0 END",
    "ackdat": "CASE WHEN source_row % 3 = 0 THEN duration / 8E0 ELSE 0E0 END",
    "sintpkt": "duration / greatest(sent_pkts, 1)",
    "dintpkt": "duration / greatest(received_pkts, 1)",
    "ct_srv_src": "CAST(1 + source_row % 17 AS DOUBLE)",
    "ct_srv_dst": "CAST(1 + source_row % 5 AS DOUBLE)",
}
_INPUT = ("input_v", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FEATURE_INPUT.items()) + " FROM flows_v")
E = "1E-8"
FEATURE_SQL = {
    "bytes_ratio": f"sbytes / (sbytes + dbytes + {E})",
    "log_total_bytes": f"ln(1 + sbytes + dbytes + {E})",
    "log_sbytes": "ln(1 + greatest(sbytes, 0))",
    "log_dbytes": "ln(1 + greatest(dbytes, 0))",
    "pkts_ratio": f"spkts / (spkts + dpkts + {E})",
    "log_total_pkts": f"ln(1 + spkts + dpkts + {E})",
    "src_bps": "sbytes / greatest(dur, 1E-6)",
    "log_src_bps": "ln(1 + sbytes / greatest(dur, 1E-6))",
    "pkt_rate": f"(spkts + {E}) / greatest(dur, 1E-6)",
    "load_asym": f"abs(sload - dload) / (sload + dload + {E})",
    "log_sload": "ln(1 + greatest(sload, 0))",
    "ttl_diff": "abs(sttl - dttl)",
    "ttl_sum": "sttl + dttl",
    "loss_rate_src": f"sloss / (spkts + {E})",
    "jit_ratio": f"sjit / (djit + {E})",
    "log_sjit": "ln(1 + greatest(sjit, 0))",
    "handshake_ratio": f"synack / (ackdat + {E})",
    "incomplete_tcp": "CASE WHEN synack > 0 AND ackdat = 0 THEN 1E0 ELSE 0E0 END",
    "intpkt_ratio": f"sintpkt / (dintpkt + {E})",
}
# large quotients over eps are compared relative to their size
SCALED = {"pkt_rate", "jit_ratio", "handshake_ratio", "intpkt_ratio", "loss_rate_src", "src_bps"}
EXTENDED_SQL = {
    "bytes_per_pkt_src": f"sbytes / (spkts + {E})",
    "log_dload": "ln(1 + greatest(dload, 0))",
    "jit_sum": "sjit + djit",
    "intpkt_diff": "abs(sintpkt - dintpkt)",
    "ct_srv_ratio": f"ct_srv_src / (ct_srv_dst + {E})",
}


def feature_input(spark: SparkSession, folder: str) -> DataFrame:
    return flows(spark, folder).selectExpr(*[f"{e} AS {n}" for n, e in FEATURE_INPUT.items()])


def _signed_log(expr: str) -> str:
    return f"sign({expr}) * ln(1 + abs({expr}))"


def _compare(formulas: dict[str, str]) -> str:
    return ", ".join(f"{r6(_signed_log(e) if n in SCALED else e)} AS {n}" for n, e in formulas.items())


def _shown(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return df.select(
        "source_row",
        *[
            (F.signum(n) * F.log1p(F.abs(n))).alias(n) if n in SCALED else F.col(n)
            for n in formulas
        ],
    )


@query("engineer_features", with_views(f"SELECT source_row, {_compare(FEATURE_SQL)} FROM input_v", _INPUT))
def engineer_features(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(prepare.engineer_features(feature_input(spark, folder)), FEATURE_SQL)


@query("engineer_features_v15", with_views(f"SELECT source_row, {_compare(EXTENDED_SQL)} FROM input_v", _INPUT))
def engineer_features_v15(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(prepare.engineer_features(feature_input(spark, folder), extended=True), EXTENDED_SQL)


SCALE_FEATURES = ["dur", "sbytes", "spkts", "sttl", "constant"]


def _scale_input(spark: SparkSession, folder: str) -> DataFrame:
    return feature_input(spark, folder).withColumn("constant", F.lit(3.5))


_STD = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r6(f'stddev_samp({f})')} AS std, coalesce(stddev_samp({f}) > 1E-8, false) AS keep FROM scale_v"
    for f in SCALE_FEATURES
)
_SCALE_V = ("scale_v", "SELECT *, 3.5E0 AS constant FROM input_v")


@query(
    "numeric_selection",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{n}' AS feature, count({n}) AS rows, {r6(f'CAST(max({n}) AS DOUBLE)')} AS high FROM coded_v"
            for n in (*[c for c in FEATURE_INPUT if c not in ("source_row", "attack_cat")], "proto_num")
        ),
        _INPUT,
        ("coded_v", "SELECT *, CASE WHEN source_row % 5 = 0 THEN 1E0 ELSE 2E0 END AS proto_num FROM input_v"),
    ),
)
def numeric_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The model's input columns of a table that also has text, labels, times and row numbers."""
    df = feature_input(spark, folder).withColumn("proto_num", F.when(F.col("source_row") % 5 == 0, 1.0).otherwise(2.0))
    others = {"srcip": F.lit("10.0.0.1"), "service": F.lit("http"), "label_binary": F.lit(1), "source_file": F.lit("a.csv")}
    mixed = df.withColumns({n: c for n, c in others.items()}).withColumn("seen_at", F.current_timestamp())
    names = [n for n in prepare.numeric_features(mixed) if n != "source_row"]
    facts = mixed.agg(*[F.count(n).alias(f"n|{n}") for n in names], *[F.max(n).cast("double").alias(f"m|{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"n|{n}").alias("rows"), F.col(f"m|{n}").alias("high")) for n in names])
    return facts.select(F.inline(rows))


@query("feature_variance", with_views(_STD, _INPUT, _SCALE_V))
def feature_variance(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.feature_variance(_scale_input(spark, folder), SCALE_FEATURES)


_FIT = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {r6(f'quantile_cont({f}, 0.5)')} AS center, CASE WHEN
 quantile_cont({f}, 0.75) = quantile_cont({f}, 0.25) THEN 1E0 ELSE {r6(f'quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)')} END AS scale
 FROM scale_v WHERE attack_cat <> 'Fuzzers'"""
    for f in SCALE_FEATURES
)


@query("robust_fit", with_views(_FIT, _INPUT, _SCALE_V))
def robust_fit(spark: SparkSession, folder: str) -> DataFrame:
    df = _scale_input(spark, folder)
    return prepare.scaler_table(df, prepare.robust_fit(df.where("attack_cat <> 'Fuzzers'"), SCALE_FEATURES))


_MED = {f: f"(SELECT quantile_cont({f}, 0.5) FROM scale_v WHERE attack_cat <> 'Fuzzers')" for f in SCALE_FEATURES}
_IQR = {
    f: f"(SELECT CASE WHEN quantile_cont({f}, 0.75) = quantile_cont({f}, 0.25) THEN 1E0 ELSE"
    f" quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END FROM scale_v WHERE attack_cat <> 'Fuzzers')"
    for f in SCALE_FEATURES
}


@query(
    "robust_scale",
    with_views(
        "SELECT source_row, "
        + ", ".join(
            r6(f"greatest(least(({f} - {_MED[f]}) / {_IQR[f]}, 10E0), -10E0)") + f" AS {f}" for f in SCALE_FEATURES
        )
        + " FROM scale_v",
        _INPUT,
        _SCALE_V,
    ),
)
def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    df = _scale_input(spark, folder)
    fitted = prepare.robust_fit(df.where("attack_cat <> 'Fuzzers'"), SCALE_FEATURES)
    return prepare.robust_scale(df, fitted).select("source_row", *SCALE_FEATURES)


@query(
    "feature_align",
    with_views(
        f"""SELECT source_row, {r6('sbytes')} AS sbytes, 0E0 AS absent, CASE WHEN dpkts = 0 THEN 0E0 ELSE {r6('dur / dpkts')} END AS gap,
 {r6('dur')} AS dur FROM input_v""",
        _INPUT,
    ),
)
def feature_align(spark: SparkSession, folder: str) -> DataFrame:
    gap = F.when(F.col("dpkts") == 0, F.lit(float("inf"))).otherwise(F.try_divide("dur", "dpkts"))
    df = feature_input(spark, folder).withColumn("gap", gap)
    return prepare.align_features(df, ["sbytes", "absent", "gap", "dur"], keep=["source_row"])


@query(
    "class_weights",
    with_views(
        """SELECT source_row, attack_cat, round(CASE WHEN attack_cat = 'DoS' THEN 5E0 ELSE 1E0 END
 / count(*) OVER (PARTITION BY attack_cat) * 1000 + 1E-10, 6) + 0E0 AS weight FROM flows_v"""
    ),
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    multipliers = prepare.class_multipliers({"DoS": 5.0}, labels.KNOWN_CLASSES)
    df = flows(spark, folder).select("source_row", "attack_cat")
    return prepare.class_weights(df, "attack_cat", multipliers).withColumn("weight", F.col("weight") * 1000)


_DRAW = "md5(concat('42:', CAST(source_row AS STRING)))"


@query(
    "stable_sample",
    with_views(
        f"""SELECT attack_cat, source_row FROM (SELECT attack_cat, source_row, row_number() OVER (PARTITION BY attack_cat
 ORDER BY {_DRAW}, source_row) AS rn FROM flows_v) WHERE rn <= 200"""
    ),
)
def stable_sample(spark: SparkSession, folder: str) -> DataFrame:
    df = flows(spark, folder).select("attack_cat", "source_row")
    return sampling.stable_sample(df, 200, "source_row", ["attack_cat"])


@query(
    "stratified_split",
    with_views(
        f"""SELECT source_row, attack_cat, CASE WHEN rn <= round_even(n * 0.2E0, 0) THEN 'test'
 WHEN rn <= round_even(n * (0.2E0 + 0.1E0), 0) THEN 'validation' ELSE 'train' END AS split FROM (
 SELECT source_row, attack_cat, row_number() OVER (PARTITION BY attack_cat ORDER BY {_DRAW}, source_row) AS rn,
 count(*) OVER (PARTITION BY attack_cat) AS n FROM flows_v)"""
    ),
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    df = flows(spark, folder).select("source_row", "attack_cat")
    return sampling.stratified_split(df, "attack_cat", "source_row")


@query(
    "stratified_split_nulls",
    with_views(
        f"""SELECT source_row, attack_cat, CASE WHEN rn <= round_even(n * 0.2E0, 0) THEN 'test'
 WHEN rn <= round_even(n * (0.2E0 + 0.1E0), 0) THEN 'validation' ELSE 'train' END AS split FROM (
 SELECT source_row, attack_cat, row_number() OVER (PARTITION BY attack_cat ORDER BY {_DRAW}, source_row) AS rn,
 count(*) OVER (PARTITION BY attack_cat) AS n FROM (SELECT source_row, CASE WHEN source_row % 4 > 0 THEN attack_cat END AS attack_cat FROM flows_v))"""
    ),
)
def stratified_split_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a class are a stratum of their own."""
    df = flows(spark, folder).selectExpr("source_row", "CASE WHEN source_row % 4 > 0 THEN attack_cat END AS attack_cat")
    return sampling.stratified_split(df, "attack_cat", "source_row")


_UNIFORM = f"(CAST(('0x' || substr({_DRAW}, 1, 12)) AS BIGINT) / 281474976710656E0)"


@query(
    "hash_split",
    with_views(
        f"""SELECT source_row, CASE WHEN {_UNIFORM} < 0.7E0 THEN 'train' WHEN {_UNIFORM} < 0.7E0 + 0.1E0 THEN 'validation'
 ELSE 'test' END AS split FROM flows_v"""
    ),
)
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.hash_split(flows(spark, folder).select("source_row"), "source_row")


_POISSON_U = _UNIFORM.replace("42:", "poisson-42:")


@query(
    "weighted_resample",
    with_views(
        f"""SELECT attack_cat, CAST(sum(k) AS BIGINT) AS rows, count(*) FILTER (WHERE k > 0) AS distinct_rows FROM (
 SELECT attack_cat, (SELECT count(*) FROM cdf_v c WHERE c.cat = a.attack_cat AND a.u >= c.cdf) AS k FROM draw_v a) GROUP BY attack_cat""",
        ("draw_v", f"SELECT attack_cat, {_POISSON_U} AS u FROM flows_v"),
        ("mean_v", "SELECT attack_cat AS cat, (SELECT count(*) FROM flows_v) / CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT attack_cat) FROM flows_v) AS m FROM flows_v GROUP BY ALL"),
        ("cdf_v", "SELECT cat, sum(exp(-m) * pow(m, j) / gamma(j + 1)) OVER (PARTITION BY cat ORDER BY j) AS cdf FROM mean_v, range(0, 60) t(j)"),
    ),
)
def weighted_resample(spark: SparkSession, folder: str) -> DataFrame:
    df = prepare.class_weights(flows(spark, folder).select("source_row", "attack_cat"), "attack_cat")
    return sampling.weighted_resample(df, "weight", "source_row").groupBy("attack_cat").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source_row").alias("distinct_rows")
    )
