"""Normalisation, production table, splits and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import vocab
from flowsieve.functions import flow as flow_fn
from flowsieve.functions import labels
from flowsieve.functions.times import iso_z, parse_event_time
from flowsieve.operators import normalize, production, quality
from flowsieve.plans.base import flows, query, r6, table, with_views

KEEP = ("source_row",)
FIREWALL_HEADER = {
    "src_ip": "Src IP",
    "dst_ip": "Dst IP",
    "src_port": "src-port",
    "dst_port": "dst_port",
    "protocol": "Protocol",
    "service": "service",
    "action": "action",
    "duration": "duration",
    "sent_bytes": "sent_bytes",
    "received_bytes": "received_bytes",
    "sent_pkts": "sent_pkts",
    "received_pkts": "received_pkts",
}


def firewall_log(spark: SparkSession, folder: str) -> DataFrame:
    """The flows as a firewall export: vendor header, all values text."""
    return flows(spark, folder).select(
        "source_file", "source_row",
        *[F.col(c).cast("string").alias(header) for c, header in FIREWALL_HEADER.items()],
        F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.concat(F.lit("row-"), F.col("source_row")).alias("flow id"),
        F.col("attack_cat").alias("Label"),
    )


def cic_log(spark: SparkSession, folder: str) -> DataFrame:
    """The flows as a flow-meter export: microseconds, flags, undirected totals."""
    row = F.col("source_row")
    return flows(spark, folder).select(
        "source_file", "source_row",
        F.col("src_ip").alias("Source IP"),
        F.col("dst_ip").alias("Destination IP"),
        (F.col("duration") * 1e6).alias("Flow Duration"),
        F.col("sent_pkts").alias("Total Fwd Packets"),
        F.col("received_pkts").alias("Total Backward Packets"),
        (F.col("sent_bytes") + F.col("received_bytes")).alias("Total Bytes"),
        F.col("sent_bytes").alias("Total Length of Fwd Packets"),
        (F.col("duration") * 1000.0).alias("Fwd IAT Mean"),
        (F.col("duration") * 500.0).alias("Bwd IAT Mean"),
        (row % 2).alias("SYN Flag Count"),
        (row % 3).alias("ACK Flag Count"),
        F.when(row % 7 == 0, 1).otherwise(0).alias("FIN Flag Count"),
        F.when(row % 11 == 0, 1).otherwise(0).alias("RST Flag Count"),
    )


@query(
    "normalize_map",
    with_views(
        "SELECT source_row, src_ip AS srcip, dst_ip AS dstip, CAST(src_port AS STRING) AS sport,"
        " CAST(dst_port AS STRING) AS dsport, protocol AS proto, service, action AS state,"
        " CAST(sent_pkts AS STRING) AS spkts, CAST(received_pkts AS STRING) AS dpkts,"
        " CAST(sent_bytes AS STRING) AS sbytes, CAST(received_bytes AS STRING) AS dbytes,"
        " strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS stime, attack_cat AS label FROM flows_v"
    ),
)
def normalize_map(spark: SparkSession, folder: str) -> DataFrame:
    raw = normalize.clean_header(firewall_log(spark, folder))
    plan = normalize.plan_header(raw.columns, own=("source_file", "source_row"))
    return normalize.map_columns(raw, plan, KEEP).drop("dur")


_FW = f"""SELECT source_row, src_ip AS srcip, dst_ip AS dstip, CAST(src_port AS DOUBLE) AS sport,
 CAST(dst_port AS DOUBLE) AS dsport, protocol AS proto, service, action AS state, {r6('duration')} AS dur,
 CAST(sent_bytes AS DOUBLE) AS sbytes, CAST(received_bytes AS DOUBLE) AS dbytes,
 CAST(sent_pkts AS DOUBLE) AS spkts, CAST(received_pkts AS DOUBLE) AS dpkts,
 {r6('sent_bytes * 8E0 / greatest(duration, 1E-6)')} AS sload,
 {r6('received_bytes * 8E0 / greatest(duration, 1E-6)')} AS dload,
 {r6('sent_bytes / (sent_pkts + 1E-8)')} AS smeansz,
 {r6('received_bytes / (received_pkts + 1E-8)')} AS dmeansz,
 {r6('greatest(duration, 1E-6) / greatest(sent_pkts, 1E0)')} AS sintpkt,
 {r6('greatest(duration, 1E-6) / greatest(received_pkts, 1E0)')} AS dintpkt,
 0E0 AS sttl, 0E0 AS dttl, 0E0 AS sloss, 0E0 AS dloss, 0E0 AS tcprtt, 0E0 AS synack, 0E0 AS ackdat,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip, service) AS DOUBLE) AS ct_srv_src,
 CAST(count(*) OVER (PARTITION BY source_file, dst_ip, service) AS DOUBLE) AS ct_srv_dst,
 CAST(count(*) OVER (PARTITION BY source_file, dst_ip) AS DOUBLE) AS ct_dst_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip) AS DOUBLE) AS ct_src_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip, dst_port) AS DOUBLE) AS ct_src_dport_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, dst_ip, src_port) AS DOUBLE) AS ct_dst_sport_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip, dst_ip) AS DOUBLE) AS ct_dst_src_ltm,
 0E0 AS stime, CAST(0 AS BIGINT) AS label, source_file FROM flows_v"""


@query("normalize_flows", with_views(_FW))
def normalize_flows(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize_flows(firewall_log(spark, folder), keep=KEEP)[0]


_CIC_STATE = (
    "CASE WHEN source_row % 11 = 0 THEN 'RST' WHEN source_row % 7 = 0 THEN 'FIN'"
    " WHEN source_row % 2 > 0 AND source_row % 3 > 0 THEN 'CON' WHEN source_row % 2 > 0 THEN 'SYN' ELSE 'CON' END"
)


@query(
    "normalize_cic",
    with_views(
        f"""SELECT source_row, {r6('duration * 1E6 / 1E6')} AS dur, CAST(sent_bytes AS DOUBLE) AS sbytes,
 CAST(received_bytes AS DOUBLE) AS dbytes, CAST(sent_pkts AS DOUBLE) AS spkts,
 CAST(received_pkts AS DOUBLE) AS dpkts, {r6('duration * 1E3 / 1E6')} AS sintpkt,
 {r6('duration * 500E0 / 1E6')} AS dintpkt, {_CIC_STATE} AS state, 'tcp' AS proto, 'unknown' AS service
 FROM flows_v"""
    ),
)
def normalize_cic(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = normalize.normalize_flows(cic_log(spark, folder), keep=KEEP, counts=False)
    return out.select(
        "source_row", "dur", "sbytes", "dbytes", "spkts", "dpkts", "sintpkt", "dintpkt", "state", "proto", "service"
    )


@query(
    "type_coercion",
    with_views(
        f"""SELECT source_row, CASE WHEN service = '-' THEN '-' ELSE service END AS service,
 coalesce(nullif(trim(CASE WHEN source_row % 9 = 0 THEN '  ' ELSE action END), ''), 'unknown') AS state,
 CASE WHEN source_row % 8 = 0 THEN 0E0 WHEN source_row % 6 = 0 THEN 0E0 ELSE {r6('duration')} END AS dur,
 CASE WHEN source_row % 3 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS label FROM flows_v"""
    ),
)
def type_coercion(spark: SparkSession, folder: str) -> DataFrame:
    row = F.col("source_row")
    dirty = flows(spark, folder).select(
        "source_row",
        F.concat(F.lit(" "), "service", F.lit(" ")).alias("service"),
        F.when(row % 9 == 0, F.lit("  ")).otherwise(F.col("action")).alias("state"),
        F.when(row % 8 == 0, F.lit("n/a")).when(row % 6 == 0, F.lit("NaN")).otherwise(F.col("duration").cast("string")).alias("dur"),
        F.when(row % 3 == 0, F.lit("1")).otherwise(F.lit("DoS")).alias("label"),
    )
    return normalize.coerce_types(dirty, ["service", "state", "dur", "label"])


@query(
    "schema_defaults",
    with_views(
        "SELECT source_row, src_ip AS srcip, 'tcp' AS proto, 'unknown' AS service, 'UNK' AS state, 0E0 AS sbytes,"
        " 0E0 AS dbytes, 0E0 AS spkts, 0E0 AS dpkts, 0E0 AS dur FROM flows_v"
    ),
)
def schema_defaults(spark: SparkSession, folder: str) -> DataFrame:
    bare = flows(spark, folder).select("source_file", "source_row", "src_ip")
    out, _ = normalize.normalize_flows(bare, keep=KEEP, counts=False)
    return out.select("source_row", "srcip", *vocab.DEFAULTS)


@query(
    "derive_duration",
    with_views(
        f"""SELECT source_row, {r6('''raw / CASE WHEN quantile_cont(raw, 0.5) OVER (PARTITION BY source_file) > 100000
 THEN 1E6 WHEN quantile_cont(raw, 0.5) OVER (PARTITION BY source_file) > 1000 THEN 1E3 ELSE 1E0 END''')} AS dur
 FROM unit_v""",
        (
            "unit_v",
            "SELECT source_row, source_file, duration * CASE WHEN substr(source_file, 12, 2) < '11' THEN 1E0"
            " WHEN substr(source_file, 12, 2) < '21' THEN 1E3 ELSE 1E6 END AS raw FROM flows_v",
        ),
    ),
)
def derive_duration(spark: SparkSession, folder: str) -> DataFrame:
    day = F.substring("source_file", 12, 2)
    factor = F.when(day < "11", F.lit(1.0)).when(day < "21", F.lit(1e3)).otherwise(F.lit(1e6))
    raw = flows(spark, folder).select("source_file", "source_row", (F.col("duration") * factor).alias("duration"))
    return normalize.normalize_flows(raw, keep=KEEP, counts=False)[0].select("source_row", "dur")


@query(
    "duration_from_times",
    with_views(f"SELECT source_row, {r6('round(duration, 3)')} AS dur FROM flows_v"),
)
def duration_from_times(spark: SparkSession, folder: str) -> DataFrame:
    millis = F.round(F.col("duration") * 1000).cast("long")
    raw = flows(spark, folder).select(
        "source_file", "source_row",
        F.lit("2024-01-01 00:00:00").alias("start_time"),
        F.date_format(
            F.timestamp_millis(F.lit(1704067200000) + millis), "yyyy-MM-dd HH:mm:ss.SSS"
        ).alias("end_time"),
    )
    return normalize.normalize_flows(raw, keep=KEEP, counts=False)[0].select("source_row", "dur")


@query(
    "directional_totals",
    with_views(
        """SELECT source_row, CAST(sent_bytes AS DOUBLE) AS sbytes, CAST(received_bytes AS DOUBLE) AS dbytes,
 ceil((sent_pkts + received_pkts) * 0.5E0) AS spkts, floor((sent_pkts + received_pkts) * 0.5E0) AS dpkts FROM flows_v"""
    ),
)
def directional_totals(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).select(
        "source_file", "source_row", "sent_bytes",
        (F.col("sent_bytes") + F.col("received_bytes")).alias("total_bytes"),
        (F.col("sent_pkts") + F.col("received_pkts")).alias("packets"),
    )
    out = normalize.normalize_flows(raw, keep=KEEP, counts=False)[0]
    return out.select("source_row", "sbytes", "dbytes", "spkts", "dpkts")


@query(
    "flow_rates",
    with_views(
        f"""SELECT source_row, {r6('sent_bytes * 8E0 / greatest(duration, 1E-6)')} AS sload,
 {r6('received_bytes / (received_pkts + 1E-8)')} AS dmeansz,
 {r6('greatest(duration, 1E-6) / greatest(sent_pkts, 1E0)')} AS sintpkt FROM flows_v"""
    ),
)
def flow_rates(spark: SparkSession, folder: str) -> DataFrame:
    return flows(spark, folder).select(
        "source_row",
        flow_fn.bits_per_second(F.col("sent_bytes").cast("double"), F.col("duration")).alias("sload"),
        flow_fn.mean_size(F.col("received_bytes").cast("double"), F.col("received_pkts")).alias("dmeansz"),
        flow_fn.packet_gap(F.col("sent_pkts").cast("double"), F.col("duration")).alias("sintpkt"),
    )


@query("tcp_state", with_views(f"SELECT {_CIC_STATE} AS state, count(*) AS n FROM flows_v GROUP BY 1"))
def tcp_state(spark: SparkSession, folder: str) -> DataFrame:
    log = normalize.clean_header(cic_log(spark, folder))
    flags = {f: F.col(f"{f}_flag_count") for f in ("syn", "fin", "rst", "ack")}
    return log.groupBy(flow_fn.tcp_state(**flags).alias("state")).agg(F.count(F.lit(1)).alias("n"))


_COUNTS = """SELECT source_row, CAST(count(*) OVER (PARTITION BY source_file, src_ip, service) AS DOUBLE) AS ct_srv_src,
 CAST(count(*) OVER (PARTITION BY source_file, dst_ip, service) AS DOUBLE) AS ct_srv_dst,
 CAST(count(*) OVER (PARTITION BY source_file, dst_ip) AS DOUBLE) AS ct_dst_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip) AS DOUBLE) AS ct_src_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip, dst_port) AS DOUBLE) AS ct_src_dport_ltm,
 1E0 AS ct_dst_sport_ltm,
 CAST(count(*) OVER (PARTITION BY source_file, src_ip, dst_ip) AS DOUBLE) AS ct_dst_src_ltm FROM nulls_v"""


@query(
    "context_counts",
    with_views(
        _COUNTS,
        (
            "nulls_v",
            "SELECT source_row, source_file, src_ip, dst_ip, dst_port,"
            " CASE WHEN service = '-' THEN NULL ELSE service END AS service FROM flows_v",
        ),
    ),
)
def context_counts(spark: SparkSession, folder: str) -> DataFrame:
    df = flows(spark, folder).select(
        "source_file", "source_row", F.col("src_ip").alias("srcip"), F.col("dst_ip").alias("dstip"),
        F.col("dst_port").alias("dsport"), F.nullif(F.col("service"), F.lit("-")).alias("service"),
    )
    out = normalize.context_counts(df, list(vocab.CONTEXT_COUNTS))
    return out.select("source_row", *vocab.CONTEXT_COUNTS)


@query(
    "normalization_report",
    with_views(
        """SELECT source_file, 'firewall_or_flow_csv' AS schema, count(*) AS rows, CAST(15 AS BIGINT) AS input_columns,
 CAST(34 AS BIGINT) AS output_columns, CAST(14 AS BIGINT) AS mapped, '' AS missing,
 'ackdat|ct_dst_ltm|ct_dst_sport_ltm|ct_dst_src_ltm|ct_src_dport_ltm|ct_src_ltm|ct_srv_dst|ct_srv_src|dintpkt|dload|dloss|dmeansz|dttl|sintpkt|sload|sloss|smeansz|sttl|synack|tcprtt' AS derived,
 1E0 AS feature_coverage, 0.32E0 AS mapped_coverage FROM flows_v GROUP BY source_file"""
    ),
)
def normalization_report(spark: SparkSession, folder: str) -> DataFrame:
    raw = normalize.clean_header(firewall_log(spark, folder))
    plan = normalize.plan_header(raw.columns, own=("source_file", "source_row"))
    report = normalize.normalization_report(raw, plan)
    return report.select(
        "source_file", "schema", "rows", "input_columns", "output_columns",
        F.size(F.map_keys("mapped_columns")).alias("mapped"),
        F.col("missing_core_features").alias("missing"), F.col("derived_columns").alias("derived"),
        "feature_coverage", "mapped_coverage",
    )


@query(
    "normalization_quality",
    with_views(
        """SELECT source_file, count(*) AS rows, 'GOOD' AS level,
 'Normalization quality: GOOD (coverage 84.0%, mapped columns 2).' AS message,
 'Missing timing/TCP fields: dintpkt, sintpkt|Few source columns were mapped; verify CSV schema manually.' AS warnings
 FROM flows_v GROUP BY source_file"""
    ),
)
def normalization_quality(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).select("source_file", "source_row", "src_ip", "dst_ip")
    plan = normalize.plan_header(raw.columns, own=("source_file", "source_row"))
    report = normalize.normalization_report(raw, plan)
    return quality.normalization_quality(report).select("source_file", "rows", "level", "message", "warnings")


@query(
    "missing_features",
    with_views(
        """SELECT source_file, f.feature AS feature, count(*) AS rows FROM flows_v,
 (VALUES ('dload'), ('dintpkt'), ('sintpkt'), ('sload')) AS f(feature) GROUP BY ALL"""
    ),
)
def missing_features(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).select("source_file", "source_row", "src_ip", "dst_ip", "service", "duration")
    plan = normalize.plan_header(raw.columns, own=("source_file", "source_row"))
    report = normalize.normalization_report(raw, plan)
    return report.select("source_file", "rows", F.explode("missing_core_features").alias("feature"))


@query(
    "detect_schema",
    with_views(
        """SELECT family, count(*) AS rows FROM (SELECT source_row, unnest(['cic_ids2017', 'firewall_or_flow_csv',
 'zeek_conn', 'generic_csv']) AS family FROM flows_v) GROUP BY family"""
    ),
)
def detect_schema(spark: SparkSession, folder: str) -> DataFrame:
    base = flows(spark, folder)
    zeek = base.select("source_file", "source_row", F.col("src_ip").alias("id.orig_h"), F.col("dst_ip").alias("id.resp_h"))
    bare = base.select("source_file", "source_row", "duration")
    parts = []
    for log in (cic_log(spark, folder), firewall_log(spark, folder), zeek, bare):
        header = [vocab.clean_name(c) for c in log.columns if c not in ("source_file", "source_row")]
        parts.append(log.select(F.lit(vocab.detect_schema(header)).alias("family")))
    return normalize.union_logs(parts).groupBy("family").agg(F.count(F.lit(1)).alias("rows"))


_PROD = f"""SELECT strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time, 'firewall' AS source, source_file, source_row,
 concat('row-', CAST(source_row AS STRING)) AS flow_id, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port,
 CAST(dst_port AS BIGINT) AS dst_port, protocol, service, action AS state, {r6('duration')} AS duration,
 CAST(sent_bytes AS DOUBLE) AS sbytes, CAST(received_bytes AS DOUBLE) AS dbytes, CAST(sent_pkts AS DOUBLE) AS spkts,
 CAST(received_pkts AS DOUBLE) AS dpkts, {r6('sent_bytes * 8E0 / greatest(duration, 1E-6)')} AS sload,
 {r6('received_bytes * 8E0 / greatest(duration, 1E-6)')} AS dload, 0E0 AS sttl, 0E0 AS dttl, 0E0 AS sloss, 0E0 AS dloss,
 {r6('greatest(duration, 1E-6) / greatest(sent_pkts, 1E0)')} AS sintpkt,
 {r6('greatest(duration, 1E-6) / greatest(received_pkts, 1E0)')} AS dintpkt, 0E0 AS tcprtt, 0E0 AS synack, 0E0 AS ackdat,
 attack_cat AS dataset_label, attack_cat AS attack_category,
 CASE WHEN attack_cat = 'Normal' THEN 'normal' ELSE 'known_attack' END AS analyst_label, '' AS split FROM flows_v"""


@query("production_flows", with_views(_PROD))
def production_flows(spark: SparkSession, folder: str) -> DataFrame:
    return production.production_flows(firewall_log(spark, folder), source="firewall")


def _label_rows(spark: SparkSession, folder: str) -> DataFrame:
    return flows(spark, folder).select(
        "source_row", F.concat(F.lit("row-"), "source_row").alias("flow_id"),
        labels.attack_category(F.col("attack_cat")).alias("attack_category"),
        labels.default_analyst_label(F.col("attack_cat")).alias("analyst_label"),
    )


def review_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as an analyst's review log: several verdicts per customer number."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("source_row"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", F.lit("False-Positive"))
        .when(F.col("o_orderstatus") == "O", F.lit(" suspicious"))
        .otherwise(F.lit(""))
        .alias("analyst_label"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Needs review")).alias("attack_category"),
    )


@query(
    "label_override",
    with_views(
        """SELECT f.source_row, concat('row-', CAST(f.source_row AS STRING)) AS flow_id,
 coalesce(o.cat, f.attack_cat) AS attack_category,
 coalesce(o.label, CASE WHEN f.attack_cat = 'Normal' THEN 'normal' ELSE 'known_attack' END) AS analyst_label
 FROM flows_v f LEFT JOIN (SELECT o_custkey AS k,
 arg_max(CASE o_orderstatus WHEN 'F' THEN 'false_positive' WHEN 'O' THEN 'suspicious' ELSE 'unknown' END, o_orderkey) AS label,
 arg_max_null(CASE WHEN o_orderpriority = '1-URGENT' THEN 'Needs review' END, o_orderkey) AS cat
 FROM orders GROUP BY 1) o ON f.source_row = o.k"""
    ),
)
def label_override(spark: SparkSession, folder: str) -> DataFrame:
    return production.apply_label_overrides(
        _label_rows(spark, folder), review_overrides(spark, folder), key="source_row"
    )


_SPLIT = """SELECT source_row, event_ts, CASE WHEN rn <= round_even(n * 0.7E0, 0) THEN 'train'
 WHEN rn <= round_even(n * (0.7E0 + 0.15E0), 0) THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT source_row, event_ts, row_number() OVER (ORDER BY event_ts, source_row) AS rn, count(*) OVER () AS n FROM cut_v)"""
# truncated to the minute, so that several flows share an instant
_CUT = ("cut_v", "SELECT source_row, date_trunc('minute', event_ts) AS event_ts FROM flows_v")


@query("time_split", with_views(f"SELECT source_row, split FROM ({_SPLIT})", _CUT))
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    df = flows(spark, folder).select("source_row", F.date_trunc("minute", "event_ts").alias("event_ts"))
    return production.time_split(df, time_col="event_ts").select("source_row", "split")


@query(
    "production_summary",
    with_views(
        f"""SELECT s.split, 'firewall' AS source, p.analyst_label, count(*) AS rows, min(p.event_time) AS first_time,
 max(p.event_time) AS last_time FROM ({_PROD}) p JOIN ({_SPLIT}) s USING (source_row) GROUP BY ALL""",
        ("cut_v", "SELECT source_row, date_trunc('second', event_ts) AS event_ts FROM flows_v"),
    ),
)
def production_summary(spark: SparkSession, folder: str) -> DataFrame:
    flows_table = production.production_flows(firewall_log(spark, folder), source="firewall")
    return production.production_summary(production.time_split(flows_table))


@query(
    "label_rollup",
    with_views(
        f"""SELECT source, split, analyst_label, count(*) AS rows FROM (SELECT 'firewall' AS source, s.split, p.analyst_label
 FROM ({_PROD}) p JOIN ({_SPLIT}) s USING (source_row)) GROUP BY ROLLUP (source, split, analyst_label)""",
        ("cut_v", "SELECT source_row, date_trunc('second', event_ts) AS event_ts FROM flows_v"),
    ),
)
def label_rollup(spark: SparkSession, folder: str) -> DataFrame:
    flows_table = production.production_flows(firewall_log(spark, folder), source="firewall")
    return production.label_rollup(production.time_split(flows_table))


@query(
    "value_counts",
    with_views(
        """SELECT 'service' AS field, service AS value, count(*) AS rows FROM flows_v GROUP BY ALL UNION ALL
 SELECT 'attack_cat', attack_cat, count(*) FROM flows_v GROUP BY ALL UNION ALL
 SELECT 'protocol', protocol, count(*) FROM flows_v GROUP BY ALL"""
    ),
)
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return production.value_counts(flows(spark, folder), ["service", "attack_cat", "protocol"])


@query(
    "prefix_reference",
    with_views(
        """SELECT in_reference, count(*) AS rows, min(source_row) AS first_row, max(source_row) AS last_row FROM (
 SELECT source_row, row_number() OVER (ORDER BY source_row) <= greatest(1, least(count(*) OVER () - 1,
 round_even(count(*) OVER () * 0.7E0, 0))) AS in_reference FROM flows_v) GROUP BY in_reference"""
    ),
)
def prefix_reference(spark: SparkSession, folder: str) -> DataFrame:
    marked = production.prefix_reference(flows(spark, folder).select("source_row"), 0.7, "source_row")
    return marked.groupBy("in_reference").agg(
        F.count(F.lit(1)).alias("rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row")
    )


@query(
    "event_time_parse",
    with_views(
        """SELECT source_row, CASE source_row % 5 WHEN 4 THEN NULL ELSE strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ') END
 AS event_time FROM flows_v"""
    ),
)
def event_time_parse(spark: SparkSession, folder: str) -> DataFrame:
    ts, kind = F.col("event_ts"), F.col("source_row") % 5
    raw = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 2, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .when(kind == 3, F.unix_timestamp(ts.cast("timestamp")).cast("string"))
        .otherwise(F.lit("not a time"))
    )
    return flows(spark, folder).select("source_row", iso_z(parse_event_time(raw)).alias("event_time"))


@query(
    "rows_per_file",
    with_views(
        """SELECT source_file, source_row FROM (SELECT source_file, source_row,
 row_number() OVER (PARTITION BY source_file ORDER BY source_row) AS rn FROM flows_v) WHERE rn <= 100"""
    ),
)
def rows_per_file(spark: SparkSession, folder: str) -> DataFrame:
    from flowsieve.sources.csv import cap_rows_per_file

    return cap_rows_per_file(flows(spark, folder), 100).select("source_file", "source_row")


@query(
    "union_headers",
    with_views(
        "SELECT source_row, src_ip AS srcip, service, CAST(NULL AS DOUBLE) AS dur FROM flows_v UNION ALL"
        f" SELECT source_row, NULL, service, {r6('duration')} FROM flows_v"
    ),
)
def union_headers(spark: SparkSession, folder: str) -> DataFrame:
    base = flows(spark, folder)
    first = base.select("source_row", F.col("src_ip").alias("srcip"), "service")
    second = base.select("source_row", "service", F.col("duration").alias("dur"))
    return normalize.union_logs([first, second])


@query(
    "input_guard",
    with_views(
        """SELECT * FROM (SELECT 'error' AS severity, concat('CSV has too many rows for dashboard batch inference: ',
 CAST(count(*) AS STRING), ' > 500') AS finding, count(*) > 500 AS hit FROM flows_v
 UNION ALL SELECT 'error', 'CSV contains duplicate column names: src_ip', count(*) > 0 FROM flows_v
 UNION ALL SELECT 'error', 'CSV has too many columns: 5 > 4', true
 UNION ALL SELECT 'warning', 'CSV contains unnamed/index-like columns: Unnamed: 0', true
 UNION ALL SELECT 'warning', 'Large CSV upload; dashboard analysis may take time on CPU.', count(*) > 50000 FROM flows_v)
 WHERE hit""".replace("SELECT * FROM (", "SELECT severity, finding FROM (")
    ),
)
def input_guard(spark: SparkSession, folder: str) -> DataFrame:
    header = ["Unnamed: 0", "src_ip", "src_ip", "dst_ip", "duration"]
    policy = quality.InputPolicy(max_rows=500, max_columns=4)
    return quality.input_guard(flows(spark, folder), header, size_bytes=10, policy=policy)


@query(
    "feature_contract",
    with_views(
        """SELECT 'duration' AS feature, 'ok' AS status, 1E0 AS finite_share UNION ALL
 SELECT 'gap', 'non_finite', round(avg(CASE WHEN received_pkts > 0 THEN 1E0 ELSE 0E0 END), 6) FROM flows_v UNION ALL
 SELECT 'sent_pkts', 'duplicate', 1E0 UNION ALL SELECT 'absent', 'missing', NULL UNION ALL SELECT '', 'empty_name', NULL"""
    ),
)
def feature_contract(spark: SparkSession, folder: str) -> DataFrame:
    gap = F.when(F.col("received_pkts") > 0, F.col("duration") / F.col("received_pkts")).otherwise(F.lit(float("inf")))
    df = flows(spark, folder).withColumn("gap", gap)
    return quality.feature_contract(df, ["duration", "gap", "sent_pkts", "sent_pkts", "absent", " "])


@query("label_column", with_views("SELECT 'attack_cat' AS label_column, attack_cat AS label, count(*) AS rows FROM flows_v GROUP BY 2"))
def label_column(spark: SparkSession, folder: str) -> DataFrame:
    df = flows(spark, folder).withColumnRenamed("attack_cat", "Attack_Cat")
    chosen = quality.choose_column(df.columns, quality.LABEL_COLUMNS)
    return df.groupBy(F.lit(chosen.lower()).alias("label_column"), F.col(chosen).alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )
