"""Sinks, profiles, CSV provenance and the preprocessing chain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import vocab
from flowsieve.functions.times import parse_wall_time
from flowsieve.operators import alerts as alert_op
from flowsieve.operators import evaluate, preprocess, production, thresholds
from flowsieve.plans.base import alerts, flows, judged, query, r6, scores, with_views
from flowsieve.plans.flow_queries import _SPLIT, firewall_log
from flowsieve.plans.score_queries import risk_sql
from flowsieve.session import work_dir
from flowsieve.sources import csv, sinks


def scratch(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/flowsieve/{label}-{uuid.uuid4().hex}"


@query(
    "production_sink",
    with_views(
        f"SELECT s.split, count(*) AS rows, sum(sent_bytes)::DOUBLE AS sbytes FROM flows_v JOIN ({_SPLIT}) s USING (source_row) GROUP BY 1",
        ("cut_v", "SELECT source_row, date_trunc('second', event_ts) AS event_ts FROM flows_v"),
    ),
)
def production_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Write the split production table, then read every set back on its own."""
    path = scratch(spark, "production")
    table = production.time_split(production.production_flows(firewall_log(spark, folder), source="firewall"))
    sinks.write_production_flows(table, path)
    parts = [sinks.read_split(spark, path, s) for s in production.SPLITS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("sbytes").alias("sbytes"))


@query(
    "score_sink",
    with_views("SELECT predicted_class, is_zeroday, count(*) AS rows FROM judged_v GROUP BY ALL"),
)
def score_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "scores")
    sinks.write_scores(judged(spark, folder).drop("event_ts"), path, "csv")
    back = spark.read.option("header", "true").csv(path)
    return back.groupBy("predicted_class", F.col("is_zeroday").cast("boolean").alias("is_zeroday")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "json_report",
    with_views(
        f"""SELECT count(*) AS rows, count(*) FILTER (WHERE is_zeroday) AS zero_day_count, {r6('avg(CAST(is_zeroday AS DOUBLE))')} AS zero_day_rate,
 (SELECT count(DISTINCT classifier_class) FROM judged_v) AS classes FROM judged_v"""
    ),
)
def json_report(spark: SparkSession, folder: str) -> DataFrame:
    df = judged(spark, folder)
    path = scratch(spark, "report")
    classes = df.groupBy("classifier_class").agg(F.count(F.lit(1)).alias("rows"))
    sinks.write_report(sinks.report_json(summary=evaluate.zero_day_summary(df), classes=classes), path)
    schema = (
        "version int, summary array<struct<rows: long, zero_day_count: long, zero_day_rate: double>>,"
        " classes array<struct<classifier_class: string, rows: long>>"
    )
    doc = spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    return doc.select(F.get("d.summary", F.lit(0)).alias("s"), F.size("d.classes").alias("classes")).select(
        "s.*", "classes"
    )


@query(
    "threshold_profile",
    with_views(
        " UNION ALL ".join(
            f"""SELECT 'site' AS profile, 'vote' AS decision_mode, '{c}' AS score, {r6(f"(SELECT quantile_cont({c}, 0.95) FROM scores_v WHERE attack_cat = 'Normal')")} AS threshold,
 count(*) AS reference_rows FROM scores_v WHERE attack_cat = 'Normal'"""
            for c in ("hybrid", "ae_re", "softmax")
        )
    ),
)
def threshold_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of a profile are saved; loading gives the newer one."""
    path, df = scratch(spark, "profile"), scores(spark, folder)
    for fpr, stamp in ((0.01, "2024-01-01"), (0.05, "2024-02-01")):
        found = thresholds.calibrate(df, target_fpr=fpr, label_col="attack_cat")
        sinks.save_profile(found, path, "site", fpr, created_at=F.lit(stamp).cast("timestamp"))
    return sinks.load_profile(spark, path, "site").select(
        "profile", "decision_mode", "score", "threshold", "reference_rows"
    )


@query("csv_provenance", with_views("SELECT count(*) AS rows, true AS numbered, count(DISTINCT source_row) AS flows FROM flows_v"))
def csv_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Flows written as CSV files and read back with file and row number."""
    path = scratch(spark, "csv")
    names = ["flow", "src_ip", "service", "sent_bytes"]
    flows(spark, folder).select(
        F.col("source_row").alias("flow"), "src_ip", "service", "sent_bytes"
    ).repartition(4, "flow").write.option("header", "true").csv(path)
    rows = csv.number_rows(csv.read_text_csv(spark, [path], names, header=True))
    per_file = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source_row").alias("numbers"),
        F.min("source_row").alias("low"), F.max("source_row").alias("high"), F.countDistinct("flow").alias("flows"),
    )
    dense = (F.col("low") == 0) & (F.col("high") == F.col("rows") - 1) & (F.col("numbers") == F.col("rows"))
    return per_file.agg(
        F.sum("rows").alias("rows"), F.min(dense).alias("numbered"), F.sum("flows").alias("flows")
    )


def _named(spark: SparkSession, path: str, name: str) -> None:
    """Give the files that Spark wrote to a folder names of the usual pattern."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, found in enumerate(files.listStatus(root)):
        if found.getPath().getName().startswith("part-"):
            files.rename(found.getPath(), hadoop.Path(root, f"{name}_{k}.csv"))


def _written(spark: SparkSession, path: str) -> DataFrame:
    """The files a query wrote below its scratch folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    return files.load(path).select("path")


def _write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Text files of the column ``value``, each with the same first line; one at least, if there are no lines."""
    if lines.isEmpty():
        lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.text(path)
        return
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.when(first, F.concat_ws("\n", F.lit(header), "value")).otherwise(F.col("value"))
    lines.select(line.alias("value")).write.text(path)


# Flow columns the CSV queries fill; the rest of a headerless line is 0.
_RAW = {
    "srcip": "src_ip", "dstip": "dst_ip", "sport": "src_port", "dsport": "dst_port", "proto": "protocol", "dur": "duration",
    "sbytes": "sent_bytes", "service": "service", "attack_cat": "attack_cat",
}
_PER_CLASS = """SELECT attack_cat, count(*) AS rows, count(DISTINCT src_ip) AS sources, CAST(sum(sent_bytes) AS DOUBLE) AS sbytes
 FROM flows_v GROUP BY attack_cat"""


def _per_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("attack_cat").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("srcip").alias("sources"), F.sum(F.col("sbytes").cast("double")).alias("sbytes")
    )


def _headerless(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    names = [c for c in vocab.RAW_FLOW_COLUMNS if c not in drop]
    return df.select(*[(F.col(_RAW[c]) if c in _RAW else F.lit(0)).alias(c) for c in names])


@query("csv_folder", with_views(_PER_CLASS))
def csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with three kinds of file, found by their names: with a header, headerless, and headerless without times."""
    path, df = scratch(spark, "csv-folder"), flows(spark, folder)
    part = F.col("source_row") % 3
    with_names = df.where(part == 0).select(*[F.col(v).alias(k.upper() if k == "attack_cat" else k) for k, v in _RAW.items()])
    with_names.write.option("header", "true").csv(f"{path}/a")
    _headerless(df.where(part == 1)).write.csv(f"{path}/b")
    _headerless(df.where(part == 2), ("stime", "ltime")).write.csv(f"{path}/c")
    # files of other names, and the feature list, are no flows
    df.select("src_ip").write.csv(f"{path}/d")
    df.limit(5).select("src_ip").coalesce(1).write.csv(f"{path}/e")
    for name, kind in (("a", "UNSW_flows"), ("b", "set-nb15"), ("c", "UNSW-NB15_part"), ("e", "other")):
        _named(spark, f"{path}/{name}", kind)
    return _per_class(csv.load_flow_csvs(spark, path))


@query("csv_headerless", with_views("SELECT service, count(*) AS rows, min(sent_bytes) AS low, max(sent_bytes) AS high FROM flows_v GROUP BY service"))
def csv_headerless(spark: SparkSession, folder: str) -> DataFrame:
    """Positional names for files without a header."""
    path = scratch(spark, "csv-headerless")
    _headerless(flows(spark, folder).repartition(4, "source_row")).write.csv(path)
    rows = csv.load_flow_csvs(spark, path, _written(spark, path))
    sbytes = F.col("sbytes").cast("long")
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("rows"), F.min(sbytes).alias("low"), F.max(sbytes).alias("high"))


@query("csv_latin1", with_views("SELECT concat('café-', service) AS service, count(*) AS rows FROM flows_v GROUP BY service"))
def csv_latin1(spark: SparkSession, folder: str) -> DataFrame:
    """Headerless files in Latin-1."""
    path = scratch(spark, "csv-latin1")
    named = flows(spark, folder).withColumn("service", F.concat(F.lit("café-"), "service"))
    _headerless(named).write.option("encoding", "ISO-8859-1").csv(path)
    rows = csv.load_flow_csvs(spark, path, _written(spark, path))
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("rows"))


@query("csv_encoding_fallback", with_views("SELECT concat('café-', service) AS service, count(*) AS rows, count(DISTINCT source_row) AS numbers FROM flows_v GROUP BY service"))
def csv_encoding_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """One folder in UTF-8 and one in Latin-1; each is read in the encoding it turns out to have."""
    path, names = scratch(spark, "csv-fallback"), ["flow", "service"]
    df = flows(spark, folder).select(F.col("source_row").alias("flow"), F.concat(F.lit("café-"), "service").alias("service"))
    for k, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        df.where(F.col("flow") % 2 == k).write.option("header", "true").option("encoding", encoding).csv(f"{path}/{k}")
    rows = csv.read_with_fallback(spark, f"{path}/0", names).unionByName(csv.read_with_fallback(spark, f"{path}/1", names))
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("flow").alias("numbers"))


@query("csv_wide_header", with_views(_PER_CLASS))
def csv_wide_header(spark: SparkSession, folder: str) -> DataFrame:
    """A header line of well over 64 KB."""
    path = scratch(spark, "csv-wide")
    extra = [f"an_extra_column_with_a_rather_long_name_{k}" for k in range(2000)]
    line = F.concat_ws(",", *[F.col(v).cast("string") for v in _RAW.values()], F.lit(",".join(["0"] * len(extra))))
    _write_lines(flows(spark, folder).select(line.alias("value")), ",".join([*_RAW, *extra]), path)
    wanted = ["attack_cat", "srcip", "sbytes"]
    return _per_class(csv.load_flow_csvs(spark, path, _written(spark, path), wanted))


@query("csv_quoted_header", with_views("SELECT attack_cat, protocol, count(*) AS rows FROM flows_v GROUP BY ALL"))
def csv_quoted_header(spark: SparkSession, folder: str) -> DataFrame:
    """A header whose first name holds a comma."""
    path = scratch(spark, "csv-quoted")
    line = F.concat_ws(",", F.col("duration").cast("string"), "protocol", "attack_cat")
    _write_lines(flows(spark, folder).select(line.alias("value")), '"dur, sec",proto,attack_cat', path)
    rows = csv.load_flow_csvs(spark, path, _written(spark, path)).where(F.col("dur,_sec").cast("double").isNotNull())
    return rows.groupBy("attack_cat", F.col("proto").alias("protocol")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "alert_time_parse",
    with_views(
        """SELECT alert_id, strftime(date_trunc('second', event_ts), '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM alerts_v"""
    ),
)
def alert_time_parse(spark: SparkSession, folder: str) -> DataFrame:
    ts, kind = F.col("event_ts"), F.col("source_row") % 4
    raw = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+07:00'"))
        .when(kind == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 2, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return alerts(spark, folder).select("alert_id", parse_wall_time(raw).alias("event_time"))


@query(
    "alert_risk",
    with_views(f"SELECT alert_id, CASE WHEN source_row % 3 = 0 THEN CAST(trunc(ae_score * 100E0) AS BIGINT) ELSE {risk_sql('severity')} END AS risk FROM alerts_v"),
)
def alert_risk(spark: SparkSession, folder: str) -> DataFrame:
    stored = F.when(F.col("source_row") % 3 == 0, F.col("ae_score") * 100.0)
    df = alerts(spark, folder).withColumn("risk", stored)
    return df.select("alert_id", alert_op.alert_risk(df).alias("risk"))


@query(
    "score_label_join",
    with_views(
        """SELECT attack_cat, predicted_class, count(*) AS rows FROM judged_v GROUP BY ALL"""
    ),
)
def score_label_join(spark: SparkSession, folder: str) -> DataFrame:
    bare = judged(spark, folder).select("source_row", "predicted_class")
    labels = flows(spark, folder).select("source_row", "attack_cat")
    joined = preprocess.scored_with_labels(bare, labels)
    return joined.groupBy("attack_cat", "predicted_class").agg(F.count(F.lit(1)).alias("rows"))


_SERVICE_CODES = {"service": {"http": 0, "https": 1, "pay": 2, "unk": 9}, "proto": {"tcp": 6, "udp": 17, "unk": -1}}


@query(
    "preprocess",
    with_views(
        f"""SELECT source_row, {r6('duration')} AS dur, CASE protocol WHEN 'tcp' THEN 6E0 WHEN 'udp' THEN 17E0 ELSE -1E0 END AS proto_num,
 CASE service WHEN 'http' THEN 0E0 WHEN 'https' THEN 1E0 WHEN 'pay' THEN 2E0 ELSE 9E0 END AS service_num,
 {r6('sent_bytes / (sent_bytes + received_bytes + 1E-8)')} AS bytes_ratio, 0E0 AS missing_feature FROM flows_v"""
    ),
)
def preprocess_rows(spark: SparkSession, folder: str) -> DataFrame:
    names = ["dur", "proto_num", "service_num", "bytes_ratio", "missing_feature"]
    normalizer = preprocess.flow_normalizer(names, keep=("source_row",), counts=False)
    aligned, _ = preprocess.preprocess(
        firewall_log(spark, folder), names, _SERVICE_CODES, normalizer, keep=["source_row"]
    )
    return aligned

