"""Streaming jobs run over the events table, and file manifests of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.scoring import Decision, HybridWeights
from flowsieve.operators import alerts as alert_op
from flowsieve.plans.alert_queries import _INCIDENT_VIEWS
from flowsieve.plans.base import ALERT_COLUMNS, FLOW_COLUMNS, SCORE_COLUMNS, _list, query, r6, table, with_views
from flowsieve.plans.score_queries import risk_sql
from flowsieve.session import durable, work_dir
from flowsieve.sources import alert_log, manifest
from flowsieve.streaming import events as ev
from flowsieve.streaming import jobs
from flowsieve.streaming.scorer import LinearScorer


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table, one file or a folder of files, read as a stream."""
    schema = table(spark, folder, "events").schema
    # a pattern, because the source takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")


SCORER = LinearScorer(
    features=["log_sbytes", "bytes_ratio", "log_total_pkts", "dur"],
    classes=["Normal", "DoS", "Exploits"],
    weights=[[-0.4, 0.8, 0.1, -0.05], [0.3, -0.2, 0.4, 0.02], [0.1, 0.1, -0.5, 0.04]],
    intercepts=[2.0, -1.0, 0.25],
    directions=[[0.6, 0.0, 0.8, 0.0]],
    centers=[7.0, 0.7, 3.0, 5.0],
    scaler={"log_sbytes": (1.0, 2.0), "dur": (2.0, 4.0)},
    hybrid=HybridWeights(ae_re=0.3, softmax=2.0, intercept=-3.0),
    decision=Decision(hybrid=0.9, ae_re=8.0, softmax=0.4, mode="vote", min_votes=2),
)
_X = (
    "x_v",
    """SELECT source_row, (ln(1 + sent_bytes) - 1) / 2E0 AS x1, sent_bytes / (sent_bytes + received_bytes + 1E-8) AS x2,
 ln(1 + sent_pkts + received_pkts + 1E-8) AS x3, least((duration - 2) / 4E0, 10E0) AS x4 FROM flows_v""",
)
_Z = (
    "z_v",
    "SELECT *, "
    + ", ".join(
        f"{w[0]}E0 * x1 + {w[1]}E0 * x2 + {w[2]}E0 * x3 + {w[3]}E0 * x4 + {b}E0 AS z{i}"
        for i, (w, b) in enumerate(zip(SCORER.weights, SCORER.intercepts, strict=True))
    )
    + ", (pow(x1 - 7, 2) + pow(x2 - 0.7E0, 2) + pow(x3 - 3, 2) + pow(x4 - 5, 2)"
    " - pow(0.6E0 * (x1 - 7) + 0.8E0 * (x3 - 3), 2)) / 4E0 AS ae_re FROM x_v",
)
_P = (
    "p_v",
    "SELECT *, exp(greatest(z0, z1, z2)) / (exp(z0) + exp(z1) + exp(z2)) AS max_prob, CASE greatest(z0, z1, z2) WHEN z0 THEN 'Normal'"
    " WHEN z1 THEN 'DoS' ELSE 'Exploits' END AS classifier_class FROM z_v",
)
_H = (
    "h_v",
    "SELECT *, 1 / (1 + exp(-(-3 + 0.3E0 * ae_re + 2E0 * (1 - max_prob)))) AS hybrid_score FROM p_v",
)
_J = (
    "j_v",
    "SELECT *, ae_re AS ae_score, (CAST(hybrid_score > 0.9E0 AS INT) + CAST(ae_re > 8E0 AS INT) + CAST(1 - max_prob > 0.4E0 AS INT)) >= 2 AS is_zeroday FROM h_v",
)


_SCORED = with_views(
        f"""SELECT source_row, CASE WHEN is_zeroday THEN 'Zero-Day Candidate' WHEN classifier_class = 'Normal' THEN 'Normal'
 ELSE 'Known-Attack' END AS label, classifier_class, {r6('max_prob')} AS confidence, {r6('ae_re')} AS ae_re,
 {r6('hybrid_score')} AS hybrid_score, is_zeroday AS is_anomaly, 'vote_2_of_3' AS zero_day_rule,
 CASE WHEN is_zeroday THEN {risk_sql("'HIGH'")} ELSE {risk_sql("'LOW'")} END AS risk, 'firewall_or_flow_csv' AS schema,
 'GOOD' AS quality, 1E0 AS feature_coverage, CAST(12 AS BIGINT) AS mapped_columns FROM j_v""",
        _X, _Z, _P, _H, _J,
    )


@query("stream_scoring", _SCORED)
def stream_scoring(spark: SparkSession, folder: str) -> DataFrame:
    flow = event_stream(spark, folder).selectExpr(*_list(FLOW_COLUMNS))
    names = [c for c in FLOW_COLUMNS if c not in ("source_row", "event_ts", "source_file", "attack_cat")]
    as_json = flow.select("source_row", F.to_json(F.struct(*names)).alias("value"))
    return jobs.run_available(ev.score_events(as_json, SCORER, ["source_row"]), "stream-scoring")


@query("stream_json_scoring", _SCORED)
def stream_json_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of JSON in a folder, two files in each trigger."""
    names = [c for c in FLOW_COLUMNS if c not in ("event_ts", "source_file", "attack_cat")]
    path = f"{work_dir(spark)}/flowsieve/json-events-{uuid.uuid4().hex}"
    table(spark, folder, "events").selectExpr(*_list(FLOW_COLUMNS)).repartition(6, "source_row").select(*names).write.json(path)
    lines = jobs.read_json_events(spark, path, max_files=2)
    lines = lines.select(F.get_json_object("value", "$.source_row").cast("long").alias("source_row"), "value")
    return jobs.run_available(ev.score_events(lines, SCORER, ["source_row"]), "stream-json")


@query(
    "stream_context_counts",
    with_views(
        """SELECT strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
 strftime(date_trunc('hour', event_ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, src_ip, service, count(*) AS rows
 FROM flows_v WHERE date_trunc('hour', event_ts) + INTERVAL 1 HOUR <= (SELECT max(event_ts) FROM flows_v) - INTERVAL 10 MINUTE GROUP BY ALL"""
    ),
)
def stream_context_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts; windows the watermark has not closed yet are not emitted."""
    flow = event_stream(spark, folder).selectExpr(*_list(FLOW_COLUMNS)).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    return jobs.run_available(
        jobs.windowed_counts(flow, ["src_ip", "service"], "event_ts", "1 hour", "10 minutes"), "stream-counts"
    )


# Events as they arrive: file k holds what was seen up to a moment, each row up to ten minutes late.
_ARRIVAL_MICROS = "(unix_micros(CAST(event_ts AS TIMESTAMP)) + (source_row * 7919) % 600 * 1000000)"
_ARRIVAL_SQL = "(epoch_us(event_ts) + (source_row * 7919) % 600 * 1000000)"
SLICE = 6 * 86_400 * 1_000_000  # of arrival time in one file


def arriving(rows: DataFrame, label: str, slot: Column, slots: Iterable[int]) -> DataFrame:
    """A stream of files in the order of ``slot``, one in each trigger."""
    spark, path = rows.sparkSession, f"{work_dir(rows.sparkSession)}/flowsieve/{label}-{uuid.uuid4().hex}"
    stored = durable(rows.withColumn("_slot", slot), label)
    for k in slots:
        # files are taken in the order they were written; rows within one are shuffled
        part = stored.where(F.col("_slot") == k).drop("_slot")
        part.repartition(1, F.lit(0)).sortWithinPartitions(F.xxhash64("row_id")).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _slots(spark: SparkSession, folder: str, length: int) -> tuple[int, int]:
    """First and last slot: two numbers of the events' time range."""
    ends = table(spark, folder, "events").select(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b")).first()
    return ends["a"] // length, (ends["b"] + 600_000_000) // length


@query(
    "stream_adaptive_threshold",
    with_views(
        f"""SELECT row_id, entity, CASE WHEN h = 0 THEN NULL ELSE {r6('t')} END AS threshold, h > 0 AND ae_re > t AS exceeds FROM (
 SELECT row_id, entity, event_ts, ae_re, count(*) FILTER (WHERE attack_cat = 'Normal') OVER w AS h,
 (SELECT quantile_cont(x, 0.95) FROM (SELECT unnest(list_slice(hist, -25, -1)) AS x)) AS t FROM (
 SELECT row_id, entity, life, event_ts, ae_re, attack_cat, coalesce(list(ae_re) FILTER (WHERE attack_cat = 'Normal') OVER
 (PARTITION BY entity, life ORDER BY event_ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS hist FROM lives_v)
 WINDOW w AS (PARTITION BY entity, life ORDER BY event_ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 WHERE epoch_ms(event_ts) < (SELECT max(epoch_ms(event_ts)) FROM scores_v) - 600000""",
        (
            "lives_v",
            """SELECT *, sum(CAST(quiet > INTERVAL 36 HOUR AS INT)) OVER (PARTITION BY entity ORDER BY event_ts, row_id) AS life FROM (
 SELECT source_row AS row_id, src_ip AS entity, event_ts, ae_re, attack_cat, coalesce(event_ts - lag(event_ts) OVER (
 PARTITION BY src_ip ORDER BY event_ts, source_row), INTERVAL 0 HOUR) AS quiet FROM scores_v)""",
        ),
    ),
)
def stream_adaptive_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Several files with rows out of order; an address that is silent for 36 hours starts anew."""
    rows = table(spark, folder, "events").selectExpr(*_list(SCORE_COLUMNS)).select(
        F.col("src_ip").alias("entity"), F.col("event_ts").cast("timestamp").alias("event_ts"),
        F.col("source_row").alias("row_id"), F.col("ae_re").alias("score"), (F.col("attack_cat") == "Normal").alias("benign"),
    )
    slot = F.expr(f"{_ARRIVAL_MICROS.replace('source_row', 'row_id')} div {SLICE}")
    first, last = _slots(spark, folder, SLICE)
    stream = arriving(rows, "stream-scores", slot, range(first, last + 1))
    return jobs.run_available(jobs.adaptive_thresholds(stream, window=25, ttl_minutes=36 * 60), "stream-adaptive")


# Every 13th event comes two files later than it should.
_LATE_SLOT = f"{{arrival}} {{div}} {SLICE} + CASE WHEN {{row}} % 13 = 0 THEN 2 ELSE 0 END"


@query(
    "stream_late_rows",
    with_views(
        """SELECT key, kind, window_start, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT service AS key, epoch_us(w) AS window_start, count(*) AS n,
 CASE WHEN epoch_ms(w) + 3600000 <= mark THEN 'late' ELSE 'closed' END AS kind FROM seen_v
 WHERE epoch_ms(w) + 3600000 <= mark OR epoch_ms(w) + 3600000 <= (SELECT max(epoch_ms(event_ts)) FROM flows_v) - 600000 GROUP BY ALL) GROUP BY ALL""",
        ("slot_v", "SELECT service, event_ts, date_trunc('hour', event_ts) AS w, " + _LATE_SLOT.format(arrival=_ARRIVAL_SQL, div="//", row="source_row") + " AS slot FROM flows_v"),
        (
            "mark_v",
            """SELECT slot, coalesce(max(upto) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000, 0) AS mark
 FROM (SELECT slot, max(epoch_ms(event_ts)) AS upto FROM slot_v GROUP BY slot)""",
        ),
        ("seen_v", "SELECT slot_v.*, mark FROM slot_v JOIN mark_v USING (slot)"),
    ),
)
def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts per service, and the rows that came after their hour was closed."""
    rows = table(spark, folder, "events").selectExpr(*_list(FLOW_COLUMNS)).select(
        "service", F.col("event_ts").cast("timestamp").alias("event_ts"), F.col("source_row").alias("row_id")
    )
    slot = F.expr(_LATE_SLOT.format(arrival=_ARRIVAL_MICROS.replace("source_row", "row_id"), div="div", row="row_id"))
    first, last = _slots(spark, folder, SLICE)
    stream = arriving(rows, "stream-flows", slot, range(first, last + 3))
    counted = jobs.run_available(jobs.windows_with_late_rows(stream, "service", "event_ts", 60, "10 minutes"), "stream-late")
    return counted.groupBy("key", "kind", "window_start").agg(F.sum("rows").alias("rows"))


@query(
    "stream_incidents",
    with_views(
        """SELECT group_type, key, epoch_us(s) AS start, max(epoch_us(event_ts)) AS last, count(*) AS alert_count,
 count(*) FILTER (WHERE is_zeroday) AS ood_count, max(risk) AS max_risk FROM members_v GROUP BY group_type, key, s HAVING count(*) >= 2
 AND s + INTERVAL 15 MINUTE < (SELECT max(event_ts) FROM alerts_v) - INTERVAL 10 MINUTE""",
        *_INCIDENT_VIEWS, recursive=True,
    ),
)
def stream_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters that the watermark has passed."""
    scored = event_stream(spark, folder).selectExpr(*_list(SCORE_COLUMNS)).where("hybrid > 0.9E0")
    live = scored.selectExpr(*_list(ALERT_COLUMNS)).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    live = live.withColumn("_risk", alert_op.alert_risk(live))
    pairs = alert_op.correlation_pairs(live, ["event_ts", "is_zeroday", "_risk"], skip=("Batch File",))
    rows = pairs.select(
        "group_type", "key", "event_ts", F.unix_micros("event_ts").alias("t"),
        F.col("is_zeroday").cast("int").alias("ood"), F.col("_risk").alias("risk"),
    )
    return jobs.run_available(jobs.anchored_incidents(rows), "stream-incidents")


_STREAM_STATE = """SELECT concat('A-', CAST(user_id AS STRING)) AS alert_id, arg_max(event_type, (ts, event_id)) AS status,
 concat('note ', CAST(min(event_id) AS STRING)) AS analyst_note, 2 * count(*) + 1 AS events FROM events GROUP BY user_id"""


@query("stream_alert_log", _STREAM_STATE)
def stream_alert_log(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts saved directly, then updated by two streams with checkpoints of their own, all in one log."""
    log = event_stream(spark, folder).select(
        F.concat(F.lit("A-"), F.col("user_id")).alias("alert_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_id").alias("seq"), F.lit("status_updated").alias("event_type"), F.col("event_type").alias("status"),
    )
    base = f"{work_dir(spark)}/flowsieve/alert-log-{uuid.uuid4().hex}"
    first = table(spark, folder, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min("ts").cast("timestamp").alias("at"))
    saved = first.select(
        F.concat(F.lit("A-"), F.col("user_id")).alias("alert_id"), (F.col("at") - F.expr("INTERVAL 1 DAY")).alias("created_at"),
        F.col("event_id").alias("seq"), F.lit("saved").alias("event_type"), F.lit("new").alias("status"),
        F.concat(F.lit("note "), F.col("event_id")).alias("analyst_note"),
    )
    alert_log.append_events(saved, f"{base}/log")
    for k in range(2):
        jobs.append_alert_log(log, f"{base}/log", f"{base}/checkpoint-{k}").awaitTermination()
    state = alert_op.alert_state(alert_log.read_events(spark, f"{base}/log"))
    return state.select("alert_id", "status", "analyst_note", "events")


EXPORT_ROWS = 1_000  # ids in one exported file
_EXPORTED = (
    "exported",
    f"""SELECT event_id // {EXPORT_ROWS} AS bucket, string_agg(concat(event_id, '|', user_id, '|', event_type, chr(10)), '' ORDER BY event_id) AS body
 FROM events GROUP BY 1""",
)


def _export(events: DataFrame, path: str) -> DataFrame:
    """Events as text files of consecutive ids, one folder for each; returns their manifest by folder."""
    lines = events.select(
        F.floor(F.col("event_id") / EXPORT_ROWS).alias("bucket"), "event_id", F.concat_ws("|", "event_id", "user_id", "event_type").alias("value")
    )
    laid = lines.repartition("bucket").sortWithinPartitions("bucket", "event_id").drop("event_id")
    laid.write.partitionBy("bucket").text(path)
    built = manifest.build_manifest(events.sparkSession, path, "*.txt")
    # the writer names the only file of a folder at random
    return built.withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))


@query(
    "manifest_build",
    with_views(
        """SELECT concat('bucket=', bucket) AS path, true AS "exists", CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256 FROM exported""",
        _EXPORTED,
    ),
)
def manifest_build(spark: SparkSession, folder: str) -> DataFrame:
    """The whole event table exported to files, and the manifest of those files."""
    return _export(table(spark, folder, "events"), f"{work_dir(spark)}/flowsieve/export-{uuid.uuid4().hex}")


@query(
    "manifest_verify",
    with_views(
        """SELECT severity, concat(message, ': bucket=', bucket) AS finding, concat('bucket=', bucket) AS path
 FROM (SELECT DISTINCT bucket FROM exported) JOIN (VALUES (0, 'error', 'Artifact missing'),
 (1, 'warning', 'Artifact exists but manifest expected missing'), (2, 'error', 'Artifact size changed'), (2, 'error', 'Artifact sha256 changed'),
 (3, 'error', 'Artifact sha256 changed')) AS v(kind, severity, message) ON bucket % 5 = kind""",
        _EXPORTED,
    ),
)
def manifest_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Two exports of the event table: the manifest of the first against the files of the second.

    By number, a file of the second export is gone, was expected missing, has longer
    lines, has lines of the same length that read otherwise, or is the same.
    """
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    base = f"{work_dir(spark)}/flowsieve/export-{uuid.uuid4().hex}"
    kind = F.floor(F.col("event_id") / EXPORT_ROWS) % 5
    number = F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long")
    expected = _export(events, f"{base}/first").withColumn("exists", number % 5 != 1)
    changed = F.when(kind == 2, F.concat("event_type", F.lit("+"))).when(kind == 3, F.upper("event_type")).otherwise(F.col("event_type"))
    actual = _export(events.where(kind != 0).withColumn("event_type", changed), f"{base}/second")
    return manifest.verify_manifest(actual, expected)
