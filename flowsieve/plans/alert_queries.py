"""Alerts, the queue, correlation, incidents, techniques, triage text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import text as text_fn
from flowsieve.operators import alerts as alert_op
from flowsieve.operators import incidents as incident_op
from flowsieve.operators import techniques
from flowsieve.plans.base import alerts, flows, judged, query, r6, table, with_views
from flowsieve.plans.prepare_queries import FEATURE_INPUT, feature_input
from flowsieve.plans.score_queries import risk_sql
from flowsieve.session import work_dir
from flowsieve.sources import alert_log

STAMP = "2024-02-01 00:00:00"
PAD = "CASE WHEN length(CAST(source_row AS STRING)) >= 6 THEN CAST(source_row AS STRING) ELSE lpad(CAST(source_row AS STRING), 6, '0') END"
RISK = risk_sql("severity")


@query(
    "alert_record",
    with_views(
        f"""SELECT concat('ZD-', {PAD}) AS alert_id, '2024-02-01 00:00:00' AS timestamp, source_row, {r6('hybrid')} AS hybrid_score,
 {r6('ae_re')} AS ae_score, {r6('max_prob')} AS max_prob, predicted_class, classifier_class, attack_cat AS zero_day_family, is_zeroday
 FROM judged_v"""
    ),
)
def alert_record(spark: SparkSession, folder: str) -> DataFrame:
    df = judged(spark, folder).select(
        "source_row", "hybrid_score", "ae_score", "max_prob", "classifier_class",
        F.col("attack_cat").alias("zero_day_family"), "is_zeroday",
    )
    return alert_op.alert_records(df, F.lit(STAMP))


_WORST = "is_zeroday DESC, hybrid DESC, ae_re DESC, max_prob, source_row"


@query(
    "top_alerts",
    with_views(
        f"""SELECT concat('BATCH-abcdef12-', {PAD}) AS alert_id, predicted_class, {r6('hybrid')} AS hybrid_score
 FROM judged_v ORDER BY {_WORST} LIMIT 25"""
    ),
)
def top_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.top_alerts(judged(spark, folder), 25, "abcdef123456", F.lit(STAMP)).select(
        "alert_id", "predicted_class", "hybrid_score"
    )


@query(
    "top_alerts_per_file",
    with_views(
        f"""SELECT concat('BATCH-', left(md5(source_file), 8), '-', {PAD}) AS alert_id, predicted_class, source_row FROM (
 SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {_WORST}) AS rn FROM judged_v) WHERE rn <= 10"""
    ),
)
def top_alerts_per_file(spark: SparkSession, folder: str) -> DataFrame:
    df = judged(spark, folder).withColumn("source_file_hash", F.md5("source_file"))
    return alert_op.top_alerts_per_file(df, 10, "source_file_hash", F.lit(STAMP)).select("alert_id", "predicted_class", "source_row")


@query(
    "alert_entities",
    with_views(
        f"""SELECT concat('BATCH-abcdef12-', {PAD}) AS alert_id, f.src_ip, f.dst_ip, CAST(f.src_port AS STRING) AS src_port,
 CAST(f.dst_port AS STRING) AS dst_port, f.protocol, CASE WHEN f.service = '-' THEN '' ELSE f.service END AS service
 FROM (SELECT * FROM judged_v ORDER BY {_WORST} LIMIT 100) j JOIN flows_v f USING (source_row)"""
    ),
)
def alert_entities(spark: SparkSession, folder: str) -> DataFrame:
    worst = alert_op.top_alerts(judged(spark, folder), 100, "abcdef123456", F.lit(STAMP))
    return alert_op.attach_entities(worst, flows(spark, folder)).select("alert_id", *alert_op.ENTITY_NAMES)


@query(
    "entity_extraction",
    with_views(
        """SELECT source_row, src_ip, '' AS dst_ip, '' AS src_port, CAST(dst_port AS STRING) AS dst_port, '' AS protocol,
 CASE WHEN service = '-' THEN 'fallback' ELSE service END AS service FROM flows_v"""
    ),
)
def entity_extraction(spark: SparkSession, folder: str) -> DataFrame:
    raw = flows(spark, folder).select(
        "source_row", F.col("src_ip").alias("id.orig_h"), F.lit("nan").alias("dst_ip"),
        F.col("dst_port").alias("Destination.Port"), "service", F.lit("fallback").alias("app"),
    )
    return alert_op.entities(raw, ["source_row"])


@query(
    "queue_filter",
    with_views(
        """SELECT alert_id, status, severity, is_zeroday FROM alerts_v WHERE status = 'triaged' AND severity = 'HIGH'
 AND is_zeroday AND contains(lower(concat_ws(' ', alert_id, predicted_class, classifier_class, status, '', zero_day_family, '')), 'fuzz')"""
    ),
)
def queue_filter(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.queue_filter(alerts(spark, folder), "triaged", "high", "OOD only", " FUZZ ").select(
        "alert_id", "status", "severity", "is_zeroday"
    )


@query(
    "ood_log",
    with_views(
        f"""SELECT source_row, predicted_class AS detection, {risk_sql("'HIGH'", 'hybrid', 'ae_re')} AS risk, {r6('hybrid')} AS hybrid_score
 FROM judged_v WHERE is_zeroday AND classifier_class = 'DoS' AND hybrid >= 0.5E0"""
    ),
)
def ood_log(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.detection_log(judged(spark, folder), classifier_class="DoS", min_hybrid=0.5).select(
        "source_row", "detection", "risk", "hybrid_score"
    )


@query(
    "ood_enrichment",
    with_views(
        f"""SELECT source_row, predicted_class AS detection, CASE WHEN is_zeroday THEN {risk_sql("'HIGH'", 'hybrid', 'ae_re')}
 ELSE {risk_sql("'MEDIUM'", 'hybrid', 'ae_re')} END AS risk FROM judged_v"""
    ),
)
def ood_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.enrich_ood(judged(spark, folder)).select("source_row", "detection", "risk")


@query(
    "queue_table",
    with_views(
        f"""SELECT alert_id, timestamp AS time, status, 'session' AS source, severity, {risk_sql('severity', '(hybrid_score + 1E-10)', '(ae_score + 1E-10)')} AS risk, predicted_class AS class,
 round(round(hybrid_score + 1E-10, 3) + 1E-10, 6) + 0E0 AS hybrid_score, round(round(ae_score + 1E-10, 3) + 1E-10, 6) + 0E0 AS ae_score,
 CASE WHEN is_zeroday THEN 'YES' ELSE 'NO' END AS ood_candidate FROM alerts_v"""
    ),
)
def queue_table(spark: SparkSession, folder: str) -> DataFrame:
    # shifted like every compared number, so that exact halves round alike
    df = alerts(spark, folder).withColumns(
        {"hybrid_score": F.col("hybrid_score") + 1e-10, "ae_score": F.col("ae_score") + 1e-10}
    )
    return alert_op.queue_table(df)


@query(
    "queue_summary",
    with_views(
        f"""SELECT count(*) AS alerts, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS critical_high,
 count(*) FILTER (WHERE is_zeroday) AS ood, CAST(trunc(avg({RISK})) AS BIGINT) AS average_risk FROM alerts_v"""
    ),
)
def queue_summary(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.queue_summary(alerts(spark, folder))


@query(
    "severity_mix",
    with_views("SELECT severity, CASE WHEN is_zeroday THEN 'YES' ELSE 'NO' END AS ood_candidate, count(*) AS rows FROM alerts_v GROUP BY ALL"),
)
def severity_mix(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.severity_mix(alerts(spark, folder))


# An append-only log: every event touches the alert of its user. What a saved event says of its alert:
_SAVED = {
    "event_timestamp": "CAST(event_id AS STRING)",
    "source": "CASE WHEN event_id % 2 = 0 THEN 'batch' ELSE 'single' END",
    "severity": "CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END",
    "risk": "event_id % 101",
    "predicted_class": "event_type",
    "classifier_class": "concat('c-', event_type)",
    "is_zeroday": "event_id % 5 = 0",
    "hybrid_score": "value / 500E0",
    "ae_score": "value / 250E0",
    "max_prob": "CAST(event_id % 1000 AS DOUBLE) / 1000E0",
    "alert_json": "concat('{\"n\":', CAST(event_id AS STRING), '}')",
    "llm_json": "CASE WHEN event_id % 4 = 0 THEN concat('{\"m\":', CAST(event_id AS STRING), '}') END",
}


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    saved = "event_id % 3 <> 0"
    return table(spark, folder, "events").selectExpr(
        "concat('A-', user_id) AS alert_id",
        "date_trunc('hour', ts) AS created_at",
        "event_id AS seq",
        f"CASE WHEN {saved} THEN 'saved' ELSE 'status_updated' END AS event_type",
        "event_type AS status",
        "concat('note ', event_id) AS analyst_note",
        *[f"CASE WHEN {saved} THEN {expr} END AS {name}" for name, expr in _SAVED.items()],
    )


_LATEST = "arg_max({}, (date_trunc('hour', ts), event_id))"
_KEPT = "arg_max({" + ", ".join(f"'{n}': {e}" for n, e in _SAVED.items()) + "}, (date_trunc('hour', ts), event_id)) FILTER (WHERE event_id % 3 <> 0)"
_STATE = f"""SELECT alert_id, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
 status, analyst_note, {', '.join(f'{r6(f"k.{n}")} AS {n}' if n in ('hybrid_score', 'ae_score', 'max_prob') else f'k.{n} AS {n}' for n in _SAVED)}, events
 FROM (SELECT concat('A-', CAST(user_id AS STRING)) AS alert_id, min(date_trunc('hour', ts)) AS first, max(date_trunc('hour', ts)) AS last,
 {_LATEST.format('event_type')} AS status, {_LATEST.format("concat('note ', CAST(event_id AS STRING))")} AS analyst_note, {_KEPT} AS k,
 count(*) AS events FROM events GROUP BY user_id)"""


@query("alert_state", _STATE)
def alert_state(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.alert_state(event_log(spark, folder))


@query("list_alerts", f"SELECT * FROM ({_STATE}) WHERE status = 'view' ORDER BY updated_at DESC, alert_id LIMIT 200")
def list_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.list_alerts(alert_op.alert_state(event_log(spark, folder)), 200, "view")


@query(
    "status_rejects",
    with_views(
        """SELECT concat('A-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS alert_id, concat('alert not found: A-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS reason
 FROM orders WHERE concat('A-', lpad(CAST(o_orderkey AS STRING), 6, '0')) NOT IN (SELECT alert_id FROM alerts_v)"""
    ),
)
def status_rejects(spark: SparkSession, folder: str) -> DataFrame:
    updates = table(spark, folder, "orders").select(
        F.concat(F.lit("A-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("alert_id")
    )
    return alert_op.rejected_updates(updates, alerts(spark, folder))


@query(
    "status_events",
    """SELECT concat('A-', CAST(o_orderkey AS STRING)) AS alert_id, o_orderkey AS seq, 'status_updated' AS event_type,
 o_orderstatus AS status, o_orderpriority AS analyst_note,
 concat('{"analyst_note":"', o_orderpriority, '","status":"', o_orderstatus, '"}') AS payload_json FROM orders""",
)
def status_events(spark: SparkSession, folder: str) -> DataFrame:
    updates = table(spark, folder, "orders").select(
        F.concat(F.lit("A-"), F.col("o_orderkey")).alias("alert_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("analyst_note"), "o_orderkey", "o_orderdate",
    )
    return alert_op.status_events(updates, F.col("o_orderdate"), F.col("o_orderkey")).drop("created_at")


_CLOSED = "source_row % 3 = 0"
_NOTED = "source_row % 6 = 0"


@query(
    "alert_status_flow",
    with_views(
        f"""SELECT alert_id, CASE WHEN {_CLOSED} THEN 'closed' ELSE status END AS status, CASE WHEN {_NOTED} THEN 'seen' ELSE '' END AS analyst_note,
 severity, is_zeroday, {r6('hybrid_score')} AS hybrid_score, strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
 strftime(event_ts + CASE WHEN {_CLOSED} THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S.%f') AS updated_at,
 CASE WHEN {_CLOSED} THEN 2 ELSE 1 END AS events FROM alerts_v"""
    ),
)
def alert_status_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts are saved, a third of them is closed, half of those with a note; the log gives the state back."""
    rows, path = alerts(spark, folder), f"{work_dir(spark)}/flowsieve/alert-status-{uuid.uuid4().hex}"
    at = F.col("event_ts").cast("timestamp")
    alert_log.append_events(alert_op.saved_events(rows, at, F.col("source_row")), path)
    closed = rows.where(_CLOSED).select(
        "alert_id", "event_ts", "source_row", F.lit("closed").alias("status"), F.when(F.expr(_NOTED), "seen").alias("analyst_note")
    )
    later = at + F.expr("INTERVAL 2 HOURS")
    alert_log.append_events(alert_op.status_events(closed, later, F.col("source_row")), path)
    state = alert_op.alert_state(alert_log.read_events(spark, path))
    return state.select(
        "alert_id", "status", "analyst_note", "severity", "is_zeroday", "hybrid_score", "created_at", "updated_at", "events"
    )


_FIELDS = alert_op.GROUP_FIELDS
_BLANK = "('', 'normal', 'nan', 'none', 'null', '-', 'unknown')"


def _pairs_sql(skip: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS group_type, {c} AS key, * FROM risky_v WHERE lower({c}) NOT IN {_BLANK}"
        for name, c in _FIELDS.items()
        if name != skip
    )


_RISKY = ("risky_v", f"SELECT *, {RISK} AS risk FROM alerts_v")


@query(
    "correlate_alerts",
    with_views(
        f"""SELECT group_type, key, count(*) AS alert_count, count(*) FILTER (WHERE is_zeroday) AS ood_count, max(risk) AS max_risk,
 max(timestamp) AS latest_time, array_to_string(list_slice(list(alert_id ORDER BY alert_id), 1, 10), '|') AS alert_ids
 FROM ({_pairs_sql()}) GROUP BY group_type, key HAVING count(*) >= 2""",
        _RISKY,
    ),
)
def correlate_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.correlate(alerts(spark, folder))


# Cluster starts by following "first event after the window" from each key's first event.
_EVENTS = ("pairs_v", _pairs_sql("Batch File"))
_KEYED = ("keyed_v", "SELECT DISTINCT group_type, key, event_ts AS t FROM pairs_v")
_STARTS = (
    "starts_v",
    """SELECT group_type, key, min(t) AS s FROM keyed_v GROUP BY ALL UNION ALL
 SELECT r.group_type, r.key, (SELECT min(t) FROM keyed_v e WHERE e.group_type = r.group_type AND e.key = r.key
 AND e.t > r.s + INTERVAL 15 MINUTE) AS s FROM starts_v r WHERE r.s IS NOT NULL""",
)
_MEMBERS = (
    "members_v",
    """SELECT p.*, st.s FROM pairs_v p ASOF JOIN (SELECT * FROM starts_v WHERE s IS NOT NULL) st
 ON p.group_type = st.group_type AND p.key = st.key AND p.event_ts >= st.s""",
)


def _top_sql(column: str, name: str) -> str:
    return f"""(SELECT group_type, key, s, array_to_string(list(v ORDER BY n DESC, v), '|') AS {name} FROM (
 SELECT *, row_number() OVER (PARTITION BY group_type, key, s ORDER BY n DESC, v) AS rn FROM (
 SELECT group_type, key, s, {column} AS v, count(*) AS n FROM members_v WHERE lower({column}) NOT IN {_BLANK} GROUP BY ALL))
 WHERE rn <= 3 GROUP BY ALL)"""


_ISO = "concat(strftime({c}, '%Y-%m-%dT%H:%M:%S'), CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' ELSE concat('.', lpad(CAST(microsecond({c}) % 1000000 AS STRING), 6, '0')) END)"
_INCIDENTS = f"""SELECT concat('INC-', left(upper(sha1(concat(g.group_type, '|', g.key, '|', {_ISO.format(c='g.s')}, '|', {_ISO.format(c='g.e')}))), 10)) AS incident_id,
 g.group_type, g.key, CAST(15 AS BIGINT) AS window_minutes, strftime(g.s, '%Y-%m-%d %H:%M:%S') AS start_time,
 strftime(g.e, '%Y-%m-%d %H:%M:%S') AS end_time, round(round_even(epoch_us(g.e - g.s) / 60000000E0, 1) + 1E-10, 6) + 0E0 AS duration_minutes,
 g.alert_count, g.ood_count, g.high_count, g.max_risk,
 CASE g.rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 coalesce(a.primary_classes, '') AS primary_classes, coalesce(b.families, '') AS families,
 coalesce(c.source_ips, '') AS source_ips, coalesce(d.services, '') AS services, g.alert_ids,
 concat('Review repeated alerts for ', g.group_type, ': ', g.key, CASE WHEN coalesce(a.primary_classes, b.families) IS NULL
 THEN ' within the same time window.' ELSE concat('; dominant signal: ', array_to_string(list_slice(string_split(
 coalesce(a.primary_classes, b.families), '|'), 1, 2), ', '), '.') END) AS recommended_focus
 FROM (SELECT group_type, key, s, max(event_ts) AS e, count(*) AS alert_count, count(*) FILTER (WHERE is_zeroday) AS ood_count,
 count(*) FILTER (WHERE risk >= 70) AS high_count, max(risk) AS max_risk,
 max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rank,
 array_to_string(list_slice(list(alert_id ORDER BY event_ts, alert_id), 1, 12), '|') AS alert_ids
 FROM members_v GROUP BY group_type, key, s HAVING count(*) >= 2) g
 LEFT JOIN {_top_sql('classifier_class', 'primary_classes')} a USING (group_type, key, s)
 LEFT JOIN {_top_sql('zero_day_family', 'families')} b USING (group_type, key, s)
 LEFT JOIN {_top_sql('src_ip', 'source_ips')} c USING (group_type, key, s)
 LEFT JOIN {_top_sql('service', 'services')} d USING (group_type, key, s)"""
_INCIDENT_VIEWS = (_RISKY, _EVENTS, _KEYED, _STARTS, _MEMBERS)


@query("incidents", with_views(_INCIDENTS, *_INCIDENT_VIEWS, recursive=True))
def incidents(spark: SparkSession, folder: str) -> DataFrame:
    return incident_op.build_incidents(alerts(spark, folder))


@query(
    "incident_top_values",
    with_views(
        f"""SELECT group_type, key, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start_time, services AS top_services FROM
 {_top_sql('service', 'services')}""",
        *_INCIDENT_VIEWS, recursive=True,
    ),
)
def incident_top_values(spark: SparkSession, folder: str) -> DataFrame:
    members = incident_op.incident_members(alerts(spark, folder))
    top = incident_op.top_values(members, {"top_services": "service"})
    return top.select(
        F.col("_group_type").alias("group_type"), F.col("_key").alias("key"),
        F.timestamp_micros("_start").alias("start_time"), "top_services",
    )


def _values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows) + ")"


_CLASS_VALUES = _values([(c, i, t, conf, why) for i, (c, t, conf, why) in enumerate(techniques.CLASS_RULES)])
_FEATURE_VALUES = _values(
    [
        (f, techniques.FEATURE_SEQ + s, t, conf, why)
        for s, (features, t, conf, why) in enumerate(
            (features, t, conf, why) for features, rows in techniques.FEATURE_RULES for t, conf, why in rows
        )
        for f in features
    ]
)
_LIBRARY_VALUES = _values([(t, n, tac, "|".join(acts)) for t, n, tac, acts in techniques.TECHNIQUES])
_BY_CLASS = (
    "by_class_v",
    f"""SELECT alert_id, seq, technique_id, confidence, rationale, [concat('classifier:', classifier_class)] AS evidence
 FROM alerts_v JOIN {_CLASS_VALUES} r(rule_class, seq, technique_id, confidence, rationale) ON rule_class =
 CASE WHEN classifier_class IN ('DoS', 'Exploits', 'Reconnaissance', 'Generic') THEN classifier_class ELSE 'Generic' END
 WHERE classifier_class <> 'Normal'""",
)
# The dominant features of an alert, derived from its row.
FEATURES_EXPR = (
    "CASE source_row % 5 WHEN 0 THEN array('sbytes', 'dur', 'log_sbytes') WHEN 1 THEN array('ct_src_ltm', 'synack')"
    " WHEN 2 THEN array('proto_num') WHEN 3 THEN array('tcprtt', 'sload', 'ct_dst_ltm', 'ackdat') ELSE array('djit', 'dintpkt') END"
)
_BY_FEATURES = (
    "by_features_v",
    f"""SELECT alert_id, seq, technique_id, confidence, rationale, list(feature ORDER BY feature) AS evidence FROM (
 SELECT alert_id, unnest({FEATURES_EXPR.replace('array(', 'list_value(')}) AS feature FROM alerts_v)
 JOIN {_FEATURE_VALUES} r(feature, seq, technique_id, confidence, rationale) USING (feature) GROUP BY ALL""",
)


def _show_candidates(df: DataFrame) -> DataFrame:
    return df.select("alert_id", "seq", "technique_id", "confidence", "evidence")


@query(
    "technique_known",
    with_views("SELECT alert_id, CAST(seq AS BIGINT) AS seq, technique_id, confidence, array_to_string(evidence, '|') AS evidence FROM by_class_v", _BY_CLASS),
)
def technique_known(spark: SparkSession, folder: str) -> DataFrame:
    return _show_candidates(techniques.by_class(alerts(spark, folder)))


def _with_features(spark: SparkSession, folder: str) -> DataFrame:
    return alerts(spark, folder).withColumn("features", F.expr(FEATURES_EXPR))


@query(
    "technique_features",
    with_views("SELECT alert_id, CAST(seq AS BIGINT) AS seq, technique_id, confidence, array_to_string(evidence, '|') AS evidence FROM by_features_v", _BY_FEATURES),
)
def technique_features(spark: SparkSession, folder: str) -> DataFrame:
    return _show_candidates(techniques.by_features(_with_features(spark, folder), "features"))


_CANDIDATES = ("cand_v", "SELECT * FROM by_class_v UNION ALL SELECT f.* FROM by_features_v f JOIN alerts_v USING (alert_id) WHERE classifier_class <> 'Normal'")


def _rank_views(source: str, limit: int) -> tuple[tuple[str, str], ...]:
    return (
        (
            "kept_v",
            f"""SELECT alert_id, technique_id, arg_min(seq, (-confidence, seq)) AS kept_seq, max(confidence) AS confidence,
 arg_min(rationale, (-confidence, seq)) AS rationale, arg_min(evidence, (-confidence, seq)) AS evidence, min(seq) AS first_seq
 FROM {source} GROUP BY ALL""",
        ),
        (
            "later_v",
            f"""SELECT c.alert_id, c.technique_id, flatten(list(c.evidence)) AS later FROM {source} c JOIN kept_v k USING (alert_id, technique_id)
 WHERE c.seq > k.kept_seq GROUP BY ALL""",
        ),
        (
            "ranked_v",
            f"""SELECT * FROM (SELECT k.alert_id, k.technique_id, k.confidence, k.rationale, CASE WHEN l.later IS NULL THEN k.evidence
 ELSE list_sort(list_distinct(list_concat(k.evidence, l.later))) END AS evidence,
 row_number() OVER (PARTITION BY k.alert_id ORDER BY k.confidence DESC, k.first_seq) AS rank
 FROM kept_v k LEFT JOIN later_v l USING (alert_id, technique_id)) WHERE rank <= {limit}""",
        ),
    )


_SHOW_RANKED = f"SELECT alert_id, rank, technique_id, {r6('confidence')} AS confidence, array_to_string(evidence, '|') AS evidence FROM ranked_v"


def _known_ranked(spark: SparkSession, folder: str) -> DataFrame:
    df = _with_features(spark, folder).where("classifier_class <> 'Normal'")
    candidates = techniques.by_class(df).unionByName(techniques.by_features(df, "features"))
    return techniques.rank(candidates, 4)


@query("technique_rank", with_views(_SHOW_RANKED, _BY_CLASS, _BY_FEATURES, _CANDIDATES, *_rank_views("cand_v", 4)))
def technique_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _known_ranked(spark, folder).select("alert_id", "rank", "technique_id", "confidence", "evidence")


_ZD = (
    "zd_v",
    """SELECT f.alert_id, f.seq, f.technique_id, round(least(f.confidence + (ae_score + 1E-10) * 0.10E0, 0.92E0), 2) AS confidence, f.rationale,
 list_append(f.evidence, concat('ae_score:', printf('%.3f', ae_score + 1E-10))) AS evidence FROM by_features_v f JOIN alerts_v USING (alert_id) UNION ALL
 SELECT alert_id, 19, 'T1190', round(least(0.48E0 + (ae_score + 1E-10) * 0.15E0, 0.75E0), 2),
 'Unknown attack is safest to triage first as possible exposed-service exploitation.', [concat('ae_score:', printf('%.3f', ae_score + 1E-10))]
 FROM alerts_v WHERE source_row % 5 = 2""",
)


@query("technique_zeroday", with_views(_SHOW_RANKED, _BY_FEATURES, _ZD, *_rank_views("zd_v", 5)))
def technique_zeroday(spark: SparkSession, folder: str) -> DataFrame:
    df = _with_features(spark, folder).withColumn("ae_score", F.col("ae_score") + 1e-10)
    candidates = techniques.zero_day(df, "features")
    return techniques.rank(candidates, 5).select("alert_id", "rank", "technique_id", "confidence", "evidence")


_DESCRIBED = (
    "described_v",
    f"""SELECT r.*, l.name, l.tactic, l.actions, classifier_class FROM ranked_v r JOIN {_LIBRARY_VALUES} l(technique_id, name, tactic, actions) USING (technique_id)
 JOIN alerts_v USING (alert_id)""",
)
_OVERALL = "CASE WHEN max(confidence) >= 0.75 THEN 'HIGH' WHEN max(confidence) >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "technique_summary",
    with_views(
        f"""SELECT alert_id, classifier_class AS attack_class, 'known_attack' AS mapping_mode, arg_min(tactic, rank) AS primary_tactic, {_OVERALL} AS confidence,
 count(*) AS technique_count, concat('Attack class: ', classifier_class, chr(10), 'Mapping mode: known_attack', chr(10), 'Overall confidence: ', {_OVERALL},
 chr(10), 'Mapped MITRE ATT&CK techniques:', chr(10), string_agg(concat('- [', technique_id, '] ', name, ' | Tactic=', tactic, ' | Confidence=',
 CAST(confidence AS STRING), ' | Why=', rationale), chr(10) ORDER BY rank), chr(10), 'Note: {techniques.NOTE_KNOWN}') AS summary FROM described_v
 GROUP BY alert_id, classifier_class""",
        _BY_CLASS, _BY_FEATURES, _CANDIDATES, *_rank_views("cand_v", 4), _DESCRIBED,
    ),
)
def technique_summary(spark: SparkSession, folder: str) -> DataFrame:
    described = techniques.describe(_known_ranked(spark, folder))
    classes = alerts(spark, folder).select("alert_id", F.col("classifier_class").alias("attack_class"))
    return techniques.summarise(described, "known_attack", techniques.NOTE_KNOWN, classes).drop("checklist")


@query(
    "response_checklist",
    with_views(
        """SELECT alert_id, array_to_string(list(action ORDER BY first_at), '|') AS checklist FROM (SELECT alert_id, action, min((rank, pos)) AS first_at FROM (
 SELECT alert_id, rank, unnest(string_split(actions, '|')) AS action, unnest([1, 2]) AS pos FROM described_v) GROUP BY ALL) GROUP BY alert_id""",
        _BY_CLASS, _BY_FEATURES, _CANDIDATES, *_rank_views("cand_v", 4), _DESCRIBED,
    ),
)
def response_checklist(spark: SparkSession, folder: str) -> DataFrame:
    described = techniques.describe(_known_ranked(spark, folder))
    classes = alerts(spark, folder).select("alert_id", F.col("classifier_class").alias("attack_class"))
    return techniques.summarise(described, "known_attack", techniques.NOTE_KNOWN, classes).select("alert_id", "checklist")


@query(
    "fallback_triage",
    with_views(
        """SELECT alert_id, CASE WHEN hybrid_score > 0.6E0 THEN 'HIGH' ELSE 'MEDIUM' END AS triage_severity,
 concat(CASE WHEN is_zeroday THEN 'Zero-Day Candidate' ELSE predicted_class END, ' detected - hybrid score: ', printf('%.3f', hybrid_score + 1E-10)) AS verdict,
 concat('AE reconstruction error cao (', printf('%.3f', ae_score + 1E-10), ') cho thay traffic bat thuong. Can kiem tra thu cong.') AS attack_summary,
 'Kiem tra nguon IP|Xem xet block traffic|Escalate len Tier 2' AS recommended_actions FROM alerts_v"""
    ),
)
def fallback_triage(spark: SparkSession, folder: str) -> DataFrame:
    # shifted like every compared number, so that exact halves print alike
    hybrid, ae = F.col("hybrid_score") + 1e-10, F.col("ae_score") + 1e-10
    triage = text_fn.fallback_triage(hybrid, ae, F.col("is_zeroday"), F.col("predicted_class"))
    return alerts(spark, folder).select("alert_id", triage.alias("t")).select(
        "alert_id", F.col("t.severity").alias("triage_severity"), "t.verdict", "t.attack_summary", "t.recommended_actions"
    )


@query(
    "extract_json",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN trim(concat('plain ', replace(replace(text, '{', ''), '}', '')), e' \\t\\n\\r') ELSE concat('{"severity": "HIGH", "n": ', CAST(length(text) AS STRING), '}') END AS body,
 CASE turn % 3 WHEN 2 THEN NULL ELSE 'HIGH' END AS severity FROM conversations""",
)
def extract_json(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.translate("text", "{}`", "  ")
    said = F.regexp_replace(F.col("text"), "[{}]", "")
    payload = F.concat(F.lit('{"severity": "HIGH", "n": '), F.length("text").cast("string"), F.lit("}"))
    fence = F.lit(text_fn.FENCE)
    answer = (
        F.when(F.col("turn") % 3 == 0, F.concat(bare, F.lit("\n"), fence, F.lit("json\n"), payload, F.lit("\n"), fence, bare))
        .when(F.col("turn") % 3 == 1, F.concat(bare, F.lit(" "), payload, F.lit(" "), bare))
        .otherwise(F.concat(F.lit("plain "), said))
    )
    body = text_fn.embedded_json(answer)
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", text_fn.strip(body).alias("body"),
        F.from_json(body, "severity string, n long")["severity"].alias("severity"),
    )


@query(
    "triage_context",
    with_views(
        f"""SELECT * FROM (SELECT 'history' AS origin, alert_id, concat('Alert history | ', alert_id, ' | ', predicted_class, ' | score=', printf('%.3f', hybrid_score)) AS label
 FROM alerts_v ORDER BY timestamp DESC, alert_id DESC LIMIT 20) UNION ALL SELECT * FROM (SELECT 'batch', concat('ZD-', {PAD}),
 concat('Zero-day log | row=', CAST(source_row AS STRING), ' | ', predicted_class, ' | hybrid=', printf('%.3f', hybrid)) FROM judged_v
 ORDER BY is_zeroday DESC, hybrid DESC, ae_re DESC, source_row LIMIT 50)"""
    ),
)
def triage_context(spark: SparkSession, folder: str) -> DataFrame:
    return alert_op.triage_context(alerts(spark, folder), judged(spark, folder))


@query(
    "export_report",
    with_views(
        """SELECT alert_id, true AS has_note, false AS has_probs, predicted_class FROM alerts_v"""
    ),
)
def export_report(spark: SparkSession, folder: str) -> DataFrame:
    df = alerts(spark, folder).select(
        "alert_id", "predicted_class", F.array("max_prob", "ae_score").alias("probs")
    )
    report = F.from_json("report_json", "predicted_class string, probs array<double>, limitations_and_safety map<string,string>")
    return alert_op.export_report(df).select("alert_id", report.alias("r")).select(
        "alert_id", F.col("r.limitations_and_safety").isNotNull().alias("has_note"),
        F.col("r.probs").isNotNull().alias("has_probs"), "r.predicted_class",
    )


_SHOWN = [c for c in FEATURE_INPUT if c not in ("source_row", "attack_cat")]
_FOUND = [c for c in (
    *[p for p in alert_op.PRIORITY_FEATURES if p in _SHOWN], *[c for c in _SHOWN if c not in alert_op.PRIORITY_FEATURES]
) if "pkt" in c]


@query(
    "feature_rows",
    with_views(
        " UNION ALL ".join(
            f"SELECT source_row, CAST({i} AS BIGINT) AS position, '{c}' AS metric, {r6(c)} AS value FROM input_v"
            for i, c in enumerate(_FOUND)
        ),
        ("input_v", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FEATURE_INPUT.items()) + " FROM flows_v"),
    ),
)
def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = alert_op.feature_rows(feature_input(spark, folder), ["source_row"], _SHOWN, search="PKT")
    return rows.withColumn("value", F.col("value").cast("double"))

