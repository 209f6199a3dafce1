"""Alert records, the queue, the event log and correlation groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.core import meaningful, ref, text
from flowsieve.functions.scoring import risk_score, verdict
from flowsieve.sources import alert_log

# Raw names tried per entity, first meaningful value wins.
ENTITY_NAMES = {
    "src_ip": ("srcip", "src_ip", "source_ip", "source.address", "sourceip", "id.orig_h"),
    "dst_ip": ("dstip", "dst_ip", "destination_ip", "dest_ip", "destination.address", "id.resp_h"),
    "src_port": ("sport", "src_port", "source_port", "source.port", "id.orig_p"),
    "dst_port": ("dsport", "dst_port", "destination_port", "dest_port", "destination.port", "id.resp_p"),
    "protocol": ("proto", "protocol", "transport", "network.transport"),
    "service": ("service", "app_proto", "application", "app", "protocol_name"),
}
# How alerts are grouped.
GROUP_FIELDS = {
    "Source IP": "src_ip",
    "Destination IP": "dst_ip",
    "Service": "service",
    "Classifier Class": "classifier_class",
    "Zero-Day Family": "zero_day_family",
    "Batch File": "source_file_hash",
}
SEARCHED = (
    "alert_id", "predicted_class", "classifier_class", "status", "source", "zero_day_family", "analyst_note",
)
# Fixed wording attached to exported reports.
LIMITATIONS = {
    "zero_day_candidate_meaning": "OOD hypothesis for analyst review; not a confirmed novel attack.",
    "required_validation": [
        "Check raw flow and packet evidence.",
        "Correlate source, destination, service and time window in SIEM/firewall logs.",
        "Review endpoint or asset context before blocking or escalation.",
    ],
    "model_limitations": [
        "Scores depend on feature quality and threshold calibration.",
        "Real-world CSV normalization can lose directional or timing evidence.",
        "MITRE and LLM output are decision support, not authoritative attribution.",
    ],
}


def _or(df: DataFrame, name: str, default: object) -> Column:
    return F.coalesce(ref(name), F.lit(default)) if name in df.columns else F.lit(default)


def alert_records(scores: DataFrame, timestamp: Column | None = None, id_col: Column | None = None) -> DataFrame:
    """Score rows as alert rows; the id is ``ZD-`` and the zero-padded row number."""
    row = F.col("source_row").cast("long")
    classifier = _or(scores, "classifier_class", "Unknown")
    detection = verdict(F.col("is_zeroday"), classifier)
    if "detection" in scores.columns:
        detection = F.coalesce(F.nullif(F.col("detection"), F.lit("")), detection)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if timestamp is None else timestamp
    fields = {
        "alert_id": id_col if id_col is not None else F.concat(F.lit("ZD-"), padded(row)),
        "timestamp": stamp,
        "source_row": row,
        "hybrid_score": _or(scores, "hybrid_score", 0.0),
        "ae_score": _or(scores, "ae_score", 0.0),
        "max_prob": _or(scores, "max_prob", 0.0),
        "predicted_class": detection,
        "classifier_class": classifier,
        "zero_day_family": _or(scores, "zero_day_family", ""),
        "is_zeroday": _or(scores, "is_zeroday", False),
    }
    extra = [c for c in scores.columns if c not in fields and c != "detection"]
    return scores.select(*[c.alias(n) for n, c in fields.items()], *[ref(c) for c in extra])


def padded(row: Column, width: int = 6) -> Column:
    """Zero-padded number that keeps all digits of wider numbers."""
    digits = row.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def _worst_first() -> list[Column]:
    return [F.desc("is_zeroday"), F.desc("hybrid_score"), F.desc("ae_score"), F.asc("max_prob"), F.asc("source_row")]


def top_alerts(
    scores: DataFrame, limit: int = 25, file_hash: str = "", timestamp: Column | None = None
) -> DataFrame:
    """The worst rows of one batch (take-ordered: each task keeps ``limit`` rows)."""
    worst = scores.orderBy(*_worst_first()).limit(limit)
    prefix = (file_hash or "unknown")[:8]
    ident = F.concat(F.lit(f"BATCH-{prefix}-"), padded(F.col("source_row").cast("long")))
    return alert_records(worst, timestamp, ident).withColumns(
        {"source_file_hash": F.lit(file_hash), "source": F.lit("batch_top")}
    )


def top_alerts_per_file(
    scores: DataFrame, limit: int, hash_col: str, timestamp: Column | None = None
) -> DataFrame:
    """The worst rows of every file; the rank limit also applies before the shuffle."""
    order = Window.partitionBy(hash_col).orderBy(*_worst_first())
    worst = scores.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")
    ident = F.concat(
        F.lit("BATCH-"), F.substring(ref(hash_col), 1, 8), F.lit("-"), padded(F.col("source_row").cast("long"))
    )
    return alert_records(worst, timestamp, ident).withColumn("source", F.lit("batch_top"))


def entities(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Six entity columns from whatever raw names the log has; absent is empty text."""
    lowered = {c.strip().lower(): c for c in reversed(df.columns)}
    out = []
    for entity, names in ENTITY_NAMES.items():
        found = [meaningful(ref(lowered[n])) for n in names if n in lowered]
        out.append(F.coalesce(*found, F.lit("")).alias(entity))
    return df.select(*[ref(k) for k in keep], *out)


def attach_entities(alerts: DataFrame, flows: DataFrame, on: Sequence[str] = ("source_row",)) -> DataFrame:
    """Alerts with the entities of their raw flow.

    The alert side is a top-N result; adaptive execution sees its size and
    broadcasts it, so the flow table is scanned without a shuffle.
    """
    known = [c for c in alerts.columns if c not in ENTITY_NAMES]
    return alerts.select(*known).join(entities(flows, on), list(on), "left")


def queue_filter(
    alerts: DataFrame,
    status: str = "All",
    severity: str = "All",
    ood: str = "All",
    query: str = "",
) -> DataFrame:
    out = alerts
    if status != "All":
        out = out.where(_or(alerts, "status", "new") == status)
    if severity != "All":
        out = out.where(F.upper(_or(alerts, "severity", "N/A")) == severity.upper())
    if ood == "OOD only":
        out = out.where(F.coalesce("is_zeroday", F.lit(False)))
    elif ood == "Known only":
        out = out.where(~F.coalesce("is_zeroday", F.lit(False)))
    needle = query.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", *[_or(alerts, c, "").cast("string") for c in SEARCHED]))
        out = out.where(hay.contains(needle))
    return out


def detection_log(
    scores: DataFrame,
    only_ood: bool = True,
    wanted_verdict: str = "All",
    classifier_class: str = "All",
    min_hybrid: float = 0.0,
) -> DataFrame:
    """Score rows with detection and risk, filtered and worst first."""
    out = scores.withColumn("detection", verdict(F.col("is_zeroday"), F.col("classifier_class")))
    if only_ood:
        out = out.where("is_zeroday")
    if wanted_verdict != "All":
        out = out.where(F.col("detection") == wanted_verdict)
    if classifier_class != "All":
        out = out.where(F.col("classifier_class") == classifier_class)
    out = out.where(F.col("hybrid_score") >= min_hybrid).withColumn("risk", ood_risk())
    return out.orderBy(F.desc("risk"), F.desc("hybrid_score"), F.desc("ae_score"), "source_row")


def ood_risk(when_ood: str = "HIGH", otherwise: str = "MEDIUM") -> Column:
    severity = F.when(F.coalesce("is_zeroday", F.lit(False)), F.lit(when_ood)).otherwise(F.lit(otherwise))
    return risk_score(F.col("hybrid_score"), F.col("ae_score"), F.col("is_zeroday"), severity)


def enrich_ood(scores: DataFrame) -> DataFrame:
    detection = verdict(F.col("is_zeroday"), F.col("classifier_class"))
    return scores.withColumns({"risk": ood_risk(), "detection": detection})


def alert_risk(alerts: DataFrame, severity_col: str = "severity") -> Column:
    """Stored risk truncated to an integer, else the computed score."""
    computed = risk_score(F.col("hybrid_score"), F.col("ae_score"), F.col("is_zeroday"), _or(alerts, severity_col, ""))
    if "risk" not in alerts.columns:
        return computed
    return F.coalesce(F.col("risk").cast("double").cast("int"), computed)


def queue_table(alerts: DataFrame) -> DataFrame:
    """The analyst's list, highest risk first, then latest."""
    severity = _or(alerts, "severity", "N/A")
    return alerts.select(
        "alert_id",
        F.col("timestamp").alias("time"),
        _or(alerts, "status", "new").alias("status"),
        _or(alerts, "source", "session").alias("source"),
        severity.alias("severity"),
        risk_score(F.col("hybrid_score"), F.col("ae_score"), F.col("is_zeroday"), severity).alias("risk"),
        F.col("predicted_class").alias("class"),
        F.round("hybrid_score", 3).alias("hybrid_score"),
        F.round("ae_score", 3).alias("ae_score"),
        F.when(F.col("is_zeroday"), F.lit("YES")).otherwise(F.lit("NO")).alias("ood_candidate"),
    ).orderBy(F.desc("risk"), F.desc("time"), "alert_id")


def queue_summary(alerts: DataFrame) -> DataFrame:
    severity = _or(alerts, "severity", "")
    risk = risk_score(F.col("hybrid_score"), F.col("ae_score"), F.col("is_zeroday"), severity)
    return alerts.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(severity.isin("CRITICAL", "HIGH")).alias("critical_high"),
        F.count_if("is_zeroday").alias("ood"),
        F.coalesce(F.avg(risk).cast("int"), F.lit(0)).alias("average_risk"),
    )


def severity_mix(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(
        _or(alerts, "severity", "N/A").alias("severity"),
        F.when(F.col("is_zeroday"), F.lit("YES")).otherwise(F.lit("NO")).alias("ood_candidate"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def saved_events(alerts: DataFrame, at: Column, seq: Column) -> DataFrame:
    """One ``saved`` event per alert, with the columns of the log and the whole alert as JSON.

    The classifier's class falls back to the predicted one, the severity to that of a
    language model's answer; an alert that was never triaged is ``new`` and ``single``.
    """

    def have(name: str, kind: str = "string") -> Column:
        return (ref(name) if name in alerts.columns else F.lit(None)).cast(kind)

    payload = F.to_json(F.struct(*[_or(alerts, c, "").alias(c) for c in ("severity", "source", "status")]))
    predicted = F.coalesce(have("predicted_class"), F.lit(""))
    return alerts.select(
        "alert_id", at.alias("created_at"), seq.alias("seq"), F.lit("saved").alias("event_type"),
        F.coalesce(have("status"), F.lit("new")).alias("status"),
        F.coalesce(have("analyst_note"), F.lit("")).alias("analyst_note"),
        payload.alias("payload_json"),
        F.coalesce(have("timestamp"), F.lit("")).alias("event_timestamp"),
        F.coalesce(have("source"), F.lit("single")).alias("source"),
        F.coalesce(F.nullif(have("severity"), F.lit("")), have("llm_severity")).alias("severity"),
        have("risk", "int").alias("risk"),
        predicted.alias("predicted_class"),
        F.coalesce(F.nullif(have("classifier_class"), F.lit("")), predicted).alias("classifier_class"),
        F.coalesce(have("is_zeroday", "boolean"), F.lit(False)).alias("is_zeroday"),
        *[have(c, "double").alias(c) for c in ("hybrid_score", "ae_score", "max_prob")],
        F.to_json(F.struct(*[ref(c) for c in alerts.columns])).alias("alert_json"),
        have("llm_json").alias("llm_json"),
    )


def status_events(updates: DataFrame, at: Column, seq: Column) -> DataFrame:
    """One ``status_updated`` event per (alert_id, status, analyst_note) row."""
    return updates.select(
        F.trim("alert_id").alias("alert_id"), at.alias("created_at"), seq.alias("seq"),
        F.lit("status_updated").alias("event_type"), "status", "analyst_note",
        F.to_json(F.struct("analyst_note", "status")).alias("payload_json"),
    )


def alert_state(log: DataFrame) -> DataFrame:
    """Latest state per alert: first created_at, the alert as last saved, last known status and note.

    ``log`` has the columns of the alert log; absent ones read as null. Only partial
    maxima cross the shuffle, so an alert with very many events costs no more than others.
    """
    log = alert_log.rows(log)
    order = F.struct("created_at", "seq")
    saved = F.col("event_type") == "saved"
    kept = F.struct(*alert_log.SAVED)
    state = log.groupBy("alert_id").agg(
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("status", "analyst_note")],
        F.max_by(F.when(saved, kept), F.when(saved, order)).alias("saved"),
        F.count(F.lit(1)).alias("events"),
    )
    return state.select("alert_id", "created_at", "updated_at", "status", "analyst_note", "saved.*", "events")


def list_alerts(state: DataFrame, limit: int = 200, status: str | None = None) -> DataFrame:
    out = state if status is None else state.where(F.col("status") == status)
    return out.orderBy(F.desc("updated_at"), "alert_id").limit(limit)


def rejected_updates(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Status updates whose alert does not exist, or without an id."""
    unknown = updates.join(known.select("alert_id").distinct(), "alert_id", "left_anti")
    reason = F.when(F.trim("alert_id") == "", F.lit("alert_id must not be empty")).otherwise(
        F.concat(F.lit("alert not found: "), F.col("alert_id"))
    )
    return unknown.withColumn("reason", reason)


def correlation_pairs(alerts: DataFrame, carry: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """One row per alert and group it belongs to."""
    pairs = []
    for group_type, field in GROUP_FIELDS.items():
        if field in alerts.columns and group_type not in skip:
            key = meaningful(ref(field))
            key = F.when(F.lower(key) != "normal", key)
            pairs.append(F.when(key.isNotNull(), F.struct(F.lit(group_type).alias("group_type"), key.alias("key"))))
    return (
        alerts.select(*[ref(c) for c in carry], F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("g"))
        .select("g.*", *[ref(c) for c in carry])
    )


def correlate(alerts: DataFrame, min_count: int = 2, sample_ids: int = 10, order_col: str = "alert_id") -> DataFrame:
    """Groups of alerts sharing an entity, with counts and the first few ids.

    Totals are partial aggregates. The id sample is limited per group before and
    after the shuffle, so a group holding a third of all alerts stays cheap.
    """
    carry = list(dict.fromkeys(["alert_id", order_col, "is_zeroday", "timestamp"]))
    with_risk = alerts.withColumn("_risk", alert_risk(alerts))
    pairs = correlation_pairs(with_risk, [*carry, "_risk"])
    totals = pairs.groupBy("group_type", "key").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.count_if("is_zeroday").alias("ood_count"),
        F.max("_risk").alias("max_risk"),
        F.max("timestamp").alias("latest_time"),
    ).where(F.col("alert_count") >= min_count)
    order = Window.partitionBy("group_type", "key").orderBy(order_col, "alert_id")
    sample = (
        pairs.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= sample_ids)
        .groupBy(F.col("group_type").alias("_t"), F.col("key").alias("_k"))
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "alert_id"))).alias("_ids"))
    )
    return (
        totals.join(sample, (F.col("group_type") == F.col("_t")) & (F.col("key") == F.col("_k")))
        .withColumn("alert_ids", F.transform("_ids", lambda s: s["alert_id"]))
        .drop("_t", "_k", "_ids")
    )


def triage_context(history: DataFrame, batch: DataFrame, max_history: int = 20, max_batch: int = 50) -> DataFrame:
    """The last alerts of the history and the worst rows of the batch as choices."""
    recent = history.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(max_history).select(
        F.lit("history").alias("origin"), "alert_id",
        F.concat(
            F.lit("Alert history | "), F.col("alert_id"), F.lit(" | "), F.col("predicted_class"),
            F.lit(" | score="), F.format_string("%.3f", F.col("hybrid_score")),
        ).alias("label"),
    )
    worst = (
        batch.orderBy(F.desc("is_zeroday"), F.desc("hybrid_score"), F.desc("ae_score"), "source_row")
        .limit(max_batch)
        .select(
            F.lit("batch").alias("origin"),
            F.concat(F.lit("ZD-"), padded(F.col("source_row").cast("long"))).alias("alert_id"),
            F.concat(
                F.lit("Zero-day log | row="), F.col("source_row").cast("string"), F.lit(" | "),
                verdict(F.col("is_zeroday"), F.col("classifier_class")),
                F.lit(" | hybrid="), F.format_string("%.3f", F.col("hybrid_score")),
            ).alias("label"),
        )
    )
    return recent.unionByName(worst)


def export_report(alerts: DataFrame, drop: Sequence[str] = ("shap_values", "probs")) -> DataFrame:
    """Alerts as JSON reports without bulky columns, limitations attached."""
    note = F.struct(
        F.lit(LIMITATIONS["zero_day_candidate_meaning"]).alias("zero_day_candidate_meaning"),
        F.lit(LIMITATIONS["required_validation"]).alias("required_validation"),
        F.lit(LIMITATIONS["model_limitations"]).alias("model_limitations"),
    )
    kept = alerts.drop(*drop).withColumn("limitations_and_safety", note)
    return kept.select("alert_id", F.to_json(F.struct("*")).alias("report_json"))


def feature_rows(df: DataFrame, ids: Sequence[str], columns: Sequence[str], search: str = "") -> DataFrame:
    """(ids, position, metric, value): priority columns first, optional name search."""
    ordered = [c for c in PRIORITY_FEATURES if c in columns] + [c for c in columns if c not in PRIORITY_FEATURES]
    if search:
        ordered = [c for c in ordered if search.lower() in c.lower()]
    items = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("metric"), text(ref(c), "").alias("value"))
            for i, c in enumerate(ordered)
        ]
    )
    return df.select(*[ref(k) for k in ids], F.explode(items).alias("s")).select(*ids, "s.*")


# Columns shown first.
PRIORITY_FEATURES = (
    "true_label", "attack_cat", "label", "dur", "sbytes", "dbytes", "sload", "dload", "spkts", "dpkts",
    "ct_srv_dst", "ct_dst_ltm", "ct_src_ltm", "state_num", "proto_num", "service_num",
)
