"""Alerts, correlation, incidents and techniques on small hand-made queues."""

import random

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import text as text_fn
from flowsieve.operators import alerts, incidents, techniques
from flowsieve.sources import alert_log


def test_top_alerts_order_and_ids(spark):
    rows = [(0, "Normal", 0.2, 0.1, 0.95, False), (1, "DoS", 0.7, 0.5, 0.5, False), (2, "Normal", 0.6, 0.9, 0.3, True)]
    df = spark.createDataFrame(rows, ["source_row", "classifier_class", "hybrid_score", "ae_score", "max_prob", "is_zeroday"])
    got = alerts.top_alerts(df, 2, "abcdef123456", F.lit("2026-05-14 10:00:00")).collect()
    assert [r["alert_id"] for r in got] == ["BATCH-abcdef12-000002", "BATCH-abcdef12-000001"]
    assert got[0]["predicted_class"] == "Zero-Day Candidate" and got[0]["source_file_hash"] == "abcdef123456"


def test_alert_record_contract(spark):
    df = spark.createDataFrame(
        [(42, "Normal", 0.91, 0.8, 0.4, True, "Shellcode")],
        ["source_row", "classifier_class", "hybrid_score", "ae_score", "max_prob", "is_zeroday", "zero_day_family"],
    )
    row = alerts.alert_records(df, F.lit("2026-05-14 12:00:00")).first()
    assert row["alert_id"] == "ZD-000042" and row["predicted_class"] == "Zero-Day Candidate"


def test_entities_attached(spark):
    raw = spark.createDataFrame([(0, "10.0.0.5", "172.16.1.10", 52512, 443, "tcp", "https")], ["source_row", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "service"])
    scores = spark.createDataFrame([(0, "DoS", 0.9, 0.8, 0.2, True)], ["source_row", "classifier_class", "hybrid_score", "ae_score", "max_prob", "is_zeroday"])
    row = alerts.attach_entities(alerts.top_alerts(scores, 5, "abc"), raw).first()
    assert (row["src_ip"], row["dst_port"], row["service"]) == ("10.0.0.5", "443", "https")


QUEUE = [
    ("A1", "2026-05-14 10:00:00", "new", "HIGH", "Zero-Day Candidate", "DoS", 0.9, 0.8, True, "source ip suspicious"),
    ("A2", "2026-05-14 10:01:00", "closed", "LOW", "Normal", "Normal", 0.1, 0.1, False, "benign"),
]
QUEUE_COLUMNS = ["alert_id", "timestamp", "status", "severity", "predicted_class", "classifier_class", "hybrid_score", "ae_score", "is_zeroday", "analyst_note"]


@pytest.mark.parametrize(
    "options, want",
    [({"status": "new"}, ["A1"]), ({"severity": "LOW"}, ["A2"]), ({"ood": "OOD only"}, ["A1"]), ({"ood": "Known only"}, ["A2"]), ({"query": "benign"}, ["A2"])],
)
def test_queue_filter(spark, options, want):
    df = spark.createDataFrame(QUEUE, QUEUE_COLUMNS)
    assert [r["alert_id"] for r in alerts.queue_filter(df, **options).collect()] == want


def test_queue_table_and_summary(spark):
    df = spark.createDataFrame(QUEUE, QUEUE_COLUMNS)
    first = alerts.queue_table(df).first()
    assert first["alert_id"] == "A1" and first["ood_candidate"] == "YES"
    summary = alerts.queue_summary(df).first()
    assert (summary["alerts"], summary["critical_high"], summary["ood"]) == (2, 1, 1) and summary["average_risk"] > 0
    empty = alerts.queue_summary(df.limit(0)).first()
    assert list(empty) == [0, 0, 0, 0]


def test_correlation_groups(spark):
    rows = [
        ("A1", "10.0.0.5", "DoS", True, 90, "2026-05-14 10:00:00"),
        ("A2", "10.0.0.5", "DoS", False, 60, "2026-05-14 10:01:00"),
        ("A3", "10.0.0.8", "Normal", False, 10, "2026-05-14 10:02:00"),
    ]
    df = spark.createDataFrame(rows, ["alert_id", "src_ip", "classifier_class", "is_zeroday", "risk", "timestamp"])
    df = df.withColumns({"hybrid_score": F.lit(0.0), "ae_score": F.lit(0.0)})
    got = {(r["group_type"], r["key"]): r for r in alerts.correlate(df).collect()}
    assert set(got) == {("Source IP", "10.0.0.5"), ("Classifier Class", "DoS")}
    dos = got[("Classifier Class", "DoS")]
    assert (dos["alert_count"], dos["ood_count"], dos["max_risk"]) == (2, 1, 90) and dos["alert_ids"] == ["A1", "A2"]


INCIDENT_ALERTS = [
    ("A1", "2026-05-14 10:00:00", "10.0.0.5", "https", "DoS", "Shellcode", True, 92, "CRITICAL"),
    ("A2", "2026-05-14 10:08:00", "10.0.0.5", "https", "DoS", "Shellcode", False, 76, "HIGH"),
    ("A3", "2026-05-14 10:40:00", "10.0.0.5", "https", "DoS", None, False, 55, "MEDIUM"),
    ("A4", "2026-05-14 10:05:00", "10.0.0.8", "dns", "Normal", None, False, 10, None),
    ("A5", None, "10.0.0.5", "https", "DoS", None, True, 99, "CRITICAL"),
]


def test_incident_fields(spark):
    names = "alert_id string, ts string, src_ip string, service string, classifier_class string, zero_day_family string, is_zeroday boolean, risk int, severity string"
    df = spark.createDataFrame(INCIDENT_ALERTS, names).withColumns(
        {"event_ts": F.to_timestamp("ts"), "hybrid_score": F.lit(0.0), "ae_score": F.lit(0.0)}
    )
    got = {r["group_type"]: r for r in incidents.build_incidents(df).collect()}
    source = got["Source IP"]
    assert source["key"] == "10.0.0.5" and source["alert_count"] == 2 and source["ood_count"] == 1
    assert source["high_count"] == 2 and source["max_risk"] == 92 and source["severity"] == "CRITICAL"
    assert source["primary_classes"] == ["DoS"] and source["families"] == ["Shellcode"]
    assert source["alert_ids"] == ["A1", "A2"] and "Source IP: 10.0.0.5" in source["recommended_focus"]
    assert source["duration_minutes"] == 8.0
    assert all(r["end_time"] <= "2026-05-14 10:15:00" for r in got.values())
    import hashlib

    raw = "Source IP|10.0.0.5|2026-05-14T10:00:00|2026-05-14T10:08:00"
    assert source["incident_id"] == "INC-" + hashlib.sha1(raw.encode()).hexdigest()[:10].upper()


def brute_starts(times, window):
    out, start = {}, None
    for t in sorted(times):
        if start is None or t - start > window:
            start = t
        out[t] = start
    return out


@pytest.mark.parametrize("block, fan", [(25, 2), (40, 3), (10**9, 64)])
@pytest.mark.parametrize("density", [1, 60, 4000, 86_400 * 3])
def test_cluster_starts_over_blocks(spark, block, fan, density):
    """Dense, sparse and gappy keys, cut into blocks of any size and combined in levels."""
    rng = random.Random(density)
    window, base = 900_000_000, 1_700_000_000_000_000
    rows, want = [], {}
    for k in range(4):
        t, times = base + rng.randrange(10**11), []
        for _ in range(400):
            t += rng.randrange(1, 2 * density * 1_000_000)
            times.append(t)
        # events exactly at the edge of a window
        times += [times[0] + window, times[0] + window + 1]
        rows += [("Service", f"k{k}", x) for x in times for _ in range(rng.randrange(1, 3))]
        want.update({(f"k{k}", x): s for x, s in brute_starts(set(times), window).items()})
    df = spark.createDataFrame(rows, "group_type string, key string, t long")
    got = {(r["key"], r["t"]): r["start"] for r in incidents.cluster_starts(df, window, block, fan).collect()}
    assert got == want


def test_alert_log_state_and_rejects(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("A-1", "new", "HIGH", "single", 71, True, 0.9), ("A-2", "new", "", "batch", 12, False, 0.1)]
    saved = spark.createDataFrame(rows, ["alert_id", "status", "severity", "source", "risk", "is_zeroday", "hybrid_score"])
    at = F.lit("2026-05-14 10:00:00").cast("timestamp")
    events = alerts.saved_events(saved, at, F.monotonically_increasing_id())
    alert_log.append_events(events, path)
    update = spark.createDataFrame([("A-1", "false_positive", "benign scan"), ("A-404", "closed", "stale")], ["alert_id", "status", "analyst_note"])
    known = alert_log.read_events(spark, path)
    rejected = alerts.rejected_updates(update, known).collect()
    assert [r["reason"] for r in rejected] == ["alert not found: A-404"]
    later = F.lit("2026-05-14 11:00:00").cast("timestamp")
    good = update.where("alert_id = 'A-1'")
    alert_log.append_events(alerts.status_events(good, later, F.lit(10).cast("long")), path)
    state = {r["alert_id"]: r for r in alerts.alert_state(alert_log.read_events(spark, path)).collect()}
    assert state["A-1"]["status"] == "false_positive" and state["A-1"]["analyst_note"] == "benign scan"
    assert state["A-1"]["severity"] == "HIGH" and str(state["A-1"]["created_at"]) == "2026-05-14 10:00:00"
    assert state["A-2"]["status"] == "new" and state["A-2"]["source"] == "batch" and state["A-2"]["severity"] is None
    kept = state["A-1"]
    assert (kept["risk"], kept["is_zeroday"], kept["hybrid_score"]) == (71, True, 0.9) and '"risk":71' in kept["alert_json"]
    assert set(alert_log.SAVED) < set(kept.asDict()) and len(kept) >= 17
    # an update without a note keeps the last one
    silent = spark.createDataFrame([("A-1", "closed", None)], "alert_id string, status string, analyst_note string")
    alert_log.append_events(alerts.status_events(silent, F.lit("2026-05-15 11:00:00").cast("timestamp"), F.lit(11).cast("long")), path)
    kept = alerts.alert_state(alert_log.read_events(spark, path)).where("alert_id = 'A-1'").first()
    assert (kept["status"], kept["analyst_note"], kept["events"], kept["risk"]) == ("closed", "benign scan", 3, 71)


def test_techniques_known_and_zero_day(spark):
    df = spark.createDataFrame(
        [("A1", "DoS", 0.5, ["sbytes"]), ("A2", "Weird", 0.5, []), ("A3", "Normal", 1.0, ["dur"])],
        "alert_id string, classifier_class string, ae_score double, features array<string>",
    )
    both = techniques.by_class(df).unionByName(techniques.by_features(df.where("classifier_class <> 'Normal'"), "features"))
    ranked = techniques.rank(both, 4).orderBy("alert_id", "rank").collect()
    got = [(r["alert_id"], r["technique_id"], r["confidence"], r["evidence"]) for r in ranked]
    assert got[:3] == [
        ("A1", "T1498", 0.86, ["classifier:DoS", "sbytes"]),
        ("A1", "T1030", 0.72, ["sbytes"]),
        ("A1", "T1499", 0.70, ["classifier:DoS"]),
    ]
    assert [g[1] for g in got[3:]] == ["T1071", "T1190"]
    zero = techniques.rank(techniques.zero_day(df, "features"), 5).where("alert_id = 'A2'").collect()
    assert [(r["technique_id"], r["confidence"], r["evidence"]) for r in zero] == [("T1190", round(0.48 + 0.5 * 0.15, 2), ["ae_score:0.500"])]


def test_triage_fallback(spark):
    df = spark.range(1).select(text_fn.fallback_triage(F.lit(0.7), F.lit(0.6), F.lit(True), F.lit("x")).alias("t"))
    row = df.select("t.*").first()
    assert row["severity"] == "HIGH" and "hybrid score: 0.700" in row["verdict"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('say\n```json\n{"a": 1}\n``` end', '{"a": 1}'),
        ('text {"a": {"b": 2}} tail', '{"a": {"b": 2}}'),
        ("no json", "no json"),
        ('```\nplain\n``` then ```{"x": 1}```', '{"x": 1}'),
        (None, ""),
    ],
)
def test_json_in_answers(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(text_fn.embedded_json(F.col("raw"))).first()[0] == want


def test_triage_choices(spark):
    history = spark.createDataFrame([("A1", "t1", "Known-Attack", 0.4), ("A2", "t2", "Zero-Day Candidate", 0.8)], ["alert_id", "timestamp", "predicted_class", "hybrid_score"])
    batch = spark.createDataFrame([(10, "Normal", 0.1, 0.1, False), (11, "DoS", 0.9, 0.8, True)], ["source_row", "classifier_class", "hybrid_score", "ae_score", "is_zeroday"])
    got = alerts.triage_context(history, batch, 1, 1).collect()
    assert [r["alert_id"] for r in got] == ["A2", "ZD-000011"] and "row=11" in got[1]["label"]
