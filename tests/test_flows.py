"""Normalisation, production table, guards: hand-made logs with known results."""

import pytest
from pyspark.sql import functions as F

from flowsieve import vocab
from flowsieve.operators import normalize, preprocess, production, quality

FIREWALL = [
    ("10.0.0.5", "172.16.1.10", 52512, 443, "tcp", 1.5, 1200, 3200, 10, 14, "CON"),
    ("10.0.0.5", "172.16.1.11", 52513, 443, "tcp", 0.2, 80, 40, 2, 1, "RST"),
]
FIREWALL_COLUMNS = (
    "src_ip dst_ip src_port dst_port protocol duration sent_bytes received_bytes sent_pkts received_pkts action"
).split()
CIC_COLUMNS = [
    "Flow ID", "Source IP", "Source Port", "Destination IP", "Destination Port", "Protocol", "Timestamp",
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd IAT Mean", "Bwd IAT Mean", "SYN Flag Count", "ACK Flag Count",
    "FIN Flag Count", "RST Flag Count", "Label", "source_file", "source_row",
]
CIC = [
    ("f1", "10.0.0.1", 1000, "10.0.0.9", 80, 6, "2026-05-19 08:00:00", 1500000, 10, 8, 1200, 900, 100000.0, 90000.0, 1, 1, 0, 0, "BENIGN", "s.csv", 0),
    ("f2", "10.0.0.2", 1001, "10.0.0.9", 80, 6, "2026-05-19 08:01:00", 900000, 50, 2, 9000, 100, 5000.0, 1000.0, 1, 0, 0, 0, "DoS Hulk", "s.csv", 1),
    ("f3", "10.0.0.3", 1002, "10.0.0.9", 22, 6, "2026-05-19 08:02:00", 200000, 4, 4, 300, 300, 2000.0, 1000.0, 0, 1, 1, 0, "BENIGN", "s.csv", 2),
]


def cic(spark):
    return spark.createDataFrame(CIC, CIC_COLUMNS)


def test_firewall_log_maps(spark):
    out, plan = normalize.normalize_flows(spark.createDataFrame(FIREWALL, FIREWALL_COLUMNS))
    rows = out.orderBy("dstip").collect()
    assert len(rows) == 2
    for c in ["proto", "state", "dur", "sbytes", "dbytes", "spkts", "dpkts", "sload", "dload"]:
        assert c in out.columns
    assert plan.coverage >= 0.7
    assert plan.schema == "firewall_or_flow_csv"
    assert rows[0]["sload"] == pytest.approx(1200 * 8 / 1.5)
    assert rows[0]["ct_src_ltm"] == 2.0 and rows[0]["ct_dst_ltm"] == 1.0


def test_expected_features_limit_coverage(spark):
    raw = spark.createDataFrame([("1.1.1.1", "2.2.2.2")], ["src_ip", "dst_ip"])
    _, plan = normalize.normalize_flows(raw, expected=["sload", "dur", "not_core"])
    assert plan.missing == ["sload"] and plan.coverage == 0.5


@pytest.mark.parametrize(
    "header, family",
    [
        (["flow_duration", "total_fwd_packets", "total_backward_packets"], "cic_ids2017"),
        (["id.orig_h"], "zeek_conn"),
        (["conn_state", "orig_bytes", "resp_bytes"], "zeek_conn"),
        (["flow.bytes"], "suricata_eve_flat"),
        (["alert.signature"], "suricata_eve_flat"),
        (["srcaddr"], "netflow_or_cloud_flow"),
        (["source_ip", "destination_ip"], "firewall_or_flow_csv"),
        (["attack_cat", "sbytes", "dbytes"], "unsw_nb15"),
        (["x"], "generic_csv"),
    ],
)
def test_schema_family(header, family):
    assert vocab.detect_schema(header) == family


def test_dotted_and_mixed_header(spark):
    raw = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 100, 40, 7)], ["id.orig_h", "ID.resp_h", "Total Bytes", "orig bytes", "packets"])
    out, plan = normalize.normalize_flows(raw)
    row = out.first()
    assert plan.mapped["srcip"] == "id.orig_h" and row["srcip"] == "1.1.1.1"
    assert (row["sbytes"], row["dbytes"], row["spkts"], row["dpkts"]) == (40.0, 60.0, 4.0, 3.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_duration_unit_equals_median_rule(spark, n):
    import random
    import statistics

    rng = random.Random(n)
    files = {f"f{k}": [rng.choice([0.5, 1000.0, 1001.0, 999.0, 100000.0, 100001.0, 250000.0]) for _ in range(n)] for k in range(40)}
    rows = [(f, v) for f, vs in files.items() for v in vs]
    df = spark.createDataFrame(rows, ["source_file", "dur"])
    got = {r["source_file"]: r["duration_divisor"] for r in normalize.duration_unit(df, F.col("dur")).collect()}
    for f, vs in files.items():
        median = statistics.median(vs)
        assert got[f] == (1e6 if median > 100000 else 1e3 if median > 1000 else 1.0), (f, vs)


def test_context_counts_null_keys_group(spark):
    rows = [("a", "x", None, "h"), ("a", "x", None, "h"), ("a", "y", "d", "h"), ("b", "x", None, "h")]
    df = spark.createDataFrame(rows, "source_file string, srcip string, dstip string, service string")
    out = normalize.context_counts(df, list(vocab.CONTEXT_COUNTS))
    got = sorted((r["source_file"], r["srcip"], r["ct_dst_ltm"], r["ct_dst_src_ltm"], r["ct_dst_sport_ltm"]) for r in out.collect())
    assert got == [("a", "x", 2.0, 2.0, 1.0), ("a", "x", 2.0, 2.0, 1.0), ("a", "y", 1.0, 1.0, 1.0), ("b", "x", 1.0, 1.0, 1.0)]


def test_production_rows_overrides_and_split(spark):
    flows = production.production_flows(cic(spark), source="cicflowmeter")
    assert flows.schema.names == vocab.PRODUCTION_SCHEMA.names
    rows = flows.orderBy("source_row").collect()
    assert [r["analyst_label"] for r in rows] == ["normal", "known_attack", "normal"]
    assert rows[0]["event_time"].startswith("2026-05-19T08:00:00") and rows[0]["duration"] == 1.5
    assert rows[2]["state"] == "FIN" and rows[0]["sintpkt"] == pytest.approx(0.1)
    overrides = spark.createDataFrame(
        [("f2", "known_attack", None, 1), ("f2", "Suspicious", "Needs review", 2)],
        "flow_id string, analyst_label string, attack_category string, seq int",
    )
    reviewed = production.apply_label_overrides(flows, overrides)
    patched = reviewed.where("flow_id = 'f2'").first()
    assert (patched["analyst_label"], patched["attack_category"]) == ("suspicious", "Needs review")
    split = production.time_split(reviewed, 0.34, 0.33, 0.33)
    assert {r["split"] for r in split.collect()} == {"train", "validation", "test"}
    counts = {r["source"]: r["rows"] for r in split.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).collect()}
    assert counts == {"cicflowmeter": 3}


def test_override_errors(spark):
    flows = production.production_flows(cic(spark))
    bad = spark.createDataFrame([("f1", "weird", 1)], "flow_id string, analyst_label string, seq int")
    with pytest.raises(ValueError, match="invalid analyst_label values: weird"):
        production.apply_label_overrides(flows, bad)
    with pytest.raises(ValueError, match="do not include"):
        production.apply_label_overrides(flows, bad.drop("flow_id"))


def test_split_ratio_must_be_positive():
    with pytest.raises(ValueError, match="positive"):
        production.split_sizes(10, 0.0, 0.0, 0.0)


def test_time_split_hot_instant_and_missing_times(spark):
    rows = [(i, "2024-01-01T00:00:00Z" if i < 600 else (None if i % 10 == 0 else f"2024-01-0{2 + i % 5}T00:00:00Z")) for i in range(1000)]
    df = spark.createDataFrame(rows, "source_row long, event_time string")
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    want = {r[0]: "train" if k < 700 else "validation" if k < 850 else "test" for k, r in enumerate(ordered)}
    for limit in (10, 1_000_000):
        got = {r["source_row"]: r["split"] for r in production.time_split(df, in_task_rows=limit).collect()}
        assert got == want


def test_input_guard(spark):
    policy = quality.InputPolicy(max_rows=10, min_columns=3)
    empty = spark.createDataFrame([], "a int")
    found = " ".join(r["finding"] for r in quality.input_guard(empty, size_bytes=10, policy=policy).collect())
    assert "no rows" in found and "too few columns" in found
    many = spark.range(12).selectExpr("id a", "id b", "id c")
    assert "too many rows" in quality.input_guard(many, policy=policy).first()["finding"]
    twice = quality.input_guard(many, header=["src_ip", "src_ip", "dst_ip"]).collect()
    assert any("duplicate column" in r["finding"] for r in twice)


def test_quality_levels(spark):
    rows = [
        ("a", 0.52, {"src_ip": "src_ip", "dst_ip": "dst_ip"}, ["sbytes", "dbytes", "dur"]),
        ("b", 0.9, {str(i): "x" for i in range(6)}, []),
        ("c", None, {}, []),
    ]
    df = spark.createDataFrame(
        rows, "source_file string, feature_coverage double, mapped_columns map<string,string>, missing_core_features array<string>"
    )
    got = {r["source_file"]: r for r in quality.normalization_quality(df).collect()}
    assert got["a"]["level"] == "LOW" and any("directional" in w for w in got["a"]["warnings"])
    assert got["b"]["level"] == "GOOD" and len(got["b"]["warnings"]) == 1
    assert got["c"]["level"] == "UNKNOWN" and "unknown" in got["c"]["message"]


CODES = {"proto": {"tcp": 7, "unk": -1}, "service": {"http": 3, "unk": -1}, "state": {"CON": 2, "unk": -1}}


def test_preprocess_aligns(spark):
    df = spark.createDataFrame([("tcp", "http", "CON", 2.0, 100, 50)], ["proto", "service", "state", "dur", "sbytes", "dbytes"])
    names = ["dur", "proto_num", "service_num", "state_num", "bytes_ratio", "missing_feature"]
    out, report = preprocess.preprocess(df, names, CODES)
    row = out.first()
    assert list(row)[:4] == [2.0, 7.0, 3.0, 2.0] and row[4] == pytest.approx(100 / 150) and row[5] == 0.0
    assert report is None


def test_preprocess_reports_failure(spark):
    def broken(_):
        raise ValueError("bad schema")

    out, report = preprocess.preprocess(spark.createDataFrame([(1.5,)], ["dur"]), ["dur", "missing_feature"], normalizer=broken)
    assert [list(r) for r in out.collect()] == [[1.5, 0.0]]
    assert report["schema"] == "normalization_failed" and "bad schema" in report["error"]


def test_preprocess_needs_saved_codes(spark):
    with pytest.raises(ValueError, match="saved category codes"):
        preprocess.preprocess(spark.createDataFrame([("tcp",)], ["proto"]), ["proto_num"])
