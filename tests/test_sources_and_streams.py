import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve import vocab
from flowsieve.operators.normalize import normalize_flows
from flowsieve.plans import io_queries
from flowsieve.sources import alert_log, csv, first_lines, manifest
from flowsieve.streaming import events, jobs


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_flow_csv_folder(spark, tmp_path):
    head = "srcip,Attack_Cat ,sbytes\n"
    write(tmp_path / "UNSW_a.csv", head + "1.1.1.1,DoS,5\nbad,row,1,2,3\n2.2.2.2,,7\nshort\n")
    values = {c: str(i) for i, c in enumerate(vocab.RAW_FLOW_COLUMNS)}
    wide = ",".join(values.values())
    narrow = ",".join(v for c, v in values.items() if c not in ("stime", "ltime"))
    write(tmp_path / "deep" / "set_nb15_2.csv", wide + "\n" + wide + "\n")
    write(tmp_path / "deep" / "nb15_three.csv", narrow.replace("13", "café") + "\n", "latin-1")
    write(tmp_path / "UNSW-NB15_GT.csv", head + "9.9.9.9,DoS,5\n")
    write(tmp_path / "other.csv", head + "8.8.8.8,DoS,5\n")
    rows = csv.load_flow_csvs(spark, str(tmp_path)).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["source_file"], []).append(r)
    assert set(by_file) == {"UNSW_a.csv", "set_nb15_2.csv", "nb15_three.csv"}
    first = sorted(by_file["UNSW_a.csv"], key=lambda r: r["source_row"])
    assert [(r["srcip"], r["attack_cat"], r["sbytes"], r["source_row"]) for r in first] == [
        ("1.1.1.1", "DoS", "5", 0), ("2.2.2.2", None, "7", 1), ("short", None, None, 2),
    ]
    assert sorted(r["source_row"] for r in by_file["set_nb15_2.csv"]) == [0, 1]
    assert by_file["set_nb15_2.csv"][0]["stime"] == "28" and by_file["set_nb15_2.csv"][0]["label"] == "48"
    assert by_file["nb15_three.csv"][0]["service"] == "café" and by_file["nb15_three.csv"][0]["stime"] is None


def test_no_flow_csv(spark, tmp_path):
    write(tmp_path / "x.csv", "a\n1\n")
    with pytest.raises(FileNotFoundError):
        csv.load_flow_csvs(spark, str(tmp_path))


def test_encoding_fallback(spark, tmp_path):
    write(tmp_path / "l.csv", "name,v\ncafé,1\n", "latin-1")
    write(tmp_path / "u.csv", "name,v\ncafé,1\n", "utf-8")
    for name in ("l.csv", "u.csv"):
        assert csv.read_with_fallback(spark, str(tmp_path / name), ["name", "v"]).first()["name"] == "café"


def test_row_numbers_over_blocks(spark, tmp_path):
    lines = [f"{i},x" + (",extra" if i % 13 == 0 else "") for i in range(5000)]
    write(tmp_path / "big.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = csv.number_rows(csv.read_text_csv(spark, [str(tmp_path / "big.csv")], ["n", "t"], header=False)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [i for i in range(5000) if i % 13]
    assert [int(r["n"]) for r in sorted(rows, key=lambda r: r["source_row"])] == kept
    assert sorted(r["source_row"] for r in rows) == list(range(len(kept)))


def test_manifest(spark, tmp_path):
    write(tmp_path / "m" / "a.bin", "hello")
    write(tmp_path / "m" / "sub" / "b.bin", "x" * 3_000_000)
    write(tmp_path / "m" / "sub" / "m" / "a.bin", "again")
    got = {r["path"]: r for r in manifest.build_manifest(spark, str(tmp_path / "m")).collect()}
    assert got["a.bin"]["sha256"] == hashlib.sha256(b"hello").hexdigest() and got["sub/b.bin"]["size_bytes"] == 3_000_000
    assert set(got) == {"a.bin", "sub/b.bin", "sub/m/a.bin"} and all(r["exists"] for r in got.values())
    assert {r["path"] for r in manifest.build_manifest(spark, f"file://{tmp_path}/m/").collect()} == set(got)
    actual = manifest.build_manifest(spark, str(tmp_path / "m"))
    expected = spark.createDataFrame(
        [("a.bin", True, 5, "0"), ("sub/b.bin", False, None, None), ("gone", True, 1, "1"), ("never", False, None, None)],
        "path string, exists boolean, size_bytes long, sha256 string",
    )
    found = sorted((r["severity"], r["finding"]) for r in manifest.verify_manifest(actual, expected).collect())
    assert found == [
        ("error", "Artifact missing: gone"),
        ("error", "Artifact sha256 changed: a.bin"),
        ("warning", "Artifact exists but manifest expected missing: sub/b.bin"),
    ]


def test_headers_of_any_width_and_quoting(spark, tmp_path):
    names = [f"column_number_{k}_of_a_header_that_is_far_too_wide" for k in range(2500)]
    write(tmp_path / "UNSW_wide.csv", ",".join([*names, "attack_cat"]) + "\n" + ",".join([str(k) for k in range(2500)] + ["DoS"]) + "\n")
    write(tmp_path / "q" / "nb15_quoted.csv", '"dur, sec",proto,attack_cat\n1.5,tcp,DoS\n')
    write(tmp_path / "q" / "nb15_bom.csv", '\ufeffdur,proto,attack_cat\n2.5,udp,Worms\n')
    rows = {r["source_file"]: r for r in csv.load_flow_csvs(spark, str(tmp_path)).collect()}
    assert rows["UNSW_wide.csv"]["attack_cat"] == "DoS" and rows["UNSW_wide.csv"][names[-1]] == "2499"
    assert rows["nb15_quoted.csv"]["dur,_sec"] == "1.5" and rows["nb15_quoted.csv"]["attack_cat"] == "DoS"
    assert rows["nb15_bom.csv"]["dur"] == "2.5" and rows["nb15_bom.csv"]["attack_cat"] == "Worms"


def test_first_lines_read_little(spark, tmp_path):
    """A header costs the bytes up to its end, whatever the size of the file."""
    write(tmp_path / "UNSW_big.csv", "srcip,attack_cat,sbytes\n" + "1.1.1.1,DoS,5\n" * 400_000)
    write(tmp_path / "nb15_other.csv", "srcip,attack_cat,sbytes\r\n" + "2.2.2.2,DoS,5\r\n" * 400_000)
    write(tmp_path / "nb15_empty.csv", "")
    write(tmp_path / "nb15 one line.csv", "x" * 5000)
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    rows = {r["path"]: r for r in first_lines.read_first_lines(spark, paths).collect()}
    assert rows[str(tmp_path / "UNSW_big.csv")]["first_line"] == rows[str(tmp_path / "nb15_other.csv")]["first_line"] == "srcip,attack_cat,sbytes"
    assert rows[str(tmp_path / "nb15_empty.csv")]["first_line"] == "" and rows[str(tmp_path / "nb15 one line.csv")]["first_line"] == "x" * 5000
    total = sum(p.stat().st_size for p in tmp_path.iterdir())
    assert sum(r["bytes_read"] for r in rows.values()) < 0.01 * total
    listed = {r["path"].rsplit("/", 1)[-1].replace("%20", " ") for r in csv.list_flow_files(spark, str(tmp_path)).collect()}
    assert listed == {p.name for p in tmp_path.iterdir()}


EVENTS = [
    {"src_ip": "10.0.0.5", "dst_ip": "172.16.1.10", "src_port": 52512, "dst_port": 443, "protocol": "tcp", "service": "https", "duration": 1.5, "bytes": 4400, "packets": 25},
    {"Flow Duration": 2500000, "Total Fwd Packets": 4, "Total Backward Packets": 2, "Total Length of Fwd Packets": 300, "Fwd IAT Mean": 5000, "SYN Flag Count": 1},
    {"id.orig_h": "1.1.1.1", "start_time": "2024-01-01 00:00:00", "end_time": "2024-01-01 00:00:07", "orig_bytes": "70", "total_bytes": 100},
    {"duration": 5000, "sent_pkts": 3},
]


@pytest.mark.parametrize("event", EVENTS)
def test_event_rules_equal_batch_rules(spark, event):
    """One JSON event gives the row the batch normaliser gives for a one-row table."""
    batch, plan = normalize_flows(spark.createDataFrame([tuple(event.values())], list(event)))
    live = events.normalize_events(events.parse_events(spark.createDataFrame([(json.dumps(event),)], ["value"])), [])
    want, got = batch.first().asDict(), live.first().asDict()
    for c in live.columns:
        if c in want and c not in ("schema",):
            assert got[c] == pytest.approx(want[c]), c
    assert got["schema"] == plan.schema and got["feature_coverage"] == plan.coverage
    assert got["mapped_columns"] == len(plan.mapped)


def test_empty_and_broken_events_are_dropped(spark):
    from flowsieve.plans.stream_queries import SCORER

    df = spark.createDataFrame([(1, "{}"), (2, "not json"), (3, json.dumps(EVENTS[0]))], ["id", "value"])
    rows = events.score_events(df, SCORER, ["id"]).collect()
    assert [r["id"] for r in rows] == [3] and 0 <= rows[0]["risk"] <= 100


def test_stream_equals_batch_scoring(spark, tmp_path):
    from flowsieve.plans.stream_queries import SCORER

    for i, event in enumerate(EVENTS * 3):
        write(tmp_path / f"e{i}.json", json.dumps({**event, "n": i}) + "\n")
    stream = jobs.read_json_events(spark, str(tmp_path), max_files=2)
    got = jobs.run_available(events.score_events(stream, SCORER, ["value"]), "test-scoring")
    want = events.score_events(spark.read.text(str(tmp_path)), SCORER, ["value"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 12


def files_in_order(spark, df, path, parts):
    """Arrival in time order over several micro-batches."""
    for i, (low, high) in enumerate(parts):
        df.where((F.col("i") >= low) & (F.col("i") < high)).coalesce(1).write.mode("append").parquet(f"{path}/p{i:03d}")
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    )


@pytest.mark.parametrize("window, ttl", [(5, None), (200, None), (7, 0.2)])
def test_streaming_adaptive_is_independent_of_batches(spark, tmp_path, window, ttl):
    """Rows out of order over three files; the window outgrows its blocks; silence forgets an entity."""
    rng = np.random.default_rng(2)
    seconds = np.sort(rng.integers(0, 700, 800))
    rows = [(f"e{i % 3}", i, i, float(s), float(np.round(rng.random(), 2)), bool(rng.random() < 0.7)) for i, s in enumerate(seconds)]
    rows += [("e0", 800, 800, 5000.0, 0.5, True), ("e9", 801, 801, 0.0, float("nan"), True)]
    # arrival order: up to 100 seconds late
    late = sorted(rows, key=lambda r: r[3] + (r[1] * 37) % 100)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(late)], "entity string, n int, row_id long, s double, score double, benign boolean, i int")
    df = df.withColumn("event_ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("s") * 1e6).cast("long"))).drop("n", "s")
    stream = files_in_order(spark, df, str(tmp_path), [(0, 200), (200, 300), (300, 650), (650, 802)])
    judged = jobs.adaptive_thresholds(stream.drop("i"), window=window, target_fpr=0.2, delay="100 seconds", ttl_minutes=ttl)
    got = {r["row_id"]: (r["threshold"], r["exceeds"]) for r in jobs.run_available(judged, "t").collect()}
    buffers, last = {}, {}
    for entity, _, row_id, s, score, benign in sorted(rows, key=lambda r: (r[3], r[2])):
        if s >= 4900:
            continue
        if ttl and s - last.get(entity, s) > ttl * 60:
            buffers[entity] = []
        last[entity] = s
        kept = buffers.setdefault(entity, [])
        limit = float(np.quantile(kept[-window:], 0.8)) if kept else None
        assert got.pop(row_id) == ((pytest.approx(limit), score > limit) if limit is not None else (None, False))
        if benign and np.isfinite(score):
            kept.append(score)
    assert not got


def test_late_rows_are_counted(spark, tmp_path):
    """Every row is in a closed window, late, or in a window that is still open."""
    minutes = [5, 30, 65, 130, 20, 70, 128, 200, 66, 10, 400, 3]
    df = spark.createDataFrame([("a", i, i) for i, _ in enumerate(minutes)], "k string, i int, row_id long").withColumn(
        "event_ts", F.timestamp_seconds(F.lit(1_700_006_400) + 60 * F.get(F.lit(minutes), F.col("i")))
    )
    stream = files_in_order(spark, df, str(tmp_path), [(0, 4), (4, 8), (8, 10), (10, 11), (11, 12)])
    rows = jobs.run_available(jobs.windows_with_late_rows(stream, "k", "event_ts", 60, "10 minutes"), "t").collect()
    counts = {}
    for r in rows:
        slot = (r["window_start"] // 1_000_000 - 1_700_006_400) // 3600, r["kind"]
        counts[slot] = counts.get(slot, 0) + r["rows"]
    # marks before each file: none, 120, 190, 190, 390
    assert counts == {(0, "closed"): 2, (1, "closed"): 1, (2, "closed"): 2, (3, "closed"): 1, (0, "late"): 3, (1, "late"): 2}


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(jobs.STATE_STORE)
    with jobs.state_store(spark):
        assert spark.conf.get(jobs.STATE_STORE) == jobs.ROCKS_DB
    assert spark.conf.get(jobs.STATE_STORE) == before


def test_streaming_incidents_span_batches(spark, tmp_path):
    minutes = [0, 5, 14, 16, 18, 40, 41, 90, 200]
    rows = [("Service", "dns", i, i % 2, 50 + i) for i, _ in enumerate(minutes)]
    base = 1_700_000_000
    df = spark.createDataFrame(rows, "group_type string, key string, i int, ood int, risk int").withColumn(
        "event_ts", F.timestamp_seconds(F.lit(base) + F.get(F.lit([m * 60 for m in minutes]), F.col("i")))
    ).withColumn("t", F.unix_micros("event_ts"))
    stream = files_in_order(spark, df, str(tmp_path), [(0, 2), (2, 4), (4, 6), (6, 9)])
    rows = jobs.run_available(jobs.anchored_incidents(stream.drop("i"), min_alerts=1), "t").collect()
    got = sorted(((r["start"] // 1_000_000 - base) // 60, (r["last"] // 1_000_000 - base) // 60, r["alert_count"]) for r in rows)
    assert got == [(0, 14, 3), (16, 18, 2), (40, 41, 2), (90, 90, 1)]


def test_streaming_incidents_reorder_late_rows(spark, tmp_path):
    """Rows that are late within the delay open or join the cluster of their own time."""
    minutes = [20, 21, 12, 13, 15, 11, 29, 36, 33, 31, 120, 300]
    base = 1_700_000_000
    rows = [("Service", "dns", i, 0, i) for i, _ in enumerate(minutes)]
    df = spark.createDataFrame(rows, "group_type string, key string, i int, ood int, risk int").withColumn(
        "event_ts", F.timestamp_seconds(F.lit(base) + F.get(F.lit([m * 60 for m in minutes]), F.col("i")))
    ).withColumn("t", F.unix_micros("event_ts"))
    stream = files_in_order(spark, df, str(tmp_path), [(0, 2), (2, 6), (6, 7), (7, 10), (10, 11), (11, 12)])
    rows = jobs.run_available(jobs.anchored_incidents(stream.drop("i"), min_alerts=1), "t").collect()
    got = sorted(((r["start"] // 1_000_000 - base) // 60, (r["last"] // 1_000_000 - base) // 60, r["alert_count"]) for r in rows)
    assert got == [(11, 21, 6), (29, 36, 4), (120, 120, 1)]


def test_alert_log_of_two_streams(spark, tmp_path):
    """A second stream with a checkpoint of its own adds to the log; a restarted one adds nothing twice."""
    df = spark.createDataFrame([(f"A-{k}", k) for k in range(3)], "alert_id string, seq long").withColumn(
        "created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    ).withColumns({"event_type": F.lit("saved"), "status": F.lit("new")})
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    for checkpoint in ("one", "two", "one"):
        jobs.append_alert_log(stream, log, str(tmp_path / checkpoint)).awaitTermination()
    alert_log.append_events(df.withColumn("event_type", F.lit("status_updated")).withColumn("status", F.lit("closed")), log)
    stored = alert_log.read_events(spark, log)
    assert stored.count() == 9 and stored.select("alert_id").distinct().count() == 3
    assert {r["stream"] for r in stored.collect()} > {"batch"}


def test_work_dir_needs_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from flowsieve.session import work_dir

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(cluster)


def test_events_with_repeated_and_null_fields(spark):
    """Names that clean to the same field, null values and unknown fields do not break a stream."""
    raw = [
        '{"Src IP": "1.1.1.1", "src-ip": "2.2.2.2", "duration": null, "bytes": 10}',
        '{"protocol": null, "x": {"deep": [1, 2]}, "sent_bytes": "n/a"}',
    ]
    df = spark.createDataFrame([(r,) for r in raw], ["value"])
    rows = events.normalize_events(events.parse_events(df), []).collect()
    assert rows[0]["srcip"] == "2.2.2.2" and rows[0]["dur"] == 0.0 and rows[0]["sbytes"] == 5.0
    assert rows[1]["proto"] == "unknown" and rows[1]["sbytes"] == 0.0 and rows[1]["mapped_columns"] == 2


ODD_NAMES = ["nb15 one two.csv", "nb15%20x.csv", "nb15 [1].csv", "nb15_{a}*?.csv", "nb15#1&ü+.csv"]


def test_files_with_odd_names(spark, tmp_path):
    """Blanks, percent signs and pattern characters in a name stand for themselves, and each file is read as itself."""
    write(tmp_path / "nb15 x.csv", "srcip,attack_cat\nplain,DoS\n")  # what the name with %20 would be if it were decoded
    write(tmp_path / "nb15 1.csv", "srcip,attack_cat\nplain,DoS\n")  # what [1] would match
    for name in ODD_NAMES:
        write(tmp_path / name, f"srcip,attack_cat,{'x' * len(name)}\n{name},DoS,1\n")
    paths = [str(tmp_path / name) for name in ODD_NAMES]
    got = {r["path"]: r["first_line"] for r in first_lines.read_first_lines(spark, [*paths, f"file:{paths[0]}"]).collect()}
    assert got == {p: f"srcip,attack_cat,{'x' * len(p.rsplit('/', 1)[-1])}" for p in paths} | {f"file:{paths[0]}": got[paths[0]]}
    assert sorted(r["srcip"] for r in csv.load_flow_csvs(spark, str(tmp_path)).collect()) == sorted([*ODD_NAMES, "plain", "plain"])
    hashed = {r["path"]: r["sha256"] for r in manifest.build_manifest(spark, str(tmp_path)).collect()}
    assert all(hashed[name] == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest() for name in ODD_NAMES) and len(hashed) == 7


def test_empty_files_are_listed(spark, tmp_path):
    """Spark's scans pass empty files over; a manifest without them would call them missing."""
    write(tmp_path / "nb15 empty.csv", "")
    write(tmp_path / "nb15_full.csv", "srcip,attack_cat\n1.1.1.1,DoS\n")
    listed = {r["path"].rsplit("/", 1)[-1]: r["length"] for r in csv.list_flow_files(spark, str(tmp_path)).collect()}
    assert listed == {"nb15 empty.csv": 0, "nb15_full.csv": 29}
    actual = manifest.build_manifest(spark, str(tmp_path))
    assert {r["path"]: r["sha256"] for r in actual.collect()}["nb15 empty.csv"] == hashlib.sha256(b"").hexdigest()
    expected = spark.createDataFrame([("nb15 empty.csv", True, 9, None)], "path string, exists boolean, size_bytes long, sha256 string")
    found = {r["finding"] for r in manifest.verify_manifest(actual, expected).collect()}
    assert found == {"Artifact size changed: nb15 empty.csv", "Artifact sha256 changed: nb15 empty.csv"}
    assert [r["srcip"] for r in csv.load_flow_csvs(spark, str(tmp_path)).collect()] == ["1.1.1.1"]


def test_wanted_columns_of_wide_files_alone_are_stored(spark, tmp_path, monkeypatch):
    extra = [f"c{k}" for k in range(300)]
    lines = [",".join(["srcip", "attack_cat", *extra]), ",".join(["1.1.1.1", "DoS", *["0"] * 300]), "2.2.2.2", '"3.3.3.3",Normal,x']
    lines += [",".join(["too", "long", *["0"] * 301]), ",".join(["4.4.4.4", "", *["0"] * 300])]
    (tmp_path / "UNSW_a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "UNSW_b.csv").write_text("srcip,attack_cat\n5.5.5.5,Worms\n")
    whole = csv.load_flow_csvs(spark, str(tmp_path)).select("srcip", "attack_cat", "source_file", "source_row").collect()
    stored = []
    monkeypatch.setattr(csv, "durable", lambda df, label, kept=csv.durable: stored.append(df.columns) or kept(df, label))
    some = csv.load_flow_csvs(spark, str(tmp_path), columns=["srcip", "attack_cat", "c299"])
    assert sorted(map(str, some.select("srcip", "attack_cat", "source_file", "source_row").collect())) == sorted(map(str, whole))
    assert len(whole) == 5 and max(map(len, stored)) == 7
    assert {r["srcip"]: r["c299"] for r in some.collect()}["1.1.1.1"] == "0"


def test_lines_are_written_below_a_header_in_every_file(spark, tmp_path):
    lines = spark.range(0, 40, 1, 4).selectExpr("concat(id, ',x') AS value")
    io_queries._write_lines(lines, "id,attack_cat", str(tmp_path / "some"))
    files = [f.read_text().splitlines() for f in (tmp_path / "some").glob("part-*")]
    assert len(files) == 4 and all(f[0] == "id,attack_cat" and len(f) == 11 for f in files)
    io_queries._write_lines(lines.where("value IS NULL"), "id,attack_cat", str(tmp_path / "none"))
    assert [f.read_text() for f in (tmp_path / "none").glob("part-*")] == ["id,attack_cat\n"]
