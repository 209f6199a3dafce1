"""Decisions, calibration, evaluation, curves: exact values and forced large-table paths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions import labels, scoring
from flowsieve.functions.scoring import Decision, HybridWeights
from flowsieve.operators import drift, evaluate, ordered, prepare, sampling, thresholds


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def decide(spark, decision, ae, top, hybrid):
    df = one(spark, ae=ae, p=top, h=hybrid)
    return df.select(decision.flag(F.col("ae"), F.col("p"), F.col("h"))).first()[0], decision.rule


def test_decision_modes(spark):
    assert decide(spark, Decision(), 0.8, 0.4, 0.7) == (True, "ae_plus_confidence_fallback")
    assert decide(spark, Decision(hybrid=0.5), 0.1, 0.9, 0.8) == (True, "hybrid_calibrated")
    assert decide(spark, Decision(hybrid=0.3), 0.1, 0.9, 0.4) == (True, "hybrid_calibrated")
    vote = Decision(hybrid=0.5, ae_re=0.5, softmax=0.5, mode="vote", min_votes=2)
    assert decide(spark, vote, 0.9, 0.4, 0.8) == (True, "vote_2_of_3")
    assert decide(spark, vote, 0.2, 0.9, 0.3) == (False, "vote_2_of_3")
    with pytest.raises(ValueError, match="min_votes must be positive"):
        Decision(hybrid=0.5, mode="vote", min_votes=0)


def test_verdicts_truth_and_risk(spark):
    df = one(spark, z=True, n=False, normal="Normal", dos="DoS", benign="benign", ex="Exploit", h=0.9, a=0.8, sev="HIGH")
    row = df.select(
        scoring.verdict(F.col("z"), F.col("normal")),
        scoring.verdict(F.col("n"), F.col("normal")),
        scoring.verdict(F.col("n"), F.col("dos")),
        labels.truth_verdict(F.col("benign")),
        labels.truth_verdict(F.col("ex")),
        scoring.risk_score(F.col("h"), F.col("a"), F.col("z"), F.col("sev")),
    ).first()
    assert list(row)[:5] == ["Zero-Day Candidate", "Normal", "Known-Attack", "Normal", "Known-Attack"]
    assert row[5] == 92


def test_risk_rounds_half_to_even(spark):
    # 10 + 45 * 0.1 = 14.5 -> 14 ; 10 + 45 * 0.3 = 23.5 -> 24
    df = spark.createDataFrame([(0.1,), (0.3,)], ["h"])
    got = [r[0] for r in df.select(scoring.risk_score(F.col("h"), F.lit(0.0), F.lit(False), F.lit(""))).collect()]
    assert got == [14, 24]


def test_hybrid_orders(spark):
    df = spark.createDataFrame([(0.1, 0.95), (1.0, 0.5)], ["ae", "p"])
    score = scoring.hybrid_score(F.col("ae"), F.col("p"), HybridWeights(3.0, 2.0, -2.0))
    low, high = [r[0] for r in df.select(score).collect()]
    assert low < high


def test_labelled_metrics(spark):
    rows = [
        ("Normal", "Normal", False, 0.1, "Normal"),
        ("Known-Attack", "DoS", False, 0.7, "DoS"),
        ("Zero-Day Candidate", "Normal", True, 0.8, "Shellcode"),
        ("Known-Attack", "Exploits", False, 0.6, "DoS"),
    ]
    df = spark.createDataFrame(rows, ["predicted_class", "classifier_class", "is_zeroday", "hybrid", "attack_cat"])
    summary = evaluate.labelled_evaluation(df, "attack_cat").first()
    assert summary["detection_accuracy"] == 1.0 and summary["ood_detection_rate"] == 1.0
    recall = {r["label"]: r["recall"] for r in evaluate.recall_per_class(df, "attack_cat").collect()}
    assert recall == {"Normal": 1.0, "DoS": 0.5, "Shellcode": 1.0}
    rates = evaluate.fpr_and_detection(df, "attack_cat").first()
    assert rates["normal_false_positive_rate"] == 0.0 and rates["attack_detection_rate"] == 1.0


def test_calibration_reference_rows(spark):
    df = spark.createDataFrame(
        [(0.1, 0.2, 0.1, "Benign"), (0.2, 0.3, 0.2, "Benign"), (0.9, 0.9, 0.9, "Attack"), (0.8, 0.7, 0.8, "Attack")],
        ["hybrid", "ae_re", "softmax", "label"],
    )
    found = {r["score"]: r for r in thresholds.calibrate(df, target_fpr=0.5, label_col="label").collect()}
    assert found["hybrid"]["reference_rows"] == 2 and found["hybrid"]["threshold"] == pytest.approx(0.15)
    no_benign = thresholds.calibrate(df.where("label = 'Attack'"), target_fpr=0.5, label_col="label").first()
    assert no_benign["reference_rows"] == 2
    with pytest.raises(ValueError, match="No reference rows"):
        thresholds.calibrate(df.limit(0), label_col="label")


@pytest.mark.parametrize("limit", [20, 300, 1_000_000])
def test_exact_quantiles_any_size(spark, limit):
    rng = random.Random(5)
    # a third of the rows share one value
    values = [0.25 if rng.random() < 0.34 else rng.gauss(0, 1) for _ in range(4001)]
    rows = [(v, float("nan") if i % 50 == 0 else v * 3, None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = ordered.exact_quantiles(df, ["a", "b", "c"], probs, limit)
    assert got["a"] == pytest.approx(list(np.quantile(values, probs)))
    assert got["b"] == pytest.approx(list(np.quantile([r[1] for r in rows if r[1] == r[1]], probs)))
    assert got["c"] == [None] * len(probs)


def test_prefix_sums_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(50), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, i int, v int")
    got = {r["i"]: r["cum_v"] for r in ordered.prefix_sums(df, ["t", "i"], ["v"], ["g"]).collect()}
    want, running = {}, {}
    for g, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        running[g] = running.get(g, 0) + v
        want[i] = running[g]
    assert got == want


def brute_adaptive(rows, window, fpr, seed):
    out, buffers = {}, {}
    for e, _, i, score, benign in sorted(rows, key=lambda r: (r[1], r[2])):
        buffer = buffers.setdefault(e, list(seed))
        limit = float(np.quantile(buffer[-window:], 1 - fpr)) if buffer else None
        out[i] = (limit, limit is not None and score > limit)
        if benign:
            buffer.append(score)
    return out


@pytest.mark.parametrize("seed", [(), (0.2, 0.4, 0.9)])
@pytest.mark.parametrize("chunk", [3, 50])
def test_adaptive_thresholds_chunks(spark, seed, chunk):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"e{rng.randrange(4)}", rng.randrange(200), i, rng.random(), rng.random() < 0.6) for i in range(600)]
    df = spark.createDataFrame(rows, "entity string, t int, i int, score double, benign boolean")
    out = thresholds.adaptive_thresholds(df, "entity", ["t", "i"], "score", F.col("benign"), seed, window=7, target_fpr=0.2, chunk=chunk)
    got = {r["i"]: (r["threshold"], r["exceeds"]) for r in out.collect()}
    want = brute_adaptive(rows, 7, 0.2, seed)
    assert got.keys() == want.keys()
    for i, (limit, flag) in want.items():
        assert got[i][1] == flag and (got[i][0] == pytest.approx(limit) if limit is not None else got[i][0] is None)


def test_adaptive_window_slides(spark):
    # window 3: quantile of [1,2,3], then of [2,3,9]
    df = spark.createDataFrame([("e", k, float(v), True) for k, v in enumerate([1, 2, 3, 9, 0])], "entity string, i int, score double, benign boolean")
    out = thresholds.adaptive_thresholds(df, "entity", ["i"], "score", F.col("benign"), window=3, target_fpr=0.5)
    got = [r["threshold"] for r in out.orderBy("i").collect()]
    assert got == [None, 1.0, 1.5, 2.0, 3.0]


def test_ranking_treats_zero_fpr_as_best(spark):
    rows = [("a", 0.9, 0.5, 0.0), ("b", 0.9, 0.5, 0.2), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "method string, auroc double, ood_detection_rate double, normal_fpr double")
    assert [r["method"] for r in evaluate.rank_methods(df).orderBy("rank").collect()] == ["a", "b", "c"]


def test_auc_without_both_classes(spark):
    df = spark.createDataFrame([("m", 0.1, 0), ("m", 0.2, 0)], ["method", "score", "target"])
    areas = evaluate.curve_areas(evaluate.score_curve(df)).first()
    assert areas["auc"] == 0.5 and areas["average_precision"] == 0.0


def test_stratified_sizes_and_fallback(spark):
    rows = [(i, "Normal" if i < 20 else "DoS") for i in range(40)]
    out = sampling.stratified_split(spark.createDataFrame(rows, ["id", "c"]), "c", "id")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 28, "validation": 4, "test": 8}
    tiny = spark.createDataFrame(rows[:30] + [(100, "Worms")], ["id", "c"])
    out = sampling.stratified_split(tiny, "c", "id")
    assert out.where("split = 'test'").count() == 6


def test_hot_group_sample_is_whole(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(9000)]
    got = sampling.stable_sample(spark.createDataFrame(rows, ["id", "g"]), 2000, "id", ["g"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"hot": 2000, "cold": 2000}


def test_resample_balances_classes(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(20000)]
    df = prepare.class_weights(spark.createDataFrame(rows, ["id", "c"]), "c")
    got = {r["c"]: r["count"] for r in sampling.weighted_resample(df, "weight", "id").groupBy("c").count().collect()}
    assert abs(got["a"] - 10000) < 500 and abs(got["b"] - 10000) < 500
    again = sampling.weighted_resample(df, "weight", "id").count()
    assert again == sum(got.values())


def test_poisson_counts(spark):
    df = spark.range(20000)
    for mean in (0.3, 4.0, 30.0, 31.0, 100.0, 2000.0):
        row = df.select(sampling.poisson_draw("id", "7", F.lit(mean)).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
        assert row[0] == pytest.approx(mean, rel=0.02) and row[1] == pytest.approx(mean, rel=0.05)


def test_zero_range_feature_scales_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], ["x", "k"])
    fitted = prepare.robust_fit(df, ["x", "k"])
    assert fitted == {"x": (2.0, 1.0), "k": (5.0, 1.0)}
    wild = spark.createDataFrame([(float("inf"), None), (float("nan"), 5.0)], "x double, k double")
    assert [list(r) for r in prepare.robust_scale(wild, fitted).collect()] == [[10.0, 0.0], [0.0, 0.0]]


def test_class_multipliers():
    assert prepare.class_multipliers({"DoS": 5}, ["DoS", "Normal"]) == {"DoS": 5.0}
    with pytest.raises(ValueError, match="Nope"):
        prepare.class_multipliers({"DoS": 5, "Nope": 2}, ["DoS"])
    with pytest.raises(ValueError, match="positive"):
        prepare.class_multipliers({"DoS": 0}, ["DoS"])


def test_adaptive_thresholds_skip_scores_that_are_no_numbers(spark):
    """Same answers as a walk over the rows; broken benign scores are judged but never history."""
    nan = float("nan")
    scores = [(1.0, 1), (nan, 1), (9.0, 0), (2.0, 1), (None, 1), (float("inf"), 1), (9.0, 0), (nan, 0), (1.5, 0), (3.0, 1), (2.5, 0)]
    rows = [("e", i, s, b) for i, (s, b) in enumerate(scores)] + [("f", 0, nan, 1), ("f", 1, 5.0, 0), (None, 0, 1.0, 1), (None, 1, 2.0, 0)]
    df = spark.createDataFrame(rows, "entity string, i long, score double, benign int")
    for seed in ([], [0.5, 4.0]):
        got = thresholds.adaptive_thresholds(df, "entity", ["i"], "score", F.col("benign"), seed=seed, window=3, chunk=2).collect()
        want = {}
        for entity in ("e", "f", None):
            kept = list(seed)[-3:]
            for _, i, score, is_benign in (r for r in rows if r[0] == entity):
                want[entity, i] = float(np.quantile(kept, 0.95)) if kept else None
                if is_benign and score is not None and np.isfinite(score):
                    kept = (kept + [score])[-3:]
        for r in got:
            limit = want[r["entity"], r["i"]]
            assert r["threshold"] == (None if limit is None else pytest.approx(limit))
            real = r["score"] is not None and r["score"] == r["score"]
            assert not real or r["exceeds"] == (limit is not None and r["score"] > limit)
        assert len(got) == len(rows)


def test_curve_ignores_scores_that_are_no_numbers(spark):
    rows = [("m", 0.9, 1), ("m", 0.2, 0), ("m", float("nan"), 0), ("m", None, 1), ("m", float("inf"), 0)]
    areas = evaluate.curve_areas(evaluate.score_curve(spark.createDataFrame(rows, "method string, score double, target int"))).first()
    assert areas["auc"] == 1.0 and areas["average_precision"] == 1.0


def test_drift_level_follows_severity_not_wording(spark):
    def report(name, **extra):
        moved = spark.createDataFrame([(name, "p95", 2.0, 4.0)], "score string, statistic string, current double, ratio double")
        rate = spark.createDataFrame([(0.1,)], "zero_day_rate double")
        return drift.drift_report(moved, rate, rate, **{"coverage": 0.7, **extra}).first()

    assert report("hybrid")["level"] == report("flow_score")["level"] == "MEDIUM"
    assert report("flow_score", coverage=0.5)["level"] == "HIGH"
    alone = drift.drift_report(None, None, spark.createDataFrame([(0.1,)], "zero_day_rate double"), coverage=0.9).first()
    assert alone["level"] == "MEDIUM" and not alone["reference_available"] and len(alone["warnings"]) == 1


def test_rank_next_to_a_heavy_value(spark):
    """The rank right after a value most rows share, and right before it."""
    values = [0.0] * 700 + [float(i) for i in range(1, 201)] + [-float(i) for i in range(1, 101)]
    df = spark.createDataFrame([(v,) for v in values], ["x"])
    ranked = sorted(values)
    wanted = [0, 99, 100, 799, 800, 801, 999]
    assert ordered.order_statistics(df, {"x": wanted}, 5)["x"] == [ranked[k] for k in wanted]


def test_reference_falls_back_to_whole_prefix(spark):
    df = spark.createDataFrame([(0, "DoS", 0.1), (1, "DoS", 0.3), (2, "Normal", 0.9)], ["i", "label", "s"])
    part = evaluate.reference_rows(df, F.col("i") < 2, "label")
    assert part.count() == 2
    assert evaluate.reference_rows(df, F.col("i") < 3, "label").count() == 1
    assert evaluate.method_thresholds(part, ["s", "i"], 0.5, flags=["i"]) == {"s": pytest.approx(0.2), "i": 0.5}


def test_best_method_without_threshold(spark):
    rows = [("m", float(v), t, f) for v, t, f in [(1, 0, "Normal"), (2, 0, "Normal"), (3, 1, "Worms"), (1.5, 1, "Worms")]]
    long = spark.createDataFrame(rows, ["method", "score", "target", "family"])
    areas = evaluate.curve_areas(evaluate.score_curve(long))
    got = evaluate.best_method_recall(long, areas, {}, "family").first()
    assert (got["family"], got["recall"], got["support"]) == ("Worms", 0.5, 2)


def test_numeric_features_from_schema(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3.0, "tcp", 1.0, 5)], ["id", "note", "dur", "label", "proto", "proto_num", "sport"])
    assert prepare.numeric_features(df) == ["dur", "proto_num"]
