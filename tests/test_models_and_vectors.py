import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.scoring import Decision, HybridWeights
from flowsieve.operators import forest, graph, models, neighbors, sketches
from flowsieve.plans import vector_queries
from flowsieve.sources import state
from flowsieve.streaming.scorer import LinearScorer


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8)) * 4
    rows = [(i, [float(x) for x in centers[i % 6] + rng.normal(size=8)]) for i in range(900)]
    # a third of the rows are copies of one vector
    rows += [(900 + i, rows[0][1]) for i in range(450)]
    rows.append((5000, [0.0] * 8))
    return rows, spark.createDataFrame(rows, "id long, v array<double>")


def unit(rows):
    x = np.array([r[1] for r in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("block", [40, 10_000])
@pytest.mark.parametrize("include_self", [True, False])
def test_knn_is_exact_with_copies(spark, cloud, block, include_self):
    rows, df = cloud
    got = {r["id"]: r["knn_distance"] for r in neighbors.knn_distance(df, df, "id", "v", 7, include_self, block).collect()}
    u = unit(rows)
    distance = 1 - u @ u.T
    if not include_self:
        np.fill_diagonal(distance, np.inf)
    want = np.sort(distance, axis=1)[:, :7].mean(axis=1)
    assert len(got) == len(rows)
    assert [got[r[0]] for r in rows] == pytest.approx(list(want), abs=1e-9)


def test_lof_many_cells_equals_one_cell(spark, cloud):
    _, df = cloud
    part = df.where("id < 900")
    many = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(part, part.where("id % 2 = 0"), "id", "v", 9, 30).collect()}
    one = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(part, part.where("id % 2 = 0"), "id", "v", 9, 10_000).collect()}
    assert many.keys() == one.keys()
    assert [many[k] for k in one] == pytest.approx([one[k] for k in one], rel=1e-6)


@pytest.mark.parametrize("room", [1 << 20, 3000])
def test_neighbour_search_stores_a_row_for_each_row(spark, cloud, monkeypatch, room):
    """Whatever the cells and parts: no table holds more rows than there are, and lists join over the parts."""
    rows, df = cloud
    stored = {}

    def counted(frame, label, kept=neighbors.durable):
        out = kept(frame, label)
        stored[label] = max(stored.get(label, 0), out.count())
        return out

    monkeypatch.setattr(neighbors, "durable", counted)
    monkeypatch.setattr(neighbors, "PASS_BYTES", room, raising=False)
    got = {}
    for r in neighbors.nearest_rows(df, "id", "v", 5, 30).collect():
        got.setdefault(r["query_id"], []).append((round(r["distance"], 12), r["ref_id"]))
    assert max(stored.values()) <= len(rows)
    u, ids = unit(rows), np.array([r[0] for r in rows])
    distance = 1 - u @ u.T
    for i in range(0, len(rows), 7):
        others = sorted((round(float(d), 9), int(j)) for d, j in zip(distance[i], ids, strict=True) if j != ids[i])[:5]
        assert sorted(j for _, j in got[int(ids[i])]) == sorted(j for _, j in others) or [d for d, _ in sorted(got[int(ids[i])])] == pytest.approx([d for d, _ in others], abs=1e-9)


def test_neighbours_of_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (None, [1.0, 1.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {}
    for r in neighbors.nearest_rows(df, "id", "v", 2, 1).collect():
        got.setdefault(r["query_id"], []).append(r["ref_id"])
    assert sorted(got[1]) in ([2, 2], [2, 3], [3, 3]) and sorted(got[2]) == [1, 1] and None in got and len(got[None]) == 2


def test_prototype_similarity_separates(spark):
    rows = [(0, [1.0, 0.1]), (0, [0.9, 0.0]), (1, [0.0, 1.0]), (1, [0.1, 0.8])]
    df = spark.createDataFrame(rows, "y int, v array<double>")
    got = neighbors.prototype_similarity(df, "v", "y", [(0, 1)]).first()
    assert -1 <= got["similarity"] < 0.3
    with pytest.raises(ValueError, match="at least one sample"):
        neighbors.prototype_similarity(df, "v", "y", [(0, 7)])


def test_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    rows += [(1000 + i, 9.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(rows, ["id", "x", "y"])
    grown = forest.fit_forest(df.where("id < 600"), ["x", "y"], "id", trees=50, sample_rows=64)
    assert grown.select("tree").distinct().count() == 50
    scored = forest.score_forest(df, grown, ["x", "y"], 64, ["id"])
    top = [r["id"] for r in scored.orderBy(F.desc("isolation_forest")).limit(5).collect()]
    assert sorted(top) == [1000, 1001, 1002, 1003, 1004] and scored.count() == 605


def test_hybrid_learner_orders_scores(spark):
    rows = [(0.1, 0.95, 0), (0.2, 0.9, 0), (0.15, 0.92, 0), (1.0, 0.5, 1), (1.2, 0.4, 1), (0.9, 0.45, 1)]
    df = spark.createDataFrame(rows, ["ae_re", "max_prob", "y"])
    weights = models.fit_hybrid(df, F.col("y") == 1)
    assert weights.ae_re > 0 and weights.softmax > 0
    with pytest.raises(ValueError, match="requires known validation and zero-day"):
        models.fit_hybrid(df.where("y = 0"), F.col("y") == 1)


def test_centroids_of_all_classes_at_once(spark):
    """Small, identical and missing classes; centres are the means of the rows they are nearest to."""
    rng = np.random.default_rng(3)
    rows = [("a", [float(i), 1.0]) for i in range(30)] + [("b", [1.0, 2.0])] + [("c", [3.0, 3.0])] * 9 + [(None, [0.0, 1.0]), (None, [1.0, 0.0]), ("a", None)]
    angles = np.concatenate([rng.normal(m, 0.02, 50) for m in (0.0, 1.0, 2.0, 3.0)])
    rows += [("d", [float(np.cos(x)), float(np.sin(x))]) for x in angles]
    got = models.build_centroids(spark.createDataFrame(rows, "c string, v array<double>"), "v", "c", k=4).collect()
    by_class = {}
    for r in got:
        by_class.setdefault(r["class"], []).append(r["centroid"])
    assert {k: len(v) for k, v in by_class.items()} == {"a": 4, "b": 1, "c": 1, "d": 4, None: 2}
    for name, centers in by_class.items():
        units = unit([r for r in rows if r[0] == name and r[1] is not None])
        centers = np.array(centers)
        nearest = ((units[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        for k in range(len(centers)):
            assert centers[k] == pytest.approx(units[nearest == k].mean(axis=0), abs=1e-9)
    # separated groups are found one by one
    found = sorted(np.arctan2([c[1] for c in by_class["d"]], [c[0] for c in by_class["d"]]) % (2 * np.pi - 0.5))
    assert found == pytest.approx([0.0, 1.0, 2.0, 3.0], abs=0.05)


def test_centroid_steps_store_no_table_while_centres_are_few(spark, monkeypatch):
    """A step is one job; with too many centres for every task the tables of the other way give the same."""
    rng = np.random.default_rng(12)
    rows = [("ab"[i % 2], [float(x) for x in p]) for i, p in enumerate(rng.normal(size=(300, 3)))] + [(None, [1.0, 0.0, 0.0])] * 3
    df = spark.createDataFrame(rows, "c string, v array<double>")
    stored = []
    monkeypatch.setattr(models, "durable", lambda frame, label, kept=models.durable: stored.append(label) or kept(frame, label))
    few = {(r["class"], r["cluster"]): r["centroid"] for r in models.build_centroids(df, "v", "c", k=3, max_rounds=6, seed_rounds=1).collect()}
    assert stored.count("centers") == 1
    monkeypatch.setattr(models, "CENTER_BYTES", 0)
    many = {(r["class"], r["cluster"]): r["centroid"] for r in models.build_centroids(df, "v", "c", k=3, max_rounds=6, seed_rounds=1).collect()}
    assert few.keys() == many.keys() and len(few) == 7
    assert all(few[key] == pytest.approx(many[key], abs=1e-9) for key in few)


def test_neighbor_graph_finds_most_with_few_comparisons(spark):
    rng = np.random.default_rng(6)
    basis = rng.normal(size=(5, 24))
    points = rng.normal(size=(3000, 5)) @ basis
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(None, [1.0] * 24), (9999, None)], "id long, v array<double>")
    found = graph.neighbor_graph(df, "id", "v", k=10, sample=8, block=48, directions=3, settled=0.01)
    got = {}
    for r in found.pairs.collect():
        assert r["query_id"] != r["ref_id"]
        got.setdefault(r["query_id"], {})[r["ref_id"]] = r["distance"]
    u = points / np.linalg.norm(points, axis=1, keepdims=True)
    distance = 1 - u @ u.T
    np.fill_diagonal(distance, np.inf)
    best = np.argsort(distance, axis=1)[:, :10]
    recall = np.mean([len(got[i].keys() & set(best[i].tolist())) / 10 for i in range(3000)])
    assert recall >= 0.9 and all(len(v) == 10 for v in got.values()) and len(got) == 3000
    assert found.compared < 0.2 * 3000 * 2999 / 2
    some = got[5]
    assert all(some[j] == pytest.approx(distance[5, j], abs=1e-9) for j in some)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_short_lists_are_compared_together(metric):
    """Lists of any length that batches cut anywhere, against one at a time."""
    rng = np.random.default_rng(9)
    sizes = [1, 7, 2, 12, 1, 5, 9]
    center = np.repeat(np.arange(7) * 3, sizes)
    ids = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in sizes])
    vectors = rng.normal(size=(40, 5)).astype("float32")
    rows = pd.DataFrame({"center": center, "id": ids, "vector": list(vectors[ids]), "fresh": rng.random(len(ids)) < 0.5, "bound": rng.uniform(0.5, 2.5, len(ids))})
    cuts = [0, 3, 4, 20, 21, len(rows)]
    found = pd.concat(graph._local_joins(4, metric)(rows.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)))
    got = sorted((int(q), int(r), round(d, 9)) for q, r, d in zip(found["query_id"], found["ref_id"], found["distance"], strict=True))
    x = vectors.astype("float64")
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    distance = 1 - x @ x.T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for _, group in rows.groupby("center"):
        for _, q in group.iterrows():
            near = [(distance[q["id"], r["id"]], r["id"]) for _, r in group.iterrows() if r["id"] != q["id"] and (q["fresh"] or r["fresh"])]
            want += [(q["id"], j, round(d, 9)) for d, j in sorted(p for p in near if p[0] < q["bound"])[:4]]
    assert got == sorted(want)


def test_neighbor_graph_of_small_tables(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, v array<double>")
    pairs = graph.neighbor_graph(df, "id", "v", k=3).pairs.collect()
    assert sorted((r["query_id"] for r in pairs)) == sorted(list(range(5)) * 3)
    assert graph.neighbor_graph(df.where("id < 0"), "id", "v", k=3).pairs.count() == 0


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=20_000), np.full(10_000, 0.25)])
    rows = [(i % 7, float(v)) for i, v in enumerate(values)] + [(0, float("inf")), (1, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "part int, x double")
    parts = sketches.sketch_scores(df, ["x"], {"part": F.col("part")})
    assert parts.count() == 7
    probs = {f"p{k}": k / 20 for k in range(21)}
    row = sketches.sketch_quantiles(sketches.merge_sketches(parts), probs).first()
    assert row["rows"] == 30_000 and row["p0"] == values.min() and row["p20"] == values.max()
    for name, p in probs.items():
        below, upto = np.mean(values < row[name]), np.mean(values <= row[name])
        assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR
    for limit in (-9.0, 0.25, 1.5, 9.0):
        share = sketches.merge_sketches(parts).select(sketches.share_above({"x": limit}).alias("s")).first()["s"]
        assert share == pytest.approx(np.mean(values > limit), abs=sketches.RANK_ERROR)


def test_registry_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert state.state_versions(spark, path).count() == 0
    with pytest.raises(KeyError, match="no saved state"):
        state.load_state(spark, path, "centroids")
    for n in (1, 2):
        assert state.save_state(spark, path, "centroids", spark.range(n)) == n
    rows = [(i, float(i), float(-i), "a" if i < 5 else "b") for i in range(10)]
    train = spark.createDataFrame(rows, "id long, x double, y double, c string")
    model = models.fit_classifier(train, ["x", "y"], "c", ["a", "b"], max_iter=5)
    assert state.save_state(spark, path, "classifier", model) == 1
    assert state.load_state(spark, path, "centroids").count() == 2 and state.load_state(spark, path, "centroids", 1).count() == 1
    back = state.load_state(spark, path, "classifier")
    probs = [[r["probs"] for r in models.class_probabilities(train, m, ["x", "y"]).orderBy("id").collect()] for m in (model, back)]
    assert probs[0] == probs[1]
    with pytest.raises(ValueError, match="no such kind of model"):
        state.save_state(spark, path, "odd", object())
    assert sorted((r["kind"], r["version"], r["format"]) for r in state.state_versions(spark, path).collect()) == [
        ("centroids", 1, "table"), ("centroids", 2, "table"), ("classifier", 1, "LogisticRegressionModel"),
    ]


def test_ensemble_members_differ_and_perceptron_bends(spark):
    rng = np.random.default_rng(8)
    points = rng.uniform(-1, 1, size=(1500, 2))
    rows = [(i, float(x), float(y), "in" if x * y > 0 else "out") for i, (x, y) in enumerate(points)]
    rows = [r for r in rows if r[3] == "in" or r[0] % 4 == 0]
    train = spark.createDataFrame(rows, "id long, x double, y double, c string")
    members = models.fit_ensemble(train, ["x", "y"], "c", ["in", "out"], "id", members=3, max_iter=5)
    assert len({tuple(m.coefficientMatrix.toArray().ravel()) for m in members}) == 3
    samples = models.member_probabilities(train, members, ["x", "y"], ["id"])
    assert samples.groupBy("id").count().agg(F.min("count"), F.max("count")).first() == (3, 3)
    draws = models.member_draws(train, "id", 0)
    assert draws.agg(F.sum("draws")).first()[0] == pytest.approx(len(rows), rel=0.1) and draws.count() < len(rows)
    bent = models.fit_perceptron(train, ["x", "y"], "c", ["in", "out"], "id", hidden=(8,), max_iter=150)
    straight = models.fit_classifier(train, ["x", "y"], "c", ["in", "out"])

    def recall(model):
        scored = models.class_probabilities(train, model, ["x", "y"])
        hit = (F.col("probs")[0] > 0.5) == (F.col("c") == "in")
        return scored.agg(F.avg(F.when(F.col("c") == "out", hit.cast("double")))).first()[0]

    assert recall(bent) > 0.9 > recall(straight)


def test_reconstruction_error_in_whole_batches(spark):
    rng = np.random.default_rng(2)
    axes = np.linalg.qr(rng.normal(size=(6, 2)))[0]
    points, center = rng.normal(size=(50, 6)), [0.5] * 6
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [1.0]), (93, [float("nan")] + [0.0] * 5)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    scored = df.select("id", models.reconstruction_error(F.col("v"), axes, center).alias("e"))
    # an expression over arrays is worked out again for each direction that uses it
    assert "zip_with" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["e"] for r in scored.collect()}
    away = points - 0.5
    assert [got[i] for i in range(50)] == pytest.approx(list(((away - away @ axes @ axes.T) ** 2).mean(axis=1)), abs=1e-12)
    assert got[90] is None and got[91] is None and got[92] is None and np.isnan(got[93])
    # the same row gives the same number to the last bit wherever it lies
    again = spark.createDataFrame([(i, rows[7][1]) for i in range(37)], "id long, v array<double>").coalesce(1)
    assert {r["e"] for r in again.select(models.reconstruction_error(F.col("v"), axes, center).alias("e")).collect()} == {got[7]}


def test_probabilities_from_weights_in_whole_batches(spark):
    df = spark.createDataFrame([(0, 1.0, -2.0), (1, 800.0, 3.0), (2, None, 1.0)], "id int, x double, y double")
    weights = [[0.5, 1.0, 0.0], [0.0, -1.0, 2.0]]
    shares = df.select("id", vector_queries._softmax(["x", "y"], weights).alias("p"))
    # an expression over arrays is worked out again for each class that uses it
    assert "aggregate(" not in shares._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["p"] for r in shares.collect()}
    a, b = np.exp([1.5, -5.0])
    assert got[0] == pytest.approx([a / (a + b), b / (a + b)]) and got[1] == pytest.approx([1.0, 0.0]) and got[2] is None


def test_scorer_state_roundtrip(spark, tmp_path):
    scorer = LinearScorer(
        features=["dur", "service_num"], classes=["Normal", "DoS"], weights=[[0.1, 0.2], [-0.3, 0.4]], intercepts=[0.5, -0.5],
        directions=[[0.6, 0.8]], centers=[0.1, 0.2], scaler={"dur": (1.0, 2.0), "service_num": (0.0, 1.0)},
        decision=Decision(hybrid=0.9, ae_re=0.2, mode="vote", min_votes=1), hybrid=HybridWeights(1.0, 2.0, -1.0),
        codes={"service": {"http": 1, "unk": 0}},
    )
    state.save_scorer(spark, scorer, str(tmp_path / "s"))
    back = state.load_scorer(spark, str(tmp_path / "s"))
    flows = spark.createDataFrame([(1, 3.0, "http"), (2, 9.0, "other")], ["id", "dur", "service"])
    columns = ["id", "max_prob", "ae_re", "hybrid", "is_zeroday", "zero_day_rule"]
    assert back.score(flows, ["id"]).select(columns).collect() == scorer.score(flows, ["id"]).select(columns).collect()
    assert back.decision == scorer.decision and back.hybrid == scorer.hybrid
