import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.operators import distance, graph, layout, seeding
from cloudfork.plans import branch, recursive
from cloudfork.sources.store import RunStore


class Parts:
    """Disjoint sets of nodes."""

    def __init__(self, nodes):
        self.of, self.count = {n: n for n in nodes}, len(set(nodes))

    def join(self, a, b):
        a, b = self.of[a], self.of[b]
        if a != b:
            self.of = {n: min(a, b) if p in (a, b) else p for n, p in self.of.items()}
            self.count -= 1
        return a != b



@pytest.mark.parametrize("metric", ["L1", "L2", "angle"])
def test_spanning_tree_is_minimal(metric):
    x = np.random.default_rng(3).normal(size=(6, 3))
    d = distance.METRICS[metric](x, x)
    pairs = list(itertools.combinations(range(6), 2))

    def spans(edges):
        p = Parts(range(6))
        return all(p.join(a, b) for a, b in edges)

    best = min(sum(d[a, b] for a, b in e) for e in itertools.combinations(pairs, 5) if spans(e))
    assert sum(w for *_, w in graph.minimum_spanning_edges(x, metric)) == pytest.approx(best)
    assert len(graph.minimum_spanning_edges(np.zeros((4, 2)))) == 3  # copies are joined by edges of length 0


def test_linkage_parts_is_single_linkage():
    rng = np.random.default_rng(5)
    for _ in range(20):
        s = rng.integers(0, 10, (7, 7))
        s = np.maximum(s, s.T)
        p = Parts(range(7))
        for a, b in itertools.combinations(range(7), 2):
            if s[a, b] >= 6:
                p.join(a, b)
        assert [p.of[i] for i in range(7)] == graph.linkage_parts(s, np.arange(7), 6).tolist()


def test_consistency():
    path = np.array([[0, 0, 1], [0, 1, 2], [0, 2, 3], [1, 0, 1], [1, 1, 2], [1, 1, 3]], np.int32)
    c = graph.consistency_block(path, 4, 2, 1)
    assert (c == c.T).all() and c[2, 3] == 1 and c[0, 2] == 0 and (c[1] == -1).all() and c[0, 0] == 2


def test_paths_and_components(spark):
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)] + [(20, 21, 2.0)], "src long, dst long, weight double")
    assert sorted(map(tuple, graph.shortest_paths(line, 0).collect())) == [(i, float(i)) for i in range(10)]
    comp = dict(map(tuple, graph.connected_components(line).collect()))
    assert comp == {i: 0 for i in range(10)} | {20: 20, 21: 20}
    hops = graph.tree_hops(line.filter("src < 20").withColumn("tree_id", F.lit(0)), 0)
    assert {(r["node_id"], r["hops"]) for r in hops.collect()} == {(i, i) for i in range(10)}
    freq = line.withColumn("inv_freq", F.lit(1) / (F.col("src") + 1))
    assert graph.bottleneck(freq) is None
    assert graph.bottleneck(freq.filter("src < 20")) == 1.0
    assert graph.graph_variants(freq.withColumn("mean_len", F.col("weight"))).filter("graph_id > 2").count() == 0


def y_cloud(n, arms, seed=1, dim=5):
    rng = np.random.default_rng(seed)
    out = rng.normal(scale=0.05, size=(n, dim))
    arm, far = rng.integers(0, arms, n), rng.uniform(0, 1, n)
    for i in range(n):
        if arms == 2:
            out[i, 0] += far[i] * (1 if arm[i] else -1)
        else:
            out[i, arm[i]] += far[i]
    return out


def cloud(spark, x):
    return spark.createDataFrame([(i, str(i % 3), r) for i, r in enumerate(x.tolist())], "cell_id long, label string, features array<double>")


def test_a_branching_cloud_branches_more_than_a_line(spark, tmp_path):
    options = Options(sigma=0.3, n_ref_cells=30, n_trees=60, threshold=0.9)
    y = branch.analyse(cloud(spark, y_cloud(900, 3)), options)
    line = branch.analyse(cloud(spark, y_cloud(900, 2)), options)
    top = lambda run: run.scores.agg(F.max("score")).first()[0]
    assert top(y) > top(line)
    sizes = {r["branch"]: r["count"] for r in y.branches.groupBy("branch").count().collect()}
    assert sizes.pop(0) == 1 and len(sizes) >= 3
    assert [sizes[b] for b in sorted(sizes)] == sorted(sizes.values(), reverse=True)
    assert y.cells.count() == 900 and y.cells.filter("node_id = 0").count() > 0
    dist = branch.node_distances(y)
    assert dist.filter("branch = 1 and signed_dist > 0").count() == 0 and dist.count() == 30
    a = branch.significance(y, {f"m{i}": i for i in range(5)})
    assert a is None or a.filter("p < 0.01").count() >= 2
    store = RunStore(spark, str(tmp_path / "run"))
    store.save_run(y, {"sigma": 0.3})
    assert store.resumes({"sigma": 0.3}) and not store.resumes({"sigma": 1}) and store.find("nothing") is None
    assert store.load_run()["scores"].count() == 30


def test_recursion_splits_and_labels(spark):
    options = Options(sigma=0.3, n_ref_cells=20, n_trees=30, threshold=0.9)
    nulls = spark.createDataFrame([(20, 1001, 2, 0.0)], "n_ref_cells long, n_points long, n_dims long, score double")
    cells = cloud(spark, y_cloud(1200, 3))
    levels = recursive.analyse_recursively(cells, options, nulls, 5, max_depth=1).cache()
    assert levels.select("stem").distinct().count() >= 3
    nodes = spark.range(1, 21).withColumnRenamed("id", "node_id")
    labels = recursive.deepest_labels(levels, nodes)
    assert labels.count() == 20 and labels.filter("stem like 'branch_%'").count() > 10
    assert recursive.branch_points(levels).count() == 1
    assert recursive.score_limit(nulls, 20, 900, 5, 0.95) == float("inf")
    assert recursive.score_limit(nulls, 5, 5000, 1, 0.95) == 0.0
    assert recursive.analyse_recursively(cells.limit(900), options, nulls, 5).count() == 0


def test_recursion_resumes_from_its_store(spark, tmp_path, monkeypatch):
    options = Options(sigma=0.3, n_ref_cells=20, n_trees=30, threshold=0.9)
    nulls = spark.createDataFrame([(20, 1001, 2, 0.0)], "n_ref_cells long, n_points long, n_dims long, score double")
    cells, store = cloud(spark, y_cloud(1200, 3)), RunStore(spark, str(tmp_path))
    first = sorted(map(tuple, recursive.analyse_recursively(cells, options, nulls, 5, max_depth=1, store=store).collect()))
    calls = []
    monkeypatch.setattr(recursive, "analyse", lambda *a: calls.append(a) or branch.analyse(*a))
    again = sorted(map(tuple, recursive.analyse_recursively(cells, options, nulls, 5, max_depth=1, store=store).collect()))
    assert first and again == first and not calls
    recursive.analyse_recursively(cells.filter("cell_id <> 3"), options, nulls, 5, max_depth=1, store=store)
    assert len(calls) == 1


def test_null_clouds_do_not_depend_on_partitions(spark):
    x = [sorted(map(tuple, spark.range(0, 500, 1, n).select("id", recursive.gaussian(F.col("id"), F.lit(3), seed=5)).collect())) for n in (1, 7)]
    values = np.array([v for _, v in x[0]])
    assert x[0] == x[1] and abs(values.mean()) < 0.2 and abs(values.std() - 1) < 0.15


def test_reports(spark):
    from cloudfork.plans import reports

    run = branch.analyse(cloud(spark, y_cloud(900, 3)), Options(sigma=0.3, n_ref_cells=20, n_trees=20, threshold=0.9))
    with pytest.raises(ValueError):
        layout.chosen_layout(spark, run.graph.limit(0), Options(sigma=1.0), tries=2)
    xy = layout.chosen_layout(spark, run.graph, Options(sigma=1.0, layout_graph=2, layout_seed=4), tries=2).drop("graph_id").cache()
    placed = reports.samples_on_layout(run, xy).toPandas()
    assert len(placed) == 20 * placed["label"].nunique() and placed.groupby("label")["share"].sum().round(9).eq(1).all()
    assert (placed[placed["largest"]].groupby("node_id").size() == 1).all()
    views = reports.density_views(run, xy)
    inside = run.cells.filter("node_id <> 0").count()
    assert views["nodes"].count() == 20 and sum(r["count"] for r in views["histogram"].collect()) == inside
    assert max(r["ecdf"] for r in views["ecdf"].collect()) == 1.0
    labels = run.branches.selectExpr("node_id", "concat('branch_', branch) as stem")
    levels = run.cells.selectExpr("'branch_1' as stem", "'branch' as parent_stem", "1 as depth", "true as run_flag", "cell_id")
    panels = reports.recursive_panels(levels, labels, run.cells, xy)
    assert sum(r["count"] for r in panels["contingency"].collect()) == inside and panels["nodes"].count() == 20
    assert panels["tree"].first()["rows"] == run.cells.count()
    odd = spark.createDataFrame([("a", 1.0, None), (None, float("nan"), None)], "l string, x double, y double")
    report = reports.pre_run(odd, ["x", "y"], ["x"], "l")
    assert [tuple(r) for r in report["marginals"].collect()] == [("a", "x", 1, 1)]
    assert report["summary"].count() == 2


def test_seeding(spark):
    cells = cloud(spark, y_cloud(500, 3))
    nodes = seeding.seed_nodes(cells, 12, key="cell_id")
    assert nodes.count() == 12 and nodes.select("cell_id").distinct().count() == 12
    with pytest.raises(ValueError):
        seeding.seed_nodes(cloud(spark, np.zeros((50, 2))), 5, key="cell_id")


def test_layout_and_profile(spark):
    square = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "src long, dst long")
    xy = {r["node_id"]: (r["x"], r["y"]) for r in layout.best_layout(spark, square, tries=4).collect()}
    assert len(xy) == 4 and all(0.1 - 1e-9 <= c <= 0.9 + 1e-9 for p in xy.values() for c in p)
    x = np.linspace(-1, 1, 30)
    mean, sd = layout.gp_fit(x, np.sin(2 * x), x)
    assert np.abs(mean - np.sin(2 * x)).max() < 0.1 and (sd > 0).all()


def test_correlation_metric(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(8, 3)), rng.normal(size=(5, 3))
    stats = lambda m: (m.mean(0), np.sqrt(((m - m.mean(0)) ** 2).sum(0)))
    d = distance.correlation_metric(True, stats(x), stats(y))(x, y)
    assert d.shape == (8, 5) and (d <= 1).all()
    with pytest.raises(ValueError):
        distance.squared_to_nearest(None, None, "corr")


@pytest.mark.parametrize("closing, expected", [(2.0, 2.0), (9.0, 9.0), (None, None)])
def test_bottleneck(spark, closing, expected):
    rows = [(i, i + 1, 1.0 + (i % 3) / 4) for i in range(12) if i != 6] + [(0, 3, 20.0)] + ([(6, 7, closing)] if closing else [])
    g = spark.createDataFrame(rows, "src long, dst long, inv_freq double")
    assert graph.bottleneck(g) == expected
    assert graph.bottleneck(g.repartition(30)) == expected


def test_forests_of_parts_make_that_of_the_whole(spark):
    rng = np.random.default_rng(6)
    a, b, w = rng.integers(0, 60, 900), rng.integers(0, 60, 900), np.round(rng.random(900), 2)
    best = lambda rows: round(float(w[rows].sum()), 6)
    whole = graph.spanning_forest(a, b, w)
    parts = Parts(range(60))
    kruskal = [i for i in np.argsort(w, kind="stable") if parts.join(a[i], b[i])]
    assert len(whole) == len(kruskal) == 59 and best(whole) == best(kruskal)
    df = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w)], "src long, dst long, w double").repartition(20)
    forest = graph.minimum_forest(df, "w").toPandas()
    assert len(forest) == 59 and round(forest["w"].sum(), 6) == best(kruskal)
    assert graph.minimum_forest(df.limit(0), "w").count() == 0 and graph.bottleneck(df.limit(0), "w") is None


def test_parts_of_a_hundredth_of_the_nodes_are_no_branches():
    """1001 nodes: the branch point, three large parts, and one of five that is nearest to the second."""
    sizes = [400, 350, 245, 5]
    part = np.repeat(np.arange(4), sizes)
    counts = np.where(part[:, None] == part[None], 100, 1)
    counts[np.ix_(part == 3, part == 1)] = counts[np.ix_(part == 1, part == 3)] = 40
    whole = np.full((1001, 1001), -1)
    whole[1:, 1:] = counts
    label = graph._branch_labels(whole, 0, 50, False)
    assert label[0] == 0 and np.bincount(label).tolist() == [1, 400, 355, 245] and set(label[996:]) == {2}


def test_profiles_follow_the_branches_of_the_data(spark, tmp_path):
    from cloudfork.plans import graphs

    # labels on three arms of three nodes around label 14: positions 0, 1 and 2 of 64
    where = {14: [0.0, 0.0, 0.0]} | {20 + 3 * a + i: [5.0 * (i + 1) * (a == b) for b in range(3)] for a in range(3) for i in range(3)}
    # node n is the third n % 3 of label n // 3
    rows = [(3 * (5 * k + j) + n % 3, [float(v) for v in x] + [0.01 * j] * 61, n // 3) for k, (n, x) in enumerate(where.items()) for j in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    dist = {r.node_id: (r.branch, r.signed_dist) for r in graphs.mean_tree_distance(spark, str(tmp_path)).collect()}
    assert set(dist) == set(where) and dist[14] == (0, 0.0)
    arms = [{dist[20 + 3 * a + i][0] for i in range(3)} for a in range(3)]
    assert sorted(map(tuple, arms)) == [(1,), (2,), (3,)]
    found = graphs.gp_profile(spark, str(tmp_path)).select("marker", "branch").distinct().collect()
    assert {tuple(r) for r in found} == {(f"e{i}", b) for i in range(64) for b in (2, 3)}


def test_recursive_labels_reach_the_second_level(spark, tmp_path, monkeypatch):
    from cloudfork.plans import graphs

    # three arms from the middle; the first, with most rows, ends in three arms of its own
    rng = np.random.default_rng(3)
    n = 2600
    x, arm, far = rng.normal(scale=0.05, size=(n, 12)), rng.choice(3, n, p=[0.7, 0.15, 0.15]), rng.uniform(0, 1, n)
    x[np.arange(n), arm] += 10 * far
    split = np.flatnonzero((arm == 0) & (far > 0.25))
    x[split, 0] = 10 + rng.normal(scale=0.05, size=len(split))
    x[split, 3 + rng.integers(0, 3, len(split))] += 10 * rng.uniform(0, 1, len(split))
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(5 * np.sinh(x))]
    rows += [(None, rows[0][1], "a"), (7, rows[7][1], "a"), (9999, [1.0] * 11 + [None], "a")]
    spark.createDataFrame(rows, "cell_id long, all_data array<double>, all_labels string").write.parquet(str(tmp_path / "all_struct.parquet"))
    asked = []

    def nulls(spark, n_ref, n_points, n_dims, options, runs=10):
        asked.append((n_ref, n_points, n_dims))
        return spark.createDataFrame([(n_ref, n_points, n_dims, 0.0)], "n_ref_cells long, n_points long, n_dims long, score double")

    monkeypatch.setattr(recursive, "null_table", nulls)
    stems = {r.stem for r in graphs.recursive_labels(spark, str(tmp_path)).collect()}
    assert any(s.count("_") >= 2 for s in stems), stems
    assert asked == [(30, 1001, 12)]
