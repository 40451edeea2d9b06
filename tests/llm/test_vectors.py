"""Neighbours, clusters and subsets against brute force."""

import math
from pathlib import Path

import numpy as np
import pytest

from cloudfork.llm import clusters, diverse, neighbors
from cloudfork.llm.vectors import complete_cells
from cloudfork.llm.vptree import Router, Tree

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "cell_id long, all_data array<double>, vec int, id string, distance double"


def frame(spark, rows):
    """Cells with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], SCHEMA).repartition(3)


def blobs(n, dim=3, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 3, (5, dim))[rng.choice(5, n, p=[0.5, 0.2, 0.1, 0.1, 0.1])]
    return centre + rng.normal(0, 0.3, (n, dim))


def as_rows(x):
    return [(i, [float(y) for y in v]) for i, v in enumerate(x)]


def brute(x, ids, asked, k):
    out = set()
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out |= {(ids[q], ids[i]) for i in order}
    return out


DIRTY = [(None, [0.0, 0.0, 0.0]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, math.nan, 2.0]), (904, [1.0, math.inf, 2.0]), (905, [])]


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_exact_neighbours(spark, shard_rows):
    x = blobs(500)
    cells = frame(spark, as_rows(x) + DIRTY)
    found = neighbors.nearest_vectors(cells, 4, dim=3, shard_rows=shard_rows).collect()
    assert {(r.query_id, r.neighbor_id) for r in found} == brute(x, np.arange(500), range(500), 4)
    assert sorted({r["rank"] for r in found}) == [1, 2, 3, 4] and len(found) == 2000


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_neighbours_within_a_distance_are_those_of_brute_force(spark, shard_rows):
    x = blobs(500, seed=3)
    found = neighbors.nearest_vectors(frame(spark, as_rows(x)), 5, max_distance=0.2, dim=3, shard_rows=shard_rows)
    near = {(a, b) for a, b in brute(x, np.arange(500), range(500), 5) if math.dist(x[a], x[b]) <= 0.2}
    assert {(r.query_id, r.neighbor_id) for r in found.collect()} == near
    mutual = {(min(a, b), max(a, b)) for a, b in near if (b, a) in near}
    assert {tuple(r) for r in neighbors.mutual_pairs(found).collect()} == mutual


def test_approximate_search_keeps_nine_in_ten(spark):
    x = blobs(3000, dim=6, seed=4)
    cells = frame(spark, as_rows(x))
    asked = list(range(0, 3000, 20))
    found = neighbors.nearest_vectors(cells, 10, queries=cells.filter("cell_id % 20 = 0"), factor=neighbors.FACTOR, dim=6, shard_rows=400)
    truth = brute(x, np.arange(3000), asked, 10)
    assert len({(r.query_id, r.neighbor_id) for r in found.collect()} & truth) >= 0.9 * len(truth)


def test_repeats_ties_copies_and_empty(spark):
    rows = [(1, [0.0] * 3), (1, [0.0] * 3), (2, [0.0] * 3), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])]
    found = {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in neighbors.nearest_vectors(frame(spark, rows), 2, dim=3).collect()}
    assert found[1, 1] == (2, 0.0) and found[2, 1] == (1, 0.0)
    assert found[1, 2] == (3, 1.0) and found[3, 1] == (1, 1.0) and found[3, 2] == (2, 1.0)
    empty = frame(spark, rows).limit(0)
    assert neighbors.nearest_vectors(empty, 2, dim=3).count() == 0
    assert clusters.similarity_clusters(empty, 0.5, dim=3).count() == 0
    assert diverse.varied_subset(empty, 3, dim=3).count() == 0


@pytest.mark.parametrize("reach", [1.0, math.inf])
def test_every_copy_has_its_list_on_any_partitions(spark, reach):
    rows = [(i, [0.0] * 3) for i in range(40)] + [(100 + i, [5.0, 0.3 * i, 0.0]) for i in range(4)]
    lists = [sorted(map(tuple, neighbors.nearest_vectors(frame(spark, rows).repartition(n), 5, max_distance=reach, dim=3).collect())) for n in (1, 3, 40)]
    assert lists[0] == lists[1] == lists[2]
    assert len({r[0] for r in lists[0]}) == 44
    assert [r[1] for r in lists[0] if r[0] == 30] == [0, 1, 2, 3, 4] and [r[1] for r in lists[0] if r[0] == 3] == [0, 1, 2, 4, 5]
    asked = frame(spark, [(7, [0.0] * 3), (300, [0.0] * 3), (301, [0.0] * 3)])
    found = {(r.query_id, r["rank"]): r.neighbor_id for r in neighbors.nearest_vectors(frame(spark, rows), 2, queries=asked, max_distance=reach, dim=3).collect()}
    assert found == {(7, 1): 0, (7, 2): 1, (300, 1): 0, (300, 2): 1, (301, 1): 0, (301, 2): 1}


def test_a_copy_whose_twin_comes_again_elsewhere(spark):
    """Cells 5 and 7 are equal, in one partition; 5 comes again in others."""
    one = lambda rows: spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], SCHEMA).coalesce(1)
    again = one([(5, [0.0] * 3), (1, [3.0, 0.0, 0.0])])
    cells = again.union(one([(5, [0.0] * 3), (7, [0.0] * 3)])).union(again)
    assert {tuple(r)[:3] for r in neighbors.nearest_vectors(cells, 2, max_distance=1, dim=3).collect()} == {(5, 7, 0.0), (7, 5, 0.0)}


def test_shards_that_are_too_large_are_split_again(spark, monkeypatch):
    x = blobs(600, seed=12)
    cells = frame(spark, as_rows(x))
    for module in (neighbors, clusters):
        monkeypatch.setattr(module, "depth_for", lambda *_: 1)
    for reach in (math.inf, 0.3):
        found = neighbors.nearest_vectors(cells, 4, max_distance=reach, dim=3, shard_rows=20).collect()
        near = {(a, b) for a, b in brute(x, np.arange(600), range(600), 4) if math.dist(x[a], x[b]) <= reach}
        assert {(r.query_id, r.neighbor_id) for r in found} == near
    label = linked(x, 0.25)
    size = np.bincount(label, minlength=len(x))
    found = clusters.similarity_clusters(cells, 0.25, dim=3, shard_rows=20).collect()
    assert {(r.cluster_id, r.cell_id) for r in found} == {(int(label[i]), i) for i in range(len(x)) if size[label[i]] > 1}


def test_tree_and_router_miss_nothing():
    x = blobs(2000, seed=5)
    q, p, d = Tree(x).nearest(x, np.arange(2000), np.arange(2000), 3, np.full(2000, np.inf))
    assert set(zip(q.tolist(), p.tolist())) == brute(x, np.arange(2000), range(2000), 3)
    router = Router.fit(x[:500], 3)
    home = router.home(x)
    row, shard = router.visits(x, np.full(2000, 0.3))
    visits = set(zip(row.tolist(), shard.tolist()))
    for i in range(0, 2000, 50):
        near = np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(axis=1)) <= 0.3)
        assert all((i, home[j]) in visits for j in near)


def test_points_that_look_for_one_another_meet_once(monkeypatch):
    from cloudfork.llm import vptree

    x = blobs(2000, seed=13)
    tree = Tree(x)
    place = np.empty(2000, int)
    place[tree.order] = np.arange(2000)
    looked, walk = [], Tree._walk
    monkeypatch.setattr(vptree.Tree, "_walk", lambda *a: (leaf for leaf in walk(*a) if looked.append((leaf[1] - leaf[0]) * len(leaf[2])) is None))
    found = [(int(a), int(b)) for q, p, _ in tree.within(x, np.full(2000, 0.3), after=place) for a, b in zip(q, p)]
    once = sum(looked)
    looked.clear()
    both = {(int(a), int(b)) for q, p, _ in tree.within(x, np.full(2000, 0.3)) for a, b in zip(q, p)}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.3
    assert both == set(zip(*(i.tolist() for i in np.nonzero(near))))
    assert len(found) == len(set(found)) == near[np.triu_indices(2000, 1)].sum() and all((b, a) in both for a, b in found)
    assert not {(b, a) for a, b in found} & set(found) and once < 0.6 * sum(looked)


def test_blocks_of_queries_find_the_same(monkeypatch):
    from cloudfork.llm import vptree

    x = blobs(2000, seed=11)
    monkeypatch.setattr(vptree, "SEARCHED", 128)
    q, p, d = Tree(x).nearest(x, np.arange(2000), np.arange(2000), 3, np.full(2000, np.inf))
    assert set(zip(q.tolist(), p.tolist())) == brute(x, np.arange(2000), range(2000), 3)
    assert np.allclose(d, np.sqrt(((x[q] - x[p]) ** 2).sum(axis=1)))
    none = Tree(x).nearest(x[:0], np.arange(0), np.arange(2000), 3, np.empty(0))
    assert [len(y) for y in none] == [0, 0, 0]


def linked(x, threshold):
    label = np.arange(len(x))
    a, b = np.nonzero(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= threshold)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("shard_rows, held", [(10_000, None), (80, None), (10_000, 100)])
def test_linked_clusters(spark, shard_rows, held, monkeypatch):
    if held:
        monkeypatch.setattr(clusters, "HELD", held)
    x = np.r_[blobs(300, seed=6), np.tile([[9.0, 9.0, 9.0]], (40, 1))]  # 40 copies of one vector
    label = linked(x, 0.25)
    size = np.bincount(label, minlength=len(x))
    found = clusters.similarity_clusters(frame(spark, as_rows(x) + DIRTY), 0.25, dim=3, shard_rows=shard_rows).collect()
    assert {(r.cluster_id, r.cell_id) for r in found} == {(int(label[i]), i) for i in range(len(x)) if size[label[i]] > 1}


def test_average_linkage_stops_below_the_threshold(spark):
    # a chain of three: 0-1 merge at 1; its mean distance to 2, with the missing link 0-2 at 4, is (1.5 + 4) / 2
    links = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.5), (5, 6, 1.0), (6, 5, 1.0), (7, 7, 0.0)], "a long, b long, distance double")
    got = {(r.node, r.cluster_id) for r in clusters.reciprocal_linkage(links, 2.0, missing=4.0).collect()}
    assert got == {(0, 0), (1, 0), (2, 2), (5, 5), (6, 5)}
    got = {(r.node, r.cluster_id) for r in clusters.reciprocal_linkage(links, 2.0).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5)}


def average_linkage(x, threshold, missing):
    """{cluster: members} of plain average linkage over all pairs, those beyond the threshold at ``missing``."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = np.where(d <= threshold, d, missing)
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(len(x))}
    while True:
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        if d[a, b] > threshold:
            return {min(m): sorted(m) for m in members.values()}
        na, nb = len(members[a]), len(members[b])
        d[a] = d[:, a] = (na * d[a] + nb * d[b]) / (na + nb)
        d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
        members[a] += members.pop(b)


@pytest.mark.parametrize("shard_rows, held", [(10_000, None), (60, None), (10_000, 500), (60, 200)])
def test_average_linkage_counts_every_pair_within_the_threshold(spark, shard_rows, held, monkeypatch):
    if held:
        monkeypatch.setattr(clusters, "HELD", held)  # links leave the shard as they are
    x = np.r_[np.random.default_rng(2).normal(0, 0.01, (150, 3)) + 20, blobs(250, seed=9)]  # a ball of 150, all near each other
    truth = average_linkage(x, 0.25, 0.5)
    assert max(map(len, truth.values())) == 150
    found = {}
    for r in clusters.similarity_clusters(frame(spark, as_rows(x) + DIRTY), 0.25, missing=0.5, dim=3, shard_rows=shard_rows).collect():
        found.setdefault(r.cluster_id, []).append(r.cell_id)
    alone = lambda c: {k: sorted(m) for k, m in c.items() if len(m) > 1}
    assert alone(found) == alone(truth)


@pytest.mark.parametrize("shard_rows", [10_000, 8])
def test_copies_in_many_batches_are_one_weighted_vector(spark, shard_rows):
    # p and q merge at 0.1; r is 0.24 from the 40 copies of p and unlinked (0.5) with q: (40 * 0.24 + 0.5) / 41 is within 0.25, (0.24 + 0.5) / 2 is not
    p, q, r = [0.0, 0.0, 0.0], [-0.1, 0.0, 0.0], [0.24, 0.0, 0.0]
    far = [[9.0 + i, 5.0, -5.0] for i in range(30)]
    x = np.array([p] * 40 + [q, r] + far)
    truth = {c: m for c, m in average_linkage(x, 0.25, 0.5).items() if len(m) > 1}
    assert list(map(len, truth.values())) == [42]
    rows = as_rows(x)
    # cells 3 and 7 come again, cell 60 also with a larger vector and cell 42 with a smaller one, which counts: that of p
    cells = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows + [rows[3], rows[7], (60, [99.0, 0.0, 0.0]), (42, [0.0, 0.0, 0.0])]], SCHEMA).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 6)  # some 16 batches, each with a representative of p
    try:
        found = clusters.similarity_clusters(cells, 0.25, missing=0.5, dim=3, shard_rows=shard_rows).collect()
        profile = clusters.cluster_profiles(clusters.similarity_clusters(cells, 0.25, missing=0.5, dim=3, shard_rows=shard_rows), cells, dim=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.cluster_id, r.cell_id) for r in found) == [(0, i) for i in [*range(43)]]
    assert [(r.cluster_id, r["size"]) for r in profile] == [(0, 43)]


def test_p3_clusters_keeps_a_ball_whole(spark, tmp_path):
    from cloudfork.llm import queries

    x = np.random.default_rng(4).normal(0, 0.01, (300, 12))
    frame(spark, as_rows(x)).write.parquet(str(tmp_path / "all_struct.parquet"))
    assert [(r.cluster_id, r["size"]) for r in queries.p3_clusters(spark, str(tmp_path)).collect()] == [(0, 300)]


def test_cluster_profiles(spark):
    rows = [(i, [float(i % 3) * 0.01, 0.0, 0.0]) for i in range(9)] + [(20, [5.0, 5.0, 5.0])]
    cells = frame(spark, rows)
    profile = clusters.cluster_profiles(clusters.similarity_clusters(cells, 0.1, dim=3), cells, dim=3).collect()
    assert [(r.cluster_id, r.size, r.typical) for r in profile] == [(0, 9, [1, 4, 7])]


def test_subset_covers_and_does_not_follow_the_large_group(spark):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 0.1, (900, 3)), rng.normal(5, 0.1, (50, 3)), rng.normal(-5, 0.1, (50, 3))]
    cells = frame(spark, as_rows(x) + DIRTY + as_rows(x[:5]))
    picked = {r.cell_id for r in diverse.varied_subset(cells, 30, dim=3, region_rows=40).collect()}
    assert len(picked) == 30
    groups = [sum(lo <= i < hi for i in picked) for lo, hi in ((0, 900), (900, 950), (950, 1000))]
    assert min(groups) >= 2 and groups[0] < 27
    away = lambda s: np.sqrt(((x[:, None] - x[sorted(s)][None]) ** 2).sum(axis=2)).min(axis=1).max()
    chance = [away(rng.choice(1000, 30, replace=False)) for _ in range(9)]
    assert away(picked) < np.median(chance)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
@pytest.mark.parametrize("partitions, region_rows", [(1, 4000), (8, 4000), (40, 4000), (8, 200)])
def test_subset_covers_nearly_as_one_greedy_selection(spark, partitions, region_rows):
    cells = complete_cells(spark.read.parquet("/root/testdata/sf0.01/all_struct.parquet")).dropDuplicates(["id"]).toPandas()
    x, ids = np.stack(cells["vec"]), cells["id"].to_numpy()
    greedy, _ = diverse.farthest_first(x, int(np.ceil(0.01 * len(x))))

    def coverage(rows):
        y = x[rows]
        return max(np.sqrt(np.maximum(((x[i : i + 500, None] - y[None]) ** 2).sum(axis=2), 0).min(axis=1)).max() for i in range(0, len(x), 500))

    dealt = spark.createDataFrame(cells.rename(columns={"id": "cell_id", "vec": "all_data"})).repartition(partitions)
    picked = [r.cell_id for r in diverse.varied_subset(dealt, region_rows=region_rows).collect()]
    assert len(picked) == len(greedy)
    ratio = coverage(np.flatnonzero(np.isin(ids, picked))) / coverage(greedy)
    print(f"{partitions} partitions, regions of {region_rows}: {ratio:.2f} times the covering radius of one greedy selection")
    assert ratio <= (1.2 if region_rows == 4000 else 1.3)


def test_subset_of_copies_counts_a_vector_once(spark):
    cells = frame(spark, [(i, [float(i % 4), 0.0, 0.0]) for i in range(200)])
    got = diverse.varied_subset(cells, 10, dim=3).collect()
    assert len(got) == 4 and {r.cell_id % 4 for r in got} == {0, 1, 2, 3}


@pytest.fixture(scope="module")
def cells(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    rows = spark.read.parquet(str(DATA / "all_struct.parquet")).select("cell_id", "all_data").collect()
    good = {r[0]: r[1] for r in rows if r[0] is not None and r[1] and len(r[1]) == 12 and all(v is not None and math.isfinite(v) for v in r[1])}
    ids = np.array(sorted(good))
    return ids, np.array([good[i] for i in ids])


def test_p1_found(spark, cells):
    from cloudfork.llm import queries

    ids, x = cells
    near = {(a, b) for a, b in brute(x, ids, range(len(ids)), 10)}
    at = {int(i): n for n, i in enumerate(ids)}
    truth = {(a, b) for a, b in near if a < b and (b, a) in near and math.dist(x[at[a]], x[at[b]]) <= 0.06}
    assert {tuple(r) for r in queries.p1_found(spark, str(DATA)).collect()} == truth


def test_p3_clusters(spark, cells):
    """Against average linkage of every connected part by brute force."""
    from cloudfork.llm import queries

    ids, x = cells
    label = linked(x, 0.25)
    truth = []
    for part in np.unique(label[np.bincount(label)[label] > 1]):
        rows = np.flatnonzero(label == part)
        truth += [(int(ids[rows[min(m)]]), len(m)) for m in average_linkage(x[rows], 0.25, 0.5).values()]
    assert sorted((r.cluster_id, r["size"]) for r in queries.p3_clusters(spark, str(DATA)).collect()) == sorted(truth)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
def test_recall_of_p1_knn(spark):
    """Over all queries of sf0.01, in several shards."""
    rows = spark.read.parquet("/root/testdata/sf0.01/all_struct.parquet")
    good = {r["id"]: r["vec"] for r in complete_cells(rows).collect()}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    truth = brute(x, ids, asked, 10)
    found = neighbors.nearest_vectors(rows, 10, queries=rows.filter("cell_id % 20 = 0"), factor=neighbors.FACTOR, shard_rows=2500)
    assert len({(r.query_id, r.neighbor_id) for r in found.collect()} & truth) >= 0.95 * len(truth)


def test_p3_found(spark, cells):
    from cloudfork.llm import queries

    ids, x = cells
    label = linked(x, 0.25)
    size = np.bincount(label, minlength=len(x))
    truth = {(int(ids[label[i]]), int(ids[i])) for i in range(len(x)) if size[label[i]] >= 6}
    assert {tuple(r) for r in queries.p3_found(spark, str(DATA)).collect()} == truth
