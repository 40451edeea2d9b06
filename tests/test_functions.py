import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.functions import quantiles, scalar
from cloudfork.operators import contingency, sampling


def hazen(x, p):
    x = np.sort(np.asarray(x, float))
    at = min(max(len(x) * p + 0.5, 1), len(x))
    k = int(at)
    return x[k - 1] + (at - k) * (x[min(k, len(x) - 1)] - x[k - 1])


@pytest.mark.parametrize("accuracy", [100_000, 200])
def test_hazen(spark, accuracy):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert quantiles.quantile_value(df, "x", 0.25) == 1.5
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in (None, "a", "b") for v in np.round(rng.normal(size=300), 1)] + [("c", 5.0), ("a", None), ("a", float("nan"))]
    got = quantiles.hazen_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", [0, 0.1, 0.5, 0.99, 1], ["g"], accuracy=accuracy).collect()
    assert len(got) == 20
    for r in got:
        x = [v for g, v in rows if g == r["g"] and v is not None and v == v]
        assert r["quantile"] == pytest.approx(hazen(x, r["p"]))
    assert quantiles.quantile_value(df.limit(0), "x", 0.5) is None


def test_hazen_of_a_far_outlier(spark):
    x = np.r_[np.random.default_rng(3).normal(size=5000), 1e12]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r["p"]: r["quantile"] for r in quantiles.hazen_quantiles(df, "x", [0.0, 0.001, 0.5, 0.999, 1.0], accuracy=1000).collect()}
    assert got == pytest.approx({p: hazen(x, p) for p in got})


def test_given_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "g string")
    assert [tuple(r) for r in contingency.given_order(df, "g", ["b", "a"]).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    for bad in (["a"], ["a", "b", "c"], ["a", "b", "b"], ["a", "c"]):
        with pytest.raises(ValueError):
            contingency.given_order(df, "g", bad)


@pytest.mark.parametrize("lo,hi,bins", [(0.0, 1.0, 10), (-3.2, 17.9, 7), (1.0, 50.0, 40), (0.0, 0.08, 85), (-1e-7, 3e5, 3), (901.0, 104949.5, 19), (2.0, 3.0, 1)])
def test_round_edges(lo, hi, bins):
    e = scalar.round_edges(lo, hi, bins)
    assert len(e) == bins + 1 and e[0] <= lo and e[-1] >= hi and e[-2] <= hi
    assert np.allclose(np.diff(e), (e[-1] - e[0]) / bins) and len(repr(e[1])) <= 9
    auto = scalar.round_edges(lo, hi, None, (hi - lo) / 4.1)
    assert auto[0] <= lo and auto[-1] >= hi and auto[-2] <= hi and np.allclose(np.diff(auto), auto[1] - auto[0])
    assert f"{auto[1] - auto[0]:.3e}"[:5] in ("1.000", "2.000", "3.000", "5.000")


def test_round_edges_by_hand():
    assert scalar.round_edges(0.03, 0.97, 4) == [0.0, 0.3, 0.6, 0.9, 1.2]
    assert scalar.round_edges(0.0, 1.0, None, 0.26) == [0.0, 0.3, 0.6, 0.9, 1.2]
    assert scalar.round_edges(2.0, 2.0, 4) == [2.0, 2.25, 2.5, 2.75, 3.0]
    assert scalar.round_edges(1e300, 1e300, 2)[0] <= 1e300 < scalar.round_edges(1e300, 1e300, 2)[1]


def test_bin_number(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 1.9, 2.0, 2.1, float("nan"), None)], "x double")
    assert [r[0] for r in df.select(scalar.bin_number(F.col("x"), [0.0, 1.0, 2.0])).collect()] == [None, 1, 1, 2, 2, 2, None, None, None]
    many = [i / 10 for i in range(101)]
    values = [(i / 10,) for i in range(101)] + [(0.05,), (9.99,)]
    got = [r[0] for r in spark.createDataFrame(values, "x double").select(scalar.bin_number(F.col("x"), many)).collect()]
    assert got == [min(i + 1, 100) for i in range(101)] + [1, 100]


def test_cube_root_bins():
    assert [scalar.cube_root_bins(n) for n in (0, 1, 2, 8, 9, 1000, 1001)] == [0, 1, 2, 2, 3, 10, 11]


def test_scalings_of_degenerate_rows(spark):
    df = spark.createDataFrame([("a", 1.0, [0.0, 0.0]), ("a", 1.0, [3.0, 4.0]), ("b", None, None)], "g string, x double, v array<double>")
    assert [r[0] for r in scalar.minmax_scaled(df, "x", ["g"], "s").select("s").collect()] == [None, None, None]
    assert [r[0] for r in df.select(scalar.unit_vector(F.col("v"))).collect()] == [None, [0.6, 0.8], None]
    assert df.select(scalar.arcsinh(F.col("x"), 0)).first()[0] == 1.0


def test_joint_states(spark):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip([1, 0, 1, 1, 0], [1, 1, 1, 0, 0]))], "i int, x int, y int")
    assert [r["joint"] for r in scalar.joint_states(df, ["x", "y"], ["i"]).orderBy("i").collect()] == [1, 2, 1, 3, 4]
    assert [r["joint"] for r in scalar.joint_states(df, ["x"], ["i"]).orderBy("i").collect()] == [1, 0, 1, 1, 0]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as node", "double(id % 11) as density")
    draw = sampling.uniform(F.col("id"))
    a, b = ({r["id"] for r in sampling.exact_sample(d, "id", 100, draw).collect()} for d in (df.repartition(1), df.repartition(5)))
    assert a == b and len(a) == 100
    one = sampling.one_per_node(df, "node", "id", 5)
    assert one.count() == 35 and sorted(map(tuple, one.collect())) == sorted(map(tuple, sampling.one_per_node(df.repartition(3), "node", "id", 5).collect()))
    kept = sampling.density_downsample(df, "density", 0, 0.5, draw)
    assert kept.filter("density = 0").count() == df.filter("density = 0").count() and kept.count() < 1000
    assert sampling.outliers(df, "density", 0).count() == 0


def test_group_tables(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y")], "r string, c string")
    assert contingency.full_counts(df, "r", "c").count() == 4
    assert {tuple(r) for r in contingency.majority(df, "r", "c").collect()} == {("a", "x", 1), ("b", "y", 1)}
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, m double")
    assert contingency.anova(flat, ["m"], "g").first()["f_stat"] is None


def test_options():
    assert Options(sigma=1).nodes_for(100_000) == 200
    assert Options(sigma=1).nodes_for(1500) == 150
    with pytest.raises(ValueError):
        Options(sigma=1).nodes_for(150)
    for bad in ({"sigma": 0}, {"sigma": 1, "metric": "corr"}, {"sigma": 1, "outlier": 2}, {"sigma": 1, "n_trees": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
