"""Rank error of the sketches, their merging, and p4_found against exact percentiles."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudfork.llm import percentiles as p

DATA = Path("/root/testdata/sf0.001")


def rank_error(values, answer, q):
    values = np.sort(values)
    lo, hi = np.searchsorted(values, answer, "left") / len(values), np.searchsorted(values, answer, "right") / len(values)
    return max(0, lo - q, q - hi)


@pytest.mark.parametrize("kind", ["sorted", "random", "repeated"])
def test_rank_error_is_bounded(kind):
    rng = np.random.default_rng(2)
    values = {"sorted": np.arange(200_000.0), "random": rng.normal(size=200_000), "repeated": rng.integers(0, 20, 200_000).astype(float)}[kind]
    levels = []
    for part in np.array_split(values, 37):
        levels = p.compress(p.merge(levels, p.compress([part], rng)), rng)
    assert sum(len(x) << h for h, x in enumerate(levels)) == len(values)
    assert sum(map(len, levels)) < 4 * p.K
    assert all(rank_error(values, p.quantile(levels, q), q) <= 0.01 for q in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99))


def test_days_combine_to_labels(spark):
    rows = [("a" if i % 3 else "b", i % 7, [float(i % 1000), None if i % 5 else float(i)]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, n int, v array<double>").withColumnRenamed("n", "day").repartition(5)
    days = p.quantile_sketches(df, "v", ["g", "day"])
    for fan_in in (1, 512):
        got = {(r.g, r.position, r.q_pct): r for r in p.sketch_quantiles(p.merge_sketches(days, ["g"], fan_in=fan_in), [0, 50, 95, 100]).collect()}
        assert len(got) == 16
        for (g, position, q), r in got.items():
            values = np.array([v[position - 1] for k, _, v in rows if k == g and v[position - 1] is not None])
            assert r.n == len(values)
            if q in (0, 100):
                assert r.value == (values.min() if q == 0 else values.max())
            else:
                assert rank_error(values, r.value, q / 100) <= 0.01


def test_partitions_throw_coins_of_their_own(spark):
    """Errors of 64 partitions of equal size cancel: merged, far below the bound of one sketch."""
    df = spark.range(0, 64 * 4000, 1, 64).select(F.array(F.randn(5)).alias("v"))
    values = np.sort([r[0][0] for r in df.collect()])
    asked = list(range(5, 100, 5))
    got = {r.q_pct: r.value for r in p.sketch_quantiles(p.quantile_sketches(df, "v", [], k=128), asked).collect()}
    assert np.mean([rank_error(values, got[q], q / 100) for q in asked]) < 0.003


def test_dirty_groups(spark):
    df = spark.createDataFrame(
        [(None, [1.0, math.nan]), (None, [3.0]), ("x", None), ("x", []), ("x", [math.inf, -math.inf, 5.0]), ("y", [None, None])], "levels string, vec array<double>"
    ).withColumnRenamed("levels", "kind")
    got = {(r.kind, r.position): (r.n, r.value) for r in p.sketch_quantiles(p.quantile_sketches(df, "vec", ["kind"]), [50]).collect()}
    assert got == {(None, 1): (2, 1.0), ("x", 1): (1, math.inf), ("x", 2): (1, -math.inf), ("x", 3): (1, 5.0)}
    assert p.sketch_quantiles(p.quantile_sketches(df.limit(0), "vec", ["kind"]), [50]).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_p4_found(spark):
    from cloudfork.llm import queries

    cells = {}
    for r in spark.read.parquet(str(DATA / "all_struct.parquet")).collect():
        if r.cell_id is not None and r.all_data and len(r.all_data) == 12 and r.all_labels is not None:
            cells[r.cell_id] = (r.all_labels.strip().lower(), r.acq_day, r.all_data)
    groups = {}
    for label, day, data in cells.values():
        for i, v in enumerate(data, start=1):
            if v is not None and not math.isnan(v):
                groups.setdefault((label, str(day), i), []).append(v)
    truth = set()
    for r in spark.read.parquet(str(DATA / "marker_reference.parquet")).collect():
        for (label, day, i), values in groups.items():
            if (label, i) == (r.all_labels.strip().lower(), r.marker_no) and len(values) >= 40:
                if abs(np.percentile(values, r.q_pct, method="inverted_cdf") - r.ref_value) > r.tolerance:
                    truth.add((label, day, i, r.q_pct))
    assert {tuple(r) for r in queries.p4_found(spark, str(DATA)).collect()} == truth
