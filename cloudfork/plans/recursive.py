"""Branch hierarchy tables and the look-ups of the recursive analysis."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.functions.quantiles import quantile_value
from cloudfork.functions.scalar import parent_stem, stem_depth
from cloudfork.operators.sampling import uniform
from cloudfork.plans.branch import KEY, analyse
from cloudfork.session import cut
from cloudfork.sources.store import RunStore

AT_ONCE = 5  # analyses whose jobs are given to Spark side by side
LEAST_POINTS = 1000  # up to so many rows there is no null distribution, and no branch


def branch_tree(stems: DataFrame) -> DataFrame:
    """(stem, parent_stem, depth): each stem with the stem without its last number, if that is one of them."""
    parents = stems.select(F.col("stem").alias("parent_stem"))
    return stems.withColumn("_up", parent_stem(F.col("stem"))).join(parents, F.col("_up") == F.col("parent_stem"), "left").select("stem", "parent_stem", stem_depth(F.col("stem")).alias("depth"))


def floor_keys(requests: DataFrame, grid: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Each request with, key by key, the greatest grid value not above it, else the smallest.

    The grid's distinct values of a key are one sorted array on the one row that every
    request meets; ``keys`` maps request columns to grid columns.
    """
    values = grid.agg(*[F.array_sort(F.collect_set(g)).alias(f"_{g}") for g in keys.values()])  # one row, a grid axis each
    out = requests.crossJoin(values)
    for r, g in keys.items():
        below = F.filter(f"_{g}", _not_above(r))
        out = out.withColumn(g, F.coalesce(F.array_max(below), F.array_min(f"_{g}")))
    return out.drop(*[f"_{g}" for g in keys.values()])


def _not_above(column: str):
    return lambda x: x <= F.col(column)


def score_limit(null_scores: DataFrame, n_ref: int, n_points: int, n_dims: int, p: float) -> float:
    """The ``p`` quantile of the null scores of the grid point next below; infinite up to LEAST_POINTS.

    null_scores: (n_ref_cells, n_points, n_dims, score), one row a score.
    """
    if n_points <= LEAST_POINTS:
        return float("inf")
    spark = null_scores.sparkSession
    grid = null_scores.select("n_ref_cells", "n_points", "n_dims").distinct()
    asked = spark.createDataFrame([(n_ref, n_points, n_dims)], "a long, b long, c long")
    point = floor_keys(asked, grid, {"a": "n_ref_cells", "b": "n_points", "c": "n_dims"}).drop("a", "b", "c")
    value = quantile_value(null_scores.join(point, ["n_ref_cells", "n_points", "n_dims"]), "score", p)
    return float("inf") if value is None else value


def analyse_recursively(
    cells: DataFrame, options: Options, null_scores: DataFrame | Callable[[int, int, int], DataFrame], dim: int, max_depth: int = 6, store: RunStore | None = None
) -> DataFrame:
    """(stem, parent_stem, depth, run_flag, cell_id, top_node, at_branch_point): every level's rows under their branch stems.

    A level splits while its best score exceeds the null quantile: each branch goes on with its own
    rows and those of the branch point, without taking out outliers again. Branches of fewer than
    min_branch_rows rows, or too few for the nodes needed, are listed with run_flag false. Branches
    that cannot split, by depth or for want of a null distribution, are not analysed again.
    ``null_scores`` is a table, or gives one for (n_ref_cells, n_points, n_dims) when a level needs
    it, see ``null_tables``. The branches of a level run side by side, the rows stay in tables.
    With a ``store``, the split of every branch is saved there with the options, and a later call with the
    same options and the same cells takes it from there instead of running the branch again.
    """
    spark = cells.sparkSession

    def split(stem: str, rows: DataFrame, depth: int, opts: Options) -> tuple[DataFrame | None, DataFrame | None]:
        """The top-level node of each row (for the top only), and the rows of each branch; None if there is no split."""
        run = analyse(rows, opts)
        top = cut(run.cells.select(KEY, F.col("node_id").alias("top_node"))) if depth == 0 else None
        n = run.cells.count()
        if n <= LEAST_POINTS or depth >= max_depth:
            return top, None
        nulls = null_scores(opts.nodes_for(n), n, dim) if callable(null_scores) else null_scores
        best = run.scores.agg(F.max("score")).first()[0] or 0.0
        if best <= score_limit(nulls, opts.nodes_for(n), n, dim, opts.p_cutoff) or run.branches.filter("branch > 0").select("branch").distinct().count() < 2:
            return top, None
        return top, cut(run.cells.join(run.branches, "node_id").select(KEY, "branch", *[c for c in rows.columns if c != KEY]))

    def split_once(job: tuple) -> tuple[DataFrame | None, DataFrame | None]:
        stem, rows, depth, opts = job
        if store is None:
            return split(*job)
        asked = {"stem": stem, "rows": rows.count(), "keys": rows.agg(F.bit_xor(F.xxhash64(*rows.columns))).first()[0], "depth": max_depth, **vars(opts)}
        own = RunStore(spark, f"{store.folder}/{stem}")
        if not own.resumes(asked):
            top, parts = split(*job)
            none = spark.createDataFrame([], f"{KEY} {dict(rows.dtypes)[KEY]}, branch int")
            own.save_tables({"top": none if top is None else top, "parts": none if parts is None else parts}, asked)
        saved = own.load_run()
        return (saved["top"] if depth == 0 else None), (None if saved["parts"].isEmpty() else saved["parts"])

    jobs, levels = [("branch", cells, 0, options)], []
    top_nodes: DataFrame | None = None
    while jobs:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            done = list(zip(jobs, pool.map(split_once, jobs)))
        jobs = []
        for (stem, rows, depth, opts), (top, placed) in done:
            top_nodes = top if depth == 0 else top_nodes
            if placed is None:
                continue
            sizes = {r["branch"]: r["count"] for r in placed.groupBy("branch").count().collect()}  # a row a branch
            for b in sorted(b for b in sizes if b > 0):
                n_part, child = sizes[b] + sizes.get(0, 0), f"{stem}_{b}"
                part = placed.filter(F.col("branch").isin(0, b))
                big = n_part >= opts.min_branch_rows and n_part // 100 * 10 >= opts.min_nodes
                levels.append(part.select(F.lit(child).alias("stem"), F.lit(stem).alias("parent_stem"), F.lit(depth + 1).alias("depth"), F.lit(big).alias("run_flag"), KEY, (F.col("branch") == 0).alias("at_branch_point")))
                if big and depth + 1 < max_depth and n_part > LEAST_POINTS:
                    jobs.append((child, part.select(*rows.columns), depth + 1, opts.with_(outlier=0.0)))
    if not levels:
        empty = f"stem string, parent_stem string, depth int, run_flag boolean, {KEY} {dict(cells.dtypes)[KEY]}, at_branch_point boolean, top_node long"
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, levels).join(top_nodes, KEY, "left")


def deepest_labels(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, stem): the deepest branch that wins the vote of a top-level node's rows; 'branch' where there is none.

    At each depth the most frequent stem wins, ties by the smaller stem; rows of branch points do not vote.
    """
    votes = levels.filter("not at_branch_point and top_node <> 0").groupBy("depth", "top_node", "stem").count()
    won = votes.groupBy("depth", "top_node").agg(F.min(F.struct((-F.col("count")).alias("c"), "stem")).alias("w"))
    deep = won.groupBy("top_node").agg(F.max(F.struct("depth", "w.stem")).alias("d"))
    return nodes.select("node_id").join(deep, F.col("node_id") == F.col("top_node"), "left").select("node_id", F.coalesce("d.stem", F.lit("branch")).alias("stem"))


def branch_points(levels: DataFrame) -> DataFrame:
    """(parent_stem, node_id): the top-level node that most of a split's branch-point rows belong to, ties by node."""
    votes = levels.filter("at_branch_point and top_node <> 0").groupBy("parent_stem", "top_node").agg(F.countDistinct("cell_id").alias("n"))
    return votes.groupBy("parent_stem").agg(F.min(F.struct((-F.col("n")).alias("c"), "top_node")).alias("w")).select("parent_stem", F.col("w.top_node").alias("node_id"))


def central_node(labels: DataFrame, layout: DataFrame) -> DataFrame:
    """(stem, node_id): the node nearest to the centre of a stem's nodes on the layout, ties by node."""
    placed = labels.join(layout, "node_id")
    centre = placed.groupBy("stem").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    away = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    best = F.min(F.struct(away.alias("d"), "node_id")).alias("b")
    return placed.join(centre, "stem").groupBy("stem").agg(best).select("stem", "b.node_id")


def gaussian(*keys, seed: int):
    """A normal number for each combination of the keys, whatever the partitions."""
    one, two = (F.greatest(uniform(*keys, seed=seed + i), F.lit(2.0**-53)) for i in (0, 1))
    return F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)


def null_table(spark: SparkSession, n_ref: int, n_points: int, n_dims: int, options: Options, runs: int = 10) -> DataFrame:
    """(n_ref_cells, n_points, n_dims, score): the best scores of clouds without branches (Gaussian), for ``score_limit``. The runs go side by side."""

    def best(r: int) -> tuple:
        noise = F.array(*[gaussian(F.col("id"), F.lit(i), seed=options.seed + 1000 * (r + 1)) for i in range(n_dims)])
        cloud = cut(spark.range(n_points).select(F.col("id").alias(KEY), F.lit("null").alias("label"), noise.alias("features")))
        run = analyse(cloud, options.with_(n_ref_cells=n_ref, seed=options.seed + r))
        return n_ref, n_points, n_dims, run.scores.agg(F.max("score")).first()[0]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = list(pool.map(best, range(runs)))
    return spark.createDataFrame(rows, "n_ref_cells long, n_points long, n_dims long, score double")


def null_tables(spark: SparkSession, options: Options, grid: list[int] | None = None) -> Callable[[int, int, int], DataFrame]:
    """Null scores of the grid points that a run meets, each made once: of the numbers of points in ``grid``, else of 1001
    and the powers of two times 1000, the next below, or the least."""
    made: dict[tuple[int, int, int], DataFrame] = {}
    lock = Lock()

    def table(n_ref: int, n_points: int, n_dims: int) -> DataFrame:
        below = max((g for g in grid if g <= n_points), default=min(grid)) if grid else max(LEAST_POINTS + 1, 1000 * 2 ** ((n_points // 1000).bit_length() - 1))
        point = n_ref, below, n_dims
        with lock:  # branches run side by side
            if point not in made:
                made[point] = null_table(spark, *point, options)
            return made[point]

    return table
