"""The branch analysis: density, outliers, reference nodes, tree ensemble, branches, significance.

``cells`` is (key, label, features); every random step depends on key and seed only, and each
stage is written to the shared folder before the next reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.config import Options
from cloudfork.operators import contingency, distance, graph, sampling, seeding
from cloudfork.session import cut, cut_counted, drop_cut

KEY = "cell_id"


@dataclass
class Run:
    """The tables of one analysis."""

    cells: DataFrame  # cell_id, label, features, density, node_id
    nodes: DataFrame  # node_id, cell_id, features
    trees: DataFrame  # tree_id, src, dst, dist
    graph: DataFrame  # src, dst, freq, mean_len, inv_freq
    sizes: DataFrame  # node_id, threshold, rank, size
    scores: DataFrame  # node_id, score
    branches: DataFrame  # node_id, branch

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def with_density(cells: DataFrame, options: Options) -> DataFrame:
    """A column density: against at most n_dens_ref rows; all ones if nothing is thinned or taken out."""
    if options.outlier == 0 and options.threshold == 1:
        return cells.withColumn("density", F.lit(1.0))
    references = sampling.exact_sample(cells, KEY, options.n_dens_ref, sampling.uniform(F.col(KEY), seed=options.seed + 1))
    if options.knn_density:
        measured = distance.knn_distance(cells, references, 100, options.metric, key=KEY).withColumn("density", F.try_divide(F.lit(1.0), F.col("kth"))).drop("kth")
    else:
        measured = distance.kernel_density(cells, references, options.sigma, options.metric, key=KEY)
    return cells.join(measured, KEY)


def analyse(cells: DataFrame, options: Options) -> Run:
    """All stages up to the branches. Rows without key or features take no part; keys are unique."""
    cells = cells.filter(F.col(KEY).isNotNull() & F.col("features").isNotNull())
    if options.zero_ball:
        cells = sampling.remove_zero_ball(cells, "features", options.metric)
    sample = sampling.exact_sample(cells, KEY, options.sample_size, sampling.uniform(F.col(KEY), seed=options.seed))
    spark = cells.sparkSession
    cells, rows = cut_counted(sample.repartition(spark.sparkContext.defaultParallelism))  # a limit leaves one partition
    n_nodes = options.nodes_for(rows)
    measured = cut(with_density(cells, options))
    out = sampling.outliers(measured, "density", options.outlier)
    kept = sampling.density_downsample(measured, "density", options.outlier, options.threshold, sampling.uniform(F.col(KEY), seed=options.seed + 2))
    nodes = cut(seeding.seed_nodes(kept, n_nodes, options.metric, key=KEY, seed=options.seed))
    placed = seeding.partition_rows(measured, nodes, out, options.metric, key=KEY)
    dense = cut(measured.join(placed, KEY))
    drop_cut(measured)
    drop_cut(cells)
    inside = dense.filter("node_id <> 0")
    drawn = sampling.one_per_node(inside, "node_id", KEY, options.n_trees, options.seed)
    trees = cut(graph.tree_ensemble(drawn.join(inside.select(KEY, "features"), KEY), options.metric))
    union = cut(graph.ensemble_graph(trees))
    sizes = cut(graph.branch_sizes(spark, trees))
    scores = cut(graph.branching_scores(sizes, nodes, n_nodes))
    branches = cut(graph.best_branches(spark, trees, sizes, scores, options.three_branches))
    return Run(dense, nodes, trees, union, sizes, scores, branches)


def significance(run: Run, markers: dict[str, int]) -> DataFrame | None:
    """The analysis of variance of each marker (name -> position) of the nodes over the branches, without the
    branch point; None if there is no branch point, or a branch has no more than branches + 1 nodes."""
    counts = run.branches.groupBy("branch").count().collect()  # a row for each branch
    sizes = {r["branch"]: r["count"] for r in counts}
    outer = [n for b, n in sizes.items() if b != 0]
    if 0 not in sizes or min(outer) <= len(outer) + 1:
        return None
    values = run.nodes.join(run.branches.filter("branch <> 0"), "node_id").select("branch", *[F.col("features")[i].alias(m) for m, i in markers.items()])
    return contingency.anova(values, list(markers), "branch")


def node_distances(run: Run) -> DataFrame | None:
    """(node_id, branch, signed_dist) from the branch point; None if there is none."""
    point = run.branches.filter("branch = 0").first()
    return None if point is None else graph.signed_distance(graph.tree_hops(run.trees, point["node_id"]), run.branches)


def label_table(run: Run) -> DataFrame:
    """(node_id, label, count) of the rows that are no outliers, zeros filled in."""
    return contingency.full_counts(run.cells.filter("node_id <> 0"), "node_id", "label")


def node_means(cells: DataFrame, dim: int) -> DataFrame:
    """(node_id, features): the mean over a node's rows (of ``Run.cells``, or any rows with node_id and features); the
    node list itself has its representative's own values. Node 0, the outliers, has none."""
    v = F.col("features")
    return cells.filter("node_id <> 0").groupBy("node_id").agg(F.array(*[F.avg(v[i]) for i in range(dim)]).alias("features"))
