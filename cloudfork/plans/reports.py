"""The tables behind the reports of an analysis, and the report that comes before one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.functions import scalar
from cloudfork.operators import contingency, information
from cloudfork.plans.branch import KEY, Run, label_table


def binned(df: DataFrame, markers: list[str], bins: int | None = None, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, list[float]]]:
    """The markers as numbers of round equal-width bins, ceil(n ** (1/3)) of them unless given, with the columns ``keep``; and the edges.

    Null and NaN values have no bin; markers without any value have no edges and are null.
    """
    clean = {m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")) for m in markers}
    row = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{m}_{k}") for m, c in clean.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    count = bins or max(1, scalar.cube_root_bins(row["n"]))
    edges = {m: scalar.round_edges(row[f"{m}_lo"], row[f"{m}_hi"], count) for m in markers if row[f"{m}_lo"] is not None}
    numbers = [(scalar.bin_number(clean[m], edges[m]) if m in edges else F.lit(None).cast("int")).alias(m) for m in markers]
    return df.select(*(keep or []), *numbers), edges


def pre_run(df: DataFrame, markers: list[str], used: list[str], label: str, bins: int | None = None) -> dict[str, DataFrame]:
    """The report before an analysis: ``marginals`` (label, marker, bin, count) over round bins, ``edges`` (marker, bin, lo, hi),
    ``information`` (m1, m2, mi) of the binned markers and ``summary`` (marker, used, max_mi, mean_mi)."""
    table, edges = binned(df, markers, bins, [label])
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("bin")) for m in markers]))
    marginals = table.select(label, pairs).filter("bin is not null").groupBy(label, "marker", "bin").count()
    rows = [(m, i, e[i - 1], e[i]) for m, e in edges.items() for i in range(1, len(e))]
    mutual = information.pairwise_information(table, markers)
    return {
        "marginals": marginals, "edges": df.sparkSession.createDataFrame(rows, "marker string, bin int, lo double, hi double"),
        "information": mutual, "summary": information.information_summary(mutual, markers, used),
    }


def samples_on_layout(run: Run, layout: DataFrame) -> DataFrame:
    """(node_id, label, count, share, largest, x, y): the rows of each sample at each node, the node's part of the
    sample, and whether it is the sample of which the node holds most."""
    counts = label_table(run)
    totals = counts.groupBy("label").agg(F.sum("count").alias("total"))
    shared = counts.join(totals, "label").withColumn("share", F.try_divide(F.col("count"), F.col("total")))
    most = contingency.largest_share(run.cells.filter("node_id <> 0"), "node_id", "label").select("node_id", F.col("label").alias("most"))
    return shared.join(most, "node_id").join(layout, "node_id").select("node_id", "label", "count", "share", F.col("label").eqNullSafe(F.col("most")).alias("largest"), "x", "y")


def density_views(run: Run, layout: DataFrame) -> dict[str, DataFrame]:
    """``nodes`` (node_id, density, x, y): the mean density of each node's rows; ``histogram`` (label, bin, lo, count) and
    ``ecdf`` (label, density, ecdf) of the densities of the rows that are no outliers."""
    inside = run.cells.filter("node_id <> 0")
    nodes = inside.groupBy("node_id").agg(F.avg("density").alias("density")).join(layout, "node_id")
    table, edges = binned(inside, ["density"], keep=["label"])
    bounds = run.cells.sparkSession.createDataFrame([(i, lo) for i, lo in enumerate(edges.get("density", []), start=1)], "bin int, lo double")
    histogram = table.groupBy("label", F.col("density").alias("bin")).count().join(bounds, "bin")
    return {"nodes": nodes, "histogram": histogram.select("label", "bin", "lo", "count"), "ecdf": contingency.distribution(inside, "density", ["label"])}


def displayed_branches(branches: DataFrame) -> DataFrame:
    """The rows of the branches that are shown: of more than one node, without the branch point."""
    shown = branches.filter("branch > 0").groupBy("branch").count().filter("count > 1").select("branch")
    return branches.join(shown, "branch", "left_semi")


def recursive_panels(levels: DataFrame, labels: DataFrame, cells: DataFrame, layout: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a recursive analysis: ``contingency`` (stem, label, count, share) of the rows by the deepest stem of
    their top-level node, ``tree`` (stem, parent_stem, depth, rows, run_flag), and with a layout ``nodes`` (node_id, stem, x, y).

    levels: of ``analyse_recursively``; labels: of ``deepest_labels``; cells: of the top-level run.
    """
    rows = cells.filter("node_id <> 0").join(labels, "node_id")
    shares = contingency.shares(rows, "stem", "label").select("stem", "label", "count", F.col("row_share").alias("share"))
    tree = levels.groupBy("stem", "parent_stem", "depth").agg(F.countDistinct(KEY).alias("rows"), F.max("run_flag").alias("run_flag"))
    return {"contingency": shares, "tree": tree} | ({"nodes": labels.join(layout, "node_id")} if layout is not None else {})
