"""Mixing sources to target weights.

Method: each source's tokens are packed into fixed-length blocks. Every output shard
draws its source counts from the multinomial of the targets, conditioned on the targets'
whole numbers of blocks, so that the shares come out up to one block. The i-th slot of a
source maps through a pseudorandom permutation of the source's block numbers, a new one
for each repeat, and slots join blocks by (source, block number).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudfork.llm.tokens import VOCABULARY, encode_corpus
from cloudfork.session import cut, drop_cut

BLOCK_TOKENS = 256
SHARD_SLOTS = 1024
BUNCH = 1024  # shards that a task draws; the driver draws whole bunches
BUCKET_DOCS = 20_000  # documents whose offsets one window computes


def clean_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def pack_blocks(encoded: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block_no, ids): the tokens of each source, in blocks of ``block_tokens``; its last may be shorter.

    ``encoded`` has doc_id, source, ids. Documents follow a hash of their id. Offsets come
    from sums over buckets, so that no window holds a whole source, however large.
    """
    counted = encoded.withColumn("n", F.size("ids").cast("long")).filter("n > 0")
    buckets = max(1, -(-counted.count() // BUCKET_DOCS))
    placed = counted.withColumns({"h": F.xxhash64("doc_id"), "bucket": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(buckets))})
    sums = placed.groupBy("source", "bucket").agg(F.sum("n").alias("bucket_n"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_n").over(by_bucket), F.lit(0))).select("source", "bucket", "start")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n", "ids").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["source", "bucket"]).withColumn("at", F.col("start") + F.col("within"))
    size = F.lit(block_tokens).cast("long")
    pieces = offsets.select(
        "source", "at", "ids", "n", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))).alias("block_no")
    )
    begin = F.greatest(F.col("block_no") * size, F.col("at"))
    end = F.least((F.col("block_no") + 1) * size, F.col("at") + F.col("n"))
    cutout = pieces.select("source", "block_no", "at", F.slice("ids", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    # a block has at most block_tokens pieces
    return cutout.groupBy("source", "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])).alias("ids"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed public constants): equal numbers give equal, close ones unrelated numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 24) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1, chosen by the key, at each i.

    Swap-or-not rounds: a keyed partner (k - i) mod n, and a coin that both partners share,
    decide whether the two change places; so every round is a bijection, whatever n is.
    """
    i, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    for r in range(rounds):
        k = _mixed(key + np.uint64(2 * r + 1)) % n
        partner = (k + n - i) % n
        coin = _mixed(_mixed(key ^ np.maximum(i, partner)) + np.uint64(2 * r + 2)) & np.uint64(1)
        i = np.where(coin == 1, partner, i)
    return i.astype(np.int64)


def _permuted(i: str, n: str, key: Column) -> Column:
    def run(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n.to_numpy(), key.to_numpy()))

    return F.pandas_udf(run, "long")(i, n, key)


def shard_counts(blocks: dict[str, int], slots: int, seed: int | list[int]) -> pd.DataFrame:
    """(shard, source, count, before): the draw of each shard of ``slots`` slots, and the source's slots in earlier ones."""
    names, left = sorted(blocks), np.array([blocks[s] for s in sorted(blocks)], np.int64)
    rng, before, rows, shard = np.random.default_rng(seed), np.zeros(len(left), np.int64), [], 0
    while left.sum() > 0:
        draw = rng.multivariate_hypergeometric(left, min(slots, int(left.sum())), method="marginals")
        rows += [(shard, s, int(c), int(b)) for s, c, b in zip(names, draw, before) if c]
        left, before, shard = left - draw, before + draw, shard + 1
    return pd.DataFrame(rows, columns=["shard", "source", "count", "before"]).astype({"shard": "int64", "count": "int64", "before": "int64"})


def plan_targets(per_source: DataFrame, targets: DataFrame, corpus_tokens: int) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, source_blocks, target_tokens, slots).

    target_tokens is the share of total_fraction times the corpus; slots the blocks that come
    nearest, at most max_repeats times the source. Sources without target get none; a target
    whose source is absent gets no slot. Of a source named twice the largest share holds.
    """
    wanted = targets.withColumn("source", clean_source(F.col("source"))).filter("source is not null").groupBy("source").agg(
        F.max(F.struct("target_share", "max_repeats", "total_fraction")).alias("t")
    ).select("source", "t.*")
    goal = F.coalesce(F.col("target_share"), F.lit(0.0)) * F.coalesce(F.col("total_fraction"), F.lit(0.0)) * corpus_tokens
    nearest = F.round(F.try_divide(F.col("target_tokens") * F.col("source_blocks"), F.col("source_tokens")))
    return (
        per_source.join(wanted, "source", "full").fillna(0, ["source_tokens", "source_blocks"]).withColumn("target_tokens", goal)
        .withColumn("slots", F.least(F.coalesce(nearest, F.lit(0.0)), F.coalesce("max_repeats", F.lit(0)) * F.col("source_blocks")).cast("long"))
        .select("source", "target_share", "max_repeats", "source_tokens", "source_blocks", "target_tokens", "slots")
    )


def _prepare(documents: DataFrame, targets: DataFrame, block_tokens: int, path: str):
    encoded = cut(encode_corpus(documents.withColumn("source", clean_source(F.col("source"))), path, keep=("source",)))
    corpus_tokens = encoded.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    named = encoded.join(targets.select(clean_source(F.col("source")).alias("source")).distinct(), "source", "left_semi")
    blocks = cut(pack_blocks(named, block_tokens))
    per_source = blocks.groupBy("source").agg(F.sum(F.size("ids").cast("long")).alias("source_tokens"), F.count("*").alias("source_blocks"))
    others = encoded.join(targets.select(clean_source(F.col("source")).alias("source")).distinct(), "source", "left_anti").filter("source is not null")
    rest = others.groupBy("source").agg(F.sum(F.size("ids").cast("long")).alias("source_tokens"), F.lit(0).cast("long").alias("source_blocks"))
    plan = cut(plan_targets(per_source.unionByName(rest), targets, corpus_tokens))
    drop_cut(encoded)
    return blocks, plan


def _drawn(bunches: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """The draw of every shard, from that of its bunch: both come from totals only."""

    def shards(pdf: pd.DataFrame) -> pd.DataFrame:
        bunch = int(pdf["shard"].iloc[0])
        inner = shard_counts(dict(zip(pdf["source"], pdf["count"])), shard_slots, [seed, bunch])
        inner["shard"] += bunch * BUNCH
        inner["before"] += inner["source"].map(dict(zip(pdf["source"], pdf["before"])))
        return inner

    return bunches.groupBy("shard").applyInPandas(shards, "shard long, source string, count long, before long")


def _slots(blocks: DataFrame, plan: DataFrame, shard_slots: int, seed: int, exact: bool) -> DataFrame:
    spark = blocks.sparkSession
    rows = plan.filter("slots > 0").orderBy("source").collect()  # sources with a target: as many rows as the target table
    wanted = {r["source"]: r["slots"] for r in rows}
    if not exact and wanted:
        total = sum(wanted.values())
        draw = np.random.default_rng(seed).multinomial(total, [n / total for n in wanted.values()])
        wanted = {r["source"]: min(int(n), r["max_repeats"] * r["source_blocks"]) for r, n in zip(rows, draw)}
    bunches = spark.createDataFrame(shard_counts(wanted, shard_slots * BUNCH, seed), "shard long, source string, count long, before long")
    counts = cut(_drawn(bunches, shard_slots, seed))
    slots = counts.select("shard", "source", F.explode(F.expr("sequence(before, before + count - 1)")).alias("i"))
    sized = slots.join(plan.select("source", "source_blocks"), "source").withColumns(
        {"repeat": F.floor(F.col("i") / F.col("source_blocks")), "block_no": F.pmod("i", "source_blocks")}
    )
    key = F.xxhash64("source", "repeat", F.lit(seed))
    return sized.select("shard", "source", "i", "repeat", _permuted("block_no", "source_blocks", key).alias("block_no"))


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 11, exact: bool = True, path: str = VOCABULARY
) -> DataFrame:
    """(shard, position, source, repeat, block_no, ids): the mixed corpus, block by block.

    repeat counts from 0 and stays below max_repeats; no block of a source comes again before
    all its blocks came. position is a pseudorandom order within the shard. Documents with
    null or unnamed source, and null or empty texts, give no block (they count towards the
    corpus total that total_fraction refers to); an empty table gives no rows. ``exact`` holds the
    multinomial to the targets' whole numbers of blocks; without, it is drawn freely, up to max_repeats.
    """
    blocks, plan = _prepare(documents, targets, block_tokens, path)
    slots = _slots(blocks, plan, shard_slots, seed, exact)
    order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "source", "i", F.lit(seed)), "source", "i")
    placed = slots.withColumn("position", F.row_number().over(order))  # at most shard_slots rows a shard
    return placed.join(blocks, ["source", "block_no"]).select("shard", "position", "source", "repeat", "block_no", "ids")


def mix_report(documents: DataFrame, targets: DataFrame, *, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = 11, exact: bool = True, path: str = VOCABULARY) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, target_tokens, actual_tokens, actual_share, repeats, shortfall_tokens)
    of each source with a target or with documents; counted from the slots' own blocks."""
    blocks, plan = _prepare(documents, targets, block_tokens, path)
    sizes = blocks.select("source", "block_no", F.size("ids").cast("long").alias("n"))
    used = _slots(blocks, plan, shard_slots, seed, exact).join(sizes, ["source", "block_no"]).groupBy("source").agg(
        F.sum("n").alias("actual_tokens"), (F.max("repeat") + 1).alias("repeats")
    )
    total = Window.partitionBy(F.lit(1))  # over the sources
    return (
        plan.join(used, "source", "left").fillna(0, ["actual_tokens", "repeats"])
        .withColumn("actual_share", F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(total)))
        .select("source", "target_share", "max_repeats", "source_tokens", "target_tokens", "actual_tokens", "actual_share", "repeats",
                F.greatest(F.lit(0.0), F.col("target_tokens") - F.col("actual_tokens")).alias("shortfall_tokens"))
    )
