"""Tokens against the public libraries, mixing by its invariants, reading levels on made texts."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudfork.llm import mixing, reading, tokens

DATA = Path("/root/testdata/sf0.001")
needs_vocabulary = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary here")
TEXTS = [
    None, "", " ", "\n\n \t x", "Hello, world! it's 2024's", "naïve café — 東京 🙂🙂🙂", "a" * 5000, "<|endoftext|> is text", "\x00\x01 ﻿​", "def f(x):\n    return x**2\n" * 50,
    "ab" * 40_000, "é é", "don't DON'T we'll I'M", "  leading", "trailing  ",
]


@needs_vocabulary
def test_ids_are_those_of_the_public_library(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(tokens.VOCABULARY)
    public.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    rows = tokens.encode_corpus(df).collect()
    assert len(rows) == len(TEXTS) + 1
    got = {r.doc_id: r.ids for r in rows}
    for i, t in enumerate(TEXTS):
        assert got[i] == (public.encode(t, add_special_tokens=False).ids if t else []), i
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert tokens.encode_corpus(df.limit(0)).count() == 0


@needs_vocabulary
@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_p6_ids_of_the_whole_table(spark):
    from tokenizers import Tokenizer

    from cloudfork.llm import queries

    public = Tokenizer.from_file(tokens.VOCABULARY)
    public.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, str(DATA)).collect()}
    assert got == {i: public.encode(t, add_special_tokens=False).ids if t else [] for i, t in texts.items()}
    assert queries.p6_roundtrip(spark, str(DATA)).filter("not exact").count() == 0


def test_permutation():
    for n in (1, 2, 3, 10, 257, 5000):
        for key in (0, -5, 12345):
            got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n))
    a, b = (mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a == b).mean() < 0.02 and (a == np.arange(1000)).mean() < 0.02


def test_shard_counts_add_up():
    drawn = mixing.shard_counts({"a": 900, "b": 90, "c": 0, "d": 10}, 100, 3)
    assert drawn.groupby("source")["count"].sum().to_dict() == {"a": 900, "b": 90, "d": 10}
    assert (drawn.groupby("shard")["count"].sum() == 100).all()


@needs_vocabulary
def test_mixing(spark):
    docs = [(i, "word " * (20 + i % 50), " Big " if i % 2 else "BIG") for i in range(400)] + [(1000 + i, "rare thing " * 30, "small") for i in range(12)]
    docs += [(2000, None, "small"), (2001, "", "big"), (2002, "no source at all", None), (2003, "unnamed source", "other"), (2003, "unnamed source", "other")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("ids", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1, 0.5), ("Small", 0.4, 3, 0.5), ("absent", 0.1, 2, 0.5)], "source string, target_share double, max_repeats int, total_fraction double")
    mixed = mixing.mix_sources(documents, targets, block_tokens=64, shard_slots=20).collect()
    report = {r.source: r for r in mixing.mix_report(documents, targets, block_tokens=64, shard_slots=20).collect()}
    size, uses = Counter(), Counter((r.source, r.block_no) for r in mixed)
    for r in mixed:
        size[r.source] += len(r.ids)
        assert len(r.ids) <= 64 and r.repeat < {"big": 1, "small": 3}[r.source]
    assert len({(r.shard, r.position) for r in mixed}) == len(mixed)
    for source, most in (("big", 1), ("small", 3)):
        assert max(n for (s, _), n in uses.items() if s == source) <= most
        assert report[source].actual_tokens == size[source]
    assert abs(report["big"].actual_tokens - report["big"].target_tokens) <= 64
    assert report["small"].actual_tokens == 3 * report["small"].source_tokens and report["small"].shortfall_tokens > 0
    assert report["absent"].actual_tokens == 0 and report["absent"].shortfall_tokens > 0
    assert report["other"].actual_tokens == 0 and report["other"].source_tokens > 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    free = Counter()
    for r in mixing.mix_sources(documents, targets, block_tokens=64, shard_slots=20, exact=False).collect():
        free[r.source] += 1
        assert r.repeat < {"big": 1, "small": 3}[r.source]
    assert free["big"] > 0 and free["small"] > 0
    assert mixing.mix_sources(documents.limit(0), targets).count() == 0
    assert mixing.mix_sources(documents, targets.limit(0)).count() == 0


@needs_vocabulary
def test_blocks_hold_every_token_once(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", list(range(i, i + i % 17))) for i in range(200)] + [(7, "a", [1, 2])], "doc_id long, source string, ids array<int>")
    for name in "ab":
        blocks = [r.ids for r in mixing.pack_blocks(df, 16).filter(f"source = '{name}'").orderBy("block_no").collect()]
        assert all(len(b) == 16 for b in blocks[:-1])
        assert Counter(t for b in blocks for t in b) == Counter(t for r in df.filter(f"source = '{name}'").collect() for t in r.ids)


EASY = "The cat sat on the mat. The dog ran to the cat. It was a fun day. " * 5
HARD = "Institutional heterogeneity notwithstanding, contemporary epistemological considerations necessitate comprehensive methodological reconceptualization of interdisciplinary investigations. " * 5


def test_levels_order_texts_and_ignore_what_is_not_prose(spark):
    code = "\n\n```python\n" + "def supercalifragilistic(antidisestablishmentarianism): pass\n" * 50 + "```\n> " + HARD + "\n\nhttps://example.org/a/very/long/link\n"
    rows = [(1, EASY), (2, HARD), (3, EASY + code), (4, None), (5, ""), (6, "```\nx = 1\n```"), (7, EASY * 500), (1, EASY)]
    got = [(r.doc_id, r.words, r.level) for r in reading.reading_levels(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    by = {i: (w, level) for i, w, level in got}
    assert by[1][1] < 3 and by[2][1] > 14
    assert by[3] == by[1]
    assert by[4] == by[5] == by[6] == (0, None)
    assert by[7][0] == 500 * by[1][0]


def test_chained_clauses_are_not_one_sentence():
    clauses = ["the cat sat down", "it slept", "we left", "he came back late"]
    for joint in ("; ", " and then ", " and ", ", but ", " so "):
        assert len(reading.prose("First of all " + clauses[0] + "".join(joint + c for c in clauses[1:]) + ".")) == 4
    assert reading.prose("Bread and butter or jam, salt and pepper.") == ["Bread and butter or jam, salt and pepper"]
    assert reading.prose("See https://example.org/a?b=c (a note) for more. See www.example.org (gone).") == ["See   for more", "See"]


@pytest.mark.parametrize("word, n", [("cat", 1), ("table", 2), ("banana", 3), ("walked", 1), ("wanted", 2), ("reading", 2), ("readability", 5), ("nation", 2), ("horses", 2), ("strength", 1)])
def test_syllables(word, n):
    assert reading.syllables(word) == n


def test_band_limits():
    levels, bands = np.array([1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10]), np.array([1, 1, 2, 2, 3, 3, 4, 4, 5, 5])
    assert reading.band_limits(levels, bands) == [2.5, 4.5, 6.5, 8.5]
    assert reading.band_limits(levels[:4], bands[:4])[1:] == [float("inf")] * 3


def test_bands_without_labels_are_null(spark):
    docs = spark.createDataFrame([(1, EASY), (2, HARD)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 5)], "doc_id long, band int")
    assert {r.doc_id: r.band for r in reading.reading_bands(docs, labels).collect()} == {1: 1, 2: 5}
    assert all(r.band is None for r in reading.reading_bands(docs, labels.limit(0)).collect())


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables here")
def test_labels_held_out(spark):
    """Limits fitted to half of the labelled documents place the band 5 of the other half."""
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "reading_labels"))
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    truth = {}
    for r in held.filter("band is not null").collect():
        truth.setdefault(r.doc_id, []).append(r.band)
    some = documents.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    got = {r.doc_id: r.band for r in reading.reading_bands(some, fit).filter("band is not null").collect()}
    pairs = [(sorted(b)[(len(b) - 1) // 2], got[i]) for i, b in truth.items() if i in got]
    assert len(pairs) > 20
    assert np.mean([abs(a - b) <= 1 for a, b in pairs]) >= 0.95
    top = [(a == 5, b == 5) for a, b in pairs]
    assert sum(a and b for a, b in top) >= 0.9 * sum(a for a, _ in top)
    assert sum(a and b for a, b in top) >= 0.9 * sum(b for _, b in top)
