"""Greedy forward feature selection. Each round scores all candidates in one pass over the rows,
whose states are counted before the shuffle; the driver keeps one number for each feature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudfork.operators.information import discrete


class _Counts:
    """Counts of the states of sets of columns: each call is one pass over the rows, which counts all of its sets at once."""

    def __init__(self, df: DataFrame, features: list[str], target: str):
        self.rows = discrete(df, [*features, target])
        self.n = self.rows.count()

    def terms(self, sets: dict) -> dict:
        """key -> sum over the states of sets[key] of c log2 c."""
        wanted = {key: tuple(sorted(s)) for key, s in sets.items()}
        distinct = sorted(set(wanted.values()))
        states = [F.struct(F.lit(i).alias("i"), F.array(*[F.col(c).cast("string") for c in s]).cast("array<string>").alias("state")) for i, s in enumerate(distinct)]
        counts = self.rows.select(F.inline(F.array(*states))).groupBy("i", "state").count()
        found = {r["i"]: r["t"] for r in counts.groupBy("i").agg(F.sum(F.col("count") * F.log2("count")).alias("t")).collect()}  # a number a set
        of = {s: found.get(i, 0.0) for i, s in enumerate(distinct)}
        return {key: of[s] for key, s in wanted.items()}


def _first(scores: dict[str, float], order: list[str]) -> str:
    return max(order, key=lambda f: (round(scores[f], 12), -order.index(f)))


def _information(t: dict, f: str, n: int, base: float) -> float:
    return (t["xy", f] + base - t["x", f] - t["y"]) / n if n else 0.0


def _with_class(data: _Counts, features: list[str], target: str):
    base = data.n * math.log2(data.n) if data.n else 0.0
    t = data.terms({("x", f): [f] for f in features} | {("xy", f): [f, target] for f in features} | {"y": [target]})
    return t, base, {f: _information(t, f, data.n, base) for f in features}


def select_mrmr(df: DataFrame, k: int, features: list[str], target: str) -> list[str]:
    """Each pick maximises I(f; C) minus the mean of I(f; s) over the picks s; ties by feature order."""
    data = _Counts(df, features, target)
    t, base, relevance = _with_class(data, features, target)
    picks, between = [_first(relevance, features)], {}
    while len(picks) < min(k, len(features)):
        rest = [f for f in features if f not in picks]
        new = data.terms({f: [f, picks[-1]] for f in rest})
        for f in rest:
            between.setdefault(f, []).append((new[f] + base - t["x", f] - t["x", picks[-1]]) / data.n)
        picks.append(_first({f: relevance[f] - sum(between[f]) / len(picks) for f in rest}, rest))
    return picks[:k]


def select_cmim(df: DataFrame, k: int, features: list[str], target: str) -> list[str]:
    """Each pick maximises the least I(f; C | s) over the picks s; ties by feature order."""
    data = _Counts(df, features, target)
    t, _, least = _with_class(data, features, target)
    picks = [_first(least, features)]
    while len(picks) < min(k, len(features)):
        s = picks[-1]
        rest = [f for f in features if f not in picks]
        new = data.terms({("fs", f): [f, s] for f in rest} | {("fcs", f): [f, target, s] for f in rest} | {"cs": [target, s]})
        for f in rest:
            least[f] = min(least[f], (t["x", s] - new["fs", f] - new["cs"] + new["fcs", f]) / data.n)
        picks.append(_first(least, rest))
    return picks[:k]


def select_disr(df: DataFrame, k: int, features: list[str], target: str) -> list[str]:
    """Each pick maximises the sum over the picks s of I(f, s; C) / H(f, s, C); ties by feature order."""
    data = _Counts(df, features, target)
    t, base, relevance = _with_class(data, features, target)
    picks, total = [_first(relevance, features)], dict.fromkeys(features, 0.0)
    while len(picks) < min(k, len(features)):
        s = picks[-1]
        rest = [f for f in features if f not in picks]
        new = data.terms({("fs", f): [f, s] for f in rest} | {("fsc", f): [f, s, target] for f in rest})
        for f in rest:
            joint = base - new["fsc", f]
            total[f] += (new["fsc", f] + base - new["fs", f] - t["y"]) / joint if joint > 1e-12 else 0.0
        picks.append(_first(total, rest))
    return picks[:k]


def select_iamb(df: DataFrame, features: list[str], target: str, threshold: float = 0.02) -> list[str]:
    """A Markov blanket: grow while the best I(f; T | blanket) reaches the threshold, then drop
    the least informative member while its I(f; T | rest) does not exceed it."""
    data = _Counts(df, features, target)

    def cmi(pairs: dict[str, list[str]]) -> dict[str, float]:
        sets = {}
        for f, z in pairs.items():
            sets |= {("z", f): z, ("fz", f): [f, *z], ("tz", f): [target, *z], ("ftz", f): [f, target, *z]}
        t = data.terms(sets)
        return {f: (t["z", f] - t["fz", f] - t["tz", f] + t["ftz", f]) / data.n if data.n else 0.0 for f in pairs}

    blanket: list[str] = []
    while len(blanket) < len(features):
        rest = [f for f in features if f not in blanket]
        gain = cmi({f: blanket for f in rest})
        best = _first(gain, rest)
        if gain[best] < threshold:
            break
        blanket.append(best)
    while blanket:
        gain = cmi({f: [g for g in blanket if g != f] for f in blanket})
        worst = min(blanket, key=lambda f: (gain[f], blanket.index(f)))
        if gain[worst] > threshold:
            break
        blanket.remove(worst)
    return blanket
