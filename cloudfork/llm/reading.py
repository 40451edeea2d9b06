"""Reading level of each document.

Method: classic readability formulas from sentence length, word length and syllable
counts, the syllables by hyphenation-style rules, combined by the median of the grade
estimates. Only the document's own prose counts: code, links and quoted lines are cut out.
Where graders have labelled documents with bands, the limits between bands are fitted to
the labels.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_ROWS = 20_000  # bound of the labelled documents to which band limits are fitted
MEASURES = ("words", "sentences", "syllables", "letters", "hard_words")
GRADES = ("flesch_kincaid", "gunning_fog", "smog", "coleman_liau", "automated")

_FENCE = regex.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", regex.M | regex.S)
_HTML = regex.compile(r"<(pre|code|blockquote)\b[^>]*>.*?(?:</\1\s*>|\Z)", regex.S | regex.I)
_NOT_PROSE = regex.compile(r"`[^`\n]*`|\x1b\[[0-9;]*[A-Za-z]|\[[0-9;]{1,8}m|(?:(?:https?|ftp)://|www\.)\S+(?:[ \t]*\([^()\n]{1,40}\))?|<[^<>\n]{1,200}>")
_LINK = regex.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")
_MARKS = regex.compile(r"^[ \t]*(?:[-*+•]|#{1,6}|\d{1,3}[.)])[ \t]+")
#: A sentence ends with its mark. A chain of main clauses counts as that many sentences (minimal terminable units): it is cut
#: at semicolons, and at a coordinating conjunction before a sentence adverb or a pronoun that begins a clause.
_ENDS = regex.compile(
    r"[.!?…。！？]+[\"'”’)\]]*(?=\s|$)|[。！？]|;\s"
    r"|\b(?i:(?:and|but|or|nor|so|yet)\s+(?=(?:then|now|also|still|there|here|i|you|he|she|it|we|they|this|that|these|those)\b))"
)
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*")
_CODE_WORD = regex.compile(r"[\p{Ll}]\p{Lu}|[_\d(){}<>=\\/|$]|\w\.\w{2,}")
_VOWELS = regex.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿаеёиоуыэюя]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
#: Letter groups of English words that add a syllable to the count of vowel groups, or take one away.
_MORE = regex.compile(r"i[aou](?!us\b)|e[ou]s?$|ua|[aeiouy]ing$|ism$|[^aeiou]eo|uous")
_LESS = regex.compile(r"(?:[^aeiouyl]|[aeiouy]l)e$|(?:[^aeiouylszxcgh]|[aeiouy]l)es$|[^td]ed$|[ts]ion|[cg]i[aou]|ious|iour|tia[ln]")


def syllables(word: str) -> int:
    """Syllables of a word: its vowel groups, corrected by endings and letter groups; at least one."""
    word = word.lower().replace("’", "'").removesuffix("'s")
    n = 0
    for part in word.split("-"):
        n += max(1, len(_VOWELS.findall(part)) + len(_MORE.findall(part)) - len(_LESS.findall(part)))
    return n


def prose(text: str | None) -> list[str]:
    """The sentences of a text's own prose.

    Fenced and indented blocks, inline code, links with a note in brackets behind them, tags and
    quoted lines are cut out. A sentence ends with its mark, at a line's end unless the text is
    wrapped at a fixed width, and where main clauses are chained.
    """
    text = _FENCE.sub("\n\n", (text or "").replace("\r\n", "\n").replace("\r", "\n"))
    text = _HTML.sub("\n\n", text)
    text = _NOT_PROSE.sub(" ", _LINK.sub(r"\1", text))
    paragraphs: list[list[str]] = [[]]
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith(">") or line.startswith(("    ", "\t")):
            paragraphs.append([])
        elif _MARKS.match(line):
            paragraphs.append([_MARKS.sub("", line).strip()])
        else:
            paragraphs[-1].append(bare)
    if _wrapped(paragraphs):
        paragraphs = [[" ".join(p)] for p in paragraphs]
    return [s.strip() for p in paragraphs for line in p for s in _ENDS.split(line) if s.strip()]


def _wrapped(paragraphs: list[list[str]], widest: int = 100) -> bool:
    """Whether three in four line breaks within paragraphs are where the next word would not have fitted."""
    width = max((len(line) for p in paragraphs for line in p), default=0)
    breaks = [(a, b) for p in paragraphs for a, b in zip(p, p[1:])]
    full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in breaks)
    return bool(breaks) and width <= widest and full >= 0.75 * len(breaks)


def measures(text: str | None, cache: dict[str, int]) -> tuple[int, int, int, int, int]:
    """(words, sentences, syllables, letters, hard words) of a text's prose.

    A run of characters without a letter, or that looks like an identifier, is no word. In
    scripts without blanks two characters count as one word of two syllables.
    """
    words = sentences = syl = letters = hard = 0
    for sentence in prose(text):
        own = 0
        for token in sentence.split():
            if _CODE_WORD.search(token):
                continue
            for word in _WORD.findall(token):
                cjk = len(_CJK.findall(word))
                if cjk:
                    own, syl, letters = own + (cjk + 1) // 2, syl + cjk, letters + 2 * cjk
                    continue
                n = cache.get(word)
                if n is None:
                    if len(cache) >= 200_000:
                        cache.clear()
                    n = cache[word] = syllables(word)
                own, syl, letters, hard = own + 1, syl + n, letters + len(word), hard + (n >= 3)
        words += own
        sentences += own > 0
    return words, sentences, syl, letters, hard


def grades(words: int, sentences: int, syl: int, letters: int, hard: int) -> tuple[float, ...]:
    """The school grades by five classic formulas, in the order of GRADES."""
    per_sentence, per_word = words / sentences, syl / words
    return (
        0.39 * per_sentence + 11.8 * per_word - 15.59,
        0.4 * (per_sentence + 100 * hard / words),
        1.043 * (30 * hard / sentences) ** 0.5 + 3.1291,
        0.0588 * (100 * letters / words) - 0.296 * (100 * sentences / words) - 15.8,
        4.71 * letters / words + 0.5 * per_sentence - 21.43,
    )


def reading_levels(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, sentences, syllables, letters, hard_words, one column for each of GRADES, level).

    level is the median of the grades. A text without prose (null, empty, only code) has zero
    words and null grades. One row for each row; very long texts are measured whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            found = [measures(x, cache) for x in b.column(1).to_pylist()]
            levels = [grades(*m) if m[0] else (None,) * len(GRADES) for m in found]
            columns = [pa.array([m[i] for m in found], pa.int64()) for i in range(len(MEASURES))]
            columns += [pa.array([g[i] for g in levels], pa.float64()) for i in range(len(GRADES))]
            columns.append(pa.array([statistics.median(g) if g[0] is not None else None for g in levels], pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, *MEASURES, *GRADES, "level"])

    schema = f"`{id_col}` {dict(documents.dtypes)[id_col]}, " + ", ".join([*(f"{m} long" for m in MEASURES), *(f"{g} double" for g in (*GRADES, "level"))])
    return documents.select(id_col, text_col).mapInArrow(run, schema)


def band_limits(levels: np.ndarray, bands: np.ndarray, n_bands: int = 5) -> list[float]:
    """The levels at which the bands 2 .. n_bands begin: for each, the limit with the fewest labels on the wrong side.

    Among equally good limits the middle one; limits never fall from band to band. A band
    that no label reaches begins at infinity.
    """
    limits: list[float] = []
    for band in range(2, n_bands + 1):
        high = bands >= band
        if not high.any():
            limits.append(float("inf"))
            continue
        order = np.argsort(levels, kind="stable")
        x, y = levels[order], high[order]
        wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum(~y[::-1])[::-1], 0]
        wrong[1:-1][x[1:] == x[:-1]] = len(x) + 1
        best = np.flatnonzero(wrong == wrong.min())
        cut = int(best[len(best) // 2])
        edge = -np.inf if cut == 0 else np.inf if cut == len(x) else (x[cut - 1] + x[cut]) / 2
        limits.append(float(max([edge, *limits[-1:]])))
    return limits


def reading_bands(documents: DataFrame, labels: DataFrame, *, min_words: int = 40, label_rows: int = LABEL_ROWS, n_bands: int = 5) -> DataFrame:
    """The columns of ``reading_levels`` and band (1 easiest .. ``n_bands``), null below ``min_words`` words of prose.

    ``labels`` (doc_id, band) of up to ``label_rows`` documents, chosen by hash of the id, fit
    the limits; repeated grades of a document count by their median. Without labels every band is null.
    """
    levels = reading_levels(documents)
    grade = labels.filter("band is not null").groupBy("doc_id").agg(F.percentile_approx("band", 0.5).alias("band"))
    sample = (
        reading_levels(documents.join(grade.select("doc_id"), "doc_id", "left_semi")).filter(F.col("words") >= min_words)
        .join(grade, "doc_id").orderBy(F.xxhash64("doc_id")).limit(label_rows).select("level", "band").toPandas()
    )
    if not len(sample):
        return levels.withColumn("band", F.lit(None).cast("int"))
    band = F.lit(1)
    for b, limit in enumerate(band_limits(sample["level"].to_numpy(), sample["band"].to_numpy(), n_bands), start=2):
        band = F.when(F.col("level") >= limit, b).otherwise(band)
    return levels.withColumn("band", F.when(F.col("words") >= min_words, band))
