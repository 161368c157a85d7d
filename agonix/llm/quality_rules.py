"""Quality rules: fixed counts per text, and the divergence of its distributions from those of its language.

Fixed counts come from Arrow kernels over a batch: words, symbols, repeated lines, and words that lie in an 8-word window
found twice or more (windows are named exactly, by encoding pairs of words, pairs of pairs, and pairs of those).

The divergence rules compare two histograms of a text, its character classes and its common words, with references: the
sums over all documents of each language (at most ``languages`` of them, those with most words; at most ``common`` words
each, a last bin for the rest). The measure is the Jensen-Shannon distance to the nearest reference, so a text in another
language than its label says isn't rejected. A histogram of n items strays from its source by chance, by about the square
root of (bins - 1) / (8 n ln 2); a rule allows for that on top of its limit, and doesn't judge texts below its minimum
length at all (200 code points for classes, 100 words for words).

Defined cases: a null or empty text has no words and fails the fixed rule; a null language, or no column ``lang``, is a
language of its own; references without words judge nothing; repeated rows are judged and counted each for itself; an empty
table gives no rows; of other columns those in ``keep`` are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_text import coded, per_row, pieces, starts, text_column
from .common import small_batches, stored, unused

WORD_GAP, LINE_GAP = r"[\x20\x09-\x0D]+", "\n"
SYMBOLS = "[#*$%&|<>]"
#: Words of the divergence rule: runs of a-z, 0-9 and everything beyond ASCII, A-Z lower-cased.
TERM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Character classes, by pattern; what none of them matches (control characters) isn't counted.
CLASSES = {
    "lower": "[a-z]",
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "blank": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:!?'\"()-]",
    "sign": r"[#$%&*+/<=>@\[\\\]^_`{|}~]",
    "other": r"[^\x00-\x7F]",
}
WINDOW = 8
MIN_CHARS, MIN_WORDS = 200, 100
CHAR_LIMIT, WORD_LIMIT = 0.20, 0.10
_HELD = 200_000


def fixed_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    rows, ids, distinct = pieces(texts, WORD_GAP)
    bounds = starts(rows, n)
    size = pc.utf8_length(distinct).to_numpy().astype(np.int64)
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_row(size[ids], bounds),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy().astype(np.int64),
        "n_dup_lines": _repeated_lines(texts),
        "n_repeat_words": per_row(_in_repeated_window(rows, ids, max(1, len(distinct))), bounds),
    }


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    rows, ids, distinct = pieces(texts, LINE_GAP)
    worded = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[ids]
    rows, ids = rows[worded], ids[worded]
    first, _ = np.divmod(np.unique(rows * max(1, len(distinct)) + ids), max(1, len(distinct)))
    return np.bincount(rows, minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def _in_repeated_window(rows: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Whether each word lies in a window of WINDOW words that its text holds twice or more."""
    covered = np.zeros(len(ids) + 1, np.int64)
    last = len(ids) - WINDOW + 1
    if last > 0:
        name, names, step = ids, size, 1
        while step < WINDOW:  # names of windows of 2, 4, 8 words from those half as long
            name, distinct = coded(name[:-step] * names + name[step:])
            names, step = max(1, len(distinct)), 2 * step
        inside = np.flatnonzero(rows[:last] == rows[WINDOW - 1 :])
        key, distinct = coded(name[inside] * (int(rows[-1]) + 1) + rows[inside])
        again = inside[np.bincount(key, minlength=len(distinct))[key] > 1]
        np.add.at(covered, again, 1)
        np.subtract.at(covered, again + WINDOW, 1)
    return np.cumsum(covered)[:-1] > 0


def class_counts(texts: pa.Array) -> np.ndarray:
    """A row of character class counts per text."""
    return np.stack([pc.count_substring_regex(texts, p).to_numpy().astype(np.int64) for p in CLASSES.values()], axis=1)


class Reference(NamedTuple):
    """One language: its character class counts, its common words, and their counts with that of all other words."""

    classes: np.ndarray
    terms: list[str]
    words: np.ndarray


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance (square root of the divergence in bits) of each row of ``counts`` from ``reference``."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = np.broadcast_to(reference / reference.sum(), p.shape)
    m = (p + q) / 2
    ratio = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0.0).sum(1)
    return np.sqrt(np.maximum(0, (ratio(p) + ratio(q)) / 2))


def allowance(bins: int, n: np.ndarray) -> np.ndarray:
    """How far a sample of n items strays from its source by chance."""
    return np.sqrt((bins - 1) / (8 * math.log(2) * np.maximum(n, 1)))


def _language(docs: DataFrame):
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def references(docs: DataFrame, column: str = "text", common: int = 64, languages: int = 256) -> list[Reference]:
    """The sums over all documents. Tasks count words before the shuffle, in tables of a bounded size; the driver gets
    ``common`` words and one row of classes per language."""
    small_batches(docs.sparkSession)
    names = list(CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = [*found]
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "term", "n"])
            found.clear()
            return made

        for batch in batches:
            texts = text_column(batch, column)
            rows, ids, distinct = pieces(pc.ascii_lower(texts), TERM_GAP)
            langs, kinds = coded(text_column(batch, "lang"))
            classes, kinds, terms = class_counts(texts), kinds.to_pylist(), distinct.to_pylist()
            keys, n = np.unique(langs[rows] * max(1, len(terms)) + ids, return_counts=True)
            for k, x in zip(keys.tolist(), n.tolist(), strict=True):
                found[kinds[k // len(terms)], terms[k % len(terms)]] += x
            for i, kind in enumerate(kinds):  # the classes travel as terms that no word can be
                for name, x in zip(names, classes[langs == i].sum(0).tolist(), strict=True):
                    found[kind, f" {name}"] += x
            if len(found) > _HELD:
                yield out()
        if found:
            yield out()

    counts = docs.select(_language(docs).alias("lang"), column).mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("is_word", ~F.startswith("term", F.lit(" "))), "terms", narrow=True)
    of = [F.coalesce(F.sum(F.when(F.col("term") == f" {name}", F.col("n"))), F.lit(0)).alias(name) for name in names]
    totals = counts.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("is_word"), F.col("n"))), F.lit(0)).alias("n"), *of)
    totals = totals.orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "term"))
    top: dict[str, dict[str, int]] = {r["lang"]: {} for r in totals}
    for r in counts.where("is_word").withColumn("place", place).where(F.col("place") <= common).where(F.col("lang").isin([*top])).collect():
        top[r["lang"]][r["term"]] = r["n"]
    return [Reference(np.array([r[x] for x in names], float), sorted(w := top[r["lang"]]), np.array([*(w[x] for x in sorted(w)), r["n"] - sum(w.values())], float)) for r in totals]


def nearest(texts: pa.Array, known: list[Reference]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distance of its classes, distance of its words, characters counted, words counted."""
    n = len(texts)
    classes = class_counts(texts)
    rows, ids, distinct = pieces(pc.ascii_lower(texts), TERM_GAP)
    n_terms = np.diff(starts(rows, n))
    by_class, by_word = [], []
    for r in known:
        if r.classes.sum() > 0:
            by_class.append(distance(classes, r.classes))
        if r.words.sum() > 0:
            bins = len(r.words)
            bin_of = pc.fill_null(pc.index_in(distinct, value_set=pa.array(r.terms, pa.string())), bins - 1).to_numpy().astype(np.int64)
            by_word.append(distance(np.bincount(rows * bins + bin_of[ids], minlength=n * bins).reshape(n, bins), r.words))
    none = np.zeros(n)
    return np.min(by_class, axis=0) if by_class else none, np.min(by_word, axis=0) if by_word else none, classes.sum(1), n_terms


def judge(docs: DataFrame, known: list[Reference], keep: list[str], column: str = "text") -> DataFrame:
    """The columns in ``keep``, the fixed counts, base_failed, char_distance, word_distance and kept of every document."""
    small_batches(docs.sparkSession)
    bins = max([len(r.words) for r in known], default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, column)
            counts = fixed_counts(texts)
            by_class, by_word, n_chars, n_terms = nearest(texts, known)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            far = (n_chars >= MIN_CHARS) & (by_class > CHAR_LIMIT + allowance(len(CLASSES), n_chars))
            far |= (n_terms >= MIN_WORDS) & (by_word > WORD_LIMIT + allowance(bins, n_terms))
            new = {**counts, "base_failed": failed, "char_distance": by_class, "word_distance": by_word, "kept": ~failed & ~far}
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x) for x in new.values())], names=[*batch.schema.names[: len(keep)], *new])

    kept = docs.select(*keep, F.col(column).alias(column := unused("text", keep)))
    more = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *T.StructType.fromDDL(more).fields]))
