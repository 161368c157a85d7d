"""Toxicity by a weighted lexicon.

A text is folded (lower case, accents off, homoglyphs and digit substitutions mapped to Latin letters), and an
Aho-Corasick automaton finds the lexicon's terms in one pass; a term counts where it stands as a word. Matches inside
an exception phrase don't count. The sum of weights, normalised by length, gives the score through a logistic curve.

Lexicon, weights and curve are learned from at most ``sample`` labelled rows, taken by hash: term weights are smoothed
log-odds of documents, and a logistic curve is fitted to what the lexicon finds. Exception phrases are given (EXCEPTIONS
by default). Every document is scored whole.

Defined cases: a null text counts as empty; an empty text has the score of a text without matches; labels that are
null are not used; a document labelled twice with both values counts for both; with no labels at all the lexicon is
empty and every score is the same, below 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_or_empty, unused

#: Look-alike letters of other scripts, and digits or signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ı": "i", "ł": "l", "ø": "o"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Phrases in which a rude word is none.
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "pathetic fallacy", "idiot proof"]
_FOLD = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(SUBSTITUTES)
_WORDS = re.compile(r"[^\s.,;:?\"()\[\]{}<>*_-]+")
_EDGE = re.compile(r"[^a-z]")


def fold(text: str) -> str:
    """Lower case, no accents, homoglyphs as Latin letters; one blank between words, whose digits stand for letters
    where a word mixes letters with them."""
    text = text.lower().translate(_FOLD)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    out = []
    for w in _WORDS.findall(text):
        if not w.isalpha():
            w = w.rstrip("!")
            if any(c.isalpha() for c in w):
                w = w.translate(_LEET)
        if w:
            out.append(w)
    return " ".join(out)


def _folded(df: DataFrame, column: str, keep: str) -> DataFrame:
    """(toxic, word): the distinct words of each folded text."""
    schema = f"{keep}, word string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, words = [], []
            for t, x in zip(batch.column("toxic").to_pylist(), batch.column(column).to_pylist(), strict=True):
                own = set(fold(x or "").split(" ")) - {""}
                toxic += [t] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(words, pa.string())], names=["toxic", "word"])

    return df.select("toxic", column).mapInArrow(run, schema)


def learn_lexicon(labelled: DataFrame, terms: int = 2000, min_docs: int = 5, least: float = 2.0) -> dict[str, float]:
    """Terms with smoothed log-odds of at least ``least`` that at least ``min_docs`` training documents hold; the
    ``terms`` best by evidence. labelled: text, toxic."""
    labelled = labelled.where("toxic in (0, 1)").select(F.col("toxic").cast("int").alias("toxic"), text_or_empty().alias("text"))
    totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return {}
    bad, good = totals[1], totals[0]
    n = _folded(labelled, "text", "toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("c") + 0.5) / (good + 1.0))
    best = n.where(F.col("t") + F.col("c") >= min_docs).withColumn("w", odds).where(F.col("w") >= least)
    best = best.orderBy((F.col("w") * F.col("t")).desc(), "word").limit(terms).collect()
    return {r["word"]: float(r["w"]) for r in best}


class Scorer:
    """The automaton and what it finds in one text."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.machine.add_word(phrase, (len(phrase), None))
        self.any = bool(lexicon)
        if self.any:
            self.machine.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """(sum of weights per root of the words, sum of weights) of the terms that stand as words."""
        text = fold(text)
        if not self.any or not text:
            return 0.0, 0.0
        hits, spared = [], []
        for end, (size, weight) in self.machine.iter(text):
            start = end - size + 1
            if (start == 0 or _EDGE.match(text[start - 1])) and (end + 1 == len(text) or _EDGE.match(text[end + 1])):
                (spared if weight is None else hits).append((start, end, weight))
        if spared:
            begins, reach = zip(*sorted((x, y) for x, y, _ in spared), strict=True)
            reach = np.maximum.accumulate(reach)  # how far phrases that begin up to here reach
            hits = [h for h in hits if not (i := bisect_right(begins, h[0])) or reach[i - 1] < h[1]]
        total = sum(w for _, _, w in hits)
        return total / (1 + text.count(" ")) ** 0.5, total


def _features(df: DataFrame, lexicon: dict[str, float], exceptions: list[str], names: list[str], kinds: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, exceptions)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            f = np.array([scorer.features(x or "") for x in texts], dtype=float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(f[:, 0]), pa.array(f[:, 1])], names=[*names, dense, total])

    dense, total = unused("dense", names), unused("total", names)
    schema = ", ".join(f"`{n}` {k}" for n, k in zip([*names, dense, total], [*kinds, "double", "double"], strict=True))
    return df.select(*[F.col(f"`{n}`") for n in names], *([] if "text" in names else ["text"])).mapInArrow(run, schema)


class Model:
    """Lexicon, exception phrases and curve."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str], curve: tuple[float, float, float]):
        self.lexicon, self.exceptions, self.curve = lexicon, exceptions, curve

    def score(self, docs: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """The columns ``keep`` and, in the column ``name``, the score; a column of that name in ``keep`` is replaced."""
        keep = [n for n in keep if n.lower() != name.lower()]
        kinds = [docs.schema[n].dataType.simpleString() for n in keep]
        a, b, c = self.curve
        f = _features(docs, self.lexicon, self.exceptions, keep, kinds)
        dense, total = (F.col(f"`{n}`") for n in f.columns[-2:])
        return f.select(*[F.col(f"`{n}`") for n in keep], (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * dense + F.lit(c) * total)))).alias(name))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two features, by damped Newton steps with a small ridge."""
    scale = np.maximum(x.std(0), 1e-9)
    m = np.c_[np.ones(len(x)), x / scale]
    w = np.zeros(3)
    ridge = np.array([1e-6, 1e-2, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(ridge) + 1e-9 * np.eye(3), m.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1])


def fit(labelled: DataFrame, terms: int = 2000, sample: int = 20000, exceptions: list[str] | None = None) -> Model:
    """Learn from (doc_id, text, toxic). ``sample`` bounds the rows of the curve, taken by hash of doc_id.

    ``exceptions`` are phrases, folded here, whose matches don't count."""
    small_batches(labelled.sparkSession)
    lexicon = learn_lexicon(labelled, terms)
    phrases = [fold(x) for x in (EXCEPTIONS if exceptions is None else exceptions)]
    known = labelled.where("toxic in (0, 1)").select(F.xxhash64("doc_id").alias("h"), F.col("toxic").cast("int").alias("toxic"), text_or_empty().alias("text"))
    rows = _features(known, lexicon, phrases, ["h", "toxic"], ["bigint", "int"]).orderBy("h").limit(sample).select("toxic", "dense", "total").collect()
    if not lexicon or not rows:
        return Model({}, phrases, (-1.0, 0.0, 0.0))
    y = np.array([r["toxic"] for r in rows], dtype=float)
    x = np.array([(r["dense"], r["total"]) for r in rows], dtype=float)
    return Model(lexicon, phrases, _curve(x, y))


def held_out():
    """True for one doc_id in five, and for a null one (an empty text): never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = 20000) -> DataFrame:
    """doc_id, text, toxic of labelled rows that may be learned from: at most ``sample`` labels, taken by hash of doc_id.

    The bound makes the labels' side a broadcast of known size, so no text is shuffled; what is learned reads the rows
    from the shared folder."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out()).distinct()
    # Only hashes that can be among the first leave their task: twice the expected share, so it hardly ever holds fewer.
    part = min(1.0, 2.0 * sample / max(1, known.count()))
    h = F.xxhash64("doc_id")
    known = known.where(F.pmod(h, F.lit(1 << 30)) < int(part * (1 << 30))).orderBy(F.pmod(h, F.lit(1 << 30)), "doc_id", "toxic").limit(sample)
    return stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "labelled")
