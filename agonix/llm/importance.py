"""Target-distribution importance resampling with hashed n-gram features, by Arrow kernels.

Features of a text are its runs of 1 to 3 consecutive words, repeats counted, each in one of ``buckets`` by its CRC-32.
Two bags of features, of the corpus and of the target, give every bucket a gain (1000 times the smoothed log ratio); a
document's weight is the sum of its features' gains, and Gumbel noise from its doc_id turns the highest sums into a draw
without replacement.

Within a batch the words are split and dictionary-encoded in Arrow. Shifted indices make pairs (word, word) and then
(pair, word), which are dictionary-encoded again, so a CRC is taken once per distinct n-gram, from that of the
n-gram one word shorter and that of the word. Bucket counts leave a task as at most ``buckets`` rows; the driver holds one gain per bucket.
The draw numbers rows inside range partitions of the score and adds the partitions' offsets: no task sees all rows.

Defined cases: a null or empty text has no features and weight 0; an empty corpus gives no rows; without target texts
only smoothing speaks; repeated rows count, are scored and can be drawn each for itself; a null doc_id takes the noise of
the empty string and loses ties; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import coded, per_row, pieces, starts, text_column
from .common import partitions, small_batches, stored


BUCKETS = 10_000
#: What stands between words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts handed to Python at a time.
ROWS = 1000


def _shift_tables(most: int) -> np.ndarray:
    """[length][byte's place][byte]: what a CRC-32 register with that byte becomes after so many zero bytes. The register
    is linear, so the CRC of two strings in a row is the first's CRC, shifted by the second's length, xor the second's."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = step[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


_SHORT = 64
_SHIFT = _shift_tables(_SHORT).ravel()


class _Words:
    """The distinct words of a batch, with a space in front: length and CRC-32."""

    def __init__(self, distinct: pa.Array):
        self.bytes = distinct.cast(pa.binary()).to_pylist()
        self.alone = np.array([crc32(w) for w in self.bytes], np.uint32)
        self.length = pc.binary_length(distinct).to_numpy().astype(np.int64) + 1
        self.crc = np.array([crc32(b" " + w) for w in self.bytes], np.uint32)

    def after(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The CRC-32 of each string with a further word."""
        length = self.length[word]
        table = np.minimum(length, _SHORT) * 1024
        out = self.crc[word] ^ _SHIFT[table + (crc & 0xFF)] ^ _SHIFT[table + 256 + (crc >> 8 & 0xFF)] ^ _SHIFT[table + 512 + (crc >> 16 & 0xFF)] ^ _SHIFT[table + 768 + (crc >> 24)]
        for i in np.flatnonzero(length > _SHORT):
            out[i] = crc32(b" " + self.bytes[word[i]], int(crc[i]))
        return out


def _grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The row of every word, and for 1, 2 and 3 words: the place of each n-gram's first word, and its bucket."""
    rows, ids, distinct = pieces(pc.ascii_lower(texts), SEPARATORS)
    words, size = _Words(distinct), len(distinct)
    at, gram, crc = np.arange(len(ids)), ids, words.alone
    out = [(at, (crc % buckets).astype(np.int64)[gram])]
    for n in (2, 3):  # an n-gram goes on if its text does: its first word and the next one are in one row
        goes = at + n - 1 < len(rows)
        goes[goes] = rows[at[goes]] == rows[at[goes] + n - 1]
        at, gram = at[goes], gram[goes]
        gram, pairs = coded(gram * size + ids[at + n - 1])
        pairs = pairs.to_numpy()
        crc = words.after(crc[pairs // size], pairs % size)
        out.append((at, (crc % buckets).astype(np.int64)[gram]))
    return rows, out


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts."""
    small_batches(texts.sparkSession, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _grams(text_column(batch, column), buckets)[1]:
                n += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["bucket", "n"])

    return texts.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the bucket counts of the corpus and the target."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = {r["bucket"]: (r["s"], r["t"]) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}  # at most one row a bucket
    s, t = (np.array([found.get(b, (0, 0))[i] for b in range(buckets)], np.float64) for i in (0, 1))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, column: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    small_batches(docs.sparkSession, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams = _grams(text_column(batch, column), len(gains))
            n_words = np.diff(starts(rows, batch.num_rows))
            n, weight = np.zeros((2, batch.num_rows), np.int64)
            for at, found in grams:
                bounds = starts(rows[at], batch.num_rows)
                n += np.diff(bounds)
                weight += per_row(gains[found], bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighted: DataFrame, num: int = 5, den: int = 100, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``weighted`` with score (weight plus Gumbel noise) and rank: of the N documents with at least ``least_words`` words
    the floor(num * N / den) highest scores, ties to the smaller doc_id, are numbered 1, 2, ...; other ranks are null."""
    spark = weighted.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weighted.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < least_words), "scored")
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    numbered = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")  # partition << 33 | place in it
    part = F.shiftright("at", 33)
    counts = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("out")).alias("fit"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(num * F.sum("fit").over(Window.partitionBy()) / den).alias("quota"))
    out = numbered.withColumn("part", part).join(F.broadcast(offsets), "part")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return out.withColumn("rank", F.when(~F.col("out") & (place <= F.col("quota")), place)).drop("part", "at", "before", "quota", "out")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document, drawn towards the texts of ``target``."""
    return draw(weigh(docs, bucket_gains(bucket_counts(docs), bucket_counts(target))), **options)
