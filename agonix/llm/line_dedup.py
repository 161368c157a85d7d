"""Line de-duplication over levelled sorted runs of line hashes.

Every document's long line keys are hashed (128 bits). The index is a set of runs: tables of (hash, documents, largest
document), bucketed and sorted by hash. Documents arrive in batches, largest doc_id first. A new batch merge-anti-joins,
bucket by bucket and without moving a run, the hashes that are settled already (enough documents hold them, so the line
goes from all smaller documents); what is left becomes a run of its own at level 0. When a level holds ``fanout`` runs
they are compacted into one run of the next level, for a fanout of 2 again without an exchange, and hashes that a
compaction of all open runs settles move to the settled runs, which later batches meet as they are. At the end the open runs are merged once more, and each
document loses the lines whose hash is settled and whose keeper is another document.

Nothing is collected: the driver holds only the names of runs, about log(batches) of them.

Defined cases: a null or empty text is one empty line; a row whose doc_id is null keeps all its lines and counts
nowhere; rows that share a doc_id count as one document and lose the same lines; an empty table gives no rows; other
columns are kept, and one called ``n_lines``, ``n_dropped`` or ``kept`` is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_column
from .common import BLANKS, partitions, scratch, small_batches, stored, unused



def line_key(line: str) -> str:
    """The line without blanks at both ends and with A-Z lower-cased."""
    return line.strip(BLANKS).encode().lower().decode()


def _hash(line: str, least: int) -> bytes | None:
    """128 bits of the key's digest; None if the key is shorter than ``least`` code points."""
    key = line.strip(BLANKS)
    return hashlib.md5(key.encode().lower()).digest() if len(key) >= least else None


def _hashes(least: int):
    """mapInArrow: doc_id and the hash of each of its distinct long line keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {_hash(x, least) for x in (text or "").split("\n")} - {None}
                ids += [doc] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "h"])

    return run


class LineRuns:
    """The levelled runs. add() takes a batch of (doc_id, h); settled() gives (h, keeper); close() forgets the tables."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, fanout: int = 2):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.done: list[DataFrame] = []  # (h, docs, keeper) of settled hashes; no hash is in two of them
        self.names: list[str] = []

    def _write(self, run: DataFrame) -> DataFrame:
        """A run as a table, bucketed and sorted by hash: joins and merges by hash read it where it lies."""
        path = scratch(self.spark, "line-run")
        name = "agonix_" + path.rpartition("-")[2]
        run.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: documents add up, as batches hold different documents."""
        every = runs[0]
        for r in runs[1:]:
            every = every.join(r.select("h", F.col("docs").alias("docs2"), F.col("keeper").alias("keeper2")).hint("merge"), "h", "full_outer")
            both = (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs")
            every = every.select("h", both, F.greatest("keeper", "keeper2").alias("keeper"))
        return every

    def settled(self) -> DataFrame | None:
        """Hashes that enough documents hold, with the largest of these; each in one row."""
        enough = F.col("docs") >= self.min_docs
        runs = [r for level in self.levels for r in level]
        found = [*self.done, *([self._merged(runs).where(enough)] if runs else [])]
        if not found:
            return None
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return every.select("h", "keeper")

    def add(self, batch: DataFrame) -> None:
        """Add a batch whose documents are all smaller than those before."""
        own = batch.dropDuplicates(["h", "doc_id"]).groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        for run in self.done:
            own = own.join(run.select("h").hint("merge"), "h", "left_anti")
        self._put(0, self._write(own))

    def _put(self, level: int, run: DataFrame) -> None:
        """Runs below the fanout stay. Others are compacted, and what that settles leaves the levels."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            if not any(self.levels):  # nothing older is open: what has enough documents now is settled
                self.done.append(self._write(merged.where(F.col("docs") >= self.min_docs)))
                merged = self._write(merged.where(F.col("docs") < self.min_docs))
            self._put(level + 1, merged)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


def drops(docs: DataFrame, column: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, out: str = "gone") -> DataFrame:
    """doc_id and ``out``: the hashes of the lines that the document loses; only documents that lose any."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text"))
    held = stored(held.mapInArrow(_hashes(min_chars), "doc_id long, h binary"), "line-hashes")
    borders = held.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in borders}, reverse=True), None]
    runs = LineRuns(spark, min_docs, fanout)
    for top, low in zip(edges, edges[1:], strict=False):
        batch = held
        if top is not None:
            batch = batch.where(F.col("doc_id") <= top)
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        runs.add(batch)
    # As a plain table on one side and line hashes on the other, a line that very many documents hold can be split.
    settled = stored(runs.settled(), "settled-lines")
    runs.close()
    lost = held.join(settled, "h").where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias(out))


def dedup_lines(docs: DataFrame, column: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept``, the text of the lines that stay.

    A line key of at least ``min_chars`` code points found in at least ``min_docs`` documents stays only in the largest
    doc_id that holds it. ``batches`` and ``fanout`` shape the runs, not the result."""
    docs = docs.drop("n_lines", "n_dropped", "kept")
    names = docs.columns
    out, key = unused("gone", names), unused("doc_key", names)
    gone = drops(docs, column, min_chars, min_docs, batches, fanout, out).withColumnRenamed("doc_id", key)
    both = docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            total, dropped, kept = [], [], []
            for text, away in zip(batch.column(batch.schema.names.index(column)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                away = set(away or ())
                stay = [x for x in lines if _hash(x, min_chars) not in away] if away else lines
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names)
            for name, values, kind in (("n_lines", total, pa.int64()), ("n_dropped", dropped, pa.int64()), ("kept", kept, pa.string())):
                batch = with_column(batch, name, pa.array(values, kind))
            yield batch

    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    return both.select(*[F.col(f"`{n}`") for n in names], out).mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
