"""Exact de-duplication with keyed streaming state (DataFrame and SQL functions only).

The table is read as a stream. A streaming aggregation keyed by the SHA-256 of the normalised text keeps, in a
disk-backed (RocksDB) state store and without expiry, the digest, the row that stays (its stable identifier and its
content locator: file and row position) and the number of copies. Every hit is then checked on its full bytes: the
row's normalised text is compared with that of the row that stays. Rows of a digest whose bytes disagree (a digest
collision) are grouped again by the text itself.

Defined cases: a null text counts as empty; all empty texts are equal; the row with most code points in the original
text stays, then the smallest doc_id (null last), then the smallest locator, so repeated rows with one doc_id have one
keeper; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, scratch, stored

_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTINGS = {
    _STATE: _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no log space ahead of use
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _normalised():
    """The text without blanks; replace() works on bytes, several times as fast as translate()."""
    out = F.coalesce(F.col("text"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _rows(df: DataFrame) -> DataFrame:
    """One row per input row, with its digest, rank fields and locator."""
    return df.select(
        F.col("doc_id"),
        _normalised().alias("norm"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    ).withColumn("text_sha256", F.sha2(F.col("norm"), 256))


def _best():
    """min() of this is the row that stays: most code points, smallest doc_id (null last), smallest locator."""
    return F.struct(
        (-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("at").alias("at")
    )


def _groups(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """Stream the table through the keyed state; returns digest, best, n."""
    batch = spark.read.parquet(path)
    keep = {k: spark.conf.get(k, None) for k in _SETTINGS}
    sink, ckpt = scratch(spark, "dedup-groups"), scratch(spark, "dedup-state")

    def publish(changed: DataFrame, batch_id: int) -> None:
        changed.select("text_sha256", "best", "n").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        stream = _stream(spark, batch, path, files_per_batch)
        agg = _rows(stream).groupBy("text_sha256").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"))
        query = agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(publish).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    best = batch.select(F.col("doc_id")).schema["doc_id"].dataType.simpleString()
    schema = f"text_sha256 string, best struct<neg_chars: bigint, no_id: boolean, doc_id: {best}, at: struct<file: string, row: bigint>>, n bigint, batch_id int"
    changes = spark.read.schema(schema).option("basePath", sink).parquet(sink) if _ran(query) else spark.createDataFrame([], schema)
    last = F.max(F.struct("batch_id", "best", "n")).alias("last")
    return stored(changes.groupBy("text_sha256").agg(last).select("text_sha256", "last.best", "last.n"), "dedup-groups")


def _stream(spark: SparkSession, batch: DataFrame, path: str, files_per_batch: int) -> DataFrame:
    """The table as a file stream; a table that is one file is its folder, filtered to that name."""
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in batch.inputFiles()] == [name]:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _ran(query) -> bool:
    return any((p["numInputRows"] if isinstance(p, dict) else p.numInputRows) for p in query.recentProgress)


def dedup_exact(spark: SparkSession, path: str, files_per_batch: int = 1000, per_task: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet table at ``path``.

    ``files_per_batch`` bounds a micro-batch of the stream, ``per_task`` about how many copies of a text meet one copy of
    their keeper; the result does not depend on them.
    """
    groups = _groups(spark, path, files_per_batch)
    rows = _rows(spark.read.parquet(path))
    found = rows.drop("norm").join(groups, "text_sha256").select("*", F.col("best.at").alias("keep_at"), F.col("best.doc_id").alias("keep_id"))
    ids = stored(found.select("at", "keep_at", "doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256"), "dedup-rows")

    # A hit is a row that shares its digest: its text meets the keeper's text. One shuffle brings the texts of hits to
    # their locators, a second one, of hits alone, to the keeper; a large group is dealt to several copies of its keeper.
    hits = ids.where("group_size > 1").select("at", "keep_at", F.col("text_sha256").alias("digest"), F.ceil(F.col("group_size") / per_task).alias("shares"))
    texts = stored(rows.select("at", "norm").join(hits, "at"), "dedup-hits")
    own = texts.where(F.col("at") != F.col("keep_at")).select("digest", "norm", F.pmod(F.xxhash64("at"), "shares").alias("share"))
    shares = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    keepers = texts.where(F.col("at") == F.col("keep_at")).select("digest", F.col("norm").alias("keeper_norm"), shares)
    bad = own.join(keepers, ["digest", "share"]).where(F.col("norm") != F.col("keeper_norm")).select("digest").distinct()
    return _settle(spark, rows, ids, bad)


def _settle(spark: SparkSession, rows: DataFrame, ids: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of digests whose bytes disagree are grouped by their text; all others stand as they are."""
    collided = [r.digest for r in bad.limit(1).collect()]
    out = ids
    if collided:
        again = rows.join(bad.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_semi")
        best = again.groupBy("norm").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        fixed = again.join(best, "norm").select("at", F.col("best.at").alias("keep_at"), "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "text_sha256")
        out = ids.join(bad.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti").select(fixed.columns).unionByName(fixed)
    return out.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "text_sha256")
