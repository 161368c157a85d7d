"""Incremental upsert by content hash as a stream.

``target``/batch=<id> holds the rows that each micro-batch inserted or changed. An index of (key, hash, batch), in a folder
that readers of the table skip, says what is known of every key: runs in levels, each partitioned into buckets by key. A batch reads, of every run, only the buckets its own
keys fall into; when a level holds FANOUT runs they become one run of the next level, in which the newest entry of a key
stays. A batch so meets about FANOUT runs per level, and an entry is written once per level.

Of several rows of a key in one batch, the one that ``order`` puts last stays, by default the largest hash: the same one
whenever the batch is run again. A batch that failed half-way is written again over its own folders, and runs are known by
the names of the batches they cover, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agonix.operators.lifecycle import content_hash

BUCKETS, FANOUT = 64, 4


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and done(s.getPath()))


def _runs(spark: SparkSession, target: str, before: int | None = None) -> list[tuple[int, int, int]]:
    """(level, first batch, last batch) of the runs that count: those no other run covers, of batches before ``before``."""
    runs = [tuple(int(x) for x in name.split("-")) for name in _folders(spark, f"{target}/_index")]
    runs = [r for r in runs if before is None or r[2] < before]
    return sorted((r for r in runs if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in runs)), key=lambda r: r[1])


def _read_run(spark: SparkSession, target: str, run: tuple[int, int, int]) -> DataFrame:
    return spark.read.parquet(f"{target}/_index/{run[0]}-{run[1]}-{run[2]}")


def _write_run(entries: DataFrame, target: str, run: tuple[int, int, int]) -> None:
    entries.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{target}/_index/{run[0]}-{run[1]}-{run[2]}")


def _newest(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy("bucket", *keys).agg(F.max(F.struct("batch", "_hash")).alias("_r")).select(*keys, "_r.*", "bucket")


def upsert_batch(batch: DataFrame, batch_id: int, keys: list[str], target: str, volatile: list[str] | None = None, order: list[str] | None = None) -> None:
    """Write what ``batch`` inserts or changes, its entries as a run of level 0, and merge levels that are full."""
    spark = batch.sparkSession
    columns = batch.columns
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    new = batch.withColumns({"_hash": content_hash(batch, volatile), "bucket": bucket})
    rest = [c for c in columns if c not in keys]
    new = new.groupBy("bucket", *keys).agg(F.max(F.struct(*(order or []), "_hash", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)])).alias("_r"))
    new = new.select("bucket", *keys, *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(rest)], "_r._hash").persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
    runs = _runs(spark, target, batch_id)
    if runs and touched:
        known = None
        for run in runs:
            part = _read_run(spark, target, run).where(F.col("bucket").isin(touched)).select(*keys, "batch", "_hash", "bucket")
            known = part if known is None else known.unionByName(part)
        fresh = new.join(_newest(known, keys).select(*keys, "_hash"), [*keys, "_hash"], "left_anti")
    else:
        fresh = new
    path = f"{target}/batch={batch_id}"
    fresh.select(*columns, "_hash").write.mode("overwrite").parquet(path)
    entries = spark.read.parquet(path).select(*keys, F.lit(batch_id).cast("long").alias("batch"), "_hash", bucket.alias("bucket"))
    if not entries.isEmpty():
        _write_run(entries, target, (0, batch_id, batch_id))
    new.unpersist()
    level = 0
    while len(full := [r for r in _runs(spark, target, batch_id + 1) if r[0] == level]) >= FANOUT:
        entries = None
        for run in full:
            part = _read_run(spark, target, run).select(*keys, "batch", "_hash", "bucket")
            entries = part if entries is None else entries.unionByName(part)
        level += 1
        _write_run(_newest(entries, keys), target, (level, full[0][1], full[-1][2]))


def stream_upserts(spark: SparkSession, source: str, schema, keys: list[str], target: str, checkpoint: str, volatile: list[str] | None = None, order: list[str] | None = None) -> None:
    """Process all new files of ``source``; a rerun over the same files finds nothing new. latest() gives the table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    apply = lambda batch, batch_id: upsert_batch(batch, batch_id, keys, target, volatile, order)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame | None:
    """The newest row of each key, with its hash; None before the first batch. The index says which batch has it."""
    runs = _runs(spark, target)
    if not runs:
        return None
    entries = None
    for run in runs:
        part = _read_run(spark, target, run).select(*keys, "batch", "_hash", "bucket")
        entries = part if entries is None else entries.unionByName(part)
    rows = spark.read.parquet(target).withColumn("batch", F.col("batch").cast("long"))
    return rows.join(_newest(entries, keys).select(*keys, "batch"), [*keys, "batch"], "left_semi").drop("batch")
