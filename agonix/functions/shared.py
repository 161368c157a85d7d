"""Tables between the steps of a job that can't be one plan: written to the folder all executors share, lineage ends there."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _open = threading.Lock(), {"n": 0, "before": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="agonix-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here give their shuffle files back when they end, by Spark's own setting: a job of many steps
    needs the disk of its largest step, not of all. The session's setting is as before once the last of several threads is out."""
    with _lock:
        if not _open["n"]:
            _open["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _open["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _open["n"] -= 1
            if not _open["n"]:
                spark.conf.set(_CLEANUP, _open["before"])


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet (in folders of ``by``) and read back; the shuffles it took are gone then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/agonix-{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    with lean(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
