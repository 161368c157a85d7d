"""Helpers the training-data operators share: the shared folder, cutting lineage, table reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agonix.functions.shared import lean

#: The white space the contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session gets a new temporary one; on a
    cluster that is an error, as no machine's own folder is seen by the others."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="agonix-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/agonix-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and its shuffles are given back. A ``narrow`` table (a few numbers a
    row) is written by two tasks a core, or one for 16 shuffle partitions if that is more, without a further shuffle:
    a file for every shuffle partition takes longer to open than such rows take to write."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, partitions(spark) // 16))
    with lean(spark):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a stored() table that no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/agonix-" in path:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def among(df: DataFrame, key: str, ids: DataFrame, most: int = 1 << 22) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids``, a narrow frame of long ids: filtered before any shuffle
    while there are at most ``most`` ids (32 MB), beyond that by a shuffled join."""
    ids = stored(ids, "ids", narrow=True)
    small = ids.count() <= most
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, "left_semi")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores in front as it takes to differ from all columns in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand whole texts to Python in small Arrow batches: both sides of the pipe hold a few of them at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file; AGONIX_TOKENIZERS names another folder."""
    folder = os.environ.get("AGONIX_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
