"""Window recipes for "strictly before" semantics.

Rows with one timestamp form a group and see only earlier groups. ``prior`` and ``trailing_days`` do this with RANGE
frames over a LONG key. ``with_last_rows`` takes the last n rows of earlier groups: a ROWS frame is right for the first row
of a group, and the group's other rows take that value; both windows share one partitioning, so one shuffle serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from agonix.functions.shared import stored

DAY_MS = 86_400_000


def prior(*keys: str, at: str = "ts_ms") -> WindowSpec:
    """All rows of the key in strictly earlier groups."""
    return Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)


def trailing_days(days: int, *keys: str, at: str = "ts_ms") -> WindowSpec:
    """Strictly earlier groups, at most ``days`` days back, the bound included."""
    return Window.partitionBy(*keys).orderBy(at).rangeBetween(-days * DAY_MS, -1)


def group(keys: list[str], order: list[str], at: str = "ts_ms") -> WindowSpec:
    """Rows of one timestamp group, in order, up to the current row."""
    return Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def with_last_rows(df: DataFrame, values: dict[str, tuple[Column, int]], keys: list[str], order: list[str], at: str = "ts_ms") -> DataFrame:
    """``df`` with a column per entry: an aggregate over the last n rows of strictly earlier groups."""
    raw = {name: value.over(Window.partitionBy(*keys).orderBy(at, *order).rowsBetween(-n, -1)) for name, (value, n) in values.items()}
    df = df.withColumns(raw)
    same = group(keys, order, at)
    return df.withColumns({name: F.first(name).over(same) for name in values})


def with_ordinal(df: DataFrame, coarse: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` with 0, 1, ... in the order of (coarse, *order), without a one-task window over all rows: rows are numbered
    within each value of ``coarse`` (a day), and the running count of values gives the offset. The counts are as many as
    there are values of ``coarse``; ``df`` must hold no null there."""
    counts = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(coarse).orderBy(*order)) - 1
    return df.withColumn("_in", inner).join(offsets, coarse).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in")


def with_place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with 1, 2, 3, ... in ``order``, which should leave no ties: rows are range-partitioned and numbered inside a
    partition, a partition begins where those before it end (one row per partition passes through one task)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    df = stored(df, "unplaced")  # the ranges are sampled from it
    at = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def with_running_sum(df: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in ``order`` within ``keys``, without a window over a whole
    key: rows are range-partitioned by (keys, order), summed inside a partition, and a partition's start is the sum of the
    partitions before it (one row per partition and key). Rows with equal keys and order must be one row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = stored(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").withColumnsRenamed({k: f"_{k}" for k in keys} | {"_part": "_p"})
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_in", inner).join(totals, on).withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_p", "_in", "_before", *[f"_{k}" for k in keys])


def rate(num: Column, den: Column, empty: float) -> Column:
    """num / den, or ``empty`` where there is nothing to divide by."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(empty))
