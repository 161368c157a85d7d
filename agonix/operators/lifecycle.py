"""Dataset life cycle: reconciliation, upserts by content hash, ledgers, versions, manifests, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_hash(df: DataFrame, volatile: list[str] | None = None):
    """SHA-256 of the row as JSON with its columns in order of name, volatile ones left out."""
    cols = sorted(c for c in df.columns if c not in set(volatile or []))
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def upsert_by_hash(existing: DataFrame, incoming: DataFrame, keys: list[str], volatile: list[str] | None = None) -> DataFrame:
    """All keys with ``action``: inserted, updated, unchanged or kept, and the row that holds afterwards."""
    e = existing.withColumn("_h", content_hash(existing, volatile))
    i = incoming.withColumn("_h", content_hash(incoming, volatile))
    e, i = e.select(*keys, F.struct(*existing.columns).alias("_e"), F.col("_h").alias("_eh")), i.select(*keys, F.struct(*existing.columns).alias("_i"), F.col("_h").alias("_ih"))
    both = e.join(i, keys, "full_outer")
    action = F.when(F.col("_i").isNull(), "kept").when(F.col("_e").isNull(), "inserted").when(F.col("_eh") == F.col("_ih"), "unchanged").otherwise("updated")
    return both.withColumn("action", action).withColumn("_row", F.when(F.col("action").isin("inserted", "updated"), F.col("_i")).otherwise(F.col("_e"))).select("_row.*", "action")


def merge_ledger(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Entries keep when they were first seen, take when they were seen last, add up attempts, and are resolved if they
    are no longer there. Both: keys, first_seen, last_seen, attempts."""
    p = previous.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("first_seen", "last_seen", "attempts")])
    m = current.withColumn("_now", F.lit(True)).join(p, keys, "full_outer")
    return m.select(
        *keys, F.coalesce("_first_seen", "first_seen").alias("first_seen"), F.coalesce("last_seen", "_last_seen").alias("last_seen"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("_attempts", F.lit(0))).alias("attempts"), F.when(F.col("_now"), "open").otherwise("resolved").alias("status"),
    )


def row_text(df: DataFrame, omit: list[str] | None = None):
    """name=value of every column in order of name, nulls as \\N, with U+001F between them."""
    cols = sorted(c for c in df.columns if c not in set(omit or []))
    return F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) for c in cols])


def dataset_version(df: DataFrame, constants: list[str], omit: list[str] | None = None, levels: tuple[int, ...] = (6, 3)) -> DataFrame:
    """One row: rows and a 16-digit version that depends on the rows' content and not on their order.

    A hash tree: equal rows are one leaf, their SHA-256 with their number; a node is the SHA-256 of its sorted children, which
    share its hash prefix of 6 and then 3 digits; the root, of at most 4096 nodes, is hashed with the constants. No group
    ever holds more than the leaves of one 6-digit prefix or 4096 nodes."""
    h = df.select(F.sha2(row_text(df, omit), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    node = h.select(F.col("h").alias("prefix"), F.concat_ws(":", "h", "n").alias("line"), "n")
    for digits in levels:
        node = node.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ","), 256).alias("digest"))
        node = node.select("prefix", F.concat_ws(":", "prefix", "digest").alias("line"), "n")
    root = node.agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("line")), ",").alias("all"))
    return root.select(F.coalesce("n", F.lit(0)).alias("n"), F.substring(F.sha2(F.concat_ws("|", *[F.lit(c) for c in constants], "all"), 256), 1, 16).alias("version"))


def reconcile(store: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Full outer comparison. manifest: key, included (boolean), complete (boolean)."""
    s, m = store.select(key, F.lit(True).alias("_s")).distinct(), manifest.select(key, "included", "complete", F.lit(True).alias("_m"))
    j = s.join(m, key, "full_outer")
    return j.select(key, F.when(F.col("_m").isNull(), "orphaned").when(F.col("_s").isNull() & F.col("included"), "missing").when(F.col("_s").isNull(), "not-stored").when(F.col("included") & F.col("complete"), "current-approved").when(F.col("included"), "stale").otherwise("out-of-scope").alias("category"))


def reconcile_contests(store: DataFrame, manifest: DataFrame, event_category: DataFrame) -> DataFrame:
    """As reconcile(), with the category of the parent event. store, manifest: contest_id, event_id."""
    s = store.select("contest_id", F.col("event_id").alias("_se"), F.lit(True).alias("_s"))
    m = manifest.select("contest_id", F.col("event_id").alias("_me"), "listed_status", F.lit(True).alias("_m"))
    j = s.join(m, "contest_id", "full_outer").withColumn("event_id", F.coalesce("_me", "_se")).join(event_category.select("event_id", F.col("category").alias("_ec")), "event_id", "left")
    return j.select("contest_id", F.when(F.col("_m").isNull(), "orphaned").when(F.col("_s").isNull(), "missing").when(F.coalesce("_ec", F.lit("orphaned")) != "current-approved", F.concat(F.lit("event-"), F.coalesce("_ec", F.lit("orphaned")))).when(F.col("listed_status") != "completed", "stale").otherwise("current-approved").alias("category"))


def curate(c: DataFrame, categories: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Contests that are currently approved and not quarantined."""
    ok = categories.where("category = 'current-approved'").select("contest_id")
    return c.join(ok, "contest_id", "left_semi").join(quarantined.select("contest_id"), "contest_id", "left_anti")


def completeness(manifest: DataFrame, store: DataFrame, failures: DataFrame) -> DataFrame:
    """Findings: completed entries without a record or a recorded failure; stored ones without the fields they need."""
    have = store.select("contest_id").unionByName(failures.select("contest_id")).distinct()
    missing = manifest.where("listed_status = 'completed'").join(have, "contest_id", "left_anti").select("contest_id", F.lit("missing-record").alias("code"))
    blank = store.where("winner is null or ts is null").select("contest_id", F.lit("missing-field").alias("code"))
    return missing.unionByName(blank)


def diff_registry(current: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """added, changed, unchanged, removed, or rejected where the incoming registry has several different rows for a key or
    an empty key."""
    i = incoming.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("_n"), F.min(F.struct(*values)).alias("_i"))
    c = current.select(key, F.struct(*values).alias("_c"))
    j = c.join(i, key, "full_outer")
    return j.select(key, F.when((F.col("_n") > 1) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""), "rejected").when(F.col("_i").isNull(), "removed").when(F.col("_c").isNull(), "added").when(F.col("_c").eqNullSafe(F.col("_i")), "unchanged").otherwise("changed").alias("change"))


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in discovery order, with how many others there were. A min over the ordered row is
    combined before the shuffle, so a key with very many listings is no large group."""
    rest = [c for c in df.columns if c not in {key, *order}]
    g = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return g.select(key, *[f"_r.{c}" for c in [*order, *rest]], "duplicates")


def dataset_manifest(discovered: DataFrame, c: DataFrame, failures: DataFrame) -> DataFrame:
    """One row of counts."""
    a = c.agg(F.count(F.lit(1)).alias("normalised"), F.count("winner").alias("eligible"), F.count_distinct("event_id").alias("events"))
    d = discovered.agg(F.count(F.lit(1)).alias("discovered"))
    f = failures.agg(F.count(F.lit(1)).alias("failures"))
    return a.join(F.broadcast(d)).join(F.broadcast(f))  # one row each


def unlabelled(f: DataFrame, required: list[str], metadata: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without labels and with complete inputs, and the keys of rows that break the contract (missing, not finite,
    or a repeated id)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("contest_id"))
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in required], F.when(n > 1, F.lit("duplicate"))))
    x = f.withColumn("_bad", bad)
    return x.where(F.size("_bad") == 0).select(*metadata, *required), x.where(F.size("_bad") > 0).select("contest_id", F.col("_bad").alias("reasons"))


def write_frames(frames: dict[str, DataFrame], path: str, sort: dict[str, list[str]] | None = None, partition: dict[str, list[str]] | None = None) -> None:
    """One Parquet folder per frame: sorted within files by its keys, partitioned where asked for. A manifest counts rows."""
    counts = []
    for name, df in frames.items():
        keys = (sort or {}).get(name)
        parts = (partition or {}).get(name)
        out = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        w = out.write.mode("overwrite")
        (w.partitionBy(*parts) if parts else w).parquet(f"{path}/{name}")
        counts.append((name, df.sparkSession.read.parquet(f"{path}/{name}").count()))
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame(counts, "name string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_curated(spark, path: str, eligible_only: bool = True) -> DataFrame:
    """Curated contests; the filter reaches the scan."""
    c = spark.read.parquet(f"{path}/contests")
    return c.where("eligible") if eligible_only else c
