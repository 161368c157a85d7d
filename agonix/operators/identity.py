"""Identity resolution, audits of who appears where, and name histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to, in the same order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def resolve_identity(df: DataFrame, mapping: DataFrame, provider: str, prefix: str = "provider:team") -> DataFrame:
    """``df`` with ``internal_id`` and ``mapped``: the registry's target, or a deterministic id. Of several entries of one
    id the last (largest ``seq``) counts. The join is left to Spark, which broadcasts a small registry by its size."""
    last = mapping.groupBy("provider_id").agg(F.max_by("internal_id", "seq").alias("_to"))
    x = df.join(last, F.col(provider).cast("string") == F.col("provider_id"), "left")
    return x.withColumns({"internal_id": F.coalesce("_to", F.concat_ws(":", F.lit(prefix), F.col(provider).cast("string"))), "mapped": F.col("_to").isNotNull()}).drop("_to", "provider_id")


def remap(c: DataFrame, mapping: DataFrame) -> DataFrame:
    """Contests with sides and winner rewritten to internal ids."""
    last = mapping.groupBy("provider_id").agg(F.max_by("internal_id", "seq").alias("to"))
    name = lambda col, to: F.coalesce(F.col(to), F.concat_ws(":", F.lit("provider:team"), F.col(col).cast("string")))
    for s in ("side_a", "side_b"):
        c = c.join(last.select(F.col("provider_id").alias(f"_p{s}"), F.col("to").alias(f"_t{s}")), F.col(s).cast("string") == F.col(f"_p{s}"), "left")
    ids = {"id_a": name("side_a", "_tside_a"), "id_b": name("side_b", "_tside_b")}
    c = c.withColumns(ids)
    return c.withColumn("id_winner", F.when(F.col("winner") == F.col("side_a"), F.col("id_a")).when(F.col("winner") == F.col("side_b"), F.col("id_b"))).drop("_pside_a", "_tside_a", "_pside_b", "_tside_b")


def validate_mapping(mapping: DataFrame, known: DataFrame) -> DataFrame:
    """Entries with an empty id, an unknown target, or several targets for one id."""
    empty = mapping.where("provider_id is null or trim(provider_id) = ''").select(F.lit("empty-id").alias("code"), F.coalesce("provider_id", F.lit("")).alias("id"))
    unknown = mapping.join(known, "internal_id", "left_anti").select(F.lit("unknown-target").alias("code"), F.col("provider_id").alias("id"))
    many = mapping.groupBy("provider_id").agg(F.count_distinct("internal_id").alias("n")).where("n > 1").select(F.lit("several-targets").alias("code"), F.col("provider_id").alias("id"))
    return empty.unionByName(unknown).unionByName(many)


def enrich_display(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """``display``: the listing's trimmed name, else the title-cased slug, else the id."""
    x = df.join(listing, key, "left")
    return x.withColumn("display", F.coalesce(F.nullif(F.trim("raw_name"), F.lit("")), F.nullif(F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))), F.lit("")), F.col(key).cast("string")))


def team_audit(sides: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per team: appearances, events, first and last seen, mapped or not."""
    a = sides.groupBy("team").agg(F.count(F.lit(1)).alias("appearances"), F.count_distinct("event_id").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    m = mapping.select(F.col("provider_id").alias("_p")).distinct()
    return a.join(m, F.col("team").cast("string") == F.col("_p"), "left").withColumn("mapped", F.col("_p").isNotNull()).drop("_p")


def player_audit(sides: DataFrame) -> DataFrame:
    """Per player: appearances, teams, first and last seen."""
    p = sides.select("team", "ts", F.explode("roster").alias("player"))
    return p.groupBy("player").agg(F.count(F.lit(1)).alias("appearances"), F.array_join(F.array_sort(F.collect_set("team")), ",").alias("teams"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def event_audit(events: DataFrame, c: DataFrame) -> DataFrame:
    """Contests per event, 0 included, and whether the event is listed twice."""
    n = c.groupBy("event_id").agg(F.count(F.lit(1)).alias("contests"))
    e = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("records"))
    return e.join(n, "event_id", "left").select("event_id", F.coalesce("contests", F.lit(0)).alias("contests"), (F.col("records") > 1).alias("duplicate"))


def roster_timeline(sides: DataFrame) -> DataFrame:
    """player, team, contest, timestamp."""
    return sides.select(F.explode("roster").alias("player"), "team", "contest_id", "ts")


def roster_score(c: DataFrame) -> DataFrame:
    """Mean over both sides of min(1, players / 5); 0 without rosters."""
    one = lambda r: F.least(F.lit(1.0), F.size(F.coalesce(r, F.array().cast("array<bigint>"))) / F.lit(5.0))
    return c.select("contest_id", ((one(F.col("roster_a")) + one(F.col("roster_b"))) / 2).alias("roster_score"))


def name_history(obs: DataFrame, id_col: str, name_col: str, at: str) -> DataFrame:
    """First and last observation of each (id, name), how many, and whether the id had several names."""
    h = obs.groupBy(id_col, name_col).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("observations"))
    names = h.groupBy(id_col).agg(F.count(F.lit(1)).alias("names"))
    return h.join(names, id_col).withColumn("renamed", F.col("names") > 1).drop("names")


def shared_keys(obs: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Names that several ids used. Distinct pairs first, so a common name is combined before it meets in one place."""
    return obs.select(name_col, id_col).distinct().groupBy(name_col).agg(F.count(F.lit(1)).alias("ids")).where("ids > 1")


def norm_alias(col):
    """Lower case, accents off, everything but letters and digits a single blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(col), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Normalised aliases that belong to several teams. aliases: team, alias."""
    return shared_keys(aliases.select(norm_alias(F.col("alias")).alias("alias"), "team"), "alias", "team")


def lookup_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each name's only team; null where there is none or the alias is shared."""
    one = aliases.select(norm_alias(F.col("alias")).alias("_k"), "team").distinct().groupBy("_k").agg(F.min("team").alias("team"), F.count(F.lit(1)).alias("_n"))
    return names.join(one, norm_alias(F.col("name")) == F.col("_k"), "left").select(*names.columns, F.when(F.col("_n") == 1, F.col("team")).alias("team"))
