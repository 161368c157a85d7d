"""Normalisation of raw records: text to typed columns, events to classes, contests to nested rows.

The single rules are column expressions, used inside the table-level jobs; nothing runs per row in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English month abbreviations in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONED = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"


def norm_timestamp(raw: Column) -> Column:
    """struct(ts, raw, confidence): only text with a zone is taken; anything else is null with confidence none."""
    ok = F.coalesce(raw.rlike(ZONED), F.lit(False))
    ts = F.when(ok, F.try_to_timestamp(F.regexp_replace(raw, r"([+-]\d\d)(\d\d)$", "$1:$2")))
    return F.struct(ts.alias("ts"), raw.alias("raw"), F.when(ts.isNotNull(), "high").otherwise("none").alias("confidence"))


def parse_utc(raw: Column) -> Column:
    """Epoch milliseconds of epoch seconds above 0 or of YYYY-MM-DD HH:MM:SS taken as UTC; null otherwise."""
    text = F.try_to_timestamp(F.concat(raw, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))
    secs = F.when(raw.rlike(r"^\d{1,12}$"), raw.cast("long"))
    return F.when(secs > 0, secs * 1000).when(raw.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.unix_millis(text))


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")


def parse_range(raw: Column) -> Column:
    """struct(start, end) of "Jan 15 - Feb 9, 2026"; a missing end month is the start month; else nulls.
    The dash may be a hyphen, an en dash or an em dash. The year is
    that of the end: a range whose end month comes before its start month began in the year before."""
    pattern = r"^\s*([A-Za-z]{3})[a-z]*\s+(\d{1,2})\s*[-–—]\s*(?:([A-Za-z]{3})[a-z]*\s+)?(\d{1,2}),\s*(\d{4})\s*$"
    g = lambda i: F.nullif(F.regexp_extract(raw, pattern, i), F.lit(""))
    m1 = _month(g(1))
    m2 = F.coalesce(_month(g(3)), m1)
    year = g(5).cast("int")
    day = lambda y, m, d: F.try_make_timestamp(y, m, d.cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.struct(day(F.when(m2 < m1, year - 1).otherwise(year), m1, g(2)).alias("start"), day(year, m2, g(4)).alias("end"))


def norm_leg(name: Column, known: list[str]) -> Column:
    """struct(name, raw, recognized): a known name in any case and with blanks around, else the text as it is."""
    key = F.lower(F.trim(name))
    found = F.lit(None).cast("string")
    for n in known:
        found = F.when(key == n.lower(), n).otherwise(found)
    return F.struct(F.coalesce(found, name).alias("name"), name.alias("raw"), found.isNotNull().alias("recognized"))


def norm_series(raw: Column) -> Column:
    """bo1, bo3 or bo5 of a text that is just that, or that has "best of" with the number in it; else unknown."""
    out = F.lit("unknown")
    for pattern in (r"(?i)best\s*of\s*%d", r"(?i)^\s*bo\s*%d\s*$"):
        for n in (5, 3, 1):  # the last one set is asked first
            out = F.when(raw.rlike(pattern % n), f"bo{n}").otherwise(out)
    return out


def valid_wins(series: Column, wins: Column) -> Column:
    """bo1 takes 1 won leg, bo3 2, bo5 3, unknown any above 0."""
    return F.when(series == "bo1", wins == 1).when(series == "bo3", wins == 2).when(series == "bo5", wins == 3).otherwise(wins >= 1)


def level_of(family: Column) -> Column:
    """international, league or unknown."""
    return F.when(family.isin("masters", "champions", "international"), "international").when(family.isin("league", "challengers"), "league").otherwise("unknown")


def classify_events(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """events (event_id, name, tier_hint) with class, confidence and reason: an override first, then structured metadata,
    then the name, then unknown. overrides: event_id, override."""
    e = events.join(overrides, "event_id", "left")
    low = F.lower("name")
    by_name = F.when(low.rlike(r"\b(masters|champions)\b"), "masters").when(low.rlike("league|cup"), "league").when(low.rlike("qualifier|open"), "challengers")
    pick = F.coalesce(
        F.when(F.col("override").isNotNull(), F.struct(F.col("override").alias("class"), F.lit("high").alias("confidence"), F.lit("override").alias("reason"))),
        F.when(F.col("tier_hint").isNotNull(), F.struct(F.lower("tier_hint").alias("class"), F.lit("high").alias("confidence"), F.lit("metadata").alias("reason"))),
        F.when(by_name.isNotNull(), F.struct(by_name.alias("class"), F.lit("low").alias("confidence"), F.lit("name").alias("reason"))),
        F.struct(F.lit("unknown").alias("class"), F.lit("none").alias("confidence"), F.lit("none").alias("reason")),
    )
    return e.withColumn("_p", pick).select(*events.columns, "_p.class", "_p.confidence", "_p.reason")


def event_inclusion(events: DataFrame, families: list[str], excluded: list[str], start, end) -> DataFrame:
    """The first rule that holds: unknown, excluded class, outside the families, outside the dates, included.

    events: class, start_date, end_date."""
    status = (
        F.when(F.col("class") == "unknown", "unknown").when(F.col("class").isin(excluded), F.concat(F.lit("excluded:"), F.col("class"))).when(~F.col("class").isin(families), "outside-families")
        .when((F.col("end_date") < F.lit(start)) | (F.col("start_date") > F.lit(end)), "outside-scope").otherwise("included")
    )
    return events.withColumn("inclusion", status)


def contest_flags(c: DataFrame) -> DataFrame:
    """contest_id, flags, reasons, eligible of normalised contests: all flags are collected, three of them are critical."""
    unknown = F.exists("legs", lambda x: ~x["recognized"])
    tied = F.exists("legs", lambda x: x["score_a"] == x["score_b"])
    flags = F.array_compact(F.array(
        F.when(F.col("ts_ms").isNull(), "timestamp-missing"), F.when(F.col("winner").isNull(), "winner-missing"), F.when(F.size("legs") == 0, "legs-missing"), F.when(F.coalesce(unknown, F.lit(False)), "unknown-leg"),
        F.when(F.coalesce(tied, F.lit(False)), "tied-leg"), F.when(F.col("series_format") == "unknown", "format-unknown"), F.when(F.size("roster_a") < 5, "roster-a-incomplete"), F.when(F.size("roster_b") < 5, "roster-b-incomplete"),
    ))
    x = c.withColumn("flags", flags)
    reasons = F.array_intersect("flags", F.array(*[F.lit(v) for v in ("timestamp-missing", "winner-missing", "legs-missing")]))
    return x.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


#: Codes of flags on contests and legs, those that are critical, and reasons against training, in order.
FLAGS = [
    "missing_team_mapping", "missing_timestamp", "ambiguous_timezone", "missing_series_format", "missing_map_score", "unknown_map", "incomplete_roster", "inconsistent_winner", "parser_fallback_used",
    "source_markup_changed", "partial_record", "unknown_event_classification", "low_confidence_event_classification", "excluded_event_category", "outside_date_scope", "duplicate_match", "not_completed", "not_training_eligible",
]
CRITICAL_FLAGS = ["unknown_event_classification", "excluded_event_category", "not_training_eligible"]
REASONS = ["cancelled", "postponed", "not_completed", "showmatch", "duplicate", "structurally_invalid", "unknown_played_at", "before_scope_start", "after_scope_end", "event_not_approved_family", "missing_team_identity", "winner_unknown", "invalid_series_result", "no_maps_played"]
ROSTER = 5


def ineligibility(c: DataFrame, start: str, end: str, approved: list[str]) -> Column:
    """All reasons, in order, why a normalised contest is not trained on; none if it is. Days are whole days in UTC.

    c: status, is_showmatch, is_duplicate, valid, ts, family, side_a, side_b, winner, series_format, winner_legs, legs_played."""
    low, high = F.to_timestamp(F.lit(f"{start}T00:00:00Z")), F.to_timestamp(F.lit(f"{end}T23:59:59.999Z"))
    blank = lambda n: F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == ""
    holds = {
        "cancelled": F.col("status") == "cancelled", "postponed": F.col("status") == "postponed", "not_completed": ~F.col("status").eqNullSafe(F.lit("completed")), "showmatch": F.col("is_showmatch"), "duplicate": F.col("is_duplicate"),
        "structurally_invalid": ~F.col("valid"), "unknown_played_at": F.col("ts").isNull(), "before_scope_start": F.col("ts") < low, "after_scope_end": F.col("ts") > high, "event_not_approved_family": ~F.coalesce(F.col("family").isin(approved), F.lit(False)),
        "missing_team_identity": blank("side_a") | blank("side_b"), "winner_unknown": F.col("winner").isNull(), "invalid_series_result": ~valid_wins(F.col("series_format"), F.col("winner_legs")), "no_maps_played": F.col("legs_played") < 1,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(holds[r], F.lit(False)), r) for r in REASONS]))


def normalize_contests(raw: DataFrame, teams: DataFrame, events: DataFrame, known_legs: list[str], start: str, end: str, approved: list[str]) -> DataFrame:
    """The normalisation job: typed contests with all their flags, reasons against training and nested legs.

    raw: contest_id, scheduled_raw, scheduled_iso, status, series_raw, team_a, team_b, winner_raw (the source's team ids),
    event_id, legs (name, score_a, score_b), rosters (team, players) or null, is_duplicate, is_showmatch; teams: team,
    internal_id of mapped teams; events: event_id, family. A team without a mapping keeps an id made from its own and is
    flagged. Teams and events join on their key; nothing else moves."""
    side = lambda s: teams.select(F.col("team").alias(f"team_{s}"), F.col("internal_id").alias(f"_{s}"))
    c = raw.join(side("a"), "team_a", "left").join(side("b"), "team_b", "left").join(events.select("event_id", "family"), "event_id", "left")
    own = lambda s: F.coalesce(F.col(f"_{s}").cast("string"), F.concat(F.lit("team:"), F.col(f"team_{s}").cast("string")))
    when = norm_timestamp(F.col("scheduled_iso"))
    def leg(x):
        named = norm_leg(x["name"], known_legs)
        flags = F.array_compact(F.array(F.when(~named["recognized"], "unknown_map"), F.when(x["score_a"].isNull() | x["score_b"].isNull(), "missing_map_score")))
        return F.struct(named["name"].alias("name"), named["recognized"].alias("recognized"), x["score_a"].alias("score_a"), x["score_b"].alias("score_b"), flags.alias("flags"))

    wins = lambda p, q: F.size(F.filter("legs", lambda x: x[p] > x[q]))
    c = c.withColumns({
        "side_a": own("a"), "side_b": own("b"), "_when": when, "ts": when["ts"], "series_format": F.coalesce(norm_series(F.col("series_raw")), F.lit("unknown")), "family": F.coalesce("family", F.lit("unknown")), "valid": F.lit(True),
        "winner": F.when(F.col("winner_raw") == F.col("team_a"), own("a")).when(F.col("winner_raw") == F.col("team_b"), own("b")),
        "winner_legs": F.when(F.col("winner_raw") == F.col("team_a"), wins("score_a", "score_b")).when(F.col("winner_raw") == F.col("team_b"), wins("score_b", "score_a")).otherwise(0),
        "legs_played": F.size(F.filter("legs", lambda x: x["score_a"].isNotNull() & x["score_b"].isNotNull())),
    })
    c = c.withColumn("reasons", ineligibility(c, start, end, approved))
    done, blank = F.col("status").eqNullSafe(F.lit("completed")), lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    inside = (F.col("ts") >= F.to_timestamp(F.lit(f"{start}T00:00:00Z"))) & (F.col("ts") <= F.to_timestamp(F.lit(f"{end}T23:59:59.999Z")))
    flags = F.array_compact(F.array(
        F.when(F.col("_a").isNull(), "missing_team_mapping"), F.when(F.col("_b").isNull(), "missing_team_mapping"), F.when(blank("series_raw"), "missing_series_format"),
        F.when(blank("scheduled_raw"), "missing_timestamp").when(F.col("ts").isNull(), "ambiguous_timezone"),
        F.when(F.col("family") == "unknown", "unknown_event_classification").when(F.col("family").startswith("excluded-"), "excluded_event_category"),
        F.when(F.col("ts").isNotNull() & ~inside, "outside_date_scope"), F.when(F.col("is_duplicate"), "duplicate_match"), F.when(~done, "not_completed"), F.when(done & F.col("winner").isNull(), "inconsistent_winner"),
        F.when(done & (F.col("rosters").isNull() | F.exists("rosters", lambda r: F.size(r["players"]) < ROSTER)), "incomplete_roster"), F.when(F.size("reasons") > 0, "not_training_eligible"),
    ))
    return c.select(
        "contest_id", "event_id", "family", "side_a", "side_b", "winner", "status", "ts", F.col("scheduled_raw").alias("ts_raw"), F.col("_when.confidence").alias("ts_confidence"), "series_format", F.transform("legs", leg).alias("legs"), "rosters",
        flags.alias("flags"), F.size(F.array_intersect(flags, F.array(*[F.lit(x) for x in CRITICAL_FLAGS]))).alias("critical_flags"), "reasons", (F.size("reasons") == 0).alias("eligible"),
    )
