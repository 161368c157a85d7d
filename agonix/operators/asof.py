"""As-of matchups: the feature row of a pairing that isn't scheduled, from the state of both sides at a moment.

Requests are appended to the history of their sides as rows of no weight: they have a place in every window but no value
there, so they read the state and never change it, and one shuffle by team serves history and requests alike. What happened
up to and including ``as_of`` counts, as for a caller who asks at that moment; later contests don't. The last n contests are
found by a running number that only history moves, so requests between them take no place.

A side without history is at its cold start. No roster is known and no event is scheduled: their features are 0, or null
for days since. International requests have no region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.functions.windows import DAY_MS, rate
from agonix.sources.contests import KNOWN_LEGS, accepted

from .features import H2H_FEATURES, MORE_FEATURES, SIDE_FEATURES, leg_pool, record, rounds, sides
from .normalize import norm_series
from .rating import START, elo, elo_p

#: Side columns that follow from ratings.
RATED = ["elo", "avg_opp_elo_last5", "avg_opp_elo_last10", "schedule_strength", "wins_above_median", "losses_below_median"]
#: Columns of a request.
REQUEST = ["request_id", "as_of_ms", "side_a", "side_b", "level", "region", "family", "series_format"]
_ROSTER = ["roster_size", "roster_jaccard", "roster_last3_overlap", "players_seen", "shared_prior_avg", "avg_appearances", "min_appearances", "max_appearances", "debuts", "avg_wins", "avg_appearances_30d", "international_appearances", "major_appearances"]
_SUMS = [*[f"legs_of_{n}" for n in KNOWN_LEGS], "legs_played", "legs_won", "unknown_legs", "rounds_won", "rounds_lost", "attack_won", "attack_played", "defense_won", "defense_played"]


def _upto(*keys: str):
    """All rows of the key up to and including the current moment."""
    return Window.partitionBy(*keys).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0)


def _days(d: int, *keys: str):
    return Window.partitionBy(*keys).orderBy("ts_ms").rangeBetween(-d * DAY_MS, 0)


def _history(c: DataFrame, ratings: DataFrame | None) -> DataFrame:
    """One row per accepted contest and side, with what was known of the opponent when they met; no ratings are null."""
    a = F.col("side") == "A"
    s = record(sides(c)).select("contest_id", "side", "team", "ts_ms", "won", *_SUMS, "win_rate")
    met = s.groupBy("contest_id").agg(F.max(F.when(a, F.col("win_rate"))).alias("_rate_a"), F.max(F.when(~a, F.col("win_rate"))).alias("_rate_b"))
    s = s.join(met, "contest_id")
    s = s.join(ratings, "contest_id") if ratings is not None else s.withColumns({n: F.lit(None).cast("double") for n in ("elo_a", "elo_b", "after_a", "after_b", "median_elo")})
    s = s.withColumn("opp_rate", F.when(a, F.col("_rate_b")).otherwise(F.col("_rate_a")))
    s = s.withColumns({"opp_elo": F.when(a, F.col("elo_b")).otherwise(F.col("elo_a")), "after": F.when(a, F.col("after_a")).otherwise(F.col("after_b"))})
    return s.select("contest_id", "side", "team", "ts_ms", F.col("won").cast("long").alias("won"), *_SUMS, "opp_rate", "opp_elo", "after", (F.col("opp_elo") > F.col("median_elo")).alias("above"))


def _side_states(history: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, side and both blocks of side features, of each side of each request."""
    h = history.withColumn("request_id", F.lit(None).cast(requests.schema["request_id"].dataType))
    one = lambda side, col: F.struct(F.lit(side).alias("side"), F.col(col).alias("team"))
    r = requests.select("request_id", F.col("as_of_ms").alias("ts_ms"), F.explode(F.array(one("A", "side_a"), one("B", "side_b"))).alias("s")).select("request_id", "ts_ms", "s.*")
    s = h.unionByName(r, allowMissingColumns=True).withColumn("past", F.col("won").isNotNull())

    ordered = Window.partitionBy("team").orderBy("ts_ms", F.col("past").desc(), "contest_id", "side").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("nth", F.count("won").over(ordered))  # requests have the number of the last contest before them
    last = lambda n: Window.partitionBy("team").orderBy("nth").rangeBetween(1 - n, 0)
    w = _upto("team")
    total = lambda col, w: F.coalesce(F.sum(col).over(w), F.lit(0))
    n = lambda w: F.count("won").over(w)
    share = lambda w: rate(F.sum("won").over(w), n(w), 0.5)
    s = leg_pool(s, w=w)
    s = rounds(s, w=w)
    legs, leg_wins, at = total("legs_played", w), total("legs_won", w), F.max(F.when(F.col("past"), F.col("ts_ms"))).over(w)
    s = s.withColumns({"prior_contests": n(w), "prior_wins": total("won", w), "prior_legs": legs, "prior_leg_wins": leg_wins, "_at": at, "_day": F.floor(F.col("ts_ms") / DAY_MS)})
    s = s.withColumns({f"last{k}_contests": n(last(k)) for k in (3, 5, 10)} | {f"last{k}_win_rate": share(last(k)) for k in (3, 5, 10)})
    s = s.withColumns({f"last{d}d_contests": n(_days(d, "team")) for d in (30, 60)} | {f"last{d}d_win_rate": share(_days(d, "team")) for d in (30, 60)})
    s = s.withColumns({f"contests_last{d}d": n(_days(d, "team")) for d in (7, 14, 30)} | {f"legs_last{d}d": total("legs_played", _days(d, "team")) for d in (7, 14, 30)})
    s = s.withColumns({"_lw": total("legs_won", last(10)), "_lp": total("legs_played", last(10)), "same_day_before": n(_upto("team", "_day"))})
    s = s.withColumns({f"avg_opp_{k}_last{m}": F.coalesce(F.avg(f"opp_{k}").over(last(m)), F.lit(empty)) for k, empty in (("elo", START), ("rate", 0.5)) for m in (5, 10)})
    won, above = F.col("won") == 1, F.col("above")
    s = s.withColumns({
        "elo": F.coalesce(F.max_by("after", F.when(F.col("past"), F.struct("ts_ms", "contest_id"))).over(w), F.lit(START)),
        "schedule_strength": F.coalesce(F.avg("opp_elo").over(w), F.lit(START)),
        "wins_above_median": F.count_if(won & above).over(w),
        "losses_below_median": F.count_if(~won & ~above).over(w),
    })
    since = (F.col("ts_ms") - F.col("_at")) / F.lit(float(DAY_MS))
    s = s.where("not past").withColumns({
        "prior_losses": F.col("prior_contests") - F.col("prior_wins"),
        "win_rate": rate(F.col("prior_wins"), F.col("prior_contests"), 0.5),
        "prior_leg_losses": F.col("prior_legs") - F.col("prior_leg_wins"),
        "leg_win_rate": rate(F.col("prior_leg_wins"), F.col("prior_legs"), 0.5),
        "is_cold_start": F.col("prior_contests") == 0,
        "last10_leg_win_rate": rate(F.col("_lw"), F.col("_lp"), 0.5),
        "last10_avg_legs_won": rate(F.col("_lw"), F.col("last10_contests"), 0.0),
        "last10_avg_legs_lost": rate(F.col("_lp") - F.col("_lw"), F.col("last10_contests"), 0.0),
        "form_trend": F.col("last5_win_rate") - F.col("last10_win_rate"),
        "days_since_last": since,
        "hours_since_last": (F.col("ts_ms") - F.col("_at")) / F.lit(3_600_000.0),
        "has_prior": F.col("_at").isNotNull(),
        "is_back_to_back": F.coalesce(since < 1, F.lit(False)),
        "inactivity": F.coalesce(since > 30, F.lit(False)),
        "days_since_same_roster": F.lit(None).cast("double"),
        **{name: F.lit(0) for name in _ROSTER},
    })
    return s.select("request_id", "side", *SIDE_FEATURES, *MORE_FEATURES, "legs_known")


def _pair_states(c: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and what its pair did before, turned to the request's A and B."""
    won_a = F.size(F.filter("legs", lambda x: x["score_a"] > x["score_b"]))
    h = c.select("contest_id", "ts_ms", "side_a", "side_b", "family", "region", "winner", (2 * won_a - F.size("legs")).cast("long").alias("diff"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"))
    r = requests.select("request_id", F.col("as_of_ms").alias("ts_ms"), "side_a", "side_b", "family", "region")
    u = h.unionByName(r, allowMissingColumns=True).withColumns({"lo": F.least("side_a", "side_b"), "hi": F.greatest("side_a", "side_b")})
    flip = F.col("side_a") != F.col("lo")
    u = u.withColumns({"_won": (F.col("winner") == F.col("lo")).cast("long"), "_diff": F.when(flip, -F.col("diff")).otherwise(F.col("diff"))})
    w = _upto("lo", "hi")
    n = lambda w: F.count("winner").over(w)
    u = u.withColumns({
        "h2h_meetings": n(w), "_lw": F.coalesce(F.sum("_won").over(w), F.lit(0)), "_ld": F.coalesce(F.sum("_diff").over(w), F.lit(0)),
        **{f"h2h_last{d}d": n(_days(d, "lo", "hi")) for d in (90, 180, 365)},
        "h2h_last_winner": F.coalesce(F.max_by("winner", F.when(F.col("winner").isNotNull(), F.struct("ts_ms", "contest_id"))).over(w).cast("string"), F.lit("unknown")),
        "h2h_same_family": n(_upto("lo", "hi", "family")),
        "h2h_same_region": F.when(F.col("region") == "unknown", 0).otherwise(n(_upto("lo", "hi", "region"))),
    }).where("winner is null")
    u = u.withColumns({"h2h_wins_a": F.when(flip, F.col("h2h_meetings") - F.col("_lw")).otherwise(F.col("_lw")), "h2h_leg_diff": F.when(flip, -F.col("_ld")).otherwise(F.col("_ld"))})
    u = u.withColumns({"h2h_wins_b": F.col("h2h_meetings") - F.col("h2h_wins_a"), "h2h_rate_a": rate(F.col("h2h_wins_a"), F.col("h2h_meetings"), 0.5)})
    return u.select("request_id", *H2H_FEATURES)


def matchup_asof(c: DataFrame, requests: DataFrame, ratings: DataFrame | None = None, rated: bool = True) -> DataFrame:
    """One feature row per request, with the columns of assemble_all() that need no scheduled event.

    c is read several times and best a table. requests: REQUEST, request_id being unique; ratings: rating.elo(c), made here if
    not given. Ratings are tables that are
    made before the result is read: a caller who wants none of their columns (RATED, elo_diff, elo_p) says so by ``rated``."""
    c = accepted(c)
    region = F.when(F.col("level") == "international", F.lit("unknown")).otherwise(F.col("region"))
    requests = stored(requests.select("request_id", "as_of_ms", "side_a", "side_b", "level", region.alias("region"), "family", norm_series(F.col("series_format")).alias("series_format")), "requests")
    if rated and ratings is None:
        ratings = elo(c)
    names = [n for n in [*SIDE_FEATURES, *MORE_FEATURES] if rated or n not in RATED]
    block = F.struct(*names, "legs_known")
    history = stored(_history(c, ratings if rated else None), "history")  # a step's shuffles are gone before the next one's begin
    s = stored(_side_states(history, requests).select("request_id", "side", block.alias("s")), "side-states")
    folded = s.groupBy("request_id").agg(F.max(F.when(F.col("side") == "A", F.col("s"))).alias("a"), F.max(F.when(F.col("side") == "B", F.col("s"))).alias("b"))
    f = requests.join(stored(_pair_states(c, requests), "pair-states"), "request_id").join(folded, "request_id")
    at, diff = F.timestamp_millis("as_of_ms"), F.col("a.elo") - F.col("b.elo") if rated else None
    return f.select(
        *requests.columns, F.lit("unknown").alias("stage"), F.lit(0).cast("long").alias("event_contests_last3d"), *H2H_FEATURES,
        *[F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in ("a", "b") for n in names],
        (F.col("a.days_since_last") - F.col("b.days_since_last")).alias("rest_difference_days"),
        (F.col("a.leg_win_rate") - F.col("b.leg_win_rate")).alias("leg_strength_diff"),
        F.size(F.array_intersect("a.legs_known", "b.legs_known")).cast("long").alias("pool_overlap"),
        *([diff.alias("elo_diff"), elo_p(diff).alias("elo_p")] if rated else []),
        F.year(F.to_utc_timestamp(at, F.current_timezone())).cast("long").alias("season_year"), F.month(F.to_utc_timestamp(at, F.current_timezone())).cast("long").alias("contest_month"),
    )
