"""Pre-contest features: for both sides of every accepted contest, only what earlier timestamp groups say.

All features of a side are windows over SIDES, one row per contest and side; those keyed by team share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.functions.windows import DAY_MS, prior, rate, trailing_days, with_last_rows
from agonix.sources.contests import KNOWN_LEGS, accepted

KEYS, ORDER = ["team"], ["contest_id", "side"]


def sides(c: DataFrame) -> DataFrame:
    """One row per accepted contest and side, legs seen from that side."""
    def one(side: str, own: str, other: str):
        legs = F.transform("legs", lambda x: F.struct(
            x["name"].alias("name"), x["recognized"].alias("recognized"), x[f"score_{own}"].alias("own"), x[f"score_{other}"].alias("other"),
            x[f"attack_{own}"].alias("attack"), x[f"defense_{own}"].alias("defense"), x[f"attack_{other}"].alias("attack_against"), x[f"defense_{other}"].alias("defense_against")))
        return F.struct(F.lit(side).alias("side"), F.col(f"side_{own}").alias("team"), F.col(f"side_{other}").alias("opp"), F.col(f"roster_{own}").alias("roster"), legs.alias("legs"))

    both = accepted(c).withColumn("s", F.explode(F.array(one("A", "a", "b"), one("B", "b", "a"))))
    s = both.select("contest_id", "ts", "ts_ms", "winner", "event_id", "family", "region", "level", "s.*").withColumn("won", F.col("winner") == F.col("team"))
    add = lambda f: F.aggregate("legs", F.lit(0.0), lambda acc, x: acc + F.coalesce(f(x), F.lit(0.0)))
    both_known = lambda x, p, q: F.when(x[p].isNotNull() & x[q].isNotNull(), x[p].cast("double"))
    played = lambda x, p, q: F.when(x[p].isNotNull() & x[q].isNotNull(), (x[p] + x[q]).cast("double"))
    legs_of = lambda name: F.size(F.filter("legs", lambda x: x["recognized"] & (x["name"] == name))).cast("long")
    return s.withColumns({
        "legs_played": F.size("legs").cast("long"),
        "legs_won": F.size(F.filter("legs", lambda x: x["own"] > x["other"])).cast("long"),
        "unknown_legs": F.size(F.filter("legs", lambda x: ~x["recognized"])).cast("long"),
        "rounds_won": add(lambda x: x["own"]),
        "rounds_lost": add(lambda x: x["other"]),
        "attack_won": add(lambda x: both_known(x, "attack", "defense_against")),
        "attack_played": add(lambda x: played(x, "attack", "defense_against")),
        "defense_won": add(lambda x: both_known(x, "defense", "attack_against")),
        "defense_played": add(lambda x: played(x, "defense", "attack_against")),
        **{f"legs_of_{n}": legs_of(n) for n in KNOWN_LEGS},
    })


def _n(w):
    return F.count(F.lit(1)).over(w)


def _sum(col, w):
    return F.coalesce(F.sum(col).over(w), F.lit(0))


def _won():
    return F.col("won").cast("long")


def record(s: DataFrame) -> DataFrame:
    """Cumulative record. A tied leg counts as lost."""
    w = prior(*KEYS)
    s = s.withColumns({"prior_contests": _n(w), "prior_wins": _sum(_won(), w), "prior_legs": _sum("legs_played", w), "prior_leg_wins": _sum("legs_won", w)})
    return s.withColumns({
        "prior_losses": F.col("prior_contests") - F.col("prior_wins"),
        "win_rate": rate(F.col("prior_wins"), F.col("prior_contests"), 0.5),
        "prior_leg_losses": F.col("prior_legs") - F.col("prior_leg_wins"),
        "leg_win_rate": rate(F.col("prior_leg_wins"), F.col("prior_legs"), 0.5),
        "is_cold_start": F.col("prior_contests") == 0,
    })


def recent_form(s: DataFrame) -> DataFrame:
    """Form over the last 3, 5 and 10 contests of earlier groups."""
    one = F.lit(1)
    wanted = {f"last{n}_contests": (F.count(one), n) for n in (3, 5, 10)} | {f"_w{n}": (F.sum(_won()), n) for n in (3, 5, 10)} | {"_lw": (F.sum("legs_won"), 10), "_lp": (F.sum("legs_played"), 10)}
    s = with_last_rows(s, wanted, KEYS, ORDER)
    s = s.withColumns({f"last{n}_win_rate": rate(F.col(f"_w{n}"), F.col(f"last{n}_contests"), 0.5) for n in (3, 5, 10)})
    s = s.withColumns({
        "last10_leg_win_rate": rate(F.col("_lw"), F.col("_lp"), 0.5),
        "last10_avg_legs_won": rate(F.col("_lw"), F.col("last10_contests"), 0.0),
        "last10_avg_legs_lost": rate(F.col("_lp") - F.col("_lw"), F.col("last10_contests"), 0.0),
        "form_trend": F.col("last5_win_rate") - F.col("last10_win_rate"),
    })
    return s.drop("_w3", "_w5", "_w10", "_lw", "_lp")


def day_form(s: DataFrame, days: tuple[int, ...] = (30, 60)) -> DataFrame:
    """Contests and win rate of the last days, the lower bound included."""
    for d in days:
        w = trailing_days(d, *KEYS)
        s = s.withColumns({f"last{d}d_contests": _n(w), f"last{d}d_win_rate": rate(_sum(_won(), w), _n(w), 0.5)})
    return s


def rest(s: DataFrame) -> DataFrame:
    """Days and hours since the last contest, and how many lie in the last days."""
    w, day = prior(*KEYS), F.floor(F.col("ts_ms") / DAY_MS)
    s = s.withColumn("_last", F.max("ts_ms").over(w)).withColumn("_day", day)
    for d in (7, 14, 30):
        t = trailing_days(d, *KEYS)
        s = s.withColumns({f"contests_last{d}d": _n(t), f"legs_last{d}d": _sum("legs_played", t)})
    since = (F.col("ts_ms") - F.col("_last")) / F.lit(float(DAY_MS))
    s = s.withColumns({
        "days_since_last": since,
        "hours_since_last": (F.col("ts_ms") - F.col("_last")) / F.lit(3_600_000.0),
        "has_prior": F.col("_last").isNotNull(),
        "is_back_to_back": F.coalesce(since < 1, F.lit(False)),
        "inactivity": F.coalesce(since > 30, F.lit(False)),
        "same_day_before": _n(prior(*KEYS, "_day")),
    })
    return s.drop("_last", "_day")


def leg_pool(s: DataFrame, known: list[str] = KNOWN_LEGS, w: WindowSpec | None = None) -> DataFrame:
    """Breadth, concentration and normalised entropy of the recognised legs played before. The known legs are a fixed
    list, so each is one windowed sum of a column that sides() has and no row is multiplied or shuffled with its legs.
    ``w``: other rows than all earlier ones."""
    w = w or prior(*KEYS)
    s = s.withColumn("_m", F.array(*[_sum(f"legs_of_{n}", w) for n in known]))
    s = s.withColumns({"unknown_leg_count": _sum("unknown_legs", w), "_p": F.filter("_m", lambda x: x > 0)})
    total = F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x)
    s = s.withColumn("_t", total).withColumn("leg_breadth", F.size("_p").cast("long"))
    share = lambda x: x / F.col("_t")
    entropy = F.aggregate("_p", F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x)))
    return s.withColumns({
        "top_leg_share": rate(F.array_max("_p"), F.col("_t"), 0.0),
        "leg_entropy": F.when(F.col("leg_breadth") > 1, entropy / F.log2(F.col("leg_breadth").cast("double"))).otherwise(0.0),
        "legs_known": F.filter(F.transform("_m", lambda x, i: F.when(x > 0, F.element_at(F.array(*[F.lit(n) for n in known]), i + 1))), lambda x: x.isNotNull()),
    }).drop("_m", "_p", "_t")


def rounds(s: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """Rounds per leg and attack and defence rates over all earlier legs (those of ``w``)."""
    w = w or prior(*KEYS)
    legs = _sum("legs_played", w)
    return s.withColumns({
        "avg_rounds_won": rate(_sum("rounds_won", w), legs, 0.0),
        "avg_rounds_lost": rate(_sum("rounds_lost", w), legs, 0.0),
        "has_split": (_sum("attack_played", w) > 0) | (_sum("defense_played", w) > 0),
        "attack_rate": rate(_sum("attack_won", w), _sum("attack_played", w), 0.5),
        "defense_rate": rate(_sum("defense_won", w), _sum("defense_played", w), 0.5),
    })


def event_congestion(c: DataFrame, days: int = 3) -> DataFrame:
    """Accepted contests of the same event in the last days, the bound included.

    Contests are counted per event and timestamp first. A window has one event's counts of two slots of ``days`` days, its own
    and the one before: no task has an event's whole history, or a contest's other columns."""
    c, slot = accepted(c), F.floor(F.col("ts_ms") / (days * DAY_MS))
    counts = c.groupBy("event_id", "ts_ms").agg(F.count(F.lit(1)).alias("_n"))
    both = counts.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    before = both.withColumn("event_contests_last3d", F.coalesce(F.sum("_n").over(trailing_days(days, "event_id", "_slot")), F.lit(0))).where(F.col("_slot") == slot)
    before = before.select(F.col("event_id").alias("_event"), F.col("ts_ms").alias("_at"), "event_contests_last3d")
    return c.join(before, F.col("event_id").eqNullSafe(F.col("_event")) & (F.col("ts_ms") == F.col("_at"))).drop("_event", "_at")


def head_to_head(c: DataFrame) -> DataFrame:
    """What the unordered pair did before, turned to the current A and B. Same family and region are partition keys."""
    c = accepted(c).withColumns({"lo": F.least("side_a", "side_b"), "hi": F.greatest("side_a", "side_b")})
    won_a = F.size(F.filter("legs", lambda x: x["score_a"] > x["score_b"]))
    diff = won_a - (F.size("legs") - won_a)  # a tied leg counts for B
    flip = F.col("side_a") != F.col("lo")
    c = c.withColumns({"_lo_won": (F.col("winner") == F.col("lo")).cast("long"), "_lo_diff": F.when(flip, -diff).otherwise(diff).cast("long")})
    w = prior("lo", "hi")
    c = c.withColumns({
        "h2h_meetings": _n(w), "_lw": _sum("_lo_won", w), "_ld": _sum("_lo_diff", w),
        "h2h_last90d": _n(trailing_days(90, "lo", "hi")), "h2h_last180d": _n(trailing_days(180, "lo", "hi")), "h2h_last365d": _n(trailing_days(365, "lo", "hi")),
        "h2h_last_winner": F.coalesce(F.max_by("winner", F.struct("ts_ms", "contest_id")).over(w).cast("string"), F.lit("unknown")),
        "h2h_same_family": _n(prior("lo", "hi", "family")),
        "h2h_same_region": F.when(F.col("region") == "unknown", 0).otherwise(_n(prior("lo", "hi", "region"))),
    })
    c = c.withColumns({
        "h2h_wins_a": F.when(flip, F.col("h2h_meetings") - F.col("_lw")).otherwise(F.col("_lw")),
        "h2h_leg_diff": F.when(flip, -F.col("_ld")).otherwise(F.col("_ld")),
    })
    c = c.withColumns({"h2h_wins_b": F.col("h2h_meetings") - F.col("h2h_wins_a"), "h2h_rate_a": rate(F.col("h2h_wins_a"), F.col("h2h_meetings"), 0.5)})
    return c.drop("_lo_won", "_lo_diff", "_lw", "_ld", "lo", "hi")


def roster_continuity(s: DataFrame) -> DataFrame:
    """Roster size, Jaccard with the previous roster, overlap with the last three, days since the same set, players who
    were in any earlier roster of the team, and earlier contests shared per pair of players."""
    s = with_last_rows(s, {"_r1": (F.collect_list("roster"), 1), "_r3": (F.collect_list("roster"), 3)}, KEYS, ORDER)
    prev = F.coalesce(F.try_element_at(F.filter("_r1", lambda x: x.isNotNull()), F.lit(-1)), F.array().cast("array<bigint>"))
    s = s.withColumns({"_prev": prev, "_recent": F.array_distinct(F.flatten("_r3")), "_set": F.array_join("roster", ",")})
    size = F.size("roster")
    s = s.withColumns({
        "roster_size": size.cast("long"),
        "roster_jaccard": F.when(F.size("_prev") > 0, rate(F.size(F.array_intersect("roster", "_prev")), F.size(F.array_union("roster", "_prev")), 0.0)).otherwise(0.0),
        "roster_last3_overlap": rate(F.size(F.filter("roster", lambda p: F.array_contains("_recent", p))), size, 0.0),
        "days_since_same_roster": (F.col("ts_ms") - F.max("ts_ms").over(prior(*KEYS, "_set"))) / F.lit(float(DAY_MS)),
    })
    player = s.select("contest_id", "side", "team", "ts_ms", F.explode("roster").alias("player"))
    seen = player.withColumn("_b", F.count(F.lit(1)).over(prior("team", "player"))).groupBy("contest_id", "side").agg(F.count_if(F.col("_b") > 0).alias("players_seen"))
    pair = s.select("contest_id", "side", "team", "ts_ms", F.explode(F.expr("flatten(transform(roster, (p, i) -> transform(slice(roster, i + 2, size(roster)), q -> struct(least(p, q) AS p, greatest(p, q) AS q))))")).alias("pq"))
    shared = pair.withColumn("_b", F.count(F.lit(1)).over(prior("team", "pq"))).groupBy("contest_id", "side").agg(F.avg("_b").alias("shared_prior_avg"))
    s = s.join(seen, ["contest_id", "side"], "left").join(shared, ["contest_id", "side"], "left")
    return s.withColumns({"players_seen": F.coalesce("players_seen", F.lit(0)), "shared_prior_avg": F.coalesce("shared_prior_avg", F.lit(0.0))}).drop("_r1", "_r3", "_prev", "_recent", "_set")


def player_experience(s: DataFrame) -> DataFrame:
    """Earlier appearances of the roster's players, across teams, per contest and side."""
    p = s.select("contest_id", "side", "ts_ms", "won", "level", "family", F.explode("roster").alias("player"))
    w = prior("player")
    p = p.withColumns({
        "_n": _n(w), "_w": _sum(_won(), w), "_r": _n(trailing_days(30, "player")),
        "_i": _sum((F.col("level") == "international").cast("long"), w), "_m": _sum((F.col("family") == "MACHINERY").cast("long"), w),
    })
    return p.groupBy("contest_id", "side").agg(
        F.avg("_n").alias("avg_appearances"), F.min("_n").alias("min_appearances"), F.max("_n").alias("max_appearances"), F.count_if(F.col("_n") == 0).alias("debuts"),
        F.avg("_w").alias("avg_wins"), F.avg("_r").alias("avg_appearances_30d"), F.sum("_i").alias("international_appearances"), F.sum("_m").alias("major_appearances"),
    )


SIDE_FEATURES = [
    "prior_contests", "prior_wins", "prior_losses", "win_rate", "prior_legs", "prior_leg_wins", "prior_leg_losses", "leg_win_rate", "is_cold_start",
    "last3_contests", "last5_contests", "last10_contests", "last3_win_rate", "last5_win_rate", "last10_win_rate", "last10_leg_win_rate", "last10_avg_legs_won", "last10_avg_legs_lost", "form_trend",
    "last30d_contests", "last30d_win_rate", "last60d_contests", "last60d_win_rate", "days_since_last", "hours_since_last", "has_prior", "is_back_to_back", "inactivity", "same_day_before",
    "contests_last7d", "contests_last14d", "contests_last30d", "legs_last7d", "legs_last14d", "legs_last30d",
]
_LEG_FEATURES = ["leg_breadth", "top_leg_share", "leg_entropy", "unknown_leg_count", "avg_rounds_won", "avg_rounds_lost", "has_split", "attack_rate", "defense_rate"]
_ROSTER_FEATURES = ["roster_size", "roster_jaccard", "roster_last3_overlap", "days_since_same_roster", "players_seen", "shared_prior_avg"]
_PLAYER_FEATURES = ["avg_appearances", "min_appearances", "max_appearances", "debuts", "avg_wins", "avg_appearances_30d", "international_appearances", "major_appearances"]
MORE_FEATURES = [
    "elo", "avg_opp_elo_last5", "avg_opp_elo_last10", "avg_opp_rate_last5", "avg_opp_rate_last10", "schedule_strength", "wins_above_median", "losses_below_median",
    *_LEG_FEATURES, *_ROSTER_FEATURES, *_PLAYER_FEATURES,
]
H2H_FEATURES = ["h2h_meetings", "h2h_wins_a", "h2h_wins_b", "h2h_rate_a", "h2h_leg_diff", "h2h_last90d", "h2h_last180d", "h2h_last365d", "h2h_last_winner", "h2h_same_family", "h2h_same_region"]


#: Versions of the table's columns and of the rules that fill them; both go up when either changes.
SCHEMA_VERSION, RULES_VERSION = "2", "2"


def _fold(s: DataFrame, names: list[str]) -> DataFrame:
    """contest_id, and the columns ``names`` of both sides as structs ``a`` and ``b``."""
    block = F.struct(*names)
    return s.groupBy("contest_id").agg(F.max(F.when(F.col("side") == "A", block)).alias("a"), F.max(F.when(F.col("side") == "B", block)).alias("b"))


def _context(c: DataFrame) -> DataFrame:
    """The contest's own columns, head-to-head and event congestion."""
    return head_to_head(event_congestion(c)).select("contest_id", "ts", "ts_ms", "side_a", "side_b", "winner", "event_id", "family", "region", "stage", "level", "series_format", "event_contests_last3d", *H2H_FEATURES)


def _columns(h: DataFrame) -> list:
    cols = [F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in ("a", "b") for n in SIDE_FEATURES]
    return [
        *h.columns, *cols,
        (F.col("a.days_since_last") - F.col("b.days_since_last")).alias("rest_difference_days"),
        (F.col("a.leg_win_rate") - F.col("b.leg_win_rate")).alias("leg_strength_diff"),
        F.year("ts").cast("long").alias("season_year"), F.month("ts").cast("long").alias("contest_month"),
        (F.col("winner") == F.col("side_a")).cast("long").alias("a_won"),
    ]


def error_inputs(c: DataFrame) -> DataFrame:
    """What the error analysis reads of assemble(): contest_id, level, series_format, a_won, rest_difference_days, and win rate,
    form and cold start of both sides. A fold compares whole structs, so columns that nobody reads would stay in its windows and
    shuffles; none of these reads legs or rosters, so the contests are made without them."""
    names = ["win_rate", "last3_win_rate", "is_cold_start"]
    kinds = dict(c.dtypes)
    kept = stored(accepted(c).select("contest_id", "ts", "ts_ms", "side_a", "side_b", "winner", "event_id", "family", "region", "level", "series_format"), "contests")
    bare = kept.withColumns({n: F.array().cast(kinds[n]) for n in ("legs", "roster_a", "roster_b")})
    folded = _fold(rest(recent_form(record(sides(bare)))), [*names, "days_since_last"])
    return kept.join(folded, "contest_id").select(
        "contest_id", "level", "series_format", (F.col("winner") == F.col("side_a")).cast("long").alias("a_won"), (F.col("a.days_since_last") - F.col("b.days_since_last")).alias("rest_difference_days"),
        *[F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in ("a", "b") for n in names],
    )


def assemble(c: DataFrame) -> DataFrame:
    """The feature table: one row per accepted contest with both sides' blocks, head-to-head and event context. The two
    side rows fold back with one aggregation on the contest; each block is a struct until then. The contests are a table
    first, as sides, context and event counts read them."""
    c = stored(accepted(c), "contests")
    h = _context(c)
    folded = _fold(rest(day_form(recent_form(record(sides(c))))), SIDE_FEATURES)
    return h.join(folded, "contest_id").select(*_columns(h))


def assemble_all(c: DataFrame, dataset: str = "") -> DataFrame:
    """assemble() with rating, opponent strength, leg pool, rounds, roster continuity and player experience of both sides,
    the rating's difference and probability, the overlap of the leg pools, and what the rows come from: the version of the
    source (``dataset``), of the columns and of the rules.

    The contests are a table first, as ratings, sides, players and context all read them. Each block of features (windows by
    team, opponents, rosters, players) is computed from the columns it needs and folds to one row per contest; the folded
    blocks lie by contest_id already, so that a column is shuffled once after its windows."""
    from .rating import STRENGTH, elo, elo_p, opponent_strength

    c = stored(accepted(c), "contests")
    s = record(sides(c))
    own = [*SIDE_FEATURES, *_LEG_FEATURES, "legs_known"]
    roster, players = roster_continuity(sides(c).select("contest_id", "side", "team", "ts_ms", "roster")), player_experience(sides(c))
    blocks = [
        (_fold(rounds(leg_pool(rest(day_form(recent_form(s))))), own), own),
        (_fold(opponent_strength(s, elo(c)), ["elo", *STRENGTH]), ["elo", *STRENGTH]),
        (_fold(roster, _ROSTER_FEATURES), _ROSTER_FEATURES),
        (_fold(players, _PLAYER_FEATURES), _PLAYER_FEATURES),
    ]
    h = _context(c)
    f = h
    for i, (folded, _) in enumerate(blocks):  # a contest may have no players
        f = f.join(folded.withColumnsRenamed({"a": f"_a{i}", "b": f"_b{i}"}), "contest_id", "inner" if i < 3 else "left")
    side = lambda p: F.struct(*[F.col(f"_{p}{i}.{n}").alias(n) for i, (_, names) in enumerate(blocks) for n in names])
    f = f.select(*h.columns, side("a").alias("a"), side("b").alias("b"))
    more = [F.col(f"{p}.{n}").alias(f"{p}_{n}") for p in ("a", "b") for n in MORE_FEATURES]
    diff = F.col("a.elo") - F.col("b.elo")
    return f.select(
        *_columns(h), *more, diff.alias("elo_diff"), elo_p(diff).alias("elo_p"), F.size(F.array_intersect("a.legs_known", "b.legs_known")).cast("long").alias("pool_overlap"),
        F.lit(dataset).alias("source_dataset_version"), F.lit(SCHEMA_VERSION).alias("feature_schema_version"), F.lit(RULES_VERSION).alias("feature_rules_version"),
    )
