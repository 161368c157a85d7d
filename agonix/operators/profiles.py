"""History-model aggregates, team profiles, comparisons and rankings.

History: one row per played leg and side (team, opp, own and other rounds, first kills, economy buckets, clutches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.functions.windows import with_place, with_running_sum

DIMENSIONS = ["aggression", "tempo", "control", "utility", "adaptability", "clutch"]
_SAFE = F.try_divide


def history(c: DataFrame) -> DataFrame:
    """Both sides of every leg of contests."""
    leg = c.select("contest_id", "ts", "ts_ms", "side_a", "side_b", F.explode("legs").alias("x"))
    rounds = F.col("x.score_a") + F.col("x.score_b")
    fk = F.floor(rounds / 2)

    def side(team, opp, own, other, first, split):
        return F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.col(own).alias("own"), F.col(other).alias("other"), first.cast("double").alias("first_kills"), F.col(split).isNotNull().alias("split"))

    s = leg.withColumn("s", F.explode(F.array(side("side_a", "side_b", "x.score_a", "x.score_b", fk, "x.attack_a"), side("side_b", "side_a", "x.score_b", "x.score_a", rounds - fk, "x.attack_a"))))
    s = s.select((F.col("contest_id") * 10 + F.col("x.leg")).alias("leg_id"), "ts", "ts_ms", F.col("x.name").alias("name"), "s.*")
    full = F.col("name").isin("LARGE", "STANDARD", "MEDIUM")
    return s.withColumns({
        "rounds": F.col("own") + F.col("other"), "won": F.col("own") > F.col("other"),
        "full_played": F.when(full, F.col("own") + F.col("other")).otherwise(0.0), "full_won": F.when(full, F.col("own")).otherwise(0.0),
        "clutch_faced": F.when(F.col("split"), 2).otherwise(0), "clutch_won": F.when(F.col("split") & (F.col("own") > F.col("other")), 1).otherwise(0),
    })


def team_aggregate(h: DataFrame, teams: DataFrame) -> DataFrame:
    """Rates per team; null where there is nothing to divide by. Teams without legs stay."""
    won = F.col("won").cast("double")
    base = h.groupBy("team").agg(
        F.count(F.lit(1)).alias("legs"), F.avg(won).alias("win_rate"), F.avg(F.col("own") - F.col("other")).alias("avg_round_diff"), _SAFE(F.sum("own"), F.sum("rounds")).alias("round_rate"),
        _SAFE(F.sum("full_won"), F.sum("full_played")).alias("full_rate"), _SAFE(F.sum("first_kills"), F.sum("rounds")).alias("entry_rate"), _SAFE(F.sum("clutch_won"), F.sum("clutch_faced")).alias("clutch_rate"),
    )
    newest = Window.partitionBy("team").orderBy(F.desc("ts_ms"), "leg_id")
    form = h.withColumn("r", F.row_number().over(newest)).where("r <= 10").groupBy("team").agg(F.avg(F.when(F.col("r") <= 5, won)).alias("form5"), F.avg(won).alias("form10"))
    # Few legs per team: the second level works on (team, leg) counts, already combined before the shuffle.
    per = h.groupBy("team", "name").agg(F.count(F.lit(1)).alias("n"), F.avg(won).alias("rate"))
    spread = per.groupBy("team").agg(F.stddev_pop("rate").alias("leg_spread"), F.count(F.lit(1)).alias("leg_kinds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("n", "rate"))))).alias("leg_performance"))
    return teams.select("team").join(base, "team", "left").join(form, "team", "left").join(spread, "team", "left").withColumn("legs", F.coalesce("legs", F.lit(0)))


def _score(x):
    """Half up, within 0 and 100; 50 where unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(x + 0.5).cast("double"))), F.lit(50.0))


def team_profile(agg: DataFrame) -> DataFrame:
    """Six 0-100 dimensions, how many are covered, and how stable the form is."""
    raw = {
        "aggression": F.col("entry_rate") * 100, "tempo": 50 + 4 * F.abs("avg_round_diff"), "control": F.col("round_rate") * 100, "utility": F.col("full_rate") * 100,
        "adaptability": F.when(F.col("leg_kinds") >= 2, 100 - 200 * F.col("leg_spread")), "clutch": F.col("clutch_rate") * 100,
    }
    covered = sum((v.isNotNull().cast("int") for v in list(raw.values())[1:]), list(raw.values())[0].isNotNull().cast("int"))
    return agg.select("team", *[_score(v).alias(k) for k, v in raw.items()], (covered / F.lit(6.0)).alias("coverage"), F.coalesce(1 - F.abs(F.col("win_rate") - F.col("form10")), F.lit(0.5)).alias("stability"))


def h2h_index(h: DataFrame) -> DataFrame:
    """Per unordered pair: legs, wins of each, rate and average difference of the lower one."""
    low = h.where(F.col("team") < F.col("opp"))
    return low.groupBy(F.col("team").alias("lo"), F.col("opp").alias("hi")).agg(F.count(F.lit(1)).alias("legs"), F.count_if("won").alias("lo_wins"), F.count_if(F.col("own") < F.col("other")).alias("hi_wins"), F.avg(F.col("won").cast("double")).alias("lo_rate"), F.avg(F.col("own") - F.col("other")).alias("lo_diff"))


def h2h_oriented(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The index for given (team_a, team_b), turned to A."""
    p = pairs.withColumns({"lo": F.least("team_a", "team_b"), "hi": F.greatest("team_a", "team_b")}).join(index, ["lo", "hi"], "left")
    flip = F.col("team_a") != F.col("lo")
    return p.select("team_a", "team_b", F.coalesce("legs", F.lit(0)).alias("legs"), F.coalesce(F.when(flip, F.col("hi_wins")).otherwise(F.col("lo_wins")), F.lit(0)).alias("a_wins"), F.when(flip, -F.col("lo_diff")).otherwise(F.col("lo_diff")).alias("a_diff"))


def _pair(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    side = lambda s: profiles.select(F.col("team").alias(f"team_{s}"), F.struct(*DIMENSIONS, "coverage", "stability").alias(s))
    return pairs.join(side("a"), "team_a").join(side("b"), "team_b")


def matchup(profiles: DataFrame, pairs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Similarity, conflicting dimensions (at least 20 apart, the largest first), complementary ones (less than 12 apart, 55 and
    more in the mean), the decisive one (the largest difference; ties: the earlier dimension), weighted advantage, agreement
    (a dimension without a difference, or no advantage, agrees), heuristic probability, confidence and trust."""
    weights = weights or {"aggression": 0.2, "tempo": 0.1, "control": 0.25, "utility": 0.2, "adaptability": 0.1, "clutch": 0.15}
    p = _pair(profiles, pairs)
    d = F.array(*[F.struct((F.col(f"a.{n}") - F.col(f"b.{n}")).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(w).alias("w"), ((F.col(f"a.{n}") + F.col(f"b.{n}")) / 2).alias("mean")) for i, (n, w) in enumerate(weights.items())])
    p = p.withColumn("d", d)
    largest = F.array_sort(F.transform("d", lambda x: F.struct((-F.abs(x["d"])).alias("k"), x["i"].alias("i"), x["name"].alias("name"))))
    total = lambda f: F.aggregate("d", F.lit(0.0), lambda acc, x: acc + f(x))
    adv = total(lambda x: x["d"] * x["w"]) / sum(weights.values())
    p = p.withColumns({
        "similarity": F.floor(F.greatest(F.lit(0.0), 100 - 1.4 * total(lambda x: F.abs(x["d"])) / len(weights)) + 0.5).cast("double"),
        "advantage": F.round(adv, 9),  # so that a difference of nothing has no sign
        "conflicting": F.array_join(F.transform(F.filter(largest, lambda x: x["k"] <= -20), lambda x: x["name"]), ","),
        "complementary": F.array_join(F.transform(F.filter("d", lambda x: (F.abs(x["d"]) < 12) & (x["mean"] >= 55)), lambda x: x["name"]), ","),
        "decisive": F.element_at(largest, 1)["name"],
    })
    p = p.withColumn("agreement", total(lambda x: ((F.signum(x["d"]) == F.signum("advantage")) | (x["d"] == 0) | (F.col("advantage") == 0)).cast("double")) / len(weights))
    prob = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 / (1 + F.exp(-0.04 * F.col("advantage")))))
    confidence = 0.6 * F.col("agreement") + 0.4 * (F.col("a.stability") + F.col("b.stability")) / 2
    p = p.withColumns({"probability": F.floor(prob * 100 + 0.5) / 100, "confidence": confidence})
    return p.withColumn("trust", 0.5 * (F.col("a.coverage") + F.col("b.coverage")) / 2 + 0.5 * F.col("confidence")).drop("a", "b", "d")


def key_factors(profiles: DataFrame, pairs: DataFrame, least: float = 8.0, top: int = 4) -> DataFrame:
    """Per pair the dimensions that differ by at least ``least``, the ``top`` largest, with the leader."""
    p = _pair(profiles, pairs)
    d = F.array(*[F.struct((-F.abs(F.col(f"a.{n}") - F.col(f"b.{n}"))).alias("k"), F.lit(n).alias("name"), (F.col(f"a.{n}") - F.col(f"b.{n}")).alias("d")) for n in DIMENSIONS])
    p = p.select("team_a", "team_b", F.explode(F.slice(F.array_sort(F.filter(d, lambda x: -x["k"] >= least)), 1, top)).alias("x"))
    return p.select("team_a", "team_b", F.col("x.name").alias("factor"), (-F.col("x.k")).alias("impact"), F.when(F.col("x.d") > 0, "A").otherwise("B").alias("leader"))


def compare(profiles: DataFrame, pairs: DataFrame, tiers: tuple[float, float, float] = (3.0, 8.0, 16.0)) -> DataFrame:
    """Long table of dimensions per pair with the size of the difference and who has it."""
    p = _pair(profiles, pairs)
    p = p.select("team_a", "team_b", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f"a.{n}").alias("a"), F.col(f"b.{n}").alias("b")) for n in DIMENSIONS])).alias("x")).select("team_a", "team_b", "x.*")
    size = F.round(F.abs(F.col("a") - F.col("b")), 1)
    lo, mid, hi = tiers
    tier = F.when(size < lo, "none").when(size < mid, "slight").when(size < hi, "moderate").otherwise("strong")
    return p.withColumns({"magnitude": size, "tier": tier, "advantage": F.when(size < lo, "even").when(F.col("a") > F.col("b"), "A").otherwise("B")})


def compare_legs(h: DataFrame, pairs: DataFrame, close: float = 5.0) -> DataFrame:
    """Per pair over the legs both played: averages, how many favour A, B or nobody, and the largest gap."""
    per = h.groupBy("team", "name").agg((100 * F.avg(F.col("won").cast("double"))).alias("rate"))
    side = lambda s: per.select(F.col("team").alias(f"team_{s}"), "name", F.col("rate").alias(f"rate_{s}"))
    both = pairs.join(side("a"), "team_a").join(side("b"), ["team_b", "name"]).withColumn("gap", F.round(F.col("rate_a") - F.col("rate_b"), 6))
    return both.groupBy("team_a", "team_b").agg(
        F.count(F.lit(1)).alias("shared"), F.round(F.avg("rate_a"), 1).alias("avg_a"), F.round(F.avg("rate_b"), 1).alias("avg_b"),
        F.count_if(F.col("gap") >= close).alias("favour_a"), F.count_if(F.col("gap") <= -close).alias("favour_b"), F.count_if(F.abs("gap") < close).alias("close"),
        F.min(F.struct((-F.abs("gap")).alias("k"), "name")).getField("name").alias("largest_gap"), F.min(F.struct(F.abs("gap").alias("k"), "name")).getField("name").alias("most_even"),
    )


def _half_up(x, places: int = 2):
    """Rounded half up on the scaled number."""
    return F.floor(x * 10**places + 0.5) / 10**places


def _ranked(t: DataFrame, order: list) -> DataFrame:
    """``t`` with rank over all rows and region_rank, the place within the region in the same order; no single task."""
    t = with_place(t, order, "rank")
    return with_running_sum(t.withColumn("_one", F.lit(1).cast("long")), "_one", ["region"], ["rank"], "region_rank").drop("_one")


def profile_rankings(agg: DataFrame, profiles: DataFrame, region: DataFrame) -> DataFrame:
    """Score of the profile: .35 rating, .25 form, .20 depth (mean strength over the team's legs, 0 without any), .15 consistency,
    .05 clutch, each 0-100, rounded to two places; ties by rating, then team. With strongest and weakest leg."""
    strength = F.map_values("leg_performance")
    depth = F.when(F.size(strength) > 0, 100 * F.aggregate(strength, F.lit(0.0), lambda acc, x: acc + x["rate"]) / F.size(strength)).otherwise(0.0)
    legs = F.transform(F.map_entries("leg_performance"), lambda e: F.struct((-F.round(e["value"]["rate"], 9)).alias("k"), e["key"].alias("name")))
    a = agg.select("team", (100 * F.coalesce("win_rate", F.lit(0.5))).alias("rating"), (100 * F.coalesce("form10", F.lit(0.5))).alias("form"), F.coalesce(depth, F.lit(0.0)).alias("depth"), F.array_sort(legs).alias("l"))
    low = F.array_sort(F.transform("l", lambda e: F.struct((-e["k"]).alias("k"), e["name"].alias("name"))))
    t = profiles.join(a, "team").join(region, "team")
    score = F.col("rating") * 0.35 + F.col("form") * 0.25 + F.col("depth") * 0.2 + F.col("adaptability") * 0.15 + F.col("clutch") * 0.05
    t = t.withColumns({"score": _half_up(F.round(score, 9)), "strongest": F.try_element_at("l", F.lit(1)).getField("name"), "weakest": F.try_element_at(low, F.lit(1)).getField("name")})
    return _ranked(t.withColumn("rating", F.round("rating", 9)), [F.desc("score"), F.desc("rating"), F.asc("team")]).select("team", "region", "score", "rank", "region_rank", "strongest", "weakest", F.round("depth", 6).alias("depth"))


#: The rating's middle and spread, legs that can be known, rounds that fill a leg, weights of what was played.
MIDDLE, SPREAD, KNOWN, FULL = 1500.0, 400.0, 13, 13.0
TIERS = {"major": 1.0, "international": 0.6, "league": 0.3, "other": 0.1}
#: Contests of a well-sampled team, the largest penalty, the weights of the score's terms.
SAMPLED, PENALTY = 10, 15.0
TERMS = {"base": 0.35, "form": 0.25, "opponents": 0.15, "depth": 0.1, "tier": 0.1, "consistency": 0.05}


def _clamp(x):
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(x, F.lit(0.0)))), F.lit(0.0))


def _rescaled(elo):
    """A rating on 0-100, its middle at 50."""
    return _clamp(50 + (elo - MIDDLE) / SPREAD * 50)


def power_state(s: DataFrame, known: int = KNOWN, full: float = FULL) -> DataFrame:
    """Per team with a row in the window: the state its newest row shows, and how high it played over the whole window.

    s: one row per contest and side in the window: team, ts_ms, contest_id, elo, win_rate, last10_contests, last10_win_rate,
    leg_breadth, last10_leg_win_rate, avg_rounds_won, avg_opp_elo_last10, is_major, is_international, is_league."""
    weight = F.when(F.col("is_major"), TIERS["major"]).when(F.col("is_international"), TIERS["international"]).when(F.col("is_league"), TIERS["league"]).otherwise(TIERS["other"])
    names = ["elo", "win_rate", "last10_contests", "last10_win_rate", "leg_breadth", "last10_leg_win_rate", "avg_rounds_won", "avg_opp_elo_last10"]
    p = s.groupBy("team").agg(F.count(F.lit(1)).alias("contests"), F.max_by(F.struct(*names), F.struct("ts_ms", "contest_id")).alias("l"), F.avg(weight).alias("w")).select("team", "contests", "w", "l.*")
    depth = (_clamp(F.col("leg_breadth") / F.lit(float(known)) * 100) + _clamp(F.col("last10_leg_win_rate") * 100) + _clamp(F.col("avg_rounds_won") / F.lit(full) * 100)) / 3
    return p.select(
        "team", "contests", "elo", _clamp(F.when(F.col("last10_contests") > 0, F.col("last10_win_rate")).otherwise(F.col("win_rate")) * 100).alias("form"), _clamp(depth).alias("depth"),
        _clamp(100 - F.abs(F.col("last10_win_rate") - F.col("win_rate")) * 100).alias("consistency"), _rescaled(F.col("avg_opp_elo_last10")).alias("opponents"), _clamp(F.col("w") * 100).alias("tier"),
    )


def power_rankings(teams: DataFrame, state: DataFrame) -> DataFrame:
    """Evidence-based ranking. Every term but the rating's is drawn to the mean of all states (50 without any) by 1 - n / 10 below
    ten contests, and what is missing to ten costs up to 15 points. Terms are rounded to two places. A team without a
    state is unrated and scores 0. Order: score, the rating's term, team.

    teams: team, region, verified; state: power_state(), a table first (one row per team), as means and terms read it and it
    stands for the whole history."""
    state = stored(state, "state")
    parts = [k for k in TERMS if k != "base"]
    means = state.agg(*[F.coalesce(F.avg(k), F.lit(50.0)).alias(f"m_{k}") for k in parts])
    t = teams.join(state, "team", "left").join(F.broadcast(means))  # one row
    w = F.least(F.col("contests") / F.lit(float(SAMPLED)), F.lit(1.0))
    exact = lambda x: _half_up(F.round(x, 9))
    t = t.withColumns({"t_base": exact(_rescaled(F.col("elo")) * TERMS["base"]), **{f"t_{k}": exact((F.col(f"m_{k}") + (F.col(k) - F.col(f"m_{k}")) * w) * TERMS[k]) for k in parts}, "t_penalty": -exact(PENALTY * F.greatest(F.lit(0.0), 1 - F.col("contests") / F.lit(float(SAMPLED))))})
    total = sum((F.col(f"t_{k}") for k in parts), F.col("t_base")) + F.col("t_penalty")
    rated = F.col("contests").isNotNull()
    level = F.when(~rated, "unrated").when(F.coalesce("verified", F.lit(False)) & (F.col("contests") >= SAMPLED), "verified").otherwise("provisional")
    t = t.withColumns({"score": F.when(rated, exact(total)).otherwise(0.0), "base": F.when(rated, F.col("t_base")).otherwise(0.0), "confidence": level})
    return _ranked(t, [F.desc("score"), F.desc("base"), F.asc("team")]).select("team", "region", "score", "rank", "region_rank", "confidence", F.coalesce("contests", F.lit(0)).alias("contests"), *[f"t_{k}" for k in [*TERMS, "penalty"]])


def catalog(c: DataFrame, family: str | None = None, team: int | None = None, after: str | None = None, before: str | None = None, limit: int = 50, most: int = 200) -> DataFrame:
    """Newest first, then id, at most min(limit, most) rows; with the total count of what matches. ``after`` and ``before`` are
    inclusive times without a zone. Filters reach the scan, the limit is a top-k."""
    if limit < 1:
        raise ValueError("limit must be a positive number")
    if family is not None:
        c = c.where(F.col("family") == family)
    if team is not None:
        c = c.where((F.col("side_a") == team) | (F.col("side_b") == team))
    if after is not None:
        c = c.where(F.col("ts") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        c = c.where(F.col("ts") <= F.lit(before).cast("timestamp_ntz"))
    total = c.agg(F.count(F.lit(1)).alias("total"))
    top = c.orderBy(F.desc("ts_ms"), "contest_id").limit(min(limit, most))
    return top.join(F.broadcast(total))


#: How the legs of a pair can be ranked; names settle ties.
LEG_ORDERS = {"largest-gap": ("magnitude", True), "closest": ("magnitude", False), "name": None, "a-strength": ("rate_a", True), "b-strength": ("rate_b", True)}


def rank_legs(legs: DataFrame, selected: list[str], mode: str = "largest-gap", active: str | None = None) -> DataFrame:
    """The legs of each pair in one of LEG_ORDERS: ``place``, whether it is ``selected`` (which never changes the order), and
    the ``active`` one: the one asked for if the pair has it, else the first.

    legs: team_a, team_b, name, rate_a, rate_b."""
    x = legs.withColumn("magnitude", F.round(F.abs(F.col("rate_a") - F.col("rate_b")), 1))
    key = LEG_ORDERS[mode]
    order = [*([F.desc(key[0]) if key[1] else F.asc(key[0])] if key else []), F.asc("name")]
    pair = Window.partitionBy("team_a", "team_b")
    x = x.withColumns({"place": F.row_number().over(pair.orderBy(*order)), "selected": F.col("name").isin(selected), "_has": F.max((F.col("name") == F.lit(active)).cast("int")).over(pair)})
    return x.withColumn("active", F.when(F.coalesce("_has", F.lit(0)) == 1, F.col("name") == F.lit(active)).otherwise(F.col("place") == 1)).drop("_has")


def validate_history(h: DataFrame, known: DataFrame, legs: list[str], now_ms: int, low: float = 13, high: float = 80) -> DataFrame:
    """Records with all their reasons; among valid ones the first of an id stays, later ones are duplicates."""
    k = known.select(F.col("team").alias("_t"))
    h = h.join(k, F.col("team") == F.col("_t"), "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_t").isNull(), "unknown-team"), F.when(~F.coalesce(F.col("name").isin(legs), F.lit(False)), "unknown-leg"), F.when(F.col("ts_ms") > now_ms, "future"),
        F.when(~F.coalesce(F.col("rounds").between(low, high), F.lit(False)), "round-count"), F.when(F.col("full_won") > F.col("full_played"), "economy"), F.when(F.col("clutch_won") > F.col("clutch_faced"), "clutch"),
    ))
    h = h.withColumn("reasons", reasons)
    valid = F.size("reasons") == 0
    first = F.row_number().over(Window.partitionBy("leg_id", "team", valid).orderBy("ts_ms", "own", "other"))
    h = h.withColumn("_r", first)
    return h.withColumn("reasons", F.when(valid & (F.col("_r") > 1), F.array(F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("_r", "_t")
