"""Queries of history aggregates, profiles, comparisons and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.functions.windows import with_last_rows
from agonix.operators import features as X
from agonix.operators import profiles as P
from agonix.operators import rating as R
from agonix.sources.contests import SQL, accepted, contests, table

from .base import query
from .feature_queries import _FORM, _PRIOR, _RECORD


def _teams(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team"))


def _regions(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("team"), "region")


def _pairs(spark, sf_dir):
    """Pairs of teams that met, lower key first or, for even sums, last."""
    c = accepted(contests(spark, sf_dir)).select("side_a", "side_b").distinct()
    even = (F.col("side_a") + F.col("side_b")) % 2 == 0
    return c.select(F.when(even, F.col("side_b")).otherwise(F.col("side_a")).alias("team_a"), F.when(even, F.col("side_a")).otherwise(F.col("side_b")).alias("team_b")).distinct()


def _history(spark, sf_dir):
    return P.history(accepted(contests(spark, sf_dir)))


def _agg(spark, sf_dir):
    return P.team_aggregate(_history(spark, sf_dir), _teams(spark, sf_dir))


HIST = SQL + """
, hh AS (
  SELECT acc.contest_id * 10 + leg AS leg_id, ts, name, side_a AS team, side_b AS opp, qa AS own, qb AS other, floor((qa + qb) / 2) AS fk, sp FROM acc JOIN legs USING (contest_id) UNION ALL
  SELECT acc.contest_id * 10 + leg, ts, name, side_b, side_a, qb, qa, qa + qb - floor((qa + qb) / 2), sp FROM acc JOIN legs USING (contest_id)
), h AS (SELECT *, own + other AS rounds, own > other AS won, CASE WHEN name IN ('LARGE', 'STANDARD', 'MEDIUM') THEN own + other ELSE 0 END AS fp, CASE WHEN name IN ('LARGE', 'STANDARD', 'MEDIUM') THEN own ELSE 0 END AS fw,
  CASE WHEN sp THEN 2 ELSE 0 END AS cf, CASE WHEN sp AND own > other THEN 1 ELSE 0 END AS cw FROM hh),
base AS (SELECT team, count(*) AS legs, avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(own - other) AS avg_round_diff, sum(own) / sum(rounds) AS round_rate, sum(fw) / nullif(sum(fp), 0) AS full_rate, sum(fk) / sum(rounds) AS entry_rate, sum(cw)::DOUBLE / nullif(sum(cf), 0)::DOUBLE AS clutch_rate FROM h GROUP BY 1),
nw AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts DESC, leg_id) AS r FROM h),
form_h AS (SELECT team, avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE r <= 5) AS form5, avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE r <= 10) AS form10 FROM nw GROUP BY 1),
per AS (SELECT team, name, count(*) AS n, avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM h GROUP BY 1, 2),
spread AS (SELECT team, stddev_pop(rate) AS leg_spread, count(*) AS leg_kinds FROM per GROUP BY 1),
agg AS (SELECT s_suppkey AS team, coalesce(legs, 0) AS legs, win_rate, avg_round_diff, round_rate, full_rate, entry_rate, clutch_rate, form5, form10, leg_spread, leg_kinds FROM supplier LEFT JOIN base ON team = s_suppkey LEFT JOIN form_h USING (team) LEFT JOIN spread USING (team)),
prof AS (SELECT team, """ + ", ".join(f"coalesce(greatest(0.0, least(100.0, floor(({e}) + 0.5)))::DOUBLE, 50.0::DOUBLE) AS {n}" for n, e in (("aggression", "entry_rate * 100"), ("tempo", "50 + 4 * abs(avg_round_diff)"), ("control", "round_rate * 100"), ("utility", "full_rate * 100"), ("adaptability", "CASE WHEN leg_kinds >= 2 THEN 100 - 200 * leg_spread END"), ("clutch", "clutch_rate * 100"))) + """,
  ((entry_rate IS NOT NULL)::INT + (avg_round_diff IS NOT NULL)::INT + (round_rate IS NOT NULL)::INT + (full_rate IS NOT NULL)::INT + (coalesce(leg_kinds, 0) >= 2)::INT + (clutch_rate IS NOT NULL)::INT) / 6.0::DOUBLE AS coverage, coalesce(1 - abs(win_rate - form10), 0.5) AS stability FROM agg),
pairs AS (SELECT DISTINCT CASE WHEN (side_a + side_b) % 2 = 0 THEN side_b ELSE side_a END AS team_a, CASE WHEN (side_a + side_b) % 2 = 0 THEN side_a ELSE side_b END AS team_b FROM acc),
pp AS (SELECT team_a, team_b, """ + ", ".join(f"a.{n} AS a_{n}, b.{n} AS b_{n}" for n in [*P.DIMENSIONS, "coverage", "stability"]) + """ FROM pairs JOIN prof a ON a.team = team_a JOIN prof b ON b.team = team_b)
"""
_LONG = " UNION ALL ".join(f"SELECT team_a, team_b, '{n}' AS dimension, a_{n} AS a, b_{n} AS b FROM pp" for n in P.DIMENSIONS)


def _r(df, *cols, places: int = 8):
    return df.withColumns({c: F.round(c, places) for c in cols})


_AGG_COLS = ["win_rate", "avg_round_diff", "round_rate", "full_rate", "entry_rate", "clutch_rate", "form5", "form10", "leg_spread"]


@query("team_aggregate", HIST + "SELECT team, legs, " + ", ".join(f"round({n}, 8) AS {n}" for n in _AGG_COLS) + " FROM agg")
def q_agg(spark, sf_dir):
    return _r(_agg(spark, sf_dir), *_AGG_COLS).select("team", "legs", *_AGG_COLS)


@query("team_profile", HIST + "SELECT team, aggression, tempo, control, utility, adaptability, clutch, round(coverage, 8) AS coverage, round(stability, 8) AS stability FROM prof")
def q_profile(spark, sf_dir):
    return _r(P.team_profile(_agg(spark, sf_dir)), "coverage", "stability")


@query("h2h_index", HIST + "SELECT team AS lo, opp AS hi, count(*) AS legs, count(*) FILTER (WHERE won) AS lo_wins, count(*) FILTER (WHERE own < other) AS hi_wins, round(avg(CASE WHEN won THEN 1.0::DOUBLE ELSE 0 END), 8) AS lo_rate, round(avg(own - other), 8) AS lo_diff FROM h WHERE team < opp GROUP BY 1, 2")
def q_index(spark, sf_dir):
    return _r(P.h2h_index(_history(spark, sf_dir)), "lo_rate", "lo_diff")


@query("h2h_oriented", HIST + "SELECT team_a, team_b, count(h.team) AS legs, count(*) FILTER (WHERE won) AS a_wins, round(avg(own - other), 8) AS a_diff FROM pairs LEFT JOIN h ON h.team = team_a AND h.opp = team_b GROUP BY 1, 2")
def q_oriented(spark, sf_dir):
    return _r(P.h2h_oriented(P.h2h_index(_history(spark, sf_dir)), _pairs(spark, sf_dir)), "a_diff")


_W = {"aggression": 0.2, "tempo": 0.1, "control": 0.25, "utility": 0.2, "adaptability": 0.1, "clutch": 0.15}


@query("matchup_profile", HIST + f""", m AS (SELECT *, floor(greatest(0, 100 - 1.4 * ({' + '.join(f'abs(a_{n} - b_{n})' for n in _W)}) / 6) + 0.5)::DOUBLE AS similarity, {' + '.join(f'{w} * (a_{n} - b_{n})' for n, w in _W.items())} AS adv FROM pp),
g AS (SELECT *, ({' + '.join(f'(CASE WHEN sign(a_{n} - b_{n}) = sign(round(adv, 9)) OR a_{n} = b_{n} OR round(adv, 9) = 0 THEN 1 ELSE 0 END)' for n in _W)}) / 6.0::DOUBLE AS agreement FROM m)
SELECT team_a, team_b, similarity, round(adv, 6) AS advantage, round(agreement, 8) AS agreement, round(0.6 * agreement + 0.4 * (a_stability + b_stability) / 2, 6) AS confidence,
  array_to_string(list_transform(list_sort(list_filter([{', '.join(f"{{'k': -abs(a_{n} - b_{n}), 'i': {i}, 'n': '{n}'}}" for i, n in enumerate(_W))}], lambda x: x.k <= -20)), lambda x: x.n), ',') AS conflicting,
  concat_ws(',', {', '.join(f"CASE WHEN abs(a_{n} - b_{n}) < 12 AND (a_{n} + b_{n}) / 2 >= 55 THEN '{n}' END" for n in _W)}) AS complementary, list_sort([{', '.join(f"{{'k': -abs(a_{n} - b_{n}), 'i': {i}, 'n': '{n}'}}" for i, n in enumerate(_W))}])[1].n AS decisive FROM g""")
def q_matchup(spark, sf_dir):
    m = P.matchup(P.team_profile(_agg(spark, sf_dir)), _pairs(spark, sf_dir))
    return _r(_r(m, "agreement"), "advantage", "confidence", places=6).select("team_a", "team_b", "similarity", "advantage", "agreement", "confidence", "conflicting", "complementary", "decisive")


@query("key_factors", HIST + f", l AS ({_LONG}), k AS (SELECT *, row_number() OVER (PARTITION BY team_a, team_b ORDER BY abs(a - b) DESC, dimension) AS r FROM l WHERE abs(a - b) >= 8) SELECT team_a, team_b, dimension AS factor, abs(a - b) AS impact, CASE WHEN a > b THEN 'A' ELSE 'B' END AS leader FROM k WHERE r <= 4")
def q_factors(spark, sf_dir):
    return P.key_factors(P.team_profile(_agg(spark, sf_dir)), _pairs(spark, sf_dir))


@query("compare_dimensions", HIST + f", l AS ({_LONG}) SELECT *, abs(a - b) AS magnitude, CASE WHEN abs(a - b) < 3 THEN 'none' WHEN abs(a - b) < 8 THEN 'slight' WHEN abs(a - b) < 16 THEN 'moderate' ELSE 'strong' END AS tier, CASE WHEN abs(a - b) < 3 THEN 'even' WHEN a > b THEN 'A' ELSE 'B' END AS advantage FROM l")
def q_compare(spark, sf_dir):
    return P.compare(P.team_profile(_agg(spark, sf_dir)), _pairs(spark, sf_dir))


@query("compare_legs", HIST + """, j AS (SELECT team_a, team_b, a.name, 100 * a.rate AS ra, 100 * b.rate AS rb, round(100 * a.rate - 100 * b.rate, 6) AS gap FROM pairs JOIN per a ON a.team = team_a JOIN per b ON b.team = team_b AND b.name = a.name)
SELECT team_a, team_b, count(*) AS shared, count(*) FILTER (WHERE gap >= 5) AS favour_a, count(*) FILTER (WHERE gap <= -5) AS favour_b, count(*) FILTER (WHERE abs(gap) < 5) AS close,
  arg_min(name, (-abs(gap), name)) AS largest_gap, arg_min(name, (abs(gap), name)) AS most_even FROM j GROUP BY 1, 2""")
def q_legs(spark, sf_dir):
    return P.compare_legs(_history(spark, sf_dir), _pairs(spark, sf_dir)).drop("avg_a", "avg_b")


@query("profile_rankings", HIST + """, dp AS (SELECT team, 100 * avg(rate) AS depth FROM per GROUP BY 1),
t AS (SELECT prof.team, r_name AS region, round(100 * coalesce(win_rate, 0.5), 9) AS rating, coalesce(depth, 0) AS depth, floor(round(0.35 * 100 * coalesce(win_rate, 0.5) + 0.25 * 100 * coalesce(form10, 0.5) + 0.2 * coalesce(depth, 0) + 0.15 * adaptability + 0.05 * clutch, 9) * 100 + 0.5) / 100 AS score
  FROM prof JOIN agg USING (team) LEFT JOIN dp USING (team) JOIN supplier ON s_suppkey = prof.team JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT team, region, score, row_number() OVER (ORDER BY score DESC, rating DESC, team) AS rank, row_number() OVER (PARTITION BY region ORDER BY score DESC, rating DESC, team) AS region_rank,
  (SELECT arg_min(name, (-round(rate, 9), name)) FROM per WHERE per.team = t.team) AS strongest, (SELECT arg_min(name, (round(rate, 9), name)) FROM per WHERE per.team = t.team) AS weakest, round(depth, 6) AS depth FROM t""")
def q_prank(spark, sf_dir):
    a = _agg(spark, sf_dir)
    return P.profile_rankings(a, P.team_profile(a), _regions(spark, sf_dir))


#: A rating without history of its own, so that plain SQL has the same one: the win rate on the rating's scale. The queries
#: power_state_elo and power_rankings_elo take the real one.
_WINDOW = "1993-01-01"
_RATES_SQL = f""", opr AS (SELECT s.contest_id, s.side, CASE WHEN count(p.contest_id) = 0 THEN 0.5 ELSE count(p.contest_id) FILTER (WHERE p.won) * 1.0::DOUBLE / count(p.contest_id) END AS r {_PRIOR} GROUP BY 1, 2),
so AS (SELECT s.contest_id, s.side, s.team, s.ts, r AS opp_rate FROM s JOIN opr ON opr.contest_id = s.contest_id AND opr.side <> s.side),
orank AS (SELECT s.contest_id, s.side, p.opp_rate, row_number() OVER (PARTITION BY s.contest_id, s.side ORDER BY p.ts DESC, p.contest_id DESC) AS r FROM s LEFT JOIN so p ON p.team = s.team AND p.ts < s.ts),
opp AS (SELECT contest_id, side, coalesce(avg(opp_rate) FILTER (WHERE r <= 10), 0.5) AS avg_opp_rate_last10 FROM orank GROUP BY 1, 2),
lnb AS (SELECT s.contest_id, s.side, count(DISTINCT p.name) AS leg_breadth FROM s LEFT JOIN ls p ON p.team = s.team AND p.ts < s.ts AND p.recognized GROUP BY 1, 2),
arw AS (SELECT s.contest_id, s.side, CASE WHEN coalesce(sum(p.legs_played), 0) = 0 THEN 0 ELSE sum(p.rounds_won) / sum(p.legs_played)::DOUBLE END AS avg_rounds_won {_PRIOR} GROUP BY 1, 2),
brd AS (SELECT * FROM lnb JOIN arw USING (contest_id, side))"""
_STATE = SQL + _FORM + _RATES_SQL + f""", rec AS (SELECT s.contest_id, s.side, s.team, s.ts, s.level, s.family, {_RECORD} {_PRIOR} GROUP BY 1, 2, 3, 4, 5, 6),
z AS (SELECT rec.*, form.* EXCLUDE (contest_id, side, team), leg_breadth, avg_rounds_won, avg_opp_rate_last10, row_number() OVER (PARTITION BY rec.team ORDER BY rec.ts DESC, rec.contest_id DESC) AS rn
  FROM rec JOIN form USING (contest_id, side, team) JOIN opp USING (contest_id, side) JOIN brd USING (contest_id, side) WHERE rec.ts >= TIMESTAMP '{_WINDOW}'),
l AS (SELECT *, 1500 + 400 * (win_rate - 0.5) AS elo, 1500 + 400 * (avg_opp_rate_last10 - 0.5) AS oelo FROM z WHERE rn = 1),
st AS (SELECT l.team, n AS contests, elo, 100 * CASE WHEN last10_contests > 0 THEN last10_win_rate ELSE win_rate END AS form,
  (least(100, leg_breadth / 5.0::DOUBLE * 100) + 100 * last10_leg_win_rate + least(100, avg_rounds_won / 50.0::DOUBLE * 100)) / 3 AS depth, 100 - 100 * abs(last10_win_rate - win_rate) AS consistency, greatest(0, least(100, 50 + (oelo - 1500) / 400.0::DOUBLE * 50)) AS opponents, 100 * w AS tier
  FROM l JOIN (SELECT team, count(*) AS n, avg(CASE WHEN family = 'MACHINERY' THEN 1.0::DOUBLE WHEN level = 'international' THEN 0.6 WHEN level = 'league' THEN 0.3 ELSE 0.1 END) AS w FROM z GROUP BY 1) USING (team))"""


def _sides_in_window(spark, sf_dir, real: bool):
    """What power_state() reads, from the window's start on; the rating is the real one or the win rate on its scale."""
    c = accepted(contests(spark, sf_dir))
    c = stored(c.withColumns({n: F.array().cast("array<bigint>") for n in ("roster_a", "roster_b")}), "contests")  # no state reads rosters
    r = X.record(X.sides(c))
    s = X.rounds(X.leg_pool(X.recent_form(r))).drop("legs", "roster")
    if real:
        s = s.join(R.opponent_strength(r, R.elo(c)).select("contest_id", "side", "elo", "avg_opp_elo_last10"), ["contest_id", "side"])
    else:
        a = F.col("side") == "A"
        met = r.groupBy("contest_id").agg(F.max(F.when(a, F.col("win_rate"))).alias("_rate_a"), F.max(F.when(~a, F.col("win_rate"))).alias("_rate_b"))
        opp = r.select("contest_id", "side", "team", "ts_ms").join(met, "contest_id").withColumn("opp_rate", F.when(a, F.col("_rate_b")).otherwise(F.col("_rate_a")))
        opp = with_last_rows(opp, {"r10": (F.avg("opp_rate"), 10)}, ["team"], ["contest_id", "side"])
        scale = lambda rate: 1500 + 400 * (rate - 0.5)
        s = s.join(opp.select("contest_id", "side", "r10"), ["contest_id", "side"])
        s = s.withColumns({"elo": scale(F.col("win_rate")), "avg_opp_elo_last10": scale(F.coalesce("r10", F.lit(0.5)))})
    flags = {"is_major": F.col("family") == "MACHINERY", "is_international": F.col("level") == "international", "is_league": F.col("level") == "league"}
    return s.where(F.col("ts") >= F.lit(_WINDOW).cast("timestamp_ntz")).withColumns(flags)


_PARTS = ["elo", "form", "depth", "consistency", "opponents", "tier"]


@query("power_state", _STATE + " SELECT team, contests, " + ", ".join(f"round({k}, 6) AS {k}" for k in _PARTS) + " FROM st")
def q_state(spark, sf_dir):
    return _r(P.power_state(_sides_in_window(spark, sf_dir, False), 5, 50.0), *_PARTS, places=6)


@query("power_state_elo")
def q_state_elo(spark, sf_dir):
    return _r(P.power_state(_sides_in_window(spark, sf_dir, True), 5, 50.0), *_PARTS, places=6)


def _verified(spark, sf_dir):
    return _regions(spark, sf_dir).withColumn("verified", F.col("team") % 4 != 0)


_TERMS = ["base", "form", "opponents", "depth", "tier", "consistency"]
_RANKS = _STATE + f""", m AS (SELECT {", ".join(f"coalesce(avg({k}), 50) AS m_{k}" for k in _TERMS[1:])} FROM st),
w AS (SELECT s_suppkey AS team, r_name AS region, s_suppkey % 4 <> 0 AS verified, least(contests / 10.0::DOUBLE, 1.0) AS w, st.* EXCLUDE (team), m.* FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN st ON st.team = s_suppkey CROSS JOIN m),
q AS (SELECT *, floor(round(0.35 * greatest(0, least(100, 50 + (elo - 1500) / 400.0::DOUBLE * 50)), 9) * 100 + 0.5) / 100 AS t_base, {", ".join(f"floor(round({v} * (m_{k} + ({k} - m_{k}) * w), 9) * 100 + 0.5) / 100 AS t_{k}" for k, v in {"form": 0.25, "opponents": 0.15, "depth": 0.1, "tier": 0.1, "consistency": 0.05}.items())},
  -(floor(round(15 * greatest(0, 1 - contests / 10.0::DOUBLE), 9) * 100 + 0.5) / 100) AS t_penalty FROM w),
p AS (SELECT *, CASE WHEN contests IS NULL THEN 0 ELSE floor(round(t_base + t_form + t_opponents + t_depth + t_tier + t_consistency + t_penalty, 9) * 100 + 0.5) / 100 END AS score, coalesce(t_base, 0) AS b FROM q)
SELECT team, region, score, row_number() OVER (ORDER BY score DESC, b DESC, team) AS rank, row_number() OVER (PARTITION BY region ORDER BY score DESC, b DESC, team) AS region_rank, CASE WHEN contests IS NULL THEN 'unrated' WHEN verified AND contests >= 10 THEN 'verified' ELSE 'provisional' END AS confidence, coalesce(contests, 0) AS contests, {", ".join(f"t_{k}" for k in [*_TERMS, "penalty"])} FROM p"""


@query("power_rankings", _RANKS)
def q_power(spark, sf_dir):
    return P.power_rankings(_verified(spark, sf_dir), P.power_state(_sides_in_window(spark, sf_dir, False), 5, 50.0))


@query("power_rankings_elo")
def q_power_elo(spark, sf_dir):
    """With the real rating and strength of opponents."""
    return P.power_rankings(_verified(spark, sf_dir), P.power_state(_sides_in_window(spark, sf_dir, True), 5, 50.0))


@query("historical_catalog", SQL + "SELECT contest_id, ts, side_a, side_b, family, (SELECT count(*) FROM acc WHERE family = 'BUILDING') AS total FROM acc WHERE family = 'BUILDING' ORDER BY ts DESC, contest_id LIMIT 50")
def q_catalog(spark, sf_dir):
    return P.catalog(accepted(contests(spark, sf_dir)), family="BUILDING").select("contest_id", "ts", "side_a", "side_b", "family", "total")


@query("catalog_between", SQL + "SELECT contest_id, ts, side_a, side_b, family, (SELECT count(*) FROM acc WHERE (side_a = 3 OR side_b = 3) AND ts >= TIMESTAMP '1993-06-01' AND ts <= TIMESTAMP '1996-06-01') AS total FROM acc WHERE (side_a = 3 OR side_b = 3) AND ts >= TIMESTAMP '1993-06-01' AND ts <= TIMESTAMP '1996-06-01' ORDER BY ts DESC, contest_id LIMIT 200")
def q_catalog_between(spark, sf_dir):
    """Contests of one team on either side within bounds that count; the limit asked for is above the largest one."""
    return P.catalog(accepted(contests(spark, sf_dir)), team=3, after="1993-06-01 00:00:00", before="1996-06-01 00:00:00", limit=10_000).select("contest_id", "ts", "side_a", "side_b", "family", "total")


@query("ranked_legs", HIST + """, j AS (SELECT team_a, team_b, a.name, 100 * a.rate AS rate_a, 100 * b.rate AS rate_b FROM pairs JOIN per a ON a.team = team_a JOIN per b ON b.team = team_b AND b.name = a.name),
m AS (SELECT * FROM (VALUES ('largest-gap'), ('closest'), ('name'), ('a-strength'), ('b-strength')) t(mode)),
k AS (SELECT *, round(abs(rate_a - rate_b), 1) AS magnitude FROM j),
r AS (SELECT mode, k.*, row_number() OVER (PARTITION BY mode, team_a, team_b ORDER BY CASE mode WHEN 'largest-gap' THEN -magnitude WHEN 'closest' THEN magnitude WHEN 'a-strength' THEN -rate_a WHEN 'b-strength' THEN -rate_b ELSE 0 END, name) AS place FROM k, m)
SELECT mode, team_a, team_b, name, place, name IN ('LARGE', 'SMALL') AS selected, CASE WHEN max(name = 'PROMO') OVER (PARTITION BY mode, team_a, team_b) THEN name = 'PROMO' ELSE place = 1 END AS active FROM r""")
def q_ranked_legs(spark, sf_dir):
    """All five orders of the legs that both teams of a pair have played."""
    per = _history(spark, sf_dir).groupBy("team", "name").agg((100 * F.avg(F.col("won").cast("double"))).alias("rate"))
    side = lambda s: per.select(F.col("team").alias(f"team_{s}"), "name", F.col("rate").alias(f"rate_{s}"))
    legs = _pairs(spark, sf_dir).join(side("a"), "team_a").join(side("b"), ["team_b", "name"])
    out = None
    for mode in P.LEG_ORDERS:
        r = P.rank_legs(legs, ["LARGE", "SMALL"], mode, "PROMO").select(F.lit(mode).alias("mode"), "team_a", "team_b", "name", "place", "selected", "active")
        out = r if out is None else out.unionByName(r)
    return out


@query("leg_ranking", HIST + "SELECT team, name, n, round(rate, 8) AS rate, row_number() OVER (PARTITION BY team ORDER BY rate DESC, name) AS place FROM per")
def q_leg_rank(spark, sf_dir):
    from pyspark.sql import Window

    per = _history(spark, sf_dir).groupBy("team", "name").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("won").cast("double")).alias("rate"))
    return _r(per.withColumn("place", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("rate"), "name"))), "rate")


@query("history_validation", HIST + """, v AS (SELECT leg_id, team, list_filter([CASE WHEN name IS NULL OR name NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD') THEN 'unknown-leg' END, CASE WHEN ts > TIMESTAMP '1998-01-01' THEN 'future' END, CASE WHEN rounds < 13 OR rounds > 80 THEN 'round-count' END], lambda x: x IS NOT NULL) AS reasons FROM h)
SELECT leg_id, team, array_to_string(reasons, ',') AS reasons FROM v""")
def q_hist_valid(spark, sf_dir):
    v = P.validate_history(_history(spark, sf_dir), _teams(spark, sf_dir), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"], 883_612_800_000)
    return v.select("leg_id", "team", F.array_join("reasons", ",").alias("reasons"))
