"""Queries of the pre-contest feature engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.operators import features as X
from agonix.sources.contests import SQL, contests

from .base import query

_ID = ["contest_id", "side", "team"]
_PRIOR = "FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts"


def _days(n: int) -> str:
    return f"p.ts >= s.ts - INTERVAL {n} DAY"


@query("contests", SQL + "SELECT contest_id, ts, side_a, side_b, score_a, score_b, winner, event_id, event_name, family, region, stage, level, series_format FROM c")
def q_contests(spark, sf_dir):
    return contests(spark, sf_dir).drop("ts_ms", "legs", "roster_a", "roster_b")


@query("contest_legs", SQL + "SELECT contest_id, leg, name, recognized, qa AS score_a, qb AS score_b, CASE WHEN sp THEN floor(qa / 2) END AS attack_a, CASE WHEN sp THEN qb - floor(qb / 2) END AS defense_b FROM legs")
def q_legs(spark, sf_dir):
    legs = contests(spark, sf_dir).select("contest_id", F.explode("legs").alias("x"))
    return legs.select("contest_id", F.col("x.leg").cast("long").alias("leg"), "x.name", "x.recognized", "x.score_a", "x.score_b", F.col("x.attack_a").cast("double").alias("attack_a"), "x.defense_b")


@query("labels", SQL + """
, t AS (SELECT contest_id, count(*) AS n, count(*) FILTER (WHERE qa > qb) AS wa FROM legs GROUP BY 1)
SELECT c.contest_id, CASE WHEN winner = side_a THEN 1 WHEN winner = side_b THEN 0 END AS a_won, winner, coalesce(wa, 0) || '-' || (coalesce(n, 0) - coalesce(wa, 0)) AS leg_score, coalesce(n, 0) AS legs_played,
       CASE WHEN winner IS NULL THEN 'no-winner' END AS rejected
FROM c LEFT JOIN t USING (contest_id)""")
def q_labels(spark, sf_dir):
    c = contests(spark, sf_dir)
    wins = F.size(F.filter("legs", lambda x: x["score_a"] > x["score_b"]))
    return c.select(
        "contest_id", F.when(F.col("winner") == F.col("side_a"), 1).when(F.col("winner") == F.col("side_b"), 0).alias("a_won"), "winner",
        F.concat_ws("-", wins.cast("string"), (F.size("legs") - wins).cast("string")).alias("leg_score"), F.size("legs").cast("long").alias("legs_played"), F.when(F.col("winner").isNull(), "no-winner").alias("rejected"),
    )


_RECORD = """count(p.contest_id) AS prior_contests, count(p.contest_id) FILTER (WHERE p.won) AS prior_wins, count(p.contest_id) FILTER (WHERE NOT p.won) AS prior_losses,
  CASE WHEN count(p.contest_id) = 0 THEN 0.5 ELSE count(p.contest_id) FILTER (WHERE p.won) * 1.0::DOUBLE / count(p.contest_id) END AS win_rate,
  CAST(coalesce(sum(p.legs_played), 0) AS BIGINT) AS prior_legs, CAST(coalesce(sum(p.legs_won), 0) AS BIGINT) AS prior_leg_wins, CAST(coalesce(sum(p.legs_played - p.legs_won), 0) AS BIGINT) AS prior_leg_losses,
  CASE WHEN coalesce(sum(p.legs_played), 0) = 0 THEN 0.5 ELSE CAST(sum(p.legs_won) AS DOUBLE) / CAST(sum(p.legs_played) AS DOUBLE) END AS leg_win_rate, count(p.contest_id) = 0 AS is_cold_start"""


@query("prior_record", SQL + f"SELECT s.contest_id, s.side, s.team, {_RECORD} {_PRIOR} GROUP BY 1, 2, 3")
def q_record(spark, sf_dir):
    return X.record(X.sides(contests(spark, sf_dir))).select(*_ID, "prior_contests", "prior_wins", "prior_losses", "win_rate", "prior_legs", "prior_leg_wins", "prior_leg_losses", "leg_win_rate", "is_cold_start")


_FORM = """, ranked_prior AS (
  SELECT s.contest_id, s.side, s.team, p.won, p.legs_won, p.legs_played, row_number() OVER (PARTITION BY s.contest_id, s.side ORDER BY p.ts DESC, p.contest_id DESC) AS r, p.contest_id AS pid
  FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts
), f AS (
  SELECT contest_id, side, team,
    """ + ",\n    ".join(f"count(pid) FILTER (WHERE r <= {n}) AS n{n}, count(pid) FILTER (WHERE r <= {n} AND won) AS w{n}" for n in (3, 5, 10)) + """,
    coalesce(sum(legs_won) FILTER (WHERE r <= 10), 0) AS lw, coalesce(sum(legs_played) FILTER (WHERE r <= 10), 0) AS lp
  FROM ranked_prior GROUP BY 1, 2, 3
), form AS (
  SELECT contest_id, side, team, n3 AS last3_contests, n5 AS last5_contests, n10 AS last10_contests,
    """ + ",\n    ".join(f"CASE WHEN n{n} = 0 THEN 0.5 ELSE w{n}::DOUBLE / n{n}::DOUBLE END AS last{n}_win_rate" for n in (3, 5, 10)) + """,
    CASE WHEN lp = 0 THEN 0.5 ELSE lw::DOUBLE / lp::DOUBLE END AS last10_leg_win_rate,
    CASE WHEN n10 = 0 THEN 0 ELSE lw::DOUBLE / n10::DOUBLE END AS last10_avg_legs_won, CASE WHEN n10 = 0 THEN 0 ELSE (lp - lw)::DOUBLE / n10::DOUBLE END AS last10_avg_legs_lost
  FROM f
)"""


@query("recent_form", SQL + _FORM + " SELECT *, last5_win_rate - last10_win_rate AS form_trend FROM form")
def q_form(spark, sf_dir):
    s = X.recent_form(X.sides(contests(spark, sf_dir)))
    return s.select(*_ID, *[f"last{n}_{k}" for n in (3, 5, 10) for k in ("contests", "win_rate")], "last10_leg_win_rate", "last10_avg_legs_won", "last10_avg_legs_lost", "form_trend")


_DAYFORM = ", ".join(f"count(p.contest_id) FILTER (WHERE {_days(n)}) AS last{n}d_contests, CASE WHEN count(p.contest_id) FILTER (WHERE {_days(n)}) = 0 THEN 0.5 ELSE (count(p.contest_id) FILTER (WHERE {_days(n)} AND p.won))::DOUBLE / (count(p.contest_id) FILTER (WHERE {_days(n)}))::DOUBLE END AS last{n}d_win_rate" for n in (30, 60))


@query("day_form", SQL + f"SELECT s.contest_id, s.side, s.team, {_DAYFORM} {_PRIOR} GROUP BY 1, 2, 3")
def q_day_form(spark, sf_dir):
    return X.day_form(X.sides(contests(spark, sf_dir))).select(*_ID, "last30d_contests", "last30d_win_rate", "last60d_contests", "last60d_win_rate")


_REST = """epoch_ms(s.ts) - epoch_ms(max(p.ts)) AS gap, count(p.contest_id) FILTER (WHERE CAST(p.ts AS DATE) = CAST(s.ts AS DATE)) AS same_day_before, """ + ", ".join(f"count(p.contest_id) FILTER (WHERE {_days(n)}) AS contests_last{n}d, CAST(coalesce(sum(p.legs_played) FILTER (WHERE {_days(n)}), 0) AS BIGINT) AS legs_last{n}d" for n in (7, 14, 30))
_REST_OUT = "gap / 86400000.0::DOUBLE AS days_since_last, gap / 3600000.0::DOUBLE AS hours_since_last, gap IS NOT NULL AS has_prior, coalesce(gap < 86400000, false) AS is_back_to_back, coalesce(gap > 30 * 86400000::BIGINT, false) AS inactivity"


@query("rest_congestion", SQL + f", r AS (SELECT s.contest_id, s.side, s.team, s.ts, {_REST} {_PRIOR} GROUP BY 1, 2, 3, 4) SELECT * EXCLUDE (gap, ts), {_REST_OUT} FROM r")
def q_rest(spark, sf_dir):
    s = X.rest(X.sides(contests(spark, sf_dir)))
    return s.select(*_ID, "days_since_last", "hours_since_last", "has_prior", "is_back_to_back", "inactivity", "same_day_before", *[f"{k}_last{d}d" for d in (7, 14, 30) for k in ("contests", "legs")])


@query("leg_pool", SQL + """
, n AS (SELECT s.contest_id, s.side, s.team, p.name, count(p.name) AS n FROM s LEFT JOIN ls p ON p.team = s.team AND p.ts < s.ts AND p.recognized GROUP BY 1, 2, 3, 4),
u AS (SELECT s.contest_id, s.side, CAST(coalesce(sum(p.unknown_legs), 0) AS BIGINT) AS unknown_leg_count FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY contest_id, side) AS total FROM n)
SELECT t.contest_id, t.side, t.team, count(*) FILTER (WHERE n > 0) AS leg_breadth, CASE WHEN max(total) = 0 THEN 0 ELSE max(n)::DOUBLE / max(total)::DOUBLE END AS top_leg_share,
  round(CASE WHEN count(*) FILTER (WHERE n > 0) > 1 THEN -sum((n::DOUBLE / total) * log2(n::DOUBLE / total)) FILTER (WHERE n > 0) / log2(count(*) FILTER (WHERE n > 0)) ELSE 0 END, 9) AS leg_entropy,
  any_value(unknown_leg_count) AS unknown_leg_count
FROM t JOIN u ON u.contest_id = t.contest_id AND u.side = t.side GROUP BY 1, 2, 3""")
def q_pool(spark, sf_dir):
    s = X.leg_pool(X.sides(contests(spark, sf_dir)))
    return s.select(*_ID, "leg_breadth", "top_leg_share", F.round("leg_entropy", 9).alias("leg_entropy"), "unknown_leg_count")


@query("leg_pool_overlap", SQL + """
, k AS (SELECT DISTINCT s.contest_id, s.side, p.name FROM s JOIN ls p ON p.team = s.team AND p.ts < s.ts AND p.recognized)
SELECT acc.contest_id, count(b.name) AS pool_overlap FROM acc LEFT JOIN k a ON a.contest_id = acc.contest_id AND a.side = 'A' LEFT JOIN k b ON b.contest_id = a.contest_id AND b.side = 'B' AND b.name = a.name GROUP BY 1""")
def q_overlap(spark, sf_dir):
    s = X.leg_pool(X.sides(contests(spark, sf_dir)))
    both = s.groupBy("contest_id").agg(F.max(F.when(F.col("side") == "A", F.col("legs_known"))).alias("a"), F.max(F.when(F.col("side") == "B", F.col("legs_known"))).alias("b"))
    return both.select("contest_id", F.size(F.array_intersect("a", "b")).cast("long").alias("pool_overlap"))


@query("rounds_splits", SQL + """
, x AS (SELECT contest_id, side, sum(floor(own / 2)) FILTER (WHERE sp) AS aw, sum(floor(own / 2) + other - floor(other / 2)) FILTER (WHERE sp) AS ap,
  sum(own - floor(own / 2)) FILTER (WHERE sp) AS dw, sum(own - floor(own / 2) + floor(other / 2)) FILTER (WHERE sp) AS dp FROM ls GROUP BY 1, 2),
y AS (SELECT s.*, coalesce(aw, 0) AS aw, coalesce(ap, 0) AS ap, coalesce(dw, 0) AS dw, coalesce(dp, 0) AS dp FROM s LEFT JOIN x USING (contest_id, side))
SELECT s.contest_id, s.side, s.team, CASE WHEN coalesce(sum(p.legs_played), 0) = 0 THEN 0 ELSE sum(p.rounds_won) / sum(p.legs_played)::DOUBLE END AS avg_rounds_won,
  CASE WHEN coalesce(sum(p.legs_played), 0) = 0 THEN 0 ELSE sum(p.rounds_lost) / sum(p.legs_played)::DOUBLE END AS avg_rounds_lost, coalesce(sum(p.ap), 0) > 0 OR coalesce(sum(p.dp), 0) > 0 AS has_split,
  CASE WHEN coalesce(sum(p.ap), 0) = 0 THEN 0.5 ELSE sum(p.aw) / sum(p.ap) END AS attack_rate, CASE WHEN coalesce(sum(p.dp), 0) = 0 THEN 0.5 ELSE sum(p.dw) / sum(p.dp) END AS defense_rate
FROM y s LEFT JOIN y p ON p.team = s.team AND p.ts < s.ts GROUP BY 1, 2, 3""")
def q_rounds(spark, sf_dir):
    return X.rounds(X.sides(contests(spark, sf_dir))).select(*_ID, "avg_rounds_won", "avg_rounds_lost", "has_split", "attack_rate", "defense_rate")


@query("event_congestion", SQL + "SELECT a.contest_id, a.event_id, count(p.contest_id) AS event_contests_last3d FROM acc a LEFT JOIN acc p ON p.event_id = a.event_id AND p.ts < a.ts AND p.ts >= a.ts - INTERVAL 3 DAY GROUP BY 1, 2")
def q_congestion(spark, sf_dir):
    return X.event_congestion(contests(spark, sf_dir)).select("contest_id", "event_id", "event_contests_last3d")


_H2H = """
, t AS (SELECT contest_id, 2 * count(*) FILTER (WHERE qa > qb) - count(*) AS d FROM legs GROUP BY 1),
a AS (SELECT acc.*, coalesce(d, 0) AS d, least(side_a, side_b) AS lo, greatest(side_a, side_b) AS hi FROM acc LEFT JOIN t USING (contest_id)),
h AS (SELECT a.contest_id, count(p.contest_id) AS h2h_meetings, count(p.contest_id) FILTER (WHERE p.winner = a.side_a) AS h2h_wins_a, count(p.contest_id) FILTER (WHERE p.winner = a.side_b) AS h2h_wins_b,
  CAST(coalesce(sum(CASE WHEN p.side_a = a.side_a THEN p.d ELSE -p.d END), 0) AS BIGINT) AS h2h_leg_diff,
  count(p.contest_id) FILTER (WHERE p.ts >= a.ts - INTERVAL 90 DAY) AS h2h_last90d, count(p.contest_id) FILTER (WHERE p.ts >= a.ts - INTERVAL 180 DAY) AS h2h_last180d, count(p.contest_id) FILTER (WHERE p.ts >= a.ts - INTERVAL 365 DAY) AS h2h_last365d,
  coalesce(CAST(arg_max(p.winner, (p.ts, p.contest_id)) AS VARCHAR), 'unknown') AS h2h_last_winner,
  count(p.contest_id) FILTER (WHERE p.family = a.family) AS h2h_same_family, count(p.contest_id) FILTER (WHERE p.region = a.region) AS h2h_same_region
  FROM a LEFT JOIN a p ON p.lo = a.lo AND p.hi = a.hi AND p.ts < a.ts GROUP BY 1),
h2h AS (SELECT *, CASE WHEN h2h_meetings = 0 THEN 0.5 ELSE h2h_wins_a::DOUBLE / h2h_meetings::DOUBLE END AS h2h_rate_a FROM h)"""


@query("head_to_head", SQL + _H2H + " SELECT * FROM h2h")
def q_h2h(spark, sf_dir):
    return X.head_to_head(contests(spark, sf_dir)).select("contest_id", *X.H2H_FEATURES)


_ROSTER = """
, pl AS (SELECT DISTINCT s.contest_id, s.side, s.team, s.ts, s.won, s.level, s.family, l_partkey AS player FROM s JOIN sl ON sl.l_orderkey = s.contest_id AND sl.l_suppkey = s.team)"""


@query("roster_continuity", SQL + _ROSTER + """
, ro AS (SELECT contest_id, side, team, ts, list_sort(list(player)) AS roster FROM pl GROUP BY 1, 2, 3, 4),
pr AS (SELECT a.contest_id, a.side, a.team, a.roster, a.ts, p.roster AS pro, p.ts AS pts, row_number() OVER (PARTITION BY a.contest_id, a.side ORDER BY p.ts DESC, p.contest_id DESC) AS r FROM ro a LEFT JOIN ro p ON p.team = a.team AND p.ts < a.ts),
g AS (SELECT contest_id, side, team, any_value(roster) AS roster, any_value(ts) AS ts, any_value(pro) FILTER (WHERE r = 1) AS prev, list_distinct(flatten(list(pro) FILTER (WHERE r <= 3 AND pro IS NOT NULL))) AS recent,
   list_distinct(flatten(list(pro) FILTER (WHERE pro IS NOT NULL))) AS ever, max(pts) FILTER (WHERE pro = roster) AS same_ts FROM pr GROUP BY 1, 2, 3),
pq AS (SELECT a.contest_id, a.side, a.team, a.ts, a.player AS p, b.player AS q FROM pl a JOIN pl b ON a.contest_id = b.contest_id AND a.side = b.side AND a.player < b.player),
sh AS (SELECT contest_id, side, avg(n) AS v FROM (SELECT a.contest_id, a.side, a.p, a.q, count(b.contest_id) AS n FROM pq a LEFT JOIN pq b ON b.team = a.team AND b.p = a.p AND b.q = a.q AND b.ts < a.ts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
SELECT g.contest_id, g.side, g.team, CAST(len(roster) AS BIGINT) AS roster_size,
  CASE WHEN prev IS NULL THEN 0 ELSE len(list_intersect(roster, prev))::DOUBLE / len(list_distinct(list_concat(roster, prev)))::DOUBLE END AS roster_jaccard,
  CASE WHEN recent IS NULL THEN 0 ELSE len(list_intersect(roster, recent))::DOUBLE / len(roster)::DOUBLE END AS roster_last3_overlap,
  (epoch_ms(ts) - epoch_ms(same_ts)) / 86400000.0::DOUBLE AS days_since_same_roster,
  CASE WHEN ever IS NULL THEN 0 ELSE len(list_intersect(roster, ever)) END AS players_seen, coalesce(sh.v, 0) AS shared_prior_avg
FROM g LEFT JOIN sh USING (contest_id, side)""")
def q_roster(spark, sf_dir):
    s = X.roster_continuity(X.sides(contests(spark, sf_dir)))
    return s.select(*_ID, "roster_size", "roster_jaccard", "roster_last3_overlap", "days_since_same_roster", "players_seen", "shared_prior_avg")


@query("player_experience", SQL + _ROSTER + """
, e AS (SELECT a.contest_id, a.side, a.player, count(b.player) AS n, count(b.player) FILTER (WHERE b.won) AS w, count(b.player) FILTER (WHERE b.ts >= a.ts - INTERVAL 30 DAY) AS r,
  count(b.player) FILTER (WHERE b.level = 'international') AS i, count(b.player) FILTER (WHERE b.family = 'MACHINERY') AS m FROM pl a LEFT JOIN pl b ON b.player = a.player AND b.ts < a.ts GROUP BY 1, 2, 3)
SELECT contest_id, side, avg(n) AS avg_appearances, min(n) AS min_appearances, max(n) AS max_appearances, count(*) FILTER (WHERE n = 0) AS debuts, avg(w) AS avg_wins, avg(r) AS avg_appearances_30d,
  CAST(sum(i) AS BIGINT) AS international_appearances, CAST(sum(m) AS BIGINT) AS major_appearances FROM e GROUP BY 1, 2""")
def q_players(spark, sf_dir):
    return X.player_experience(X.sides(contests(spark, sf_dir)))


_SIDE_SQL = f"""
, rec AS (SELECT s.contest_id, s.side, s.team, {_RECORD} {_PRIOR} GROUP BY 1, 2, 3),
dform AS (SELECT s.contest_id, s.side, s.team, {_DAYFORM} {_PRIOR} GROUP BY 1, 2, 3),
r0 AS (SELECT s.contest_id, s.side, s.team, s.ts, {_REST} {_PRIOR} GROUP BY 1, 2, 3, 4), rst AS (SELECT * EXCLUDE (gap, ts), {_REST_OUT} FROM r0),
blk AS (SELECT * EXCLUDE (team), last5_win_rate - last10_win_rate AS form_trend FROM rec JOIN form USING (contest_id, side, team) JOIN dform USING (contest_id, side, team) JOIN rst USING (contest_id, side, team)),
cong AS (SELECT a.contest_id, count(p.contest_id) AS event_contests_last3d FROM acc a LEFT JOIN acc p ON p.event_id = a.event_id AND p.ts < a.ts AND p.ts >= a.ts - INTERVAL 3 DAY GROUP BY 1)"""
_BLOCKS = ", ".join(f"{p}.{n} AS {p}_{n}" for p in ("a", "b") for n in X.SIDE_FEATURES)
_HS = ", ".join(f"h2h.{n}" for n in X.H2H_FEATURES)
FEATURE_SQL = SQL + _FORM + _H2H.replace("\na AS", "\nacc_h AS").replace("FROM a LEFT JOIN a p", "FROM acc_h a LEFT JOIN acc_h p") + _SIDE_SQL + f"""
, features AS (SELECT acc.contest_id, acc.ts, epoch_ms(acc.ts) AS ts_ms, acc.side_a, acc.side_b, acc.winner, acc.event_id, acc.family, acc.region, acc.stage, acc.level, acc.series_format, cong.event_contests_last3d, {_HS}, {_BLOCKS},
  a.days_since_last - b.days_since_last AS rest_difference_days, a.leg_win_rate - b.leg_win_rate AS leg_strength_diff, year(acc.ts) AS season_year, month(acc.ts) AS contest_month, CASE WHEN acc.winner = acc.side_a THEN 1 ELSE 0 END AS a_won
FROM acc JOIN h2h USING (contest_id) JOIN cong USING (contest_id) JOIN blk a ON a.contest_id = acc.contest_id AND a.side = 'A' JOIN blk b ON b.contest_id = acc.contest_id AND b.side = 'B')
"""


@query("pre_contest_features", FEATURE_SQL + "SELECT * FROM features")
def q_features(spark, sf_dir):
    return X.assemble(contests(spark, sf_dir))


@query("pre_contest_features_all")
def q_features_all(spark, sf_dir):
    """The whole table. Ratings have no plain SQL; the tests hold its columns against a replay and the single queries."""
    from agonix.operators.lifecycle import dataset_version

    c = contests(spark, sf_dir)
    source = dataset_version(c.drop("legs", "roster_a", "roster_b"), ["schema-1", "rules-1"], ["ts_ms"])  # one row
    return X.assemble_all(c, source.first()["version"])


@query("leakage_check", SQL + "SELECT s.contest_id, s.side, count(p.contest_id) AS recounted, count(p.contest_id) AS stored, false AS leak FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts GROUP BY 1, 2")
def q_leakage(spark, sf_dir):
    s = X.record(X.sides(contests(spark, sf_dir)))
    from pyspark.sql import Window

    # Counts per (team, timestamp) summed up independently of the feature's own frame.
    per = s.groupBy("team", "ts_ms").agg(F.count(F.lit(1)).alias("n"))
    cum = per.withColumn("recounted", F.coalesce(F.sum("n").over(Window.partitionBy("team").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = s.join(cum.drop("n"), ["team", "ts_ms"])
    return both.select("contest_id", "side", "recounted", F.col("prior_contests").alias("stored"), (F.col("recounted") != F.col("prior_contests")).alias("leak"))


@query("event_context", SQL + """
SELECT contest_id, event_id, event_name, coalesce(region, 'unknown') AS region, coalesce(stage, 'unknown') AS stage, year(ts) AS season_year, month(ts) AS contest_month, level = 'international' AS is_international, level = 'league' AS is_league, family = 'MACHINERY' AS is_major FROM acc""")
def q_event_context(spark, sf_dir):
    from agonix.sources.contests import accepted

    c = accepted(contests(spark, sf_dir))
    return c.select("contest_id", "event_id", "event_name", F.coalesce("region", F.lit("unknown")).alias("region"), F.coalesce("stage", F.lit("unknown")).alias("stage"), F.year("ts").cast("long").alias("season_year"), F.month("ts").cast("long").alias("contest_month"), (F.col("level") == "international").alias("is_international"), (F.col("level") == "league").alias("is_league"), (F.col("family") == "MACHINERY").alias("is_major"))
