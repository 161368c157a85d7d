"""Queries of pairings that aren't scheduled."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.operators import features as X
from agonix.operators.asof import RATED, matchup_asof
from agonix.operators.evidence import contribution, evidence_trust, supporting_factors
from agonix.sources.contests import SQL, accepted, contests, table

from .base import query
from .feature_queries import _DAYFORM, _FORM, _H2H, _RECORD, _REST, _REST_OUT

#: RATED columns have no plain SQL.
_PLAIN = [n for n in [*X.SIDE_FEATURES, *X.MORE_FEATURES] if n not in RATED]


def requests(c):
    """A request from every contest: every second one with its sides swapped, every tenth against a side without history,
    every third ten days later; the others ask at the very moment of the contest."""
    c = accepted(c)
    swapped, unseen = F.col("contest_id") % 2 == 1, F.col("contest_id") % 10 == 0
    b = F.when(unseen, -F.col("side_b")).otherwise(F.col("side_b"))
    return c.select(
        F.col("contest_id").alias("request_id"), (F.col("ts_ms") + F.when(F.col("contest_id") % 3 == 0, 10 * 86_400_000).otherwise(0)).alias("as_of_ms"),
        F.when(swapped, b).otherwise(F.col("side_a")).alias("side_a"), F.when(swapped, F.col("side_a")).otherwise(b).alias("side_b"), "level", "region", "family", "series_format",
    )


_ASOF = "FROM rs s LEFT JOIN s p ON p.team = s.team AND p.ts <= s.ts"
_REQ = """
, rq AS (SELECT contest_id AS request_id, ts + CASE WHEN contest_id % 3 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS ts, CASE WHEN contest_id % 10 = 0 THEN -side_b ELSE side_b END AS b, side_a AS a, contest_id % 2 = 1 AS sw,
    level, CASE WHEN level = 'international' THEN 'unknown' ELSE region END AS region, family, series_format FROM acc),
req AS (SELECT request_id, ts, CASE WHEN sw THEN b ELSE a END AS side_a, CASE WHEN sw THEN a ELSE b END AS side_b, level, region, family, series_format FROM rq),
rs AS (SELECT request_id AS contest_id, ts, 'A' AS side, side_a AS team FROM req UNION ALL SELECT request_id, ts, 'B', side_b FROM req)"""
_RATE = """
, opr AS (SELECT s.contest_id, s.side, CASE WHEN count(p.contest_id) = 0 THEN 0.5 ELSE count(p.contest_id) FILTER (WHERE p.won) * 1.0::DOUBLE / count(p.contest_id) END AS r FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts GROUP BY 1, 2),
so AS (SELECT s.contest_id, s.side, s.team, s.ts, r AS opp_rate FROM s JOIN opr ON opr.contest_id = s.contest_id AND opr.side <> s.side),
orank AS (SELECT s.contest_id, s.side, p.opp_rate, row_number() OVER (PARTITION BY s.contest_id, s.side ORDER BY p.ts DESC, p.contest_id DESC) AS r FROM rs s LEFT JOIN so p ON p.team = s.team AND p.ts <= s.ts),
opp AS (SELECT contest_id, side, round(coalesce(avg(opp_rate) FILTER (WHERE r <= 5), 0.5), 9) AS avg_opp_rate_last5, round(coalesce(avg(opp_rate) FILTER (WHERE r <= 10), 0.5), 9) AS avg_opp_rate_last10 FROM orank GROUP BY 1, 2)"""
_LEGS = """
, ln AS (SELECT s.contest_id, s.side, p.name, count(p.name) AS n FROM rs s LEFT JOIN ls p ON p.team = s.team AND p.ts <= s.ts AND p.recognized GROUP BY 1, 2, 3),
lt AS (SELECT *, sum(n) OVER (PARTITION BY contest_id, side) AS total FROM ln),
pool AS (SELECT contest_id, side, count(*) FILTER (WHERE n > 0) AS leg_breadth, CASE WHEN max(total) = 0 THEN 0 ELSE max(n)::DOUBLE / max(total)::DOUBLE END AS top_leg_share,
  round(CASE WHEN count(*) FILTER (WHERE n > 0) > 1 THEN -sum((n::DOUBLE / total) * log2(n::DOUBLE / total)) FILTER (WHERE n > 0) / log2(count(*) FILTER (WHERE n > 0)) ELSE 0 END, 9) AS leg_entropy FROM lt GROUP BY 1, 2),
lover AS (SELECT a.contest_id, count(b.name) AS pool_overlap FROM ln a LEFT JOIN ln b ON b.contest_id = a.contest_id AND b.side = 'B' AND b.name = a.name WHERE a.side = 'A' GROUP BY 1),
lx AS (SELECT contest_id, side, sum(floor(own / 2)) FILTER (WHERE sp) AS aw, sum(floor(own / 2) + other - floor(other / 2)) FILTER (WHERE sp) AS ap,
  sum(own - floor(own / 2)) FILTER (WHERE sp) AS dw, sum(own - floor(own / 2) + floor(other / 2)) FILTER (WHERE sp) AS dp FROM ls GROUP BY 1, 2),
ly AS (SELECT s.*, coalesce(aw, 0) AS aw, coalesce(ap, 0) AS ap, coalesce(dw, 0) AS dw, coalesce(dp, 0) AS dp FROM s LEFT JOIN lx USING (contest_id, side)),
rnd AS (SELECT s.contest_id, s.side, CAST(coalesce(sum(p.unknown_legs), 0) AS BIGINT) AS unknown_leg_count, CASE WHEN coalesce(sum(p.legs_played), 0) = 0 THEN 0 ELSE sum(p.rounds_won) / sum(p.legs_played)::DOUBLE END AS avg_rounds_won,
  CASE WHEN coalesce(sum(p.legs_played), 0) = 0 THEN 0 ELSE sum(p.rounds_lost) / sum(p.legs_played)::DOUBLE END AS avg_rounds_lost, coalesce(sum(p.ap), 0) > 0 OR coalesce(sum(p.dp), 0) > 0 AS has_split,
  CASE WHEN coalesce(sum(p.ap), 0) = 0 THEN 0.5 ELSE sum(p.aw) / sum(p.ap) END AS attack_rate, CASE WHEN coalesce(sum(p.dp), 0) = 0 THEN 0.5 ELSE sum(p.dw) / sum(p.dp) END AS defense_rate
  FROM rs s LEFT JOIN ly p ON p.team = s.team AND p.ts <= s.ts GROUP BY 1, 2)"""
_ZERO = [n for n in _PLAIN if n.startswith(("roster_", "players_", "shared_", "min_app", "max_app", "debuts", "international_", "major_")) or n in ("avg_appearances", "avg_wins", "avg_appearances_30d")]
_OUT = ", ".join((f"0 AS {p}_{n}" if n in _ZERO else f"NULL::DOUBLE AS {p}_{n}" if n == "days_since_same_roster" else f"{p}.{n} AS {p}_{n}") for p in ("a", "b") for n in _PLAIN)
_PAIR = _H2H.replace("\na AS (SELECT acc.*", "\nhh AS (SELECT acc.*").replace("count(p.contest_id) AS h2h_meetings", "count(p.contest_id) AS h2h_meetings")
_PAIR = _PAIR.replace("FROM a LEFT JOIN a p ON p.lo = a.lo AND p.hi = a.hi AND p.ts < a.ts", "FROM rqp a LEFT JOIN hh p ON p.lo = a.lo AND p.hi = a.hi AND p.ts <= a.ts").replace("\nh AS (", "\nrqp AS (SELECT *, request_id AS contest_id, least(side_a, side_b) AS lo, greatest(side_a, side_b) AS hi FROM req),\nh AS (")
ASOF_SQL = (
    SQL + _REQ + _FORM.replace("FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts", _ASOF) + _PAIR + _RATE + _LEGS + f"""
, rec AS (SELECT s.contest_id, s.side, {_RECORD} {_ASOF} GROUP BY 1, 2),
dform AS (SELECT s.contest_id, s.side, {_DAYFORM} {_ASOF} GROUP BY 1, 2),
r0 AS (SELECT s.contest_id, s.side, s.ts, {_REST} {_ASOF} GROUP BY 1, 2, 3), rst AS (SELECT * EXCLUDE (gap, ts), {_REST_OUT} FROM r0),
blk AS (SELECT * EXCLUDE (team), last5_win_rate - last10_win_rate AS form_trend FROM rec JOIN form USING (contest_id, side) JOIN dform USING (contest_id, side) JOIN rst USING (contest_id, side) JOIN opp USING (contest_id, side) JOIN pool USING (contest_id, side) JOIN rnd USING (contest_id, side))
SELECT req.request_id, epoch_ms(req.ts) AS as_of_ms, req.side_a, req.side_b, level, region, family, series_format, 'unknown' AS stage, 0 AS event_contests_last3d, {", ".join(f"h2h.{n}" for n in X.H2H_FEATURES)}, {_OUT},
  a.days_since_last - b.days_since_last AS rest_difference_days, a.leg_win_rate - b.leg_win_rate AS leg_strength_diff, pool_overlap, year(req.ts) AS season_year, month(req.ts) AS contest_month
FROM req JOIN h2h ON h2h.contest_id = request_id JOIN blk a ON a.contest_id = request_id AND a.side = 'A' JOIN blk b ON b.contest_id = request_id AND b.side = 'B' JOIN lover ON lover.contest_id = request_id"""
)


def _rounded(df):
    return df.withColumns({f"{p}_{n}": F.round(f"{p}_{n}", 9) for p in ("a", "b") for n in ("leg_entropy", "avg_opp_rate_last5", "avg_opp_rate_last10")})


@query("matchup_asof", ASOF_SQL)
def q_asof(spark, sf_dir):
    """All columns but the rating's."""
    c = stored(accepted(contests(spark, sf_dir)), "accepted")
    return _rounded(matchup_asof(c, requests(c), rated=False))


@query("matchup_asof_rating")
def q_asof_rating(spark, sf_dir):
    """The rating's columns; the tests hold them against a replay."""
    c = stored(accepted(contests(spark, sf_dir)), "accepted")
    return matchup_asof(c, requests(c)).select("request_id", *[F.round(n, 6).alias(n) for n in ("elo_diff", "elo_p", *[f"{p}_{n}" for p in ("a", "b") for n in RATED])])


_UNRATED = ["recent-form", "leg-pool-breadth", "activity-rest", "competition-experience"]
_CONF = ASOF_SQL.replace("SELECT req.request_id, epoch_ms", ", m AS (SELECT req.request_id, epoch_ms", 1) + """),
n AS (SELECT team, count(*) AS contests FROM s WHERE ts >= TIMESTAMP '1993-01-01' GROUP BY 1),
k AS (SELECT s_suppkey AS team, coalesce(contests, 0) AS contests, CASE WHEN s_suppkey % 4 = 0 THEN 'provisional' WHEN s_suppkey % 9 = 0 THEN 'unrated' ELSE 'verified' END AS confidence FROM supplier LEFT JOIN n ON n.team = s_suppkey)
"""


def _confidence(spark, sf_dir, c):
    """Contests of each team in the window, and how sure its identity is."""
    n = X.sides(c).where(F.col("ts") >= F.lit("1993-01-01").cast("timestamp_ntz")).groupBy("team").agg(F.count(F.lit(1)).alias("contests"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("team")).join(n, "team", "left")
    return t.select("team", F.coalesce("contests", F.lit(0)).alias("contests"), F.when(F.col("team") % 4 == 0, "provisional").when(F.col("team") % 9 == 0, "unrated").otherwise("verified").alias("confidence"))


@query("matchup_evidence", _CONF + """, z AS (SELECT request_id, h2h_meetings AS meetings, coalesce(a.contests, 0) AS a_contests, coalesce(b.contests, 0) AS b_contests,
  (CASE a.confidence WHEN 'verified' THEN 1 WHEN 'provisional' THEN 0.5 ELSE 0 END + least(1, coalesce(a.contests, 0) / 20.0::DOUBLE)) / 2 AS sa, (CASE b.confidence WHEN 'verified' THEN 1 WHEN 'provisional' THEN 0.5 ELSE 0 END + least(1, coalesce(b.contests, 0) / 20.0::DOUBLE)) / 2 AS sb
  FROM m LEFT JOIN k a ON a.team = side_a LEFT JOIN k b ON b.team = side_b)
SELECT request_id, CAST(floor(round(least(100, ((sa + sb) / 2 + least(1, meetings / 5.0::DOUBLE) * 0.1) * 100), 9) + 0.5) AS BIGINT) AS trust, CASE WHEN least(a_contests, b_contests) >= 10 THEN 'sufficient' WHEN least(a_contests, b_contests) >= 3 THEN 'limited' ELSE 'none' END AS leg_evidence, a_contests, b_contests, meetings FROM z""")
def q_evidence(spark, sf_dir):
    c = stored(accepted(contests(spark, sf_dir)), "accepted")
    return evidence_trust(matchup_asof(c, requests(c), rated=False), _confidence(spark, sf_dir, c))


def _favours(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 'A' WHEN {b} > {a} THEN 'B' ELSE 'even' END"


@query("supporting_factors", _CONF + " UNION ALL ".join(f"SELECT request_id, '{n}' AS factor, {a}::DOUBLE AS a, {b}::DOUBLE AS b, {_favours(a, b)} AS favoured FROM m" for n, a, b in (("recent-form", "a_last10_win_rate", "b_last10_win_rate"), ("leg-pool-breadth", "a_leg_breadth", "b_leg_breadth"), ("competition-experience", "a_international_appearances + a_major_appearances", "b_international_appearances + b_major_appearances")))
    + " UNION ALL SELECT request_id, 'activity-rest', coalesce(a_days_since_last, -1), coalesce(b_days_since_last, -1), CASE WHEN a_days_since_last IS NULL AND b_days_since_last IS NULL THEN 'even' WHEN a_days_since_last IS NULL THEN 'B' WHEN b_days_since_last IS NULL THEN 'A' WHEN a_days_since_last < b_days_since_last THEN 'A' WHEN b_days_since_last < a_days_since_last THEN 'B' ELSE 'even' END FROM m")
def q_factors(spark, sf_dir):
    """The factors that follow from no rating."""
    c = stored(accepted(contests(spark, sf_dir)), "accepted")
    return supporting_factors(matchup_asof(c, requests(c), rated=False), _UNRATED)


@query("driver_decomposition", _CONF + """, p AS (SELECT request_id, 400 * (a_win_rate - b_win_rate) AS d, round(0.5 + (a_win_rate - b_win_rate) / 2, 4) AS p FROM m)
SELECT request_id, 'rating difference' AS driver, round(d, 9) AS differential, round(1 / (1 + pow(10, -d / 400)), 9) AS uncalibrated, round(p - 1 / (1 + pow(10, -d / 400)), 9) AS adjustment, p AS final, true AS sole_driver FROM p""")
def q_driver(spark, sf_dir):
    """With the win rates' difference as rating, which plain SQL has too."""
    c = stored(accepted(contests(spark, sf_dir)), "accepted")
    gap = F.col("a_win_rate") - F.col("b_win_rate")
    f = matchup_asof(c, requests(c), rated=False).select("request_id", (400 * gap).alias("elo_diff"), (1 / (1 + F.pow(F.lit(10.0), -400 * gap / 400))).alias("elo_p"), F.round(0.5 + gap / 2, 4).alias("p"))
    return contribution(f, "elo").withColumns({n: F.round(n, 9) for n in ("differential", "uncalibrated", "adjustment")})
