"""Queries of quality rules, duplicates, quarantine and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.operators import features as X
from agonix.operators import quality as Q
from agonix.sources.contests import SQL, accepted, contests

from .base import query
from .feature_queries import FEATURE_SQL

_START, _END = 725_846_400_000, 852_076_800_000  # 1993-01-01 and 1997-01-01

_ROSTER = """, ro AS (SELECT l_orderkey AS contest_id, list(DISTINCT l_partkey) FILTER (WHERE r = 1) AS a, list(DISTINCT l_partkey) FILTER (WHERE r = 2) AS b FROM sl JOIN c ON c.contest_id = l_orderkey GROUP BY 1),
ri AS (
  SELECT 'player-both-sides' AS code, 'error' AS severity, contest_id, 'rosters' AS field FROM ro WHERE len(list_intersect(a, b)) > 0
  UNION ALL SELECT 'roster-incomplete', 'warning', contest_id, 'roster_a' FROM ro WHERE len(a) < 5 UNION ALL SELECT 'roster-incomplete', 'warning', contest_id, 'roster_b' FROM ro WHERE len(b) < 5
  UNION ALL SELECT 'roster-size', 'info', contest_id, 'roster_a' FROM ro WHERE len(a) NOT BETWEEN 3 AND 6 UNION ALL SELECT 'roster-size', 'info', contest_id, 'roster_b' FROM ro WHERE len(b) NOT BETWEEN 3 AND 6),
rosters AS (SELECT code, severity, 'roster' AS entity_type, CAST(contest_id AS VARCHAR) AS entity_id, field FROM ri)"""
_LEGS = ", legi AS (SELECT 'leg-unrecognised' AS code, 'warning' AS severity, 'match' AS entity_type, CAST(contest_id AS VARCHAR) AS entity_id, 'leg_' || leg AS field FROM legs WHERE NOT recognized)"
_SCORE = """, w AS (SELECT c.contest_id, any_value(winner) AS winner, any_value(side_a) AS sa, any_value(side_b) AS sb, count(*) FILTER (WHERE qa > qb) AS wa, count(*) FILTER (WHERE qb > qa) AS wb, count(*) FILTER (WHERE qa = qb) AS ti FROM c JOIN legs USING (contest_id) GROUP BY 1),
sc0 AS (SELECT 'tied-leg' AS code, 'warning' AS severity, contest_id, 'legs' AS field FROM w WHERE ti > 0 UNION ALL SELECT 'no-winner', 'error', contest_id, 'winner' FROM c WHERE winner IS NULL
  UNION ALL SELECT 'winner-behind-on-legs', 'warning', contest_id, 'winner' FROM w WHERE (winner = sa AND wa < wb) OR (winner = sb AND wb < wa)),
scores AS (SELECT code, severity, 'match' AS entity_type, CAST(contest_id AS VARCHAR) AS entity_id, field FROM sc0)"""
_TIME = ", times AS (SELECT 'out-of-scope' AS code, 'warning' AS severity, 'match' AS entity_type, CAST(contest_id AS VARCHAR) AS entity_id, 'ts' AS field FROM c WHERE ts < TIMESTAMP '1993-01-01' OR ts > TIMESTAMP '1997-01-01')"
_DUP = """, sq AS (SELECT c.contest_id, ts, event_id, series_format, least(side_a, side_b) AS lo, greatest(side_a, side_b) AS hi, string_agg(name, '|' ORDER BY leg) AS seq FROM c JOIN legs USING (contest_id) GROUP BY ALL),
dup AS (SELECT a.contest_id AS id_a, b.contest_id AS id_b, CASE WHEN a.event_id = b.event_id THEN 'high' ELSE 'low' END AS confidence FROM sq a JOIN sq b ON a.lo = b.lo AND a.hi = b.hi AND a.seq = b.seq AND a.series_format = b.series_format AND a.contest_id < b.contest_id AND abs(epoch_ms(a.ts) - epoch_ms(b.ts)) <= 86400000)"""
_ALL = SQL + _ROSTER + _LEGS + _SCORE + _TIME + _DUP + """, issues AS (SELECT * FROM rosters UNION ALL SELECT * FROM legi UNION ALL SELECT * FROM scores UNION ALL SELECT * FROM times
  UNION ALL SELECT 'duplicate-candidate', CASE WHEN confidence = 'high' THEN 'warning' ELSE 'info' END, 'match', CAST(id_a AS VARCHAR), 'contest_id' FROM dup)"""


@query("roster_issues", SQL + _ROSTER + " SELECT * FROM rosters")
def q_roster(spark, sf_dir):
    return Q.roster_issues(contests(spark, sf_dir))


@query("leg_issues", SQL + _LEGS + " SELECT * FROM legi")
def q_leg(spark, sf_dir):
    return Q.leg_issues(contests(spark, sf_dir))


@query("score_issues", SQL + _SCORE + " SELECT * FROM scores")
def q_score(spark, sf_dir):
    return Q.score_issues(contests(spark, sf_dir))


@query("timestamp_issues", SQL + _TIME + """, sp AS (SELECT event_id, min(ts) + INTERVAL 30 DAY AS lo, max(ts) - INTERVAL 30 DAY AS hi FROM c GROUP BY 1)
SELECT * FROM times UNION ALL SELECT 'outside-event', 'warning', 'match', CAST(contest_id AS VARCHAR), 'ts' FROM c JOIN sp USING (event_id) WHERE ts < lo OR ts > hi""")
def q_time(spark, sf_dir):
    c = contests(spark, sf_dir)
    span = c.groupBy("event_id").agg((F.min("ts_ms") + 30 * 86_400_000).alias("first_ms"), (F.max("ts_ms") - 30 * 86_400_000).alias("last_ms"))
    return Q.timestamp_issues(c, _START, _END, span)


@query("duplicate_contests", SQL + _DUP + " SELECT * FROM dup")
def q_dup(spark, sf_dir):
    return Q.find_duplicates(contests(spark, sf_dir))


@query("quality_audit", _ALL + " SELECT * FROM issues")
def q_audit(spark, sf_dir):
    return Q.audit(contests(spark, sf_dir), _START, _END)


@query("issue_summary", _ALL + " SELECT s AS severity, count(code) AS n, count(DISTINCT code) AS codes FROM (VALUES ('fatal'), ('error'), ('warning'), ('info')) v(s) LEFT JOIN issues ON severity = s GROUP BY 1")
def q_summary(spark, sf_dir):
    return Q.issue_summary(Q.audit(contests(spark, sf_dir), _START, _END))


_QUAR = """, q AS (SELECT c.contest_id, concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM legs WHERE legs.contest_id = c.contest_id) THEN 'no-scored-legs' END,
  CASE WHEN EXISTS (SELECT 1 FROM issues i WHERE i.entity_type = 'match' AND i.entity_id = CAST(c.contest_id AS VARCHAR) AND (i.severity = 'fatal' OR i.code IN ('no-winner', 'winner-behind-on-legs'))) THEN 'fatal-issue' END) AS reasons FROM c)"""


def _quarantine(spark, sf_dir):
    c = contests(spark, sf_dir)
    return c, Q.quarantine(c, Q.audit(c, _START, _END), ["no-winner", "winner-behind-on-legs"])


@query("quarantine", _ALL + _QUAR + " SELECT contest_id, reasons FROM q WHERE reasons <> ''")
def q_quarantine(spark, sf_dir):
    return _quarantine(spark, sf_dir)[1].select("contest_id", F.array_join("reasons", ",").alias("reasons"))


@query("hardened_eligibility", _ALL + _QUAR + " SELECT contest_id, concat_ws(',', CASE WHEN winner IS NULL THEN 'no-winner' END, CASE WHEN reasons <> '' THEN 'quarantined' END) = '' AS eligible, concat_ws(',', CASE WHEN winner IS NULL THEN 'no-winner' END, CASE WHEN reasons <> '' THEN 'quarantined' END) AS reasons FROM c JOIN q USING (contest_id)")
def q_harden(spark, sf_dir):
    c, q = _quarantine(spark, sf_dir)
    return Q.harden(c, q).select("contest_id", "eligible", F.array_join("reasons", ",").alias("reasons"))


@query("feature_validation", FEATURE_SQL + " SELECT contest_id, 'rate-range' AS code, 'a_win_rate' AS field FROM features WHERE contest_id % 50 = 0 UNION ALL SELECT contest_id, 'negative', 'b_prior_wins' FROM features WHERE contest_id % 70 = 0")
def q_features(spark, sf_dir):
    """Planted faults in two columns; the rest of the table must pass."""
    f = X.assemble(contests(spark, sf_dir))
    f = f.withColumns({"a_win_rate": F.when(F.col("contest_id") % 50 == 0, F.col("a_win_rate") + 2).otherwise(F.col("a_win_rate")), "b_prior_wins": F.when(F.col("contest_id") % 70 == 0, -1).otherwise(F.col("b_prior_wins"))})
    rates = [c for c in f.columns if c.endswith("win_rate") or c == "h2h_rate_a"]
    return Q.validate_features(f, rates, [c for c in f.columns if c.endswith(("_contests", "_wins", "_meetings"))])


@query("source_integrity", SQL + " SELECT contest_id, 'label' AS code FROM acc WHERE contest_id % 31 = 0 UNION ALL SELECT contest_id + 100000000, 'no-source' FROM acc WHERE contest_id % 37 = 0")
def q_integrity(spark, sf_dir):
    """Stored rows with a flipped label or without a source contest."""
    c = accepted(contests(spark, sf_dir))
    label = (F.col("winner") == F.col("side_a")).cast("int")
    stored = c.select("contest_id", F.when(F.col("contest_id") % 31 == 0, 1 - label).otherwise(label).alias("a_won")).unionByName(c.where("contest_id % 37 = 0").select((F.col("contest_id") + 100000000).alias("contest_id"), label.alias("a_won")))
    src = c.select("contest_id", label.alias("again"))
    x = stored.join(src, "contest_id", "left")
    return x.select("contest_id", F.when(F.col("again").isNull(), "no-source").when(F.col("again") != F.col("a_won"), "label").alias("code")).where("code is not null")


@query("contest_audit", SQL + ", n AS (SELECT contest_id, count(*) AS n, count(*) FILTER (WHERE NOT recognized) AS u FROM legs GROUP BY 1) SELECT count(*) AS contests, count(*) FILTER (WHERE winner IS NULL) AS without_winner, count(*) FILTER (WHERE coalesce(u, 0) > 0) AS with_unknown_leg, count(*) FILTER (WHERE series_format = 'unknown') AS unknown_format, CAST(sum(coalesce(n, 0)) AS BIGINT) AS legs FROM c LEFT JOIN n USING (contest_id)")
def q_contest_audit(spark, sf_dir):
    c = contests(spark, sf_dir)
    return c.agg(F.count(F.lit(1)).alias("contests"), F.count_if(F.col("winner").isNull()).alias("without_winner"), F.count_if(F.exists("legs", lambda x: ~x["recognized"])).alias("with_unknown_leg"), F.count_if(F.col("series_format") == "unknown").alias("unknown_format"), F.sum(F.size("legs")).alias("legs"))


@query("contest_counts", SQL + "SELECT year(ts) AS season_year, family, series_format, count(*) AS n, count(winner) AS eligible FROM c GROUP BY GROUPING SETS ((year(ts)), (family), (series_format))")
def q_counts(spark, sf_dir):
    """Counts by year, by family and by format in one pass over the contests."""
    c = contests(spark, sf_dir).withColumn("season_year", F.year("ts").cast("long"))
    return c.groupingSets([[F.col("season_year")], [F.col("family")], [F.col("series_format")]], "season_year", "family", "series_format").agg(F.count(F.lit(1)).alias("n"), F.count("winner").alias("eligible"))


def _signal_sql():
    cols = {"n": "n", "events": "ev", "legs": "lg", "region": "evr", "split": "lsp", "unknown": "lun", "both": "rb", "any": "ra", "none": "0"}
    rows = []
    for name, (group, covered, total, leakage, included) in Q.SIGNALS.items():
        missing = f"CASE WHEN {cols[total]} > 0 THEN 1 - {cols[covered]} / {cols[total]}::DOUBLE ELSE {1 if name == 'attack-defense' else 0} END" if name != "unknown-legs" else "0"
        rows.append(f"SELECT '{name}' AS signal, '{group}' AS signal_group, {cols[covered]} AS covered, {cols[total]} AS total, round({missing}, 9) AS missing_rate, {'NULL::TIMESTAMP' if covered == 'none' else 'mt'} AS earliest, {covered != 'none'} AS known_before, '{leakage}' AS leakage, {included} AS included FROM t")
    return " UNION ALL ".join(rows)


@query("feature_coverage", SQL + """, rc AS (SELECT contest_id, count(*) FILTER (WHERE k <= 3) AS ka FROM sl JOIN c ON contest_id = l_orderkey GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT min(ts) FROM c) AS mt, (SELECT count(DISTINCT event_id) FROM c) AS ev, (SELECT count(DISTINCT event_id) FROM c WHERE region <> 'ASIA') AS evr, (SELECT count(*) FROM legs) AS lg, (SELECT count(*) FROM legs WHERE sp) AS lsp, (SELECT count(*) FROM legs WHERE NOT recognized) AS lun,
  (SELECT count(*) FROM c WHERE contest_id % 5 <> 0 AND contest_id % 7 <> 0) AS rb, (SELECT count(*) FROM c WHERE contest_id % 5 <> 0) AS ra) """ + _signal_sql())
def q_coverage(spark, sf_dir):
    """All signals; every fifth contest has no roster, every seventh one at most, and one region is left out."""
    c, k = contests(spark, sf_dir), F.col("contest_id")
    roster = lambda s, gone: F.when(~gone, F.col(f"roster_{s}"))
    c = c.withColumns({"roster_a": roster("a", k % 5 == 0), "roster_b": roster("b", (k % 5 == 0) | (k % 7 == 0))})
    events = c.select("event_id", F.when(F.col("region") != "ASIA", F.col("region")).alias("region")).distinct()
    return Q.signal_coverage(c, events).withColumn("missing_rate", F.round("missing_rate", 9))


@query("canonical_window", SQL + "SELECT event_name, min(ts) AS start_ts, count(*) AS n FROM acc WHERE event_id = 3 GROUP BY 1")
def q_canonical(spark, sf_dir):
    return accepted(contests(spark, sf_dir)).where("event_id = 3").groupBy("event_name").agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("n"))
