"""Queries of normalisation, reconciliation, upserts, ledgers, versions and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.operators import lifecycle as L
from agonix.operators import normalize as N
from agonix.operators import quality as Q
from agonix.sources.contests import SQL, contests, table

from .base import query


def _raw(spark, sf_dir):
    """Order dates as raw text of several forms, by key."""
    k = F.col("o_orderkey") % 5
    d = lambda f: F.date_format("o_orderdate", f)
    raw = F.when(k == 0, F.concat(d("yyyy-MM-dd"), F.lit("T"), d("HH:mm:ss"), F.lit("Z"))).when(k == 1, F.concat(d("yyyy-MM-dd"), F.lit("T"), d("HH:mm:ss"), F.lit("+02:00"))).when(k == 2, d("yyyy-MM-dd HH:mm:ss")).when(k == 3, d("yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", raw.alias("raw"))


@query("normalize_timestamps", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN epoch_ms(o_orderdate) - 7200000 END AS ts_ms, CASE WHEN o_orderkey % 5 < 2 THEN 'high' ELSE 'none' END AS confidence, CASE WHEN o_orderkey % 5 = 2 THEN epoch_ms(o_orderdate) END AS utc_ms FROM orders")
def q_ts(spark, sf_dir):
    r = _raw(spark, sf_dir)
    t = N.norm_timestamp(F.col("raw"))
    return r.select("o_orderkey", F.unix_millis(t["ts"]).alias("ts_ms"), t["confidence"].alias("confidence"), N.parse_utc(F.col("raw")).alias("utc_ms"))


def _ranges(o):
    last = F.last_day("o_orderdate")
    nxt = F.date_add(last, 1)
    start, year = F.concat(F.date_format("o_orderdate", "MMM"), F.lit(" "), F.day("o_orderdate")), lambda d: F.concat(F.lit(", "), F.year(d))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(start, F.lit(" – "), F.day(last), year(last))).when(F.col("o_orderkey") % 3 == 1, F.concat(start, F.lit(" - "), F.date_format(nxt, "MMM"), F.lit(" "), F.day(nxt), year(nxt))).otherwise("soon")
    r = N.parse_range(raw)
    return o.select("o_orderkey", r["start"].cast("string").alias("start_date"), r["end"].cast("string").alias("end_date"))


@query("parse_date_ranges", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start_date, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(last_day(o_orderdate) AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(last_day(o_orderdate) + INTERVAL 1 DAY AS DATE) AS VARCHAR) END AS end_date FROM orders WHERE month(o_orderdate) < 12")
def q_ranges(spark, sf_dir):
    return _ranges(table(spark, sf_dir, "orders").where(F.month("o_orderdate") < 12))


@query("parse_date_ranges_all", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start_date, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(last_day(o_orderdate) AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(last_day(o_orderdate) + INTERVAL 1 DAY AS DATE) AS VARCHAR) END AS end_date FROM orders")
def q_ranges_all(spark, sf_dir):
    """Every order, those of December too, whose ranges cross the year."""
    return _ranges(table(spark, sf_dir, "orders"))


_FAMILY = {"MACHINERY": "masters", "BUILDING": "league", "HOUSEHOLD": "league", "FURNITURE": "unknown", "AUTOMOBILE": "excluded-showmatch"}


def _raw_contests(spark, sf_dir):
    """Contests as a source would give them: text for times and formats, foreign ids, gaps."""
    c, k = contests(spark, sf_dir), F.col("contest_id")
    d = lambda f: F.date_format("ts", f)
    iso = F.when(k % 6 == 0, F.concat(d("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 6 == 1, F.concat(d("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200"))).when(k % 6 == 2, d("yyyy-MM-dd HH:mm:ss")).when(k % 6 != 5, F.concat(d("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
    status = F.when(k % 12 == 0, "cancelled").when(k % 12 == 1, "postponed").when(k % 12 == 2, "upcoming").when(k % 12 == 3, "live").otherwise("completed")
    series = F.when(k % 7 == 0, None).otherwise(F.concat(F.lit("Best of "), F.col("series_format").substr(3, 1)))
    score = lambda x, n: F.when((k % 23 == 0) & (x["leg"] == 1), None).otherwise(x[n])
    legs = F.transform("legs", lambda x: F.struct(F.concat(F.lit(" "), F.lower(x["name"])).alias("name"), score(x, "score_a").alias("score_a"), score(x, "score_b").alias("score_b")))
    rosters = F.when(k % 5 != 0, F.array(F.struct(F.col("side_a").alias("team"), F.col("roster_a").alias("players")), F.struct(F.col("side_b").alias("team"), F.col("roster_b").alias("players"))))
    return c.select(
        "contest_id", F.when(k % 6 != 5, iso).alias("scheduled_raw"), iso.alias("scheduled_iso"), status.alias("status"), series.alias("series_raw"), F.col("side_a").alias("team_a"), F.col("side_b").alias("team_b"),
        F.when(k % 13 == 0, -1).otherwise(F.col("winner")).alias("winner_raw"), "event_id", legs.alias("legs"), rosters.alias("rosters"), (k % 17 == 0).alias("is_duplicate"), (k % 19 == 0).alias("is_showmatch"), F.col("family").alias("segment"),
    )


_NORMALISED = SQL + f""", x AS (SELECT c.*, CASE contest_id % 6 WHEN 0 THEN epoch_ms(ts) WHEN 1 THEN epoch_ms(ts) - 7200000 WHEN 3 THEN epoch_ms(ts) + 18000000 WHEN 4 THEN epoch_ms(ts) + 18000000 END AS tms,
    CASE contest_id % 12 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'postponed' WHEN 2 THEN 'upcoming' WHEN 3 THEN 'live' ELSE 'completed' END AS status,
    CASE WHEN contest_id % 7 = 0 THEN 'unknown' WHEN series_format = 'unknown' THEN 'unknown' ELSE series_format END AS fmt, CASE WHEN contest_id % 13 = 0 THEN NULL ELSE winner END AS won,
    CASE family {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FAMILY.items())} END AS fam FROM c),
lg AS (SELECT contest_id, count(*) FILTER (WHERE ok) AS played, count(*) FILTER (WHERE ok AND qa > qb) AS wa, count(*) FILTER (WHERE ok AND qb > qa) AS wb, count(*) AS n, count(*) FILTER (WHERE NOT recognized) AS unknown_legs, count(*) FILTER (WHERE NOT ok) AS blank_legs
  FROM (SELECT *, NOT (contest_id % 23 = 0 AND leg = 1) AS ok FROM legs) GROUP BY 1),
ro AS (SELECT l_orderkey AS contest_id, count(DISTINCT l_partkey) FILTER (WHERE r = 1) AS ra, count(DISTINCT l_partkey) FILTER (WHERE r = 2) AS rb FROM sl GROUP BY 1),
y AS (SELECT x.*, coalesce(played, 0) AS played, CASE WHEN won = side_a THEN coalesce(wa, 0) WHEN won = side_b THEN coalesce(wb, 0) ELSE 0 END AS wins, coalesce(unknown_legs, 0) AS unknown_legs, coalesce(blank_legs, 0) AS blank_legs, ra, rb,
  (epoch_ms(TIMESTAMP '1993-01-01')) AS lo, (epoch_ms(TIMESTAMP '1998-01-01') - 1) AS hi FROM x LEFT JOIN lg USING (contest_id) JOIN ro USING (contest_id)),
z AS (SELECT *, concat_ws(',', CASE WHEN status = 'cancelled' THEN 'cancelled' END, CASE WHEN status = 'postponed' THEN 'postponed' END, CASE WHEN status <> 'completed' THEN 'not_completed' END, CASE WHEN contest_id % 19 = 0 THEN 'showmatch' END, CASE WHEN contest_id % 17 = 0 THEN 'duplicate' END,
  CASE WHEN tms IS NULL THEN 'unknown_played_at' END, CASE WHEN tms < lo THEN 'before_scope_start' END, CASE WHEN tms > hi THEN 'after_scope_end' END, CASE WHEN fam NOT IN ('masters', 'league') THEN 'event_not_approved_family' END, CASE WHEN won IS NULL THEN 'winner_unknown' END,
  CASE WHEN NOT CASE fmt WHEN 'bo1' THEN wins = 1 WHEN 'bo3' THEN wins = 2 WHEN 'bo5' THEN wins = 3 ELSE wins >= 1 END THEN 'invalid_series_result' END, CASE WHEN played < 1 THEN 'no_maps_played' END) AS reasons FROM y)"""
_NORM_ROWS = """SELECT contest_id, CASE WHEN side_a % 10 = 0 THEN 'team:' || side_a ELSE 't' || side_a END AS side_a, CASE WHEN won % 10 = 0 THEN 'team:' || won ELSE 't' || won END AS winner, tms AS ts_ms, CASE WHEN tms IS NULL THEN 'none' ELSE 'high' END AS ts_confidence, fmt AS series_format, unknown_legs, blank_legs,
  concat_ws(',', CASE WHEN side_a % 10 = 0 THEN 'missing_team_mapping' END, CASE WHEN side_b % 10 = 0 THEN 'missing_team_mapping' END, CASE WHEN contest_id % 7 = 0 THEN 'missing_series_format' END, CASE WHEN contest_id % 6 = 5 THEN 'missing_timestamp' WHEN tms IS NULL THEN 'ambiguous_timezone' END,
  CASE WHEN fam = 'unknown' THEN 'unknown_event_classification' WHEN fam = 'excluded-showmatch' THEN 'excluded_event_category' END, CASE WHEN tms < lo OR tms > hi THEN 'outside_date_scope' END, CASE WHEN contest_id % 17 = 0 THEN 'duplicate_match' END, CASE WHEN status <> 'completed' THEN 'not_completed' END,
  CASE WHEN status = 'completed' AND won IS NULL THEN 'inconsistent_winner' END, CASE WHEN status = 'completed' AND (contest_id % 5 = 0 OR ra < 5 OR rb < 5) THEN 'incomplete_roster' END, CASE WHEN reasons <> '' THEN 'not_training_eligible' END) AS flags,
  (CASE WHEN fam IN ('unknown', 'excluded-showmatch') THEN 1 ELSE 0 END) + (CASE WHEN reasons <> '' THEN 1 ELSE 0 END) AS critical_flags, reasons, reasons = '' AS eligible FROM z"""


def _normalised(spark, sf_dir):
    """Normalised contests and the events they belong to."""
    raw = _raw_contests(spark, sf_dir)
    team = F.col("s_suppkey")
    teams = table(spark, sf_dir, "supplier").where(team % 10 != 0).select(team.alias("team"), F.concat(F.lit("t"), team).alias("internal_id"))
    family = F.lit(None).cast("string")
    for k, v in _FAMILY.items():
        family = F.when(F.col("segment") == k, v).otherwise(family)
    raw = raw.withColumn("event_id", F.concat_ws("|", "event_id", "segment"))  # here an event has one family
    events = raw.select("event_id", family.alias("family")).distinct()
    return N.normalize_contests(raw, teams, events, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"], "1993-01-01", "1997-12-31", ["masters", "league"]), events


@query("normalize_contests", _NORMALISED + _NORM_ROWS)
def q_normalize(spark, sf_dir):
    """The whole job over raw contests: identities, times, formats, legs, flags and reasons against training."""
    n, _ = _normalised(spark, sf_dir)
    of = lambda code: F.size(F.filter("legs", lambda x: F.array_contains(x["flags"], code))).cast("long")
    return n.select(
        "contest_id", "side_a", "winner", F.unix_millis("ts").alias("ts_ms"), "ts_confidence", "series_format", of("unknown_map").alias("unknown_legs"), of("missing_map_score").alias("blank_legs"),
        F.array_join("flags", ",").alias("flags"), "critical_flags", F.array_join("reasons", ",").alias("reasons"), "eligible",
    )


_TAGS = """SELECT 'total' AS section, unnest(['normalized', 'eligible', 'ineligible', 'missing_team_mappings', 'ambiguous_timestamps', 'missing_series_format', 'missing_winner', 'missing_legs', 'unknown_legs', 'incomplete_rosters', 'forfeits', 'percent_eligible', 'discovered_contests', 'duplicate_links', 'network_failures', 'parse_failures']) AS name,
  unnest([count(*)::DOUBLE, count(*) FILTER (WHERE reasons = ''), count(*) FILTER (WHERE reasons <> ''), count(*) FILTER (WHERE side_a % 10 = 0 OR side_b % 10 = 0), count(*) FILTER (WHERE tms IS NULL), count(*) FILTER (WHERE contest_id % 7 = 0), count(*) FILTER (WHERE status = 'completed' AND won IS NULL),
    count(*) FILTER (WHERE n IS NULL), count(*) FILTER (WHERE unknown_legs > 0), count(*) FILTER (WHERE status = 'completed' AND (contest_id % 5 = 0 OR ra < 5 OR rb < 5)), count(*) FILTER (WHERE status = 'completed' AND reasons LIKE '%invalid_series_result%'), floor(count(*) FILTER (WHERE reasons = '') / count(*)::DOUBLE * 1000 + 0.5) / 10,
    (SELECT count(*) FROM orders), 12, (SELECT count(*) FROM orders WHERE o_orderkey % 101 < 2), (SELECT count(*) FROM orders WHERE o_orderkey % 101 = 2)]) AS value FROM z LEFT JOIN (SELECT contest_id, count(*) AS n FROM legs GROUP BY 1) USING (contest_id)
UNION ALL SELECT 'year', CAST(year(epoch_ms(tms)) AS VARCHAR), count(*) FROM z WHERE tms IS NOT NULL GROUP BY 2
UNION ALL SELECT 'family', f, count(fam) FROM (VALUES ('masters'), ('league'), ('challengers'), ('unknown'), ('excluded-showmatch')) t(f) LEFT JOIN z ON fam = f GROUP BY 2
UNION ALL SELECT 'format', f, count(z.fmt) FROM (VALUES ('bo1'), ('bo3'), ('bo5'), ('unknown')) t(f) LEFT JOIN z ON z.fmt = f GROUP BY 2
UNION ALL SELECT 'leg', CASE WHEN recognized THEN name ELSE ' ' || lower(name) END, count(*) FROM legs GROUP BY 2
UNION ALL SELECT 'team', 't' || t, count(*) FROM (SELECT side_a AS t FROM z UNION ALL SELECT side_b FROM z) WHERE t % 10 <> 0 GROUP BY 2
UNION ALL SELECT 'total', k, count(e) FROM (VALUES ('included_events', 'masters,league'), ('excluded_events', 'excluded-showmatch'), ('unknown_events', 'unknown'), ('discovered_events', 'masters,league,excluded-showmatch,unknown')) v(k, fams) LEFT JOIN (SELECT DISTINCT event_id || '|' || family AS e, fam FROM z) ON list_contains(string_split(fams, ','), fam) GROUP BY 2"""


@query("quality_report", _NORMALISED + _TAGS)
def q_report(spark, sf_dir):
    """What the normalisation run has found and what its records lack."""
    n, events = _normalised(spark, sf_dir)
    inclusion = F.when(F.col("family").isin("masters", "league"), "included").when(F.col("family") == "unknown", "unknown").otherwise(F.concat(F.lit("excluded:"), F.col("family")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contest_id"))
    k = F.col("contest_id") % 101
    failures = o.where(k < 4).select(F.when(k == 0, "timeout").when(k == 1, "fetch_failed").when(k == 2, "parse_failure").otherwise("other").alias("error_code"))
    return Q.quality_report(n, events.select("event_id", inclusion.alias("inclusion")), o, failures, ["masters", "league", "challengers", "unknown", "excluded-showmatch"], ["bo1", "bo3", "bo5", "unknown"], 12)


@query("normalize_legs", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD') THEN p_type ELSE lower(p_type) || ' ' END AS name, p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD') AS recognized, p_partkey % 7 = 0 AS placeholder FROM part")
def q_leg_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    from agonix.operators.quality import PLACEHOLDERS
    from agonix.sources.contests import KNOWN_LEGS

    leg = N.norm_leg(F.concat(F.lower("p_type"), F.lit(" ")), KNOWN_LEGS)
    raw = F.when(F.col("p_partkey") % 7 == 0, " TBD ").otherwise(F.col("p_type"))
    return p.select("p_partkey", leg["name"].alias("name"), leg["recognized"].alias("recognized"), F.lower(F.trim(raw)).isin(PLACEHOLDERS).alias("placeholder"))


@query("normalize_series", """WITH t AS (SELECT o_orderpriority, o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Bo 1' WHEN '2' THEN 'Upper final, best of 3' WHEN '3' THEN 'Grand Final' WHEN '4' THEN 'bo3 x' ELSE 'BO5' END AS text FROM orders),
s AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*bo\\s*1\\s*$', 'i') THEN 'bo1' WHEN regexp_matches(text, '^\\s*bo\\s*3\\s*$', 'i') THEN 'bo3' WHEN regexp_matches(text, '^\\s*bo\\s*5\\s*$', 'i') THEN 'bo5' WHEN regexp_matches(text, 'best\\s*of\\s*1', 'i') THEN 'bo1' WHEN regexp_matches(text, 'best\\s*of\\s*3', 'i') THEN 'bo3' WHEN regexp_matches(text, 'best\\s*of\\s*5', 'i') THEN 'bo5' ELSE 'unknown' END AS series FROM t)
SELECT o_orderpriority, series, count(*) AS n, count(*) FILTER (WHERE CASE series WHEN 'bo1' THEN o_orderkey % 4 = 1 WHEN 'bo3' THEN o_orderkey % 4 = 2 WHEN 'bo5' THEN o_orderkey % 4 = 3 ELSE o_orderkey % 4 >= 1 END) AS valid FROM s GROUP BY 1, 2""")
def q_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    text = F.when(F.col("o_orderpriority").startswith("1"), "Bo 1").when(F.col("o_orderpriority").startswith("2"), "Upper final, best of 3").when(F.col("o_orderpriority").startswith("3"), "Grand Final").when(F.col("o_orderpriority").startswith("4"), "bo3 x").otherwise("BO5")
    s = o.withColumn("series", N.norm_series(text))
    return s.groupBy("o_orderpriority", "series").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.valid_wins(F.col("series"), F.col("o_orderkey") % 4)).alias("valid"))


def _events(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.concat("n_name", F.lit(" Masters"))).when(k % 4 == 1, F.concat("n_name", F.lit(" League"))).when(k % 4 == 2, F.concat("n_name", F.lit(" Open Qualifier"))).otherwise(F.lit("?"))
    return n.select(k.cast("long").alias("event_id"), name.alias("name"), F.when(k % 5 == 0, "League").alias("tier_hint"), F.date_add(F.lit("1994-01-01").cast("date"), k * 30).alias("start_date"), F.date_add(F.lit("1994-01-11").cast("date"), k * 30).alias("end_date"))


def _classified(spark, sf_dir):
    e = _events(spark, sf_dir)
    return N.classify_events(e, e.where("event_id % 6 = 3").select("event_id", F.lit("showmatch").alias("override")))


_CLS = """WITH e AS (SELECT CAST(n_nationkey AS BIGINT) AS event_id, CASE WHEN n_nationkey % 6 = 3 THEN 'showmatch' WHEN n_nationkey % 5 = 0 THEN 'league' WHEN n_nationkey % 4 = 0 THEN 'masters' WHEN n_nationkey % 4 = 1 THEN 'league' WHEN n_nationkey % 4 = 2 THEN 'challengers' ELSE 'unknown' END AS class,
  CASE WHEN n_nationkey % 6 = 3 OR n_nationkey % 5 = 0 THEN 'high' WHEN n_nationkey % 4 = 3 THEN 'none' ELSE 'low' END AS confidence, CASE WHEN n_nationkey % 6 = 3 THEN 'override' WHEN n_nationkey % 5 = 0 THEN 'metadata' WHEN n_nationkey % 4 = 3 THEN 'none' ELSE 'name' END AS reason,
  DATE '1994-01-01' + CAST(n_nationkey * 30 AS INTEGER) AS sd, DATE '1994-01-11' + CAST(n_nationkey * 30 AS INTEGER) AS ed FROM nation)"""


@query("classify_events", _CLS + " SELECT event_id, class, confidence, reason, CASE WHEN class IN ('masters', 'champions', 'international') THEN 'international' WHEN class IN ('league', 'challengers') THEN 'league' ELSE 'unknown' END AS level FROM e")
def q_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "class", "confidence", "reason", N.level_of(F.col("class")).alias("level"))


@query("event_inclusion", _CLS + " SELECT event_id, CASE WHEN class = 'unknown' THEN 'unknown' WHEN class = 'showmatch' THEN 'excluded:showmatch' WHEN class NOT IN ('masters', 'league') THEN 'outside-families' WHEN ed < DATE '1994-06-01' OR sd > DATE '1995-06-01' THEN 'outside-scope' ELSE 'included' END AS inclusion FROM e")
def q_inclusion(spark, sf_dir):
    return N.event_inclusion(_classified(spark, sf_dir), ["masters", "league"], ["showmatch"], "1994-06-01", "1995-06-01").select("event_id", "inclusion")


@query("prerun_report", _CLS + """, i AS (SELECT event_id, class, sd, CASE WHEN class = 'unknown' THEN 'unknown' WHEN class = 'showmatch' THEN 'showmatch' WHEN class NOT IN ('masters', 'league', 'champions') THEN 'outside-families' WHEN ed < DATE '1994-06-01' OR sd > DATE '1995-06-01' THEN 'outside-scope' ELSE 'included' END AS inc FROM e),
inc AS (SELECT f AS name, count(event_id)::DOUBLE AS value FROM (VALUES ('masters'), ('league'), ('champions')) t(f) LEFT JOIN i ON class = f AND inc = 'included' GROUP BY 1)
SELECT 'included' AS section, name, value FROM inc
UNION ALL SELECT 'excluded', inc, count(*) FROM i WHERE inc NOT IN ('included', 'unknown') GROUP BY 2
UNION ALL SELECT 'total', unnest(['candidate_events', 'unknown_events', 'links', 'completed', 'non_completed', 'failed_discoveries', 'duplicate_links']), unnest([(SELECT count(*) FROM i), (SELECT count(*) FROM i WHERE inc = 'unknown'), count(*), count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus <> 'F'), (SELECT count(*) FROM i WHERE event_id % 9 = 4), 1000000]) FROM orders
UNION ALL SELECT 'anomaly', 'no-events:' || name, 0 FROM inc WHERE value = 0
UNION ALL SELECT 'anomaly', 'expected-family-missing:' || name, 0 FROM inc WHERE value = 0 AND name IN ('masters', 'champions')
UNION ALL SELECT 'anomaly', 'duplicate-links-exceed-links', 1000000 FROM (SELECT count(*) AS n FROM orders) WHERE n > 0 AND n < 1000000
UNION ALL SELECT 'anomaly', 'unknown-events-exceed-half', count(*) FILTER (WHERE inc = 'unknown') FROM i HAVING count(*) FILTER (WHERE inc = 'unknown') > count(*) / 2.0
UNION ALL SELECT 'anomaly', 'failed-discoveries', count(*) FROM i WHERE event_id % 9 = 4 HAVING count(*) > 0
UNION ALL SELECT 'anomaly', 'starts-before-scope:' || event_id, 1 FROM i WHERE sd < DATE '1994-06-01'""")
def q_prerun(spark, sf_dir):
    """What a run over the classified events would read, and its anomalies; a million duplicate links are given as found."""
    e = N.event_inclusion(_classified(spark, sf_dir), ["masters", "league", "champions"], ["showmatch"], "1994-06-01", "1995-06-01")
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contest_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("live").alias("listed_status"))
    return Q.prerun_report(e, listed, e.where("event_id % 9 = 4"), ["masters", "league", "champions"], "1994-06-01", duplicate_links=1_000_000)


@query("contest_flags", SQL + """, n AS (SELECT contest_id, bool_or(NOT recognized) AS u, bool_or(qa = qb) AS t FROM legs GROUP BY 1),
r AS (SELECT l_orderkey AS contest_id, count(DISTINCT l_partkey) FILTER (WHERE r = 1) AS a, count(DISTINCT l_partkey) FILTER (WHERE r = 2) AS b FROM sl GROUP BY 1)
SELECT c.contest_id, concat_ws(',', CASE WHEN winner IS NULL THEN 'winner-missing' END, CASE WHEN u THEN 'unknown-leg' END, CASE WHEN t THEN 'tied-leg' END, CASE WHEN series_format = 'unknown' THEN 'format-unknown' END, CASE WHEN a < 5 THEN 'roster-a-incomplete' END, CASE WHEN b < 5 THEN 'roster-b-incomplete' END) AS flags, winner IS NOT NULL AS eligible
FROM c LEFT JOIN n USING (contest_id) JOIN r USING (contest_id)""")
def q_flags(spark, sf_dir):
    return N.contest_flags(contests(spark, sf_dir)).select("contest_id", F.array_join("flags", ",").alias("flags"), "eligible")


def _halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    old = e.where("event_id % 4 <> 0")
    new = e.where("event_id % 4 <> 1").withColumn("value", F.when(F.col("event_id") % 8 == 2, F.col("value") + 1).otherwise(F.col("value")))
    return old, new


@query("upsert_by_hash", "SELECT event_id, CASE WHEN event_id % 4 <> 1 AND event_id % 8 = 2 THEN value + 1 ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN 'inserted' WHEN event_id % 4 = 1 THEN 'kept' WHEN event_id % 8 = 2 THEN 'updated' ELSE 'unchanged' END AS action FROM events")
def q_upsert(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return L.upsert_by_hash(old, new, ["event_id"]).select("event_id", "value", "action")


@query("merge_ledger", """WITH p AS (SELECT user_id, event_type, min(ts) AS f, max(ts) AS l, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), c AS (SELECT user_id, event_type, min(ts) AS f, max(ts) AS l, count(*) AS n FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 0 GROUP BY 1, 2)
SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.event_type, p.event_type) AS event_type, coalesce(p.f, c.f) AS first_seen, coalesce(c.l, p.l) AS last_seen, coalesce(c.n, 0) + coalesce(p.n, 0) AS attempts, CASE WHEN c.user_id IS NOT NULL THEN 'open' ELSE 'resolved' END AS status FROM c FULL JOIN p ON c.user_id = p.user_id AND c.event_type = p.event_type""")
def q_ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda x: x.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("attempts"))
    return L.merge_ledger(of(e.where("event_id % 2 = 0")), of(e.where("event_id % 2 = 1 and user_id % 3 <> 0")), ["user_id", "event_type"])


_VERSIONED = ["contest_id", "event_id", "event_name", "family", "level", "region", "score_a", "score_b", "series_format", "side_a", "side_b", "stage", "ts", "winner"]


@query("dataset_version", SQL + f""", h AS (SELECT sha256(concat_ws(chr(31), {", ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '{chr(92)}N')" for c in _VERSIONED)})) AS h FROM c),
l AS (SELECT h, h || ':' || count(*) AS line, count(*) AS n FROM h GROUP BY h),
a AS (SELECT left(h, 6) AS p, sum(n) AS n, sha256(string_agg(line, ',' ORDER BY line)) AS g FROM l GROUP BY 1),
b AS (SELECT left(p, 3) AS p, sum(n) AS n, sha256(string_agg(p || ':' || g, ',' ORDER BY p || ':' || g)) AS g FROM a GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, left(sha256('schema-1|rules-1|' || string_agg(p || ':' || g, ',' ORDER BY p || ':' || g)), 16) AS version FROM b""")
def q_version(spark, sf_dir):
    return L.dataset_version(contests(spark, sf_dir).drop("legs", "roster_a", "roster_b"), ["schema-1", "rules-1"], ["ts_ms"])


_MAN = """, man AS (SELECT contest_id, event_id, contest_id % 11 <> 0 AS complete, CASE WHEN contest_id % 11 = 0 THEN 'live' ELSE 'completed' END AS listed_status FROM c WHERE contest_id % 13 <> 0 UNION ALL SELECT contest_id + 100000000, event_id, true, 'completed' FROM c WHERE contest_id % 29 = 0),
ev AS (SELECT CAST(n_nationkey AS BIGINT) AS event_id, CASE WHEN n_nationkey % 7 = 0 THEN 'out-of-scope' WHEN n_nationkey % 5 = 1 THEN 'stale' ELSE 'current-approved' END AS category FROM nation),
cat AS (SELECT coalesce(man.contest_id, c.contest_id) AS contest_id, CASE WHEN man.contest_id IS NULL THEN 'orphaned' WHEN c.contest_id IS NULL THEN 'missing' WHEN ev.category <> 'current-approved' THEN 'event-' || ev.category WHEN listed_status <> 'completed' THEN 'stale' ELSE 'current-approved' END AS category FROM c FULL JOIN man ON man.contest_id = c.contest_id JOIN ev ON ev.event_id = coalesce(man.event_id, c.event_id))"""


def _manifest(spark, sf_dir):
    c = contests(spark, sf_dir)
    live = F.when(F.col("contest_id") % 11 == 0, "live").otherwise("completed")
    m = c.where("contest_id % 13 <> 0").select("contest_id", "event_id", live.alias("listed_status")).unionByName(c.where("contest_id % 29 = 0").select((F.col("contest_id") + 100000000).alias("contest_id"), "event_id", F.lit("completed").alias("listed_status")))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("event_id"))
    em = n.select("event_id", (F.col("event_id") % 7 != 0).alias("included"), (F.col("event_id") % 5 != 1).alias("complete"))
    return c, m, L.reconcile(n, em, "event_id")


@query("reconcile_events", SQL + _MAN + " SELECT * FROM ev")
def q_rec_events(spark, sf_dir):
    return _manifest(spark, sf_dir)[2]


@query("reconcile_contests", SQL + _MAN + " SELECT * FROM cat")
def q_rec(spark, sf_dir):
    return L.reconcile_contests(*_manifest(spark, sf_dir))


@query("curated_contests", SQL + _MAN + " SELECT contest_id, side_a, side_b, winner FROM c JOIN cat USING (contest_id) WHERE category = 'current-approved' AND winner IS NOT NULL")
def q_curated(spark, sf_dir):
    c, m, e = _manifest(spark, sf_dir)
    return L.curate(c, L.reconcile_contests(c, m, e), c.where("winner is null")).select("contest_id", "side_a", "side_b", "winner")


@query("manifest_completeness", SQL + _MAN + " SELECT contest_id, 'missing-record' AS code FROM man WHERE listed_status = 'completed' AND contest_id NOT IN (SELECT contest_id FROM c) AND contest_id % 2 = 0 UNION ALL SELECT contest_id, 'missing-field' FROM c WHERE winner IS NULL")
def q_complete(spark, sf_dir):
    c, m, _ = _manifest(spark, sf_dir)
    return L.completeness(m, c, m.where("contest_id > 100000000 and contest_id % 2 = 1"))


@query("registry_diff", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'rejected' WHEN s_suppkey % 5 = 0 THEN 'removed' WHEN s_suppkey % 3 = 0 THEN 'added' WHEN s_suppkey % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM supplier")
def q_diff(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    current = s.where((k % 3 != 0) | (k % 5 == 0) | (k % 7 == 0))
    incoming = s.where((k % 5 != 0) | (k % 7 == 0)).withColumn("s_name", F.when(k % 2 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    incoming = incoming.unionByName(s.where(k % 7 == 0).withColumn("s_name", F.lit("other")))
    return L.diff_registry(current, incoming, "s_suppkey", ["s_name"])


@query("first_wins_dedup", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate, count(*) - 1 AS duplicates FROM orders GROUP BY 1")
def q_first(spark, sf_dir):
    return L.dedup_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("dataset_manifest", SQL + "SELECT count(*) AS normalised, count(winner) AS eligible, count(DISTINCT event_id) AS events, (SELECT count(*) FROM orders) AS discovered, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT contest_id FROM c)) AS failures FROM c")
def q_manifest(spark, sf_dir):
    c = contests(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contest_id"))
    return L.dataset_manifest(o, c, o.join(c.select("contest_id"), "contest_id", "left_anti"))
