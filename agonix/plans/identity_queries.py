"""Queries of identity, audits and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.operators import features as X
from agonix.operators import identity as I
from agonix.sources.contests import SQL, contests, table

from .base import query


def _mapping(spark, sf_dir):
    """Registry over suppliers: two of three are mapped, every ninth twice (the later entry counts)."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("provider_id"), F.concat(F.lit("team-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("internal_id"), F.lit(0).alias("seq"))
    again = s.where("cast(provider_id as bigint) % 9 = 1").select("provider_id", F.concat("internal_id", F.lit("-b")).alias("internal_id"), F.lit(1).alias("seq"))
    return s.unionByName(again)


def _aliases(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("team"), F.col("s_name").alias("alias")).unionByName(s.select(F.col("s_suppkey").alias("team"), F.concat(F.lit("Équipe #"), (F.col("s_nationkey")).cast("string")).alias("alias")))


_MAP = """, m0 AS (SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, 'team-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS internal_id, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0),
mp AS (SELECT provider_id, CASE WHEN s_suppkey % 9 = 1 THEN internal_id || '-b' ELSE internal_id END AS internal_id FROM m0)"""
_ID = "coalesce({m}.internal_id, 'provider:team:' || {c})"


@query("resolve_identity", "WITH x AS (SELECT 1)" + _MAP + f" SELECT s_suppkey, {_ID.format(m='mp', c='supplier.s_suppkey')} AS internal_id, mp.internal_id IS NOT NULL AS mapped FROM supplier LEFT JOIN mp ON provider_id = CAST(supplier.s_suppkey AS VARCHAR)")
def q_resolve(spark, sf_dir):
    return I.resolve_identity(table(spark, sf_dir, "supplier").select("s_suppkey"), _mapping(spark, sf_dir), "s_suppkey")


@query("remap_identities", SQL + _MAP + f" SELECT contest_id, {_ID.format(m='a', c='side_a')} AS id_a, {_ID.format(m='b', c='side_b')} AS id_b, CASE WHEN winner = side_a THEN {_ID.format(m='a', c='side_a')} WHEN winner = side_b THEN {_ID.format(m='b', c='side_b')} END AS id_winner FROM c LEFT JOIN mp a ON a.provider_id = CAST(side_a AS VARCHAR) LEFT JOIN mp b ON b.provider_id = CAST(side_b AS VARCHAR)")
def q_remap(spark, sf_dir):
    return I.remap(contests(spark, sf_dir), _mapping(spark, sf_dir)).select("contest_id", "id_a", "id_b", "id_winner")


@query("mapping_validation", "WITH x AS (SELECT 1)" + _MAP + " SELECT 'several-targets' AS code, provider_id AS id FROM m0 WHERE s_suppkey % 9 = 1 UNION ALL SELECT 'unknown-target', provider_id FROM m0 WHERE s_suppkey % 9 = 1 UNION ALL SELECT 'unknown-target', provider_id FROM m0 WHERE s_suppkey % 100 = 1")
def q_map_valid(spark, sf_dir):
    m = _mapping(spark, sf_dir)
    known = m.where("seq = 0 and cast(provider_id as bigint) % 100 <> 1").select("internal_id").distinct()
    return I.validate_mapping(m, known)


@query("display_names", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN '  ' END), ''), CASE WHEN p_partkey % 5 <> 0 THEN upper(left(lower(p_brand), 1)) || lower(substr(p_brand, 2)) END, CAST(p_partkey AS VARCHAR)) AS display FROM part")
def q_display(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 0, "  ")
    listing = p.select("p_partkey", raw.alias("raw_name"), F.when(F.col("p_partkey") % 5 != 0, F.lower("p_brand")).alias("slug"))
    return I.enrich_display(p.select("p_partkey"), listing, "p_partkey").select("p_partkey", "display")


@query("team_audit", SQL + _MAP + " SELECT team, count(*) AS appearances, count(DISTINCT event_id) AS events, min(ts) AS first_seen, max(ts) AS last_seen, CAST(team AS VARCHAR) IN (SELECT provider_id FROM mp) AS mapped FROM s GROUP BY team")
def q_team_audit(spark, sf_dir):
    return I.team_audit(X.sides(contests(spark, sf_dir)), _mapping(spark, sf_dir))


_PL = ", pl AS (SELECT DISTINCT s.contest_id, s.side, s.team, s.ts, l_partkey AS player FROM s JOIN sl ON sl.l_orderkey = s.contest_id AND sl.l_suppkey = s.team)"


@query("player_audit", SQL + _PL + " SELECT player, count(*) AS appearances, array_to_string(list_sort(list(DISTINCT team)), ',') AS teams, min(ts) AS first_seen, max(ts) AS last_seen FROM pl GROUP BY 1")
def q_player_audit(spark, sf_dir):
    return I.player_audit(X.sides(contests(spark, sf_dir)))


@query("event_audit", SQL + ", e AS (SELECT CAST(n_nationkey AS BIGINT) AS event_id FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT) FROM nation WHERE n_regionkey = 1) SELECT e.event_id, (SELECT count(*) FROM c WHERE c.event_id = e.event_id) AS contests, count(*) > 1 AS duplicate FROM e GROUP BY 1")
def q_event_audit(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    e = n.select(F.col("n_nationkey").cast("long").alias("event_id"))
    return I.event_audit(e.unionByName(n.where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("event_id"))), contests(spark, sf_dir))


@query("roster_timeline", SQL + _PL + " SELECT player, team, contest_id, ts FROM pl")
def q_timeline(spark, sf_dir):
    return I.roster_timeline(X.sides(contests(spark, sf_dir)))


@query("roster_score", SQL + ", n AS (SELECT l_orderkey AS contest_id, count(DISTINCT l_partkey) FILTER (WHERE r = 1) AS a, count(DISTINCT l_partkey) FILTER (WHERE r = 2) AS b FROM sl GROUP BY 1) SELECT c.contest_id, (least(1.0, a / 5.0::DOUBLE) + least(1.0, b / 5.0::DOUBLE)) / 2 AS roster_score FROM c JOIN n USING (contest_id)")
def q_roster_score(spark, sf_dir):
    return I.roster_score(contests(spark, sf_dir))


@query("name_history", "WITH h AS (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observations FROM events GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY user_id) > 1 AS renamed FROM h")
def q_names(spark, sf_dir):
    return I.name_history(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("shared_names", "SELECT event_type, count(DISTINCT user_id) AS ids FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def q_shared(spark, sf_dir):
    return I.shared_keys(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("alias_collisions", "WITH a AS (SELECT s_suppkey AS team, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS alias FROM supplier UNION ALL SELECT s_suppkey, 'equipe ' || s_nationkey FROM supplier) SELECT alias, count(DISTINCT team) AS ids FROM a GROUP BY 1 HAVING count(DISTINCT team) > 1")
def q_collisions(spark, sf_dir):
    return I.alias_collisions(_aliases(spark, sf_dir))


@query("alias_lookup", "SELECT s_name AS name, s_suppkey AS team FROM supplier UNION ALL SELECT n_name, CAST(NULL AS BIGINT) FROM nation")
def q_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.upper("s_name").alias("u"), F.col("s_name").alias("name")).drop("u").unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return I.lookup_alias(names, _aliases(spark, sf_dir))
