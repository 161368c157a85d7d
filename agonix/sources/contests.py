"""Contests from order tables: an order with line items of at least two suppliers is a contest between the two with
the lowest keys; the larger quantity wins. Column pruning and shuffles: only the columns used are read, line items meet
orders once on the order key, and the dimension tables are small enough for Spark's own broadcast choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Leg names that count as recognised.
KNOWN_LEGS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"]
DAY_MS = 86_400_000
_LINE = ["l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")


def side_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the two sides of each contest, with ``side`` (A, B) and ``k``, the line's place on its side."""
    line = table(spark, sf_dir, "lineitem").select(*_LINE)
    rank = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*_LINE[2:]))
    return line.withColumn("r", rank).where("r <= 2").withColumn("k", place).withColumn("side", F.when(F.col("r") == 1, "A").otherwise("B"))


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contest: sides, scores, winner, legs, rosters and event context. A draw has no winner."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type"))
    lines = side_lines(spark, sf_dir).join(part, "l_partkey", "left")
    leg = F.struct("k", F.col("p_type").alias("name"), F.col("l_quantity").alias("q"), F.col("l_linestatus").alias("st"))
    a, b = F.col("side") == "A", F.col("side") == "B"
    both = lines.groupBy("l_orderkey").agg(
        F.min(F.when(a, F.col("l_suppkey"))).alias("side_a"),
        F.min(F.when(b, F.col("l_suppkey"))).alias("side_b"),
        F.sum(F.when(a, F.col("l_quantity"))).alias("score_a"),
        F.sum(F.when(b, F.col("l_quantity"))).alias("score_b"),
        F.array_sort(F.collect_list(F.when(a, leg))).alias("lines_a"),
        F.array_sort(F.collect_list(F.when(b, leg))).alias("lines_b"),
        F.array_sort(F.collect_set(F.when(a, F.col("l_partkey")))).alias("roster_a"),
        F.array_sort(F.collect_set(F.when(b, F.col("l_partkey")))).alias("roster_b"),
    )
    both = both.where("side_b is not null")
    legs = F.expr(
        """transform(arrays_zip(slice(lines_a, 1, least(size(lines_a), size(lines_b))), slice(lines_b, 1, least(size(lines_a), size(lines_b)))),
             z -> struct(z['0'].k AS leg, z['0'].name AS name, coalesce(z['0'].name IN (%s), false) AS recognized,
               z['0'].q AS score_a, z['1'].q AS score_b,
               CASE WHEN z['0'].st = 'F' AND z['1'].st = 'F' THEN floor(z['0'].q / 2) END AS attack_a,
               CASE WHEN z['0'].st = 'F' AND z['1'].st = 'F' THEN z['0'].q - floor(z['0'].q / 2) END AS defense_a,
               CASE WHEN z['0'].st = 'F' AND z['1'].st = 'F' THEN floor(z['1'].q / 2) END AS attack_b,
               CASE WHEN z['0'].st = 'F' AND z['1'].st = 'F' THEN z['1'].q - floor(z['1'].q / 2) END AS defense_b))"""
        % ", ".join(f"'{n}'" for n in KNOWN_LEGS)
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = both.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("legs", legs)
    return c.select(
        F.col("l_orderkey").alias("contest_id"),
        F.col("o_orderdate").alias("ts"),
        epoch_ms("o_orderdate").alias("ts_ms"),
        "side_a", "side_b", "score_a", "score_b",
        F.when(F.col("score_a") > F.col("score_b"), F.col("side_a")).when(F.col("score_b") > F.col("score_a"), F.col("side_b")).alias("winner"),
        "legs", "roster_a", "roster_b",
        F.col("c_nationkey").cast("long").alias("event_id"),
        F.col("n_name").alias("event_name"),
        F.col("c_mktsegment").alias("family"),
        F.col("r_name").alias("region"),
        F.col("o_orderstatus").alias("stage"),
        F.when(F.col("c_nationkey") % 2 == 0, "international").otherwise("league").alias("level"),
        F.when(F.col("o_orderpriority").startswith("1"), "bo1").when(F.col("o_orderpriority").startswith("2"), "bo3").when(F.col("o_orderpriority").startswith("3"), "bo5").otherwise("unknown").alias("series_format"),
    )


def accepted(c: DataFrame) -> DataFrame:
    """Contests with a timestamp and a winner among their sides; only these move any state."""
    return c.where("ts_ms is not null and (winner = side_a or winner = side_b)")


#: The same adapter for DuckDB, as common table expressions; every SQL of this library begins with it.
SQL = """
WITH ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS r,
         row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k
  FROM lineitem
), sl AS (
  SELECT ranked.*, p_type FROM ranked LEFT JOIN part ON p_partkey = l_partkey WHERE r <= 2
), ab AS (
  SELECT l_orderkey AS contest_id, min(l_suppkey) FILTER (WHERE r = 1) AS side_a, min(l_suppkey) FILTER (WHERE r = 2) AS side_b,
         sum(l_quantity) FILTER (WHERE r = 1) AS score_a, sum(l_quantity) FILTER (WHERE r = 2) AS score_b
  FROM sl GROUP BY l_orderkey HAVING min(l_suppkey) FILTER (WHERE r = 2) IS NOT NULL
), c AS (
  SELECT ab.*, o_orderdate AS ts, CASE WHEN score_a > score_b THEN side_a WHEN score_b > score_a THEN side_b END AS winner,
         CAST(c_nationkey AS BIGINT) AS event_id, n_name AS event_name, c_mktsegment AS family, r_name AS region, o_orderstatus AS stage,
         CASE WHEN c_nationkey % 2 = 0 THEN 'international' ELSE 'league' END AS level,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'bo1' WHEN '2' THEN 'bo3' WHEN '3' THEN 'bo5' ELSE 'unknown' END AS series_format
  FROM ab JOIN orders ON o_orderkey = contest_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
), legs AS (
  SELECT a.l_orderkey AS contest_id, a.k AS leg, a.p_type AS name, coalesce(a.p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD'), false) AS recognized,
         a.l_quantity AS qa, b.l_quantity AS qb, (a.l_linestatus = 'F' AND b.l_linestatus = 'F') AS sp
  FROM sl a JOIN sl b ON a.l_orderkey = b.l_orderkey AND a.k = b.k WHERE a.r = 1 AND b.r = 2
), acc AS (
  SELECT * FROM c WHERE winner IS NOT NULL
), sides AS (
  SELECT contest_id, ts, 'A' AS side, side_a AS team, side_b AS opp, winner = side_a AS won, event_id, family, region, level FROM acc
  UNION ALL
  SELECT contest_id, ts, 'B', side_b, side_a, winner = side_b, event_id, family, region, level FROM acc
), ls AS (
  SELECT s.contest_id, s.side, s.team, s.ts, l.name, l.recognized, CASE WHEN s.side = 'A' THEN qa ELSE qb END AS own, CASE WHEN s.side = 'A' THEN qb ELSE qa END AS other, l.sp
  FROM sides s JOIN legs l USING (contest_id)
), lsum AS (
  SELECT contest_id, side, count(*) AS legs_played, count(*) FILTER (WHERE own > other) AS legs_won, sum(own) AS rounds_won, sum(other) AS rounds_lost,
         count(*) FILTER (WHERE NOT recognized) AS unknown_legs
  FROM ls GROUP BY 1, 2
), s AS (
  SELECT sides.*, coalesce(legs_played, 0) AS legs_played, coalesce(legs_won, 0) AS legs_won, coalesce(rounds_won, 0) AS rounds_won, coalesce(rounds_lost, 0) AS rounds_lost, coalesce(unknown_legs, 0) AS unknown_legs
  FROM sides LEFT JOIN lsum USING (contest_id, side)
)
"""
