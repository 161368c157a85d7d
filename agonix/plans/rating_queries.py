"""Queries of sequential ratings. A fold over all earlier results has no plain SQL; the tests replay it."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.operators import features as X
from agonix.operators import rating as R
from agonix.sources.contests import contests

from .base import query


@query("elo_ratings")
def q_elo(spark, sf_dir):
    """One rating per team over all its history."""
    diff = F.col("elo_a") - F.col("elo_b")
    e = R.elo(contests(spark, sf_dir)).withColumns({"elo_diff": diff, "elo_p": R.elo_p(diff)})
    return e.select("contest_id", *[F.round(c, 6).alias(c) for c in ("elo_a", "elo_b", "median_elo", "elo_diff", "elo_p")])


@query("opponent_strength")
def q_strength(spark, sf_dir):
    c = contests(spark, sf_dir)
    s = R.opponent_strength(X.record(X.sides(c)), R.elo(c))
    return s.select("contest_id", "side", "team", *[F.round(f"avg_opp_{k}_last{n}", 6).alias(f"avg_opp_{k}_last{n}") for k in ("elo", "rate") for n in (5, 10)], F.round("schedule_strength", 6).alias("schedule_strength"), "wins_above_median", "losses_below_median")
