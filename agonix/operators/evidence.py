"""What stands behind a predicted pairing: how much evidence there is, whom each factor favours, what drove the probability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contests and meetings from which more add no trust, the weight of meetings, contests for leg evidence.
CONTESTS, MEETINGS, MEETING_WEIGHT = 20, 5, 0.1
SUFFICIENT, LIMITED = 10, 3
IDENTITY = {"verified": 1.0, "provisional": 0.5}
#: Factors beside the estimator: the column of each side; the side with more is favoured, for rest the one with fewer days.
FACTORS = {"recent-form": "last10_win_rate", "opponent-adjusted-strength": "avg_opp_elo_last10", "leg-pool-breadth": "leg_breadth", "schedule-strength": "schedule_strength", "activity-rest": "days_since_last", "competition-experience": None}


def favoured(a, b):
    """A, B or even."""
    return F.when(a > b, "A").when(b > a, "B").otherwise("even")


def favoured_by_rest(a, b):
    """The side that played last; one that never played is never favoured."""
    return F.when(a.isNull() & b.isNull(), "even").when(a.isNull(), "B").when(b.isNull(), "A").otherwise(favoured(b, a))


def supporting_factors(f: DataFrame, factors: list[str] | None = None) -> DataFrame:
    """request_id, factor, a, b, favoured: one row per request and factor. Days since the last contest are -1 without any.

    f: rows of asof.matchup_asof()."""
    rows = []
    for name in factors or [*FACTORS]:
        col = FACTORS[name]
        a, b = ((F.col(f"{p}_{col}") if col else F.col(f"{p}_international_appearances") + F.col(f"{p}_major_appearances")).cast("double") for p in "ab")
        side = favoured_by_rest(a, b) if name == "activity-rest" else favoured(a, b)
        none = F.lit(-1.0)
        rows.append(F.struct(F.lit(name).alias("factor"), F.coalesce(a, none).alias("a"), F.coalesce(b, none).alias("b"), side.alias("favoured")))
    return f.select("request_id", F.explode(F.array(*rows)).alias("x")).select("request_id", "x.*")


def evidence_trust(f: DataFrame, confidence: DataFrame) -> DataFrame:
    """request_id, trust (0-100, from identities, contests in the window and meetings; nothing the probability depends on) and
    leg_evidence (sufficient, limited, none). confidence: team, confidence, contests; teams without a row have nothing."""
    side = lambda p: confidence.select(F.col("team").alias(f"side_{p}"), F.col("confidence").alias(f"_c{p}"), F.col("contests").alias(f"_n{p}"))
    x = f.join(side("a"), "side_a", "left").join(side("b"), "side_b", "left")
    n = {p: F.coalesce(f"_n{p}", F.lit(0)) for p in "ab"}

    def of(p: str):
        identity = F.lit(0.0)
        for k, v in IDENTITY.items():
            identity = F.when(F.col(f"_c{p}") == k, v).otherwise(identity)
        return (identity + F.least(F.lit(1.0), n[p] / F.lit(float(CONTESTS)))) / 2

    bonus = F.least(F.lit(1.0), F.col("h2h_meetings") / F.lit(float(MEETINGS))) * MEETING_WEIGHT
    score = F.floor(F.round(F.least(F.lit(100.0), ((of("a") + of("b")) / 2 + bonus) * 100), 9) + 0.5)
    least = F.least(n["a"], n["b"])
    return x.select("request_id", score.alias("trust"), F.when(least >= SUFFICIENT, "sufficient").when(least >= LIMITED, "limited").otherwise("none").alias("leg_evidence"), n["a"].alias("a_contests"), n["b"].alias("b_contests"), F.col("h2h_meetings").alias("meetings"))


def contribution(pred: DataFrame, family: str) -> DataFrame:
    """What drove each probability: the rating's difference and probability, what calibration or another estimator added, the
    final one, and whether the rating alone drove it. pred: request_id, elo_diff, elo_p, p."""
    alone = family == "elo"
    driver = "rating difference" if alone else f"{family} estimator"
    return pred.select("request_id", F.lit(driver).alias("driver"), F.col("elo_diff").alias("differential"), F.col("elo_p").alias("uncalibrated"), (F.col("p") - F.col("elo_p")).alias("adjustment"), F.col("p").alias("final"), F.lit(alone).alias("sole_driver"))
