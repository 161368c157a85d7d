"""Area under the curve by range partitions and bootstrap by partial sums, against brute force."""

import random

import numpy as np
import pytest

from agonix.functions.windows import with_running_sum
from agonix.operators import metrics as M


def area(rows):
    pos, neg = [p for p, y in rows if y == 1], [p for p, y in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("scores", [[0.1, 0.5, 0.9], [i / 997 for i in range(998)], [0.5]])
def test_area_with_ties_and_groups(spark, scores):
    rng = random.Random(len(scores))
    rows = [(g, rng.choice(scores), int(rng.random() < (0.0 if g == "none" else 0.4))) for g in ("x", "y", "none", None) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, p double, y int").repartition(3)
    got = {r.g: r.auc for r in M.roc_auc(df, ["g"]).collect()}
    assert got.keys() == {"x", "y", "none", None} and got["none"] is None
    for g in ("x", "y", None):
        assert got[g] == pytest.approx(area([(p, y) for k, p, y in rows if k == g]))
    assert M.roc_auc(df).first().auc == pytest.approx(area([(p, y) for _, p, y in rows]))
    assert M.roc_auc(df.limit(0)).first().auc is None
    bundle = {r.g: r for r in M.metric_bundle(df, ["g"]).collect()}
    assert {g: bundle[g].auc for g in bundle} == got and bundle["x"].n == 120


def test_running_sum_needs_no_single_partition(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 AS k", "1 AS v")
    out = with_running_sum(df, "v", ["k"], ["id"], "upto").collect()
    assert all(r.upto == r.id // 2 + 1 for r in out) and len(out) == 1000
    plan = with_running_sum(df, "v", [], ["id"], "upto")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


def test_bootstrap_equals_whole_resamples(spark):
    """The bounds are those of resamples drawn row by row with the same weights, and tasks give one row per resample."""
    rows = [(i, (i % 10) / 10 + 0.05, int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "contest_id long, p double, y int")
    w = np.stack([np.random.Generator(np.random.Philox(key=[i, 9])).poisson(1.0, 500) for i, _, _ in rows]).astype(float)
    v = np.array([(p - y) ** 2 for _, p, y in rows])
    each = np.sort(w.T @ v / w.sum(0))
    got = {r.metric: (r.low, r.high) for r in M.bootstrap(df, iterations=500, seed=9).collect()}
    assert got["brier"] == pytest.approx((each[round(0.025 * 499)], each[round(0.975 * 499)]))
    assert {r.metric: (r.low, r.high) for r in M.bootstrap(df.repartition(7), iterations=500, seed=9).collect()} == {k: pytest.approx(x) for k, x in got.items()}
