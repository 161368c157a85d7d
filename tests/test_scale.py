"""What a task holds must not grow with the whole history; the results stay those of plain loops."""

import random
import re
from statistics import median

import pyarrow as pa
import pytest

from agonix.operators import asof
from agonix.operators import features as X
from agonix.operators import ml as ML
from agonix.operators import rating as R
from pyspark.ml.linalg import Vectors

DAY = 86_400_000


def test_medians_of_small_blocks_equal_a_replay(spark):
    rng = random.Random(3)
    rows = [(i, DAY * rng.randrange(40) + rng.randrange(3), *rng.sample(range(12), 2)) for i in range(300)]
    rated = spark.createDataFrame([(*r, 1500.0 if r[1] < 3 * DAY else rng.uniform(1300, 1700), rng.uniform(1490, 1510)) for r in rows], "contest_id long, ts_ms long, side_a long, side_b long, elo_a double, elo_b double")
    values = [(r.contest_id, r.ts_ms, r.elo_a, r.elo_b) for r in rated.collect()]
    got = {r.contest_id: r.median_elo for r in R._medians(rated, 17).collect()}
    for c, t, _, _ in values:
        before = [v for _, s, *own in values if s < t for v in own]
        assert got[c] == pytest.approx(median(before) if before else 1500.0)


def test_a_block_needs_no_more_values_than_it_has(spark):
    """Ten blocks of 1000 values over 500 bins: the ranks that a task gets are as many as its own values, not the history's."""
    rows = [(k, b, 2) for k in range(10) for b in range(500)]
    bounds, ranges = R._windows(pa.table({k: list(v) for k, v in zip(("slice", "bin", "n"), zip(*rows, strict=True), strict=True)}))
    for k, (total, low, high, below) in bounds.items():
        assert total == 1000 * k and high - low <= 1000 + 5 and low <= total // 2 <= high and below <= low
    assert [k for k, _, _ in ranges] == [*range(1, 10)]
    assert all((last - first + 1) * 2 * k <= 1000 + 5 + 4 * k for k, first, last in ranges)


def test_tasks_leave_forests_of_their_pairs(spark):
    pairs = spark.createDataFrame([(i % 2, a, b) for i in range(4) for a in range(30) for b in range(30)], "slice int, a long, b long")
    got = {(r.slice, r.team): r.group for r in R.connected(pairs, 3).collect()}
    assert got == {(k, a): 0 for k in range(2) for a in range(30)}


def test_event_counts_lie_in_time_slots(spark):
    rng = random.Random(2)
    rows = [(i, 1, 2, 1, e, DAY * rng.randrange(-4, 12) + rng.choice([0, 0, 1, DAY - 1])) for i, e in enumerate(rng.choice([7, 7, 8, None]) for _ in range(200))]
    c = spark.createDataFrame(rows, "contest_id long, side_a long, side_b long, winner long, event_id long, ts_ms long")
    out = X.event_congestion(c)
    got = {r.contest_id: r.event_contests_last3d for r in out.collect()}
    assert got == {i: sum(f == e and t - 3 * DAY <= u < t for _, _, _, _, f, u in rows) for i, _, _, _, e, t in rows}
    keys = re.findall(r"windowspecdefinition\(([^)]*?) ASC", out._jdf.queryExecution().optimizedPlan().toString())
    assert keys and all("_slot" in k for k in keys)


def test_unrated_matchups_make_no_ratings(spark, sf, monkeypatch):
    from agonix.plans.registry import QUERIES

    def none(*_, **__):
        raise AssertionError("ratings were made")

    monkeypatch.setattr(asof, "elo", none)
    assert QUERIES["matchup_evidence"](spark, sf).count() > 0


def test_side_windows_carry_no_legs(spark, sf):
    from agonix.sources.contests import contests

    s = X.leg_pool(X.sides(contests(spark, sf))).select("contest_id", "side", "leg_breadth", "leg_entropy")
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Window ", line)]
    assert below and not any("recognized" in line for line in below)


def test_partners_are_found_by_ids_alone(spark):
    """No window over the orders has the vectors among its rows; every row is some row's partner once."""
    rows = [(i, float(i % 2), Vectors.dense([float(i), float(i * i)])) for i in range(200)]
    p = ML.shuffled_partners(spark.createDataFrame(rows, ["contest_id", "y", "features"]), 3)
    got = p.collect()
    assert sorted(r.contest_id for r in got) == [*range(200)] == sorted(int(r.other[0]) for r in got)
    lines = p._jdf.queryExecution().optimizedPlan().toString().splitlines()
    under = [lines[i + 1] for i, line in enumerate(lines) if re.match(r"[\s:|+-]*Window ", line)]
    assert under and not any("features" in line for line in under)
