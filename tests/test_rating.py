"""Ratings against a plain replay, and the traps of tie groups."""

import random
from statistics import median

import pytest

from agonix.functions.windows import with_last_rows
from agonix.operators import features as X
from agonix.operators import rating as R
from agonix.sources.contests import accepted, contests
from pyspark.sql import functions as F


def replay(rows):
    """contest_id -> elo_a, elo_b, median before it, one rating per team over all rows."""
    out, ratings, seen, i = {}, {}, [], 0
    rows = sorted(rows, key=lambda r: (r.ts_ms, r.contest_id))
    while i < len(rows):
        group = [r for r in rows[i:] if r.ts_ms == rows[i].ts_ms]
        mid = median(seen) if seen else 1500.0
        for r in group:
            out[r.contest_id] = (ratings.get(r.side_a, 1500.0), ratings.get(r.side_b, 1500.0), mid)
        for r in group:
            a, b = ratings.get(r.side_a, 1500.0), ratings.get(r.side_b, 1500.0)
            d = 24 * ((r.winner == r.side_a) - 1 / (1 + 10 ** ((b - a) / 400)))
            ratings[r.side_a], ratings[r.side_b] = a + d, b - d
            seen += out[r.contest_id][:2]
        i += len(group)
    return out


@pytest.mark.parametrize("slices", [1, 3, 20])
def test_elo_equals_a_replay(spark, sf, slices):
    c = contests(spark, sf)
    want = replay(accepted(c).select("ts_ms", "contest_id", "side_a", "side_b", "winner").collect())
    got = {r.contest_id: (r.elo_a, r.elo_b, r.median_elo) for r in R.elo(c, slices=slices).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_separate_groups_ties_and_rare_days(spark):
    """Sides that never meet, several contests in one timestamp, days without a contest; ratings after a contest."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a, b = rng.sample(range(10 * (i % 7), 10 * (i % 7) + 4), 2)
        rows.append((i, 40_000_000 * rng.choice([1, 2, 3, 50, 51, 90]), a, b, rng.choice([a, b])))
    c = spark.createDataFrame(rows, "contest_id long, ts_ms long, side_a long, side_b long, winner long")
    got = {r.contest_id: r for r in R.elo(c, slices=4).collect()}
    want = replay(c.collect())
    assert got.keys() == want.keys()
    assert all((got[k].elo_a, got[k].elo_b, got[k].median_elo) == pytest.approx(want[k]) for k in want)
    last = {}
    for i, t, a, b, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        last[a], last[b] = got[i].after_a, got[i].after_b
    final = {}
    for i, t, a, b, w in sorted(rows, key=lambda r: (r[1], r[0])):
        x, y = final.get(a, 1500.0), final.get(b, 1500.0)
        d = 24 * ((w == a) - 1 / (1 + 10 ** ((y - x) / 400)))
        final[a], final[b] = x + d, y - d
    assert last == pytest.approx(final)
    assert R.elo(c.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 9, 40])
def test_median_from_the_middle_values_alone(n):
    rng = random.Random(n)
    known = sorted(rng.choice([1500.0, rng.uniform(1000, 2000)]) for _ in range(n))
    new = [rng.choice([1500.0, rng.uniform(1000, 2000)]) for _ in range(12)]
    low, high = max(0, n // 2 - 13), min(n, n // 2 + 13)
    m = R.Median(known[low:high], low, n - high)
    for i, x in enumerate(new):
        seen = known + new[:i]
        assert m.value(7.0) == pytest.approx(median(seen) if seen else 7.0)
        m.add(x)


def test_connected_groups(spark):
    pairs = [(0, i, i + 1) for i in range(40) if i != 20] + [(1, 5, 3), (1, 3, 9), (1, 2, 2)]
    got = {(r.slice, r.team): r.group for r in R.connected(spark.createDataFrame(pairs, "slice int, a long, b long")).collect()}
    assert got == {(0, i): 0 if i <= 20 else 21 for i in range(41)} | {(1, 5): 3, (1, 3): 3, (1, 9): 3, (1, 2): 2}


def test_the_queries_keep_one_rating_per_team(spark, sf):
    from agonix.plans.registry import QUERIES

    rows = accepted(contests(spark, sf)).select("ts_ms", "contest_id", "side_a", "side_b", "winner").collect()
    want = replay(rows)
    got = {r.contest_id: (r.elo_a, r.elo_b, r.median_elo) for r in QUERIES["elo_ratings"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    met = {(r.contest_id, s): (t, r.ts_ms, want[r.contest_id][o]) for r in rows for s, t, o in (("A", r.side_a, 1), ("B", r.side_b, 0))}
    by = {}
    for team, ts, opp in met.values():
        by.setdefault(team, []).append((ts, opp))
    for r in QUERIES["opponent_strength"](spark, sf).collect():
        team, ts, _ = met[r.contest_id, r.side]
        before = [v for t, v in by[team] if t < ts]
        assert r.schedule_strength == pytest.approx(sum(before) / len(before) if before else 1500.0, abs=1e-5)


def test_last_rows_see_no_row_of_their_own_group(spark):
    df = spark.createDataFrame([(1, 0, 1, 1), (1, 10, 2, 2), (1, 10, 3, 4), (1, 20, 4, 8), (1, 20, 5, 16)], "team long, ts_ms long, contest_id long, v long")
    out = with_last_rows(df, {"s": (F.sum("v"), 2)}, ["team"], ["contest_id"]).orderBy("contest_id").collect()
    assert [r.s for r in out] == [None, 1, 1, 6, 6]


def test_later_rows_change_nothing_before(spark, sf):
    c = contests(spark, sf).cache()
    cut = c.agg(F.percentile("ts_ms", F.lit(0.5)).alias("m")).first().m
    early = X.record(X.sides(c.where(F.col("ts_ms") < cut))).select("contest_id", "side", "prior_wins", "win_rate")
    full = X.record(X.sides(c)).where(F.col("ts_ms") < cut).select("contest_id", "side", "prior_wins", "win_rate")
    assert early.exceptAll(full).count() == 0 == full.exceptAll(early).count()


def test_the_whole_feature_table(spark, sf):
    from agonix.plans.registry import QUERIES

    f = {r.contest_id: r for r in QUERIES["pre_contest_features_all"](spark, sf).collect()}
    want = replay(accepted(contests(spark, sf)).select("ts_ms", "contest_id", "side_a", "side_b", "winner").collect())
    assert f.keys() == want.keys()
    for k, (a, b, _) in want.items():
        assert (f[k].a_elo, f[k].b_elo, f[k].elo_p) == pytest.approx((a, b, 1 / (1 + 10 ** ((b - a) / 400))))
    for q in ("opponent_strength", "leg_pool", "rounds_splits", "roster_continuity", "player_experience"):
        for r in QUERIES[q](spark, sf).collect():
            for n, v in r.asDict().items():
                if n not in ("contest_id", "side", "team"):
                    got = f[r.contest_id][f"{r.side.lower()}_{n}"]
                    assert got == v or got == pytest.approx(v, abs=1e-5), (q, n)
    for r in QUERIES["leg_pool_overlap"](spark, sf).collect():
        assert f[r.contest_id].pool_overlap == r.pool_overlap


def state_at(rows, want, moment):
    """Ratings after all contests up to the moment, and per team the list of (opponent's rating, above the median, won)."""
    final, met = {}, {}
    for r in sorted((r for r in rows if r.ts_ms <= moment), key=lambda r: (r.ts_ms, r.contest_id)):
        a, b, mid = want[r.contest_id]
        x, y = final.get(r.side_a, 1500.0), final.get(r.side_b, 1500.0)
        d = 24 * ((r.winner == r.side_a) - 1 / (1 + 10 ** ((y - x) / 400)))
        final[r.side_a], final[r.side_b] = x + d, y - d
        met.setdefault(r.side_a, []).append((b, b > mid, r.winner == r.side_a))
        met.setdefault(r.side_b, []).append((a, a > mid, r.winner == r.side_b))
    return final, met


def test_matchups_as_of_a_moment(spark, sf):
    """The rating's columns against a replay: ties at the moment count, unseen sides are at the start."""
    from agonix.plans.registry import QUERIES

    rows = accepted(contests(spark, sf)).select("ts_ms", "contest_id", "side_a", "side_b", "winner").collect()
    want = replay(rows)
    got = {r.request_id: r for r in QUERIES["matchup_asof_rating"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for r in random.Random(5).sample(rows, 150):
        final, met = state_at(rows, want, r.ts_ms + (864_000_000 if r.contest_id % 3 == 0 else 0))
        b = -r.side_b if r.contest_id % 10 == 0 else r.side_b
        for p, team in zip("ab", (b, r.side_a) if r.contest_id % 2 else (r.side_a, b), strict=True):
            opp = met.get(team, [])
            mean = lambda v: sum(v) / len(v) if v else 1500.0
            assert got[r.contest_id][f"{p}_elo"] == pytest.approx(final.get(team, 1500.0), abs=1e-5)
            assert got[r.contest_id][f"{p}_avg_opp_elo_last5"] == pytest.approx(mean([x for x, _, _ in opp][-5:]), abs=1e-5)
            assert got[r.contest_id][f"{p}_schedule_strength"] == pytest.approx(mean([x for x, _, _ in opp]), abs=1e-5)
            assert got[r.contest_id][f"{p}_wins_above_median"] == sum(up and won for _, up, won in opp)
            assert got[r.contest_id][f"{p}_losses_below_median"] == sum(not up and not won for _, up, won in opp)


def test_a_request_reads_and_never_counts(spark, sf):
    """Asked twice, alone and among others, a request has the same answer; without history both sides are at the start."""
    from agonix.operators.asof import matchup_asof

    c = accepted(contests(spark, sf)).cache()
    a, b, t = (c.agg(F.max(x)).first()[0] for x in ("side_a", "side_b", "ts_ms"))
    ask = lambda i, x, y, t: (i, t, x, y, "league", "ASIA", "MACHINERY", "Best of 3")
    rows = [ask(1, a, b, t), ask(2, a, b, t), ask(3, b, a, t - 1), ask(4, -1, -2, t), ask(5, a, -1, 0)]
    schema = "request_id long, as_of_ms long, side_a long, side_b long, level string, region string, family string, series_format string"
    ratings = R.elo(c)
    many = {r.request_id: r.asDict() for r in matchup_asof(c, spark.createDataFrame(rows, schema), ratings).collect()}
    one = matchup_asof(c, spark.createDataFrame(rows[:1], schema), ratings).first().asDict()
    assert many[1] == one and many[2] == one | {"request_id": 2} and one["series_format"] == "bo3"
    assert many[4]["a_is_cold_start"] and many[4]["a_elo"] == many[4]["b_elo"] == 1500 and many[4]["elo_p"] == 0.5 and many[4]["h2h_last_winner"] == "unknown"
    assert many[5]["a_prior_contests"] == 0 and many[5]["a_days_since_last"] is None
    assert many[4]["a_last5_win_rate"] == 0.5 and many[1]["a_prior_contests"] > 0 and many[1]["a_roster_size"] == 0
