"""Sequential ratings, spread over tasks.

A rating depends on all earlier ones of both sides, so it is no window. Time is cut into slices of about equal size, at
the bounds of days. Within a slice, sides that meet directly or through others form a connected group; groups don't touch
each other, so each is one ordered pass over its contests, and all groups of a slice run in parallel. The ratings a slice
ends with are a table that the next slice joins. No task ever has more than one slice of the contests, and it holds the
ratings of its group's sides only.

The running median of all ratings so far is exact and takes no ordered pass over everything. It has time slices of its own,
of a fixed size (BLOCK contests), so that a task holds no more when there are more contests: a slice moves the median by at
most half as many ranks as it has values, and its task needs, of everything before, only the values whose rank lies that
close to the middle. Counts by slice and bin of values say where these are.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.functions.windows import DAY_MS, prior, rate, with_last_rows
from agonix.sources.contests import accepted

START, K, SCALE = 1500.0, 24.0, 400.0
SLICES = 8
#: Contests in a task's medians, pairs in a task's forest.
BLOCK, PART = 100_000, 500_000


def expected(own: float, other: float) -> float:
    """Logistic win probability of a rating difference."""
    return 1.0 / (1.0 + 10.0 ** ((other - own) / SCALE))


class Median:
    """Exact running median of values that are added, after ``below`` values under and ``above`` values over ``known``."""

    def __init__(self, known: list[float] = (), below: int = 0, above: int = 0):
        known = sorted(known)
        half = (below + len(known) + above) // 2 - below
        self.low, self.high = [-x for x in known[:half]], known[half:]
        heapq.heapify(self.low)
        self.below, self.above = below, above

    def add(self, x: float) -> None:
        if self.high and x >= self.high[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        while self.below + len(self.low) > self.above + len(self.high):
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while self.above + len(self.high) > self.below + len(self.low) + 1:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self, empty: float) -> float:
        n, m = self.below + len(self.low), self.above + len(self.high)
        if n + m == 0:
            return empty
        return self.high[0] if m > n else (self.high[0] - self.low[0]) / 2


_RATED = ["contest_id", "ts_ms", "side_a", "side_b", "elo_a", "elo_b", "after_a", "after_b"]


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, ts_ms, contest_id, side_a, side_b, a_won, elo) sorted by group, ts_ms and contest_id: what each contest's
    sides were rated before their timestamp group, and right after the contest; within a timestamp group results count one
    after another. A row without contest_id gives the rating that side_a comes with; such rows, with after_a, also end a group."""
    group, now, ratings, before, out = None, None, {}, {}, []

    def full() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(_RATED)
        types = [pa.int64()] * 4 + [pa.float64()] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_RATED)
        out.clear()
        return batch

    for batch in batches:
        for g, t, c, a, b, won, x in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if g != group:
                out += [(None, None, team, None, None, None, v, None) for team, v in ratings.items()]
                group, now, ratings, before = g, t, {}, {}
            if c is None:
                ratings[a] = x
                continue
            if t != now:
                now, before = t, {}
            ra, rb = ratings.get(a, START), ratings.get(b, START)
            e = expected(ra, rb)
            na, nb = ra + K * (won - e), rb + K * ((1.0 - won) - (1.0 - e))
            out.append((c, t, a, b, before.setdefault(a, ra), before.setdefault(b, rb), na, nb))
            ratings[a], ratings[b] = na, nb
            if len(out) >= 10_000:
                yield full()
    out += [(None, None, team, None, None, None, v, None) for team, v in ratings.items()]
    yield full()


def time_slices(c: DataFrame, slices: int) -> DataFrame:
    """``c`` with ``slice``: days in order, about as many rows in each slice. One row a day is counted and broadcast."""
    day = F.floor(F.col("ts_ms") / DAY_MS)
    days = c.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_day", F.floor(before * slices / F.sum("_n").over(Window.partitionBy())).cast("int").alias("slice"))
    return c.join(F.broadcast(days), day == F.col("_day")).drop("_day")


def _settled(e: DataFrame) -> bool:
    """Whether every larger end has one edge, to a team that is nowhere a larger end."""
    end = lambda c, up: e.select("slice", F.col(c).alias("x"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = end("u", 1).unionByName(end("v", 0)).groupBy("slice", "x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up > 0 and down > 0").isEmpty()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, a, b) -> (slice, team, root): the smallest team that each team reaches over this task's pairs."""
    trees: dict[int, dict[int, int]] = {}

    def root(up: dict[int, int], x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for k, a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            up = trees.setdefault(k, {})
            x, y = root(up, a), root(up, b)
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
    for k, up in trees.items():
        teams = [*up]
        for at in range(0, len(teams), 10_000):
            part = teams[at : at + 10_000]
            columns = pa.array([k] * len(part), pa.int32()), pa.array(part, pa.int64()), pa.array([root(up, x) for x in part], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns], names=["slice", "team", "root"])


def connected(pairs: DataFrame, parts: int = 4) -> DataFrame:
    """(slice, a, b) -> (slice, team, group): the smallest team that each team is connected to within its slice.

    Each of ``parts`` tasks leaves a forest of its pairs, at most one edge per slice and team. Large-star and small-star steps
    in turn join the forests; the rounds grow with the logarithm of the longest path, each is a table."""
    up = lambda df: df.select("slice", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    whole = pairs.select(F.col("slice").cast("int").alias("slice"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    spread = whole.repartition(parts, "slice", F.pmod(F.xxhash64(F.least("a", "b")), F.lit(parts)))
    forest = stored(spread.mapInArrow(_forest, "slice int, team long, root long"), "forests")
    e = stored(up(forest.withColumnsRenamed({"team": "a", "root": "b"})), "pairs")
    alone = forest.select("slice", "team").distinct()
    while not _settled(e):
        both = e.unionByName(e.select("slice", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("slice", "u").agg(F.min("v").alias("m")).select("slice", "u", F.least("u", "m").alias("m"))
        large = both.join(low, ["slice", "u"]).where("v > u").select("slice", F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("slice", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["slice", "u"]).where("v <> m").select("slice", F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("slice", "u", F.col("m").alias("v"))).distinct(), "pairs")
    return alone.join(e.select("slice", F.col("u").alias("team"), F.col("v").alias("group")), ["slice", "team"], "left").withColumn("group", F.coalesce("group", "team"))


def _ratings(c: DataFrame, slices: int, total: int) -> DataFrame:
    """contest_id, ts_ms, side_a, side_b, elo_a, elo_b, after_a, after_b of the ``total`` contests, a slice at a time. The
    ratings that groups of earlier slices ended with are rows before the contests of a later group."""
    most = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = time_slices(c, slices)
    groups = stored(connected(rows.select("slice", F.col("side_a").alias("a"), F.col("side_b").alias("b")), slices * (1 + total // slices // PART)), "groups", by="slice")
    rows = rows.join(groups.withColumnRenamed("team", "side_a"), ["slice", "side_a"]).withColumn("elo", F.lit(None).cast("double"))
    rows = stored(rows.select("slice", "group", "ts_ms", "contest_id", "side_a", "side_b", "a_won", "elo"), "contests", by="slice")
    done: list[DataFrame] = []
    for k in range(slices):
        own = F.col("slice") == k
        ready = rows.where(own).select("group", "ts_ms", "contest_id", "side_a", "side_b", "a_won", "elo")
        for j, ended in enumerate(done):
            last = ended.where("contest_id is null").select(F.lit(j - (1 << 62)).alias("ts_ms"), "side_a", F.col("after_a").alias("elo"))
            ready = ready.unionByName(last.join(groups.where(own).select(F.col("team").alias("side_a"), "group"), "side_a"), allowMissingColumns=True)
        ready = ready.repartition(max(1, min(most, total // slices // 20_000)), "group").sortWithinPartitions("group", "ts_ms", "contest_id")
        rated = ready.mapInArrow(_rate, "contest_id long, ts_ms long, side_a long, side_b long, elo_a double, elo_b double, after_a double, after_b double")
        done.append(stored(rated, "rated"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.where("contest_id is not null")


def _windows(count: pa.Table) -> tuple[dict[int, tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """From rows (slice, bin, n): per slice the number of earlier values, the ranks among them that can become the middle, and
    the number of values below the bins of these ranks; and (slice, first bin, last bin).

    A slice of n values moves the middle by n / 2 ranks at most."""
    of, at, n = (np.asarray(count.column(i)) for i in range(3))
    slices, row = np.unique(of, return_inverse=True)
    bins, column = np.unique(at, return_inverse=True)
    own = np.zeros((len(slices), len(bins)), np.int64)
    own[row, column] = n
    earlier = np.cumsum(own, axis=0) - own
    bounds, ranges = {}, []
    for k, mine, before in zip(slices.tolist(), own.sum(axis=1).tolist(), earlier, strict=True):
        upto = np.cumsum(before)
        total = int(upto[-1])
        low, high = max(0, total // 2 - mine // 2 - 2), min(total, total // 2 + mine // 2 + 2)
        first, last = int(np.searchsorted(upto, low, "right")), int(np.searchsorted(upto - before, high, "left")) - 1
        bounds[k] = (total, low, high, int(upto[first - 1]) if first else 0)
        if total:
            ranges.append((k, int(bins[first]), int(bins[last])))
    return bounds, ranges


def _medians(rated: DataFrame, blocks: int) -> DataFrame:
    """contest_id, median_elo: the median of both sides' ratings over all earlier timestamp groups."""
    spark = rated.sparkSession
    rated = time_slices(rated.select("contest_id", "ts_ms", "elo_a", "elo_b"), blocks)
    bin_ = F.floor(F.lit(4096.0) / (1 + F.exp((F.lit(START) - F.col("v")) / 60)))  # in order of the values, narrow around START
    value = rated.select("slice", F.explode(F.array("elo_a", "elo_b")).alias("v")).withColumn("bin", bin_)
    bounds, ranges = _windows(value.groupBy("slice", "bin").agg(F.count(F.lit(1)).alias("n")).toArrow())  # blocks x bins
    near = spark.createDataFrame(ranges, "k int, low long, high long").select("k", F.explode(F.sequence("low", "high")).alias("bin"))
    known = value.join(F.broadcast(near), "bin").where("slice < k")  # at most blocks x bins
    known = known.select(F.col("k").alias("slice"), F.lit(-(1 << 62)).alias("ts_ms"), F.lit(None).cast("long").alias("contest_id"), F.col("v").alias("elo_a"), F.lit(None).cast("double").alias("elo_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, moment, values, held, mid, m, ids, medians = None, None, array("d"), [], None, START, [], []

        def begin() -> Median:
            """The values whose rank can become the middle."""
            total, low, high, below = bounds[now]
            return Median(np.sort(np.frombuffer(values))[low - below : high - below].tolist(), low, total - high)

        for batch in batches:
            for k, t, c, a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if k != now:
                    now, moment, values, held, mid = k, None, array("d"), [], None
                if c is None:  # the known values come first
                    values.append(a)
                    continue
                if t != moment:
                    mid = mid or begin()
                    for x in held:
                        mid.add(x)
                    moment, held, m = t, [], mid.value(START)
                held += (a, b)
                ids.append(c)
                medians.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(medians, pa.float64())], names=["contest_id", "median_elo"])
            ids, medians = [], []

    ordered = rated.select(*known.columns).unionByName(known).repartition(blocks, "slice").sortWithinPartitions("slice", "ts_ms", "contest_id")
    return ordered.mapInArrow(run, "contest_id long, median_elo double")


def elo(c: DataFrame, median: bool = True, slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """contest_id, elo_a, elo_b (before each accepted contest's timestamp group), after_a, after_b (once it counts) and
    median_elo: one rating per team over all history, whatever the number of slices. ``block``: contests a task takes the
    medians of.

    Runs when called: each slice is a table that the next one reads."""
    c = stored(accepted(c).select("ts_ms", "contest_id", "side_a", "side_b", (F.col("winner") == F.col("side_a")).cast("double").alias("a_won")), "results")
    total = c.count()
    if not total:
        return c.select("contest_id", *[F.lit(START).alias(n) for n in ("elo_a", "elo_b", "after_a", "after_b", "median_elo")])
    rated = _ratings(c, slices, total)
    out = rated.select("contest_id", "elo_a", "elo_b", "after_a", "after_b")
    return out.join(_medians(rated, max(SLICES, 1 + total // block)), "contest_id") if median else out.withColumn("median_elo", F.lit(None).cast("double"))


def elo_p(difference: Column) -> Column:
    """Logistic win probability of a rating difference, as a column."""
    return 1 / (1 + F.pow(F.lit(10.0), -difference / SCALE))


def with_elo(c: DataFrame, **options) -> DataFrame:
    """The accepted contests with both ratings, the win probability of A and the difference."""
    diff = F.col("elo_a") - F.col("elo_b")
    return accepted(c).join(elo(c, **options), "contest_id").withColumns({"elo_diff": diff, "elo_p": elo_p(diff)})


STRENGTH = [*[f"avg_opp_{n}_last{k}" for n in ("elo", "rate") for k in (5, 10)], "schedule_strength", "wins_above_median", "losses_below_median"]


def opponent_strength(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """Average rating and win rate of recent opponents, frozen when met, and wins and losses against the median of all ratings:
    contest_id, side, team, elo and STRENGTH.

    sides: with win_rate (operators.features.record); ratings: elo(). Only the columns used are shuffled, and no side row meets
    itself: win rates fold to one row a contest, which brings the opponent's."""
    a = F.col("side") == "A"
    met = sides.groupBy("contest_id").agg(F.max(F.when(a, F.col("win_rate"))).alias("_rate_a"), F.max(F.when(~a, F.col("win_rate"))).alias("_rate_b"))
    s = sides.select("contest_id", "side", "team", "ts_ms", "won").join(ratings, "contest_id").join(met, "contest_id")
    pick = lambda x, y: F.when(a, F.col(x)).otherwise(F.col(y))
    s = s.select("contest_id", "side", "team", "ts_ms", "won", pick("elo_a", "elo_b").alias("elo"), pick("elo_b", "elo_a").alias("opp_elo"), pick("_rate_b", "_rate_a").alias("opp_rate"), (pick("elo_b", "elo_a") > F.col("median_elo")).alias("above"))
    s = with_last_rows(s, {f"{n}{k}": (F.avg(v), k) for n, v in (("avg_opp_elo_last", "opp_elo"), ("avg_opp_rate_last", "opp_rate")) for k in (5, 10)}, ["team"], ["contest_id", "side"])
    w = prior("team")
    won = F.col("won")
    s = s.withColumns({
        **{f"avg_opp_elo_last{k}": F.coalesce(f"avg_opp_elo_last{k}", F.lit(START)) for k in (5, 10)},
        **{f"avg_opp_rate_last{k}": F.coalesce(f"avg_opp_rate_last{k}", F.lit(0.5)) for k in (5, 10)},
        "schedule_strength": rate(F.sum("opp_elo").over(w), F.count("opp_elo").over(w), START),
        "wins_above_median": F.count_if(won & F.col("above")).over(w),
        "losses_below_median": F.count_if(~won & ~F.col("above")).over(w),
    })
    return s.select("contest_id", "side", "team", "elo", *STRENGTH)
