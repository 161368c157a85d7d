"""Upserts as a stream, versions, ledgers, exports, and contracts."""

import random

import pytest

from agonix.operators import lifecycle as L
from agonix.operators import metrics as M
from agonix.operators import ml as ML
from agonix.operators import quality as Q
from agonix.streaming.upserts import FANOUT, _runs, latest, stream_upserts, upsert_batch
from pyspark.sql import functions as F


def test_stream_upserts_and_reruns(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, seen int").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream_upserts(spark, src, schema, ["k"], out, ck, volatile=["seen"])
    spark.createDataFrame([(1, "a", 9), (2, "c", 9), (3, "d", 9)], "k long, v string, seen int").coalesce(1).write.mode("append").parquet(src)
    stream_upserts(spark, src, schema, ["k"], out, ck, volatile=["seen"])
    n = spark.read.parquet(out).count()
    assert {(r.k, r.v, r.seen) for r in latest(spark, out, ["k"]).collect()} == {(1, "a", 0), (2, "c", 9), (3, "d", 9)}
    stream_upserts(spark, src, schema, ["k"], out, ck, volatile=["seen"])
    assert n == 4 == spark.read.parquet(out).count()


def test_many_batches_equal_a_replay(spark, tmp_path):
    """Repeated keys in a batch, levels merged several times, a batch run again."""
    rng, out, held = random.Random(4), str(tmp_path / "t"), {}
    schema = "k long, g string, v string, at int"
    for n in range(18):
        rows = [(rng.randrange(60), rng.choice("ab"), rng.choice("xyz"), n) for _ in range(25)]
        batch = spark.createDataFrame(rows, schema)
        upsert_batch(batch, n, ["k", "g"], out, volatile=["at"], order=["v"])
        if n in (3, 7, 15):  # as after a failure
            upsert_batch(batch, n, ["k", "g"], out, volatile=["at"], order=["v"])
        for k, g in {r[:2] for r in rows}:
            v = max(r[2] for r in rows if r[:2] == (k, g))
            if held.get((k, g), (None,))[0] != v:
                held[k, g] = (v, n)
    assert {(r.k, r.g): (r.v, r.at) for r in latest(spark, out, ["k", "g"]).collect()} == held
    runs = _runs(spark, out)
    assert [r[0] for r in runs] == [2, 0, 0] and len(runs) <= 3 * FANOUT


def test_of_repeated_keys_the_same_row_stays(spark, tmp_path):
    rows = [(1, v) for v in "cab"]
    kept = set()
    for i, order in enumerate((rows, rows[::-1])):
        upsert_batch(spark.createDataFrame(order, "k long, v string"), 0, ["k"], str(tmp_path / str(i)))
        kept.add(latest(spark, str(tmp_path / str(i)), ["k"]).first().v)
    assert len(kept) == 1
    upsert_batch(spark.createDataFrame([], "k long, v string"), 1, ["k"], str(tmp_path / "0"))
    assert latest(spark, str(tmp_path / "0"), ["k"]).count() == 1 and latest(spark, str(tmp_path / "none"), ["k"]) is None


def test_version_ignores_order_and_omitted_columns(spark):
    a = spark.createDataFrame([(i, f"x{i}", i * 7) for i in range(50)], "k long, v string, at long")
    v = lambda df: L.dataset_version(df, ["1"], ["at"]).first()
    assert v(a) == v(a.orderBy(F.desc("k")).withColumn("at", F.lit(0)))
    assert v(a).version != v(a.withColumn("v", F.when(F.col("k") == 3, "y").otherwise(F.col("v")))).version
    assert v(a).version != L.dataset_version(a, ["2"], ["at"]).first().version
    assert L.dataset_version(a.where("false"), ["1"]).first().n == 0


def test_write_frames_counts_and_sorts(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g long, k long")
    L.write_frames({"rows": df}, str(tmp_path / "o"), sort={"rows": ["k"]}, partition={"rows": ["g"]})
    assert spark.read.parquet(str(tmp_path / "o/rows")).count() == 30
    assert spark.read.parquet(str(tmp_path / "o/manifest")).first().n == 30


def test_contract_splits_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k long, x double")
    good, bad = Q.validate_contract(df, ["x"], "k")
    assert [r.k for r in good.collect()] == [1] and sorted(r.k for r in bad.collect()) == [2, 3]
    ok, out = L.unlabelled(df.withColumnRenamed("k", "contest_id"), ["x"], ["contest_id"])
    assert ok.count() == 1 and out.count() == 2


def test_empty_tables(spark):
    e = spark.createDataFrame([], "contest_id long, ts_ms long, p double, y int")
    assert M.probability_metrics(e).first().log_loss == 0
    assert M.bootstrap(e).count() == 0
    assert M.reliability(e).count() == 10


def test_selection_rules():
    assert ML.pick_best([("a", 0.5), ("b", 0.5)]) == "a"
    assert ML.select_family({"elo": 0.6, "logistic": 0.61, "trees": 0.65}) == "elo"
    assert ML.select_family({"elo": 0.7, "logistic": 0.604, "trees": 0.6}) == "logistic"
    assert ML.select_family({"elo": 0.7, "logistic": 0.65, "trees": 0.6}) == "trees"


def test_prep_uses_train_rows_alone(spark):
    train = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, "a")], "contest_id long, x double, c string")
    policy = {"numeric": ["x"], "boolean": [], "categorical": ["c"]}
    p = ML.fit_prep(train, policy)
    assert p["median"]["x"] == 2.0 and p["missing"] == ["x"] and p["vocabulary"]["c"] == ["a", "b"]
    row = ML.apply_prep(spark.createDataFrame([(9, None, "zzz")], train.schema), p, ["contest_id"]).first()
    assert list(row.features) == pytest.approx([0.0, 1.0, 0.0, 0.0, 1.0])


def test_ranges_across_the_year(spark):
    from agonix.operators.normalize import parse_range

    df = spark.createDataFrame([("Dec 5 - Jan 1, 2026",), ("Jan 15 - Feb 9, 2026",), ("Dec 5 - 9, 2026",)], "raw string")
    assert [(str(r.x.start), str(r.x.end)) for r in df.select(parse_range(F.col("raw")).alias("x")).collect()] == [("2025-12-05", "2026-01-01"), ("2026-01-15", "2026-02-09"), ("2026-12-05", "2026-12-09")]


def test_bootstrap_bounds_and_paired_differences(spark):
    rows = [(i, float(i % 10) / 10 + 0.05, int(i % 3 == 0), 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "contest_id long, p double, y int, elo_p double")
    got = {r.metric: (r.low, r.high) for r in M.bootstrap(df).collect()}
    assert set(got) == {"log_loss", "brier", "accuracy", "log_loss_minus_elo", "brier_minus_elo"}
    for name, v in (("brier", [(p - y) ** 2 for _, p, y, _ in rows]), ("brier_minus_elo", [(p - y) ** 2 - 0.25 for _, p, y, _ in rows])):
        mean = sum(v) / len(v)
        half = 1.96 * (sum((x - mean) ** 2 for x in v) / len(v) / len(v)) ** 0.5
        assert got[name] == pytest.approx((mean - half, mean + half), abs=0.1 * half)
    assert {r.metric for r in M.bootstrap(df.drop("elo_p")).collect()} == {"log_loss", "brier", "accuracy"}


def test_a_row_alone_may_be_drawn_or_not(spark):
    one = spark.createDataFrame([(1, 0.8, 1)], "contest_id long, p double, y int")
    assert {(r.metric, r.low == r.high) for r in M.bootstrap(one).collect()} == {("log_loss", True), ("brier", True), ("accuracy", True)}
