"""What several steps read is computed once, and no column is carried that nobody reads."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from agonix.operators import features as X
from agonix.operators import metrics as M
from agonix.operators import profiles as P
from agonix.sources.contests import contests


def counted(spark, df, column):
    """``df`` and an accumulator that counts how often its rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(count, LongType()).asNondeterministic()(column)), seen


def test_rankings_compute_a_state_once(spark):
    rows = [(i, i + 1, 1500.0 + i, 50.0, 50.0, 50.0, 50.0, 60.0) for i in range(20)]
    state, seen = counted(spark, spark.createDataFrame(rows, "team long, contests long, elo double, form double, depth double, consistency double, opponents double, tier double"), "contests")
    teams = spark.createDataFrame([(i, "r", True) for i in range(22)], "team long, region string, verified boolean")
    assert P.power_rankings(teams, state).count() == 22 and seen.value == 20


def test_extremes_compute_predictions_once(spark):
    rows = [(i, (i % 10) / 10, i % 2, 0.9) for i in range(60)]
    pred, seen = counted(spark, spark.createDataFrame(rows, "contest_id long, p double, y int, elo_p double"), "contest_id")
    assert M.error_extremes(pred).count() == 30 and seen.value == 60


def test_error_inputs_are_those_of_the_feature_table(spark, sf, monkeypatch):
    f = X.assemble(contests(spark, sf))
    tables, keep = [], X.stored
    monkeypatch.setattr(X, "stored", lambda df, name, by=None: tables.append(df.columns) or keep(df, name, by))
    e = X.error_inputs(contests(spark, sf))
    assert sorted(e.collect()) == sorted(f.select(*e.columns).collect())
    assert tables and not {"legs", "roster_a", "roster_b"} & {n for t in tables for n in t}


def test_bounds_are_the_splits_and_safe_folds(spark, sf):
    from agonix.operators import splits as S

    for n in (0, 1, 7, 61):
        f = spark.createDataFrame([(i * 7 % 61, 86_400_000 * (i // 9) + i % 2) for i in range(n)], "contest_id long, ts_ms long")
        split = S.chrono_split(f)
        parts, folds = S.bounds(f)
        assert n == 0 or {(r.contest_id, k) for k, own in parts.items() for r in f.where(own).collect()} == {(r.contest_id, r.split) for r in split.collect()}
        got = {(k, role, r.contest_id) for k, both in folds.items() for role, own in zip(("train", "validation"), both, strict=True) for r in f.where(own).collect()}
        want = {(r.fold_id, r.role, r.contest_id) for r in S.safe_folds(S.walk_forward(f), split).collect()}
        assert got == {w for w in want if w[0] in {k for k, role, _ in want if role == "validation"}}


def test_the_audit_computes_its_table_once(spark):
    from agonix.operators import ml as ML
    from agonix.operators import splits as S
    from agonix.operators.audit import model_audit

    rows = [(i, 86_400_000 * i, i % 5, 5 + i % 3, 2020, "ab"[i % 2], float(i % 11), i % 2) for i in range(40)]
    plain = spark.createDataFrame(rows, "contest_id long, ts_ms long, side_a long, side_b long, season_year long, family string, x double, a_won long")
    f, seen = counted(spark, plain, "side_b")
    policy = ML.feature_policy(f)
    got = sorted(map(str, model_audit(f, policy).collect()))
    assert seen.value == 40
    assert got == sorted(map(str, model_audit(plain, policy, S.chrono_split(plain)).collect()))


def test_training_writes_no_vectors(spark, monkeypatch):
    from agonix.operators import training as T
    from tests.test_training import table

    kinds, keep = [], T.stored
    monkeypatch.setattr(T, "stored", lambda df, name, by=None: kinds.extend(t for _, t in df.dtypes) or keep(df, name, by))
    T.train_models(table(spark, 120), "d", trees=1)
    assert kinds and "vector" not in kinds


def test_a_stored_table_leaves_no_shuffle(spark, tmp_path):
    from pathlib import Path

    from agonix.functions.shared import stored
    from agonix.llm.common import stored as also

    base = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    key, files = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", lambda: {f for f in base.rglob("shuffle_*.data")}
    before = spark.conf.get(key)
    old = files()
    for keep in (stored, also):
        kept = keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert {r["count"] for r in kept.collect()} == {142, 143} and not files() - old
    assert spark.conf.get(key) == before


def test_as_of_steps_are_tables(spark, sf):
    """No shuffle of one block of windows is kept while another one runs."""
    from agonix.operators.asof import matchup_asof
    from agonix.plans.asof_queries import requests

    c = contests(spark, sf)
    f = matchup_asof(c, requests(c), rated=False)
    assert "Window" not in f._jdf.queryExecution().optimizedPlan().toString()
