"""The training job on a small table, its artifact, scoring contract, importance and audit."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from agonix.operators import ml as ML
from agonix.operators import training as T
from agonix.operators.audit import correlations, model_audit

SCHEMA = "contest_id long, ts_ms long, side_a long, side_b long, season_year long, family string, x double, gap double, cold boolean, elo_p double, a_won long"


def table(spark, n=400, signal=2.0, seed=1):
    """Contests in order of time whose outcome follows x, not the rating."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = r.gauss(0, 1)
        won = int(r.random() < 1 / (1 + math.exp(-signal * x)))
        rows.append((i, 86_400_000 * i, i % 7, 7 + i % 5, 2020 + i // 200, "ab"[i % 2], x, None if i % 3 == 0 else r.random(), i < 10, r.uniform(0.4, 0.6), won))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def trained(spark):
    f = table(spark)
    return f, T.train_models(f, "data-1", trees=4)


def test_the_job_chooses_what_learns(spark, trained):
    f, t = trained
    by = {}
    for stage, name, a, _ in t.evidence:
        by.setdefault(stage, {})[name] = a
    assert set(by["candidate"]) == {"logistic-0.01", "logistic-0.1", "logistic-1", "trees-2-0.05", "trees-2-0.1", "trees-3-0.05", "trees-3-0.1"}
    assert set(by["walk_forward"]) == {"elo", "logistic", "trees", "prior", "constant"} == set(by["walk_forward_pooled"])
    assert by["walk_forward"]["constant"] == pytest.approx(math.log(2))
    assert t.family == ML.select_family({k: by["walk_forward"][k] for k in ("elo", "logistic", "trees")}) == "logistic"
    assert by["candidate"][f"logistic-{t.setting:g}"] == min(v for k, v in by["candidate"].items() if k.startswith("logistic"))
    assert by["calibration"][f"logistic+{t.calibration}"] == min(v for k, v in by["calibration"].items() if k.startswith("logistic"))
    assert by["walk_forward"]["logistic"] < by["walk_forward"]["elo"] and set(by["test_baseline"]) == {"elo", "prior", "constant"}
    assert list(by["test"]) == [f"logistic+{t.calibration}"]
    assert "test_interval_brier_minus_elo" in by


def test_folds_never_read_test_rows(spark, trained):
    f, _ = trained
    y = f.withColumn("y", F.col("a_won").cast("double"))
    from agonix.operators import splits as S

    split = S.chrono_split(y)
    folds = S.safe_folds(S.walk_forward(y), split)
    ids = sorted(r.fold_id for r in folds.select("fold_id").distinct().collect())
    p = T.backtest_families(y, folds, ids, ML.feature_policy(f), {"logistic": 0.1}, trees=2)
    test = {r.contest_id for r in split.where("split = 'test'").collect()}
    assert ids and not test & {r.contest_id for r in p.collect()}
    want = {(r.fold_id, r.contest_id) for r in folds.where("role = 'validation'").collect()}
    assert {(r.fold_id, r.contest_id) for r in p.where("family = 'logistic'").collect()} == want


def test_the_artifact_is_what_was_trained(spark, trained, tmp_path):
    f, t = trained
    T.save_model(t, spark, str(tmp_path / "m"))
    u = T.load_model(spark, str(tmp_path / "m"))
    assert (u.version, u.family, u.setting, u.evidence) == (t.version, t.family, t.setting, t.evidence)
    scores = lambda m: sorted(tuple(r) for r in T.score(m, f)[0].collect())
    assert scores(t) == scores(u)
    assert {r.name: r.value for r in T.model_card(u, spark).where("section = 'model'").collect()}["version"] == t.version
    again = T.model_version("data-1", t.prep, t.family, t.model, t.calibration, t.cal_model)
    assert again == t.version != T.model_version("data-2", t.prep, t.family, t.model, t.calibration, t.cal_model)
    assert t.version != T.model_version("data-1", {**t.prep, "mean": {**t.prep["mean"], "x": 9.0}}, t.family, t.model, t.calibration, t.cal_model)
    spark.read.parquet(str(tmp_path / "m/manifest")).withColumn("version", F.lit("f" * 16)).write.parquet(str(tmp_path / "bad/manifest"))
    t.model.write().overwrite().save(str(tmp_path / "bad/estimator"))
    if t.cal_model is not None:
        t.cal_model.write().overwrite().save(str(tmp_path / "bad/calibration"))
    with pytest.raises(ValueError, match="manifest"):
        T.load_model(spark, str(tmp_path / "bad"))


def test_scoring_keeps_the_contract(spark, trained):
    f, t = trained
    odd = f.limit(6).withColumns({
        "x": F.when(F.col("contest_id") == 1, None).when(F.col("contest_id") == 2, float("nan")).when(F.col("contest_id") == 4, float("inf")).otherwise(F.col("x")),
        "family": F.when(F.col("contest_id") == 0, "never seen").otherwise(F.col("family")), "gap": F.when(F.col("contest_id") == 5, float("-inf")).otherwise(F.lit(None)),
    })
    good, bad = T.score(t, odd)
    assert {r.contest_id: r.reasons for r in bad.collect()} == {1: ["x"], 2: ["x"], 4: ["x"], 5: ["gap"]}
    for r in good.collect():
        assert 0 <= r.p <= 1 and r.p + r.p_b == 1 and r.predicted == ("A" if r.p >= 0.5 else "B") and r.confidence == pytest.approx(2 * abs(r.p - 0.5)) and r.fidelity == "retrospective"
    with pytest.raises(ValueError, match="missing"):
        T.score(t, f.drop("x"))
    with pytest.raises(ValueError, match="no rows"):
        T.train_models(f.limit(1), "d", trees=1)


def test_importance_equals_a_shuffle_by_hand(spark, trained):
    f, _ = trained
    policy = ML.feature_policy(f)
    y = f.withColumn("y", F.col("a_won").cast("double"))
    prep = ML.fit_prep(y, policy)
    x = ML.apply_prep(y, prep, ["contest_id", "ts_ms", "y"]).cache()
    names = ML.encoded_names(prep)
    model = ML.fit_logistic(x, 0.1)
    assert len(names) == len(model.coefficients)
    got = {r.field: r.importance for r in ML.permutation_importance(model, x, names, repeats=2).collect()}
    w, b = np.array(model.coefficients), model.intercept
    loss = lambda m, y: float(np.mean(-np.log(np.where(y == 1, 1, 0) * (p := 1 / (1 + np.exp(-(m @ w + b)))) + np.where(y == 1, 0, 1) * (1 - p))))
    want = np.zeros(len(names))
    for seed in range(2):
        rows = ML.shuffled_partners(x, seed).select("y", vector_to_array("features").alias("a"), vector_to_array("other").alias("b")).collect()
        m, o, yy = np.array([r.a for r in rows]), np.array([r.b for r in rows]), np.array([r.y for r in rows])
        assert sorted(map(tuple, m)) == sorted(map(tuple, o)) and (m != o).any()
        for j in range(len(names)):
            swapped = m.copy()
            swapped[:, j] = o[:, j]
            want[j] += (loss(swapped, yy) - loss(m, yy)) / 2
    assert [got[n] for n in names] == pytest.approx(list(want), abs=1e-9)
    assert max(got, key=got.get) == "n_x"
    c = T.coefficients(T.Trained("", policy, prep, "logistic", 0.1, model, "none", None, 0, []))
    assert c.where("kind = 'positive'").orderBy(F.desc("weight")).first().field == "n_x"


def test_preparation_counts_digits(spark, monkeypatch):
    """Medians are exact and no aggregate keeps a column's values."""
    monkeypatch.setattr(ML.F, "percentile", lambda *a: pytest.fail("an aggregate that keeps all values"))
    r = random.Random(4)
    rows = [(r.gauss(0, 1) * 10 ** r.randint(-300, 300), -float(i % 7), i % 4 - 2, None if i % 2 else 0.1 * i, 5.0, None, float("-inf") if i < 3 else -0.0, i % 5 == 0, "xyz"[i % 3] if i else None) for i in range(1001)]
    names = ["wide", "ties", "whole", "gaps", "same", "nothing", "odd", "flag", "word"]
    f = spark.createDataFrame(rows, "wide double, ties double, whole long, gaps double, same double, nothing double, odd double, flag boolean, word string")
    policy = {"numeric": names[:7], "boolean": ["flag"], "categorical": ["word"]}
    p = ML.fit_prep(f.repartition(3), policy)
    for i, n in enumerate(names[:7]):
        own = [x[i] for x in rows if x[i] is not None]
        assert p["median"][n] == (np.median(own) if own else 0.0), n
        if n not in ("wide", "odd"):
            filled = [p["median"][n] if x[i] is None else x[i] for x in rows]
            assert (p["mean"][n], p["std"][n]) == (pytest.approx(np.mean(filled), abs=1e-12), pytest.approx(np.std(filled) or 1.0, abs=1e-12))
    assert p["missing"] == ["gaps", "nothing"] and p["vocabulary"] == {"word": ["x", "y", "z"]}
    assert ML.fit_prep(f.limit(0), policy)["median"]["wide"] == 0.0
    v = ML.apply_prep(f.where("flag").limit(1), {**p, "mean": p["mean"] | {"wide": 0.0, "odd": 0.0}, "std": p["std"] | {"wide": 1.0, "odd": 1.0}}, ["ties"]).first()
    assert len(v.features) == len(ML.encoded_names(p)) and v.features[ML.encoded_names(p).index("b_flag")] == 1.0
    with pytest.raises(Exception, match="NaN"):
        ML.apply_prep(f.withColumn("same", F.lit(float("nan"))), p, []).collect()


def test_importance_of_trees_is_theirs(spark, trained, monkeypatch):
    """As scored by the model itself, though no row is multiplied by the places."""
    f, _ = trained
    policy = ML.feature_policy(f)
    y = f.withColumn("y", F.col("a_won").cast("double"))
    prep = ML.fit_prep(y, policy)
    x = ML.apply_prep(y, prep, ["contest_id", "ts_ms", "y"]).cache()
    names, model = ML.encoded_names(prep), ML.fit_trees(x, 3, 0.1, 6)
    rows = ML.shuffled_partners(x, 0).select("y", vector_to_array("features").alias("a"), vector_to_array("other").alias("b")).collect()
    place = names.index("n_x")
    swapped = spark.createDataFrame([(r.y, [*r.a[:place], r.b[place], *r.a[place + 1 :]]) for r in rows], "y double, a array<double>")
    from pyspark.ml.functions import array_to_vector

    from agonix.operators.metrics import probability_metrics

    loss = lambda df: probability_metrics(ML.with_p(model, df, ["y"])).first().log_loss
    want = loss(swapped.select("y", array_to_vector("a").alias("features"))) - loss(x)
    monkeypatch.setattr(ML, "with_p", lambda *a: pytest.fail("rows are scored once a place"))
    got = {r.field: r.importance for r in ML.permutation_importance(model, x, names, repeats=1).collect()}
    assert set(got) == set(names) and got["n_x"] == pytest.approx(want, abs=1e-12) and want > 0.01
    used = {k for t in model.trees for k, v in enumerate(t.featureImportances.toArray()) if v}
    assert all(got[n] == 0 for i, n in enumerate(names) if i not in used)


def test_audit_finds_what_was_planted(spark):
    f = table(spark, 300).withColumns({
        "twin": F.col("x"), "near": F.col("x") * 2 + 0.001 * F.col("elo_p"), "same": F.lit(4.0), "nothing": F.lit(None).cast("double"), "rare": F.when(F.col("contest_id") == 7, 1.0).otherwise(0.0),
        "leak": F.col("a_won") + 0.01 * F.col("elo_p"), "flag": F.lit(True), "flag2": F.col("cold"),
    })
    from agonix.operators import splits as S

    found = {}
    for r in model_audit(f, ML.feature_policy(f), S.chrono_split(f), shift=["x"]).collect():
        found.setdefault(r.section, {})[r.field, r.other] = (r.v1, r.v2, r.v3)
    assert set(found["constant"]) == {("same", None), ("flag", None), ("nothing", None)}
    assert found["near_constant"] == {("rare", None): (pytest.approx(299 / 300), None, None)}
    assert set(found["duplicate"]) == {("x", "twin"), ("flag2", "cold")} and set(found["label"]) == {("leak", None)}
    assert {("near", "twin"), ("near", "x"), ("twin", "x")} <= set(found["correlated"])
    assert found["missing"]["gap", None] == (100, pytest.approx(1 / 3), None) and found["missing"]["nothing", None][0] == 300
    assert found["total"]["rows", None][0] == 300 and found["total"]["teams", None][0] == 12
    data = f.toPandas()
    r = {(x.field, x.other): x.r for x in correlations(f, ["x", "elo_p", "same"], {"x": 0.3, "elo_p": 0.5, "same": 4.0}).collect()}
    assert r["x", "same"] == 0 and r["x", "elo_p"] == pytest.approx(np.corrcoef(data.x, data.elo_p)[0, 1], abs=0.05)
    assert model_audit(f.limit(0), ML.feature_policy(f), S.chrono_split(f.limit(0))).count() == 1
