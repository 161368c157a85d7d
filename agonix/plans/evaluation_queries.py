"""Queries of splits, folds and probabilistic evaluation, on a simple form predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from agonix.operators import features as X
from agonix.operators import metrics as M
from agonix.operators import rating as R
from agonix.operators import splits as S
from agonix.sources.contests import SQL, accepted, contests

from .base import query
from .feature_queries import FEATURE_SQL


def predictions(spark, sf_dir):
    """contest_id, p, y and context: p leans half the difference of the prior win rates, within 0.05 and 0.95."""
    c = contests(spark, sf_dir)
    s = X.record(X.sides(c)).groupBy("contest_id").agg(*[F.max(F.when(F.col("side") == k, F.col("win_rate"))).alias(f"w{k}") for k in "AB"], F.bool_or("is_cold_start").alias("cold"))
    p = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + (F.col("wA") - F.col("wB")) / 2)), 4)
    return accepted(c).join(s, "contest_id").select("contest_id", "ts", "ts_ms", p.alias("p"), (F.col("winner") == F.col("side_a")).cast("int").alias("y"), "level", "series_format", "family", "cold")


PRED = SQL + """
, wr AS (SELECT s.contest_id, s.side, CASE WHEN count(p.contest_id) = 0 THEN 0.5 ELSE (count(p.contest_id) FILTER (WHERE p.won))::DOUBLE / count(p.contest_id)::DOUBLE END AS w, count(p.contest_id) = 0 AS cold FROM s LEFT JOIN s p ON p.team = s.team AND p.ts < s.ts GROUP BY 1, 2),
pred AS (SELECT acc.contest_id, acc.ts, round(greatest(0.05, least(0.95, 0.5 + (a.w - b.w) / 2)), 4) AS p, CASE WHEN winner = side_a THEN 1 ELSE 0 END AS y, level, series_format, family, a.cold OR b.cold AS cold
  FROM acc JOIN wr a ON a.contest_id = acc.contest_id AND a.side = 'A' JOIN wr b ON b.contest_id = acc.contest_id AND b.side = 'B'),
o AS (SELECT *, row_number() OVER (ORDER BY ts, contest_id) - 1 AS i, count(*) OVER () AS n FROM pred),
split AS (SELECT contest_id, ts, CASE WHEN i < floor(0.7 * n) THEN 'train' WHEN i < floor(0.7 * n) + floor(0.15 * n) THEN 'validation' ELSE 'test' END AS split FROM o),
fp AS (SELECT *, greatest(1, floor(0.2 * n)) AS warm, greatest(1, floor((n - greatest(1, floor(0.2 * n))) / 5)) AS size FROM o),
folds AS (SELECT fold_id, role, contest_id FROM (
  SELECT k AS fold_id, contest_id, CASE WHEN i < warm + k * size THEN 'train' WHEN k = 4 OR i < warm + (k + 1) * size THEN 'validation' END AS role FROM fp, range(5) t(k)) WHERE role IS NOT NULL)
"""
_LOSS = "-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))"


def _r(df, *cols, places: int = 9):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("predictions", PRED + "SELECT contest_id, p, y, level, series_format, family, cold FROM pred")
def q_pred(spark, sf_dir):
    return predictions(spark, sf_dir).drop("ts", "ts_ms")


@query("chrono_split", PRED + "SELECT contest_id, split FROM split")
def q_split(spark, sf_dir):
    return S.chrono_split(accepted(contests(spark, sf_dir))).select("contest_id", "split")


@query("walk_forward_folds", PRED + "SELECT CAST(fold_id AS INTEGER) AS fold_id, role, contest_id FROM folds")
def q_folds(spark, sf_dir):
    return S.walk_forward(accepted(contests(spark, sf_dir)))


@query("safe_folds", PRED + "SELECT CAST(fold_id AS INTEGER) AS fold_id, role, contest_id FROM folds WHERE fold_id NOT IN (SELECT fold_id FROM folds JOIN split USING (contest_id) WHERE role = 'validation' AND split = 'test')")
def q_safe(spark, sf_dir):
    c = accepted(contests(spark, sf_dir))
    return S.safe_folds(S.walk_forward(c), S.chrono_split(c))


@query("split_summary", PRED + "SELECT split, count(*) AS n, epoch_ms(min(pred.ts)) AS first_ms, epoch_ms(max(pred.ts)) AS last_ms, avg(CASE WHEN cold THEN 1.0::DOUBLE ELSE 0 END) AS cold_start_rate, count(DISTINCT year(pred.ts)) AS years, count(DISTINCT family) AS families FROM pred JOIN split USING (contest_id) GROUP BY 1")
def q_summary(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"a_is_cold_start": F.col("cold"), "b_is_cold_start": F.col("cold"), "season_year": F.year("ts")})
    return S.split_summary(p, S.chrono_split(p))


@query("split_validation", PRED + "SELECT 'missing' AS code, CAST(contest_id AS VARCHAR) AS entity FROM pred WHERE contest_id % 97 = 0 UNION ALL SELECT 'duplicate', CAST(contest_id AS VARCHAR) FROM pred WHERE contest_id % 97 = 1")
def q_validate(spark, sf_dir):
    """Planted faults: every 97th contest is not assigned, the next one is twice."""
    c = accepted(contests(spark, sf_dir))
    s = S.chrono_split(c)
    return S.validate_splits(c, s.where("contest_id % 97 <> 0").unionByName(s.where("contest_id % 97 = 1")))


@query("log_loss_brier", PRED + f"SELECT level, count(*) AS n, round(avg({_LOSS}), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier FROM pred GROUP BY 1")
def q_prob(spark, sf_dir):
    return _r(M.probability_metrics(predictions(spark, sf_dir), ["level"]), "log_loss", "brier")


_CONF = "count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS positive_rate, round(avg(abs(p - 0.5)), 9) AS sharpness"
_CONF_OUT = "tp, fp, fn, tn, mean_p, positive_rate, sharpness, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 9) AS specificity, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"
_CLS = ["mean_p", "positive_rate", "sharpness", "accuracy", "precision", "recall", "specificity", "balanced_accuracy", "f1"]


@query("classification_metrics", PRED + f", k AS (SELECT series_format, {_CONF} FROM pred GROUP BY 1) SELECT series_format, {_CONF_OUT} FROM k")
def q_cls(spark, sf_dir):
    return _r(M.classification_metrics(predictions(spark, sf_dir), ["series_format"]), *_CLS)


_AUC = """, rk AS (SELECT {by} AS g, y, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS r FROM pred),
auc AS (SELECT g, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 9) END AS auc FROM rk GROUP BY 1)"""


@query("roc_auc", PRED + _AUC.format(by="level") + " SELECT g AS level, auc FROM auc")
def q_auc(spark, sf_dir):
    return _r(M.roc_auc(predictions(spark, sf_dir), ["level"]), "auc")


_BINS = ", b AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM pred GROUP BY 1)"


@query("reliability", PRED + _BINS + " SELECT k AS bin, coalesce(n, 0) AS n, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM range(10) t(k) LEFT JOIN b ON b.bin = k")
def q_rel(spark, sf_dir):
    return _r(M.reliability(predictions(spark, sf_dir)), "mean_p", "observed")


@query("calibration_line", PRED + _BINS + """, t AS (SELECT sum(n) AS w, sum(n * mean_p) AS wx, sum(n * observed) AS wy, sum(n * mean_p * mean_p) AS wxx, sum(n * mean_p * observed) AS wxy, sum(n * abs(mean_p - observed)) AS gap FROM b),
u AS (SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS slope FROM t) SELECT round(gap / w, 8) AS ece, round(slope, 7) AS slope, round((wy - slope * wx) / w, 7) AS intercept FROM u""")
def q_cal(spark, sf_dir):
    return _r(_r(M.calibration(predictions(spark, sf_dir)), "ece", places=8), "slope", "intercept", places=7)


@query("metric_bundle", PRED + _AUC.format(by="family") + f""", k AS (SELECT family, count(*) AS n, round(avg({_LOSS}), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier, {_CONF} FROM pred GROUP BY 1)
SELECT family, n, log_loss, brier, {_CONF_OUT}, auc FROM k JOIN auc ON g = family""")
def q_bundle(spark, sf_dir):
    return _r(M.metric_bundle(predictions(spark, sf_dir), ["family"]), "log_loss", "brier", "auc", *_CLS)


#: Predictions with what the error analysis looks at; elo_p is a rating without history (the win rates' difference on the
#: rating's scale), so that plain SQL has the same.
_ANALYSED = FEATURE_SQL + """, pa AS (SELECT contest_id, round(greatest(0.05, least(0.95, 0.5 + (a_win_rate - b_win_rate) / 2)), 4) AS p, a_won AS y, a_is_cold_start OR b_is_cold_start AS cold, level, series_format, rest_difference_days,
  1 / (1 + pow(10, -(a_last3_win_rate - b_last3_win_rate))) AS elo_p FROM features)"""


def _analysed(spark, sf_dir):
    f = X.error_inputs(contests(spark, sf_dir))
    p = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + (F.col("a_win_rate") - F.col("b_win_rate")) / 2)), 4)
    elo = 1 / (1 + F.pow(F.lit(10.0), -(F.col("a_last3_win_rate") - F.col("b_last3_win_rate"))))
    return f.select("contest_id", p.alias("p"), F.col("a_won").cast("int").alias("y"), (F.col("a_is_cold_start") | F.col("b_is_cold_start")).alias("cold"), "level", "series_format", "rest_difference_days", F.lit(False).alias("roster_missing"), elo.alias("elo_p"))


_SEGMENTS = {"cold-start": "cold", "established": "NOT cold", "a-won": "y = 1", "b-won": "y = 0", "roster-incomplete": "false", "rest-gap": "abs(rest_difference_days) >= 7", **{f"level:{v}": f"level = '{v}'" for v in ("international", "league")}, **{f"format:{v}": f"series_format = '{v}'" for v in ("bo1", "bo3", "bo5", "unknown")}}


@query("error_segments", _ANALYSED + " UNION ALL ".join(f"SELECT '{k}' AS segment, count(*) AS n, count(*) FILTER (WHERE (p >= 0.5) <> (y = 1)) AS errors, coalesce(round(avg(CASE WHEN (p >= 0.5) <> (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 9), 0) AS error_rate, coalesce(round(avg({_LOSS}), 9), 0) AS log_loss, count(*) FILTER (WHERE p <= 0.05 OR p >= 0.95) AS extremes FROM pa WHERE {c}" for k, c in _SEGMENTS.items()))
def q_seg(spark, sf_dir):
    p = _analysed(spark, sf_dir)
    return _r(M.error_segments(p, M.segments_of(p, ["international", "league"], ["bo1", "bo3", "bo5", "unknown"])), "error_rate", "log_loss")


@query("error_extremes", _ANALYSED + """, e AS (SELECT contest_id, p, y, abs(p - 0.5) AS confidence, (p >= 0.5) = (y = 1) AS ok, round(abs(p - elo_p), 12) AS gap FROM pa)
(SELECT contest_id, p, y, round(confidence, 9) AS confidence, 'confident-wrong' AS kind FROM e WHERE NOT ok ORDER BY e.confidence DESC, contest_id LIMIT 10) UNION ALL (SELECT contest_id, p, y, round(confidence, 9), 'unsure-right' FROM e WHERE ok ORDER BY e.confidence, contest_id LIMIT 10)
UNION ALL (SELECT contest_id, p, y, round(gap, 9), 'rating-disagreement' FROM e WHERE gap >= 0.3 ORDER BY gap DESC, contest_id LIMIT 10)""")
def q_extremes(spark, sf_dir):
    return _r(M.error_extremes(_analysed(spark, sf_dir)), "confidence")


@query("bootstrap_intervals")
def q_boot(spark, sf_dir):
    """The form predictor and its difference from the rating."""
    e = R.elo(contests(spark, sf_dir), median=False)
    return M.bootstrap(predictions(spark, sf_dir).join(e.select("contest_id", R.elo_p(F.col("elo_a") - F.col("elo_b")).alias("elo_p")), "contest_id"))


@query("run_stats", """WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS codes, round(avg(value), 9) AS mean, max(value) FILTER (WHERE i = least(floor(0.5 * n), n - 1)) AS p50, max(value) FILTER (WHERE i = least(floor(0.95 * n), n - 1)) AS p95 FROM e GROUP BY 1""")
def q_stats(spark, sf_dir):
    from agonix.sources.contests import table

    return _r(M.run_stats(table(spark, sf_dir, "events").select("user_id", "event_type", "value"), "user_id", "event_type", "value"), "mean")


@query("window_partition", PRED + "SELECT contest_id, CASE WHEN ts >= (SELECT min(ts) FROM acc WHERE event_id = 3) THEN 'eligible' ELSE 'excluded' END AS part FROM acc")
def q_window(spark, sf_dir):
    """Eligible from the first contest of the anchor event on; the start is a one-row table."""
    c = accepted(contests(spark, sf_dir))
    start = c.where("event_id = 3").agg(F.min("ts_ms").alias("start"))
    return c.join(F.broadcast(start)).select("contest_id", F.when(F.col("ts_ms") >= F.col("start"), "eligible").otherwise("excluded").alias("part"))
