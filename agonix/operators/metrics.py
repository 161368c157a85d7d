"""Evaluation of win probabilities. Input: predictions with ``p`` (of side A) and ``y`` (0/1); ``by`` groups them.

Everything but AUC and the bootstrap is one aggregation; AUC counts by distinct score first and takes prefix sums over
range partitions of the scores; the bootstrap leaves a task as one row per resample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agonix.functions.shared import stored
from agonix.functions.windows import with_running_sum

EPS = 1e-15


def _clip():
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("p")))


def _or0(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _probability() -> list:
    loss = -(F.col("y") * F.ln(_clip()) + (1 - F.col("y")) * F.ln(1 - _clip()))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("log_loss"), F.coalesce(F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.lit(0.0)).alias("brier")]


def _confusion(threshold: float) -> list:
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    return [
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
        F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("positive_rate"), F.avg(F.abs(F.col("p") - 0.5)).alias("sharpness"),
    ]


def _rates(m: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = m.withColumns({"accuracy": _or0(tp + tn, tp + fp + fn + tn), "precision": _or0(tp, tp + fp), "recall": _or0(tp, tp + fn), "specificity": _or0(tn, tn + fp)})
    return m.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "f1": _or0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))})


def probability_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, log loss, Brier score (0 when empty)."""
    return pred.groupBy(*(by or [])).agg(*_probability())


def classification_metrics(pred: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and what follows from them; the threshold is inclusive, empty denominators give 0."""
    return _rates(pred.groupBy(*(by or [])).agg(*_confusion(threshold)))


def roc_auc(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area with average ranks; null if one class is missing."""
    by = by or []
    score = pred.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    score = with_running_sum(score, "n", by, ["p"], "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / F.lit(2.0))
    t = score.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    auc = F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / F.lit(2.0), (F.col("np") * F.col("nn")).cast("double"))
    return t.select(*by, auc.alias("auc"))


def reliability(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins, p = 1 in the last, empty ones kept."""
    b = pred.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"))
    every = pred.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "observed")


def calibration(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error, and slope and intercept of the count-weighted line through the bins (null with fewer
    than two bins or no spread)."""
    b = reliability(pred, bins).where("n > 0")
    w, x, y = F.col("n").cast("double"), F.col("mean_p"), F.col("observed")
    t = b.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * F.abs(x - y)).alias("gap"), F.count(F.lit(1)).alias("bins"))
    var = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    slope = F.when((F.col("bins") > 1) & (var > 1e-12), (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / var)
    t = t.withColumns({"ece": F.coalesce(F.try_divide("gap", "w"), F.lit(0.0)), "slope": slope})
    return t.select("ece", "slope", ((F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w")).alias("intercept"))


def metric_bundle(pred: DataFrame, by: list[str]) -> DataFrame:
    """All metrics by group; groups are joined null-safe."""
    out = _rates(pred.groupBy(*by).agg(*_probability(), *_confusion(0.5)))
    auc = roc_auc(pred, by).withColumnsRenamed({b: f"_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return out.join(auc, on).drop(*[f"_{b}" for b in by])


def error_segments(pred: DataFrame, tags: dict[str, object]) -> DataFrame:
    """Errors by segment; ``tags`` maps a segment's name to the condition that puts a row in it. Rows are tagged once and
    exploded by tag, so one shuffle of partial counts serves all segments; a segment without rows is there with 0."""
    t = pred.withColumn("segment", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tags.items()]))))
    wrong = (F.col("p") >= 0.5) != (F.col("y") == 1)
    loss = -(F.col("y") * F.ln(_clip()) + (1 - F.col("y")) * F.ln(1 - _clip()))
    g = t.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"), F.avg(loss).alias("log_loss"), F.count_if((F.col("p") <= 0.05) | (F.col("p") >= 0.95)).alias("extremes"))
    every = pred.sparkSession.createDataFrame([(n,) for n in tags], "segment string")
    zero = F.lit(0)
    return F.broadcast(every).join(g, "segment", "left").select("segment", *[F.coalesce(c, zero).alias(c) for c in ("n", "errors")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("error_rate", "log_loss")], F.coalesce("extremes", zero).alias("extremes"))


#: Days of rest that count as an imbalance, a difference of probabilities that counts as disagreement.
REST_GAP, DISAGREEMENT = 7, 0.3


def segments_of(pred: DataFrame, levels: list[str], formats: list[str]) -> dict[str, object]:
    """The segments of the error analysis. pred: y, cold, level, series_format, rest_difference_days, roster_missing."""
    tags = {"cold-start": F.col("cold"), "established": ~F.col("cold"), "a-won": F.col("y") == 1, "b-won": F.col("y") == 0, "roster-incomplete": F.col("roster_missing"), "rest-gap": F.abs("rest_difference_days") >= REST_GAP}
    return tags | {f"level:{v}": F.col("level") == v for v in levels} | {f"format:{v}": F.col("series_format") == v for v in formats}


def error_extremes(pred: DataFrame, n: int = 10) -> DataFrame:
    """The n most confident wrong and the n least confident right predictions, and, if ``pred`` has elo_p, the n that differ most
    from the rating's, by at least DISAGREEMENT. ``confidence`` is the distance from 0.5, or from the rating's probability."""
    sure = F.abs(F.col("p") - 0.5)
    right = (F.col("p") >= 0.5) == (F.col("y") == 1)
    p = stored(pred.withColumns({"confidence": sure, "right": right}), "analysed")  # three selections read it
    keep = ["contest_id", "p", "y", "confidence"]
    worst = p.where("not right").select(*keep).orderBy(F.desc("confidence"), "contest_id").limit(n).withColumn("kind", F.lit("confident-wrong"))
    out = worst.unionByName(p.where("right").select(*keep).orderBy("confidence", "contest_id").limit(n).withColumn("kind", F.lit("unsure-right")))
    if "elo_p" in pred.columns:
        far = p.withColumn("confidence", F.round(F.abs(F.col("p") - F.col("elo_p")), 12)).where(F.col("confidence") >= DISAGREEMENT)
        out = out.unionByName(far.select(*keep).orderBy(F.desc("confidence"), "contest_id").limit(n).withColumn("kind", F.lit("rating-disagreement")))
    return out


def bootstrap(pred: DataFrame, iterations: int = 2000, seed: int = 1) -> DataFrame:
    """Nearest-rank 2.5 % and 97.5 % bounds of log loss, Brier and accuracy over resamples with replacement, and, if
    ``pred`` has elo_p, of log loss and Brier minus the rating's on the same resample.

    At every size each row gets a Poisson(1) weight per iteration from a generator of its own, keyed by the seed and the
    row. A task multiplies weights by values block by block and keeps one sum per iteration and metric, so what leaves it
    is ``iterations`` rows whatever it has read. The sums are divided by the resample's own total; a resample without rows
    counts for nothing. Rows that share a contest_id share their weights."""
    p, y = F.col("p"), F.col("y")
    loss = lambda p: -(y * F.ln(F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))) + (1 - y) * F.ln(1 - F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))))
    values = {"log_loss": loss(p), "brier": F.pow(p - y, 2), "accuracy": ((p >= 0.5) == (y == 1)).cast("double")}
    if "elo_p" in pred.columns:
        e = F.col("elo_p")
        values |= {"log_loss_minus_elo": loss(p) - loss(e), "brier_minus_elo": F.pow(p - y, 2) - F.pow(e - y, 2)}
    names = [*values]
    rows = pred.select(F.coalesce(F.col("contest_id").cast("long"), F.lit(-1).cast("long")).alias("id"), *[v.cast("double").alias(k) for k, v in values.items()]).repartition(pred.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((iterations, 1 + len(names)))
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            v = np.column_stack([np.ones(len(key)), *(batch.column(1 + i).to_numpy() for i in range(len(names)))])
            for at in range(0, len(key), 256):
                w = np.stack([np.random.Generator(np.random.Philox(key=[k, seed])).poisson(1.0, iterations) for k in key[at : at + 256]])
                sums += w.T.astype(float) @ v[at : at + 256]
        if sums[:, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), *(pa.array(x.copy()) for x in sums.T)], names=["it", "w", *names])

    parts = rows.mapInArrow(run, "it long, w double, " + ", ".join(f"{n} double" for n in names))
    each = parts.groupBy("it").agg(F.sum("w").alias("w"), *[F.sum(m).alias(m) for m in names]).where("w > 0").select("it", *[(F.col(m) / F.col("w")).alias(m) for m in names])
    at = lambda m, q: F.try_element_at(F.array_sort(F.collect_list(m)), (F.greatest(F.round(q * (F.count(m) - 1)), F.lit(0)) + 1).cast("int"))
    bounds = [F.struct(F.lit(m).alias("metric"), at(m, 0.025).alias("low"), at(m, 0.975).alias("high")) for m in values]
    out = each.agg(F.count(F.lit(1)).alias("n"), F.array(*bounds).alias("m")).where("n > 0")  # `iterations` values
    return out.select(F.explode("m").alias("m")).select("m.*")


def run_stats(log: DataFrame, run: str, code: str, value: str) -> DataFrame:
    """Counts, distinct codes, average, median and 95th percentile (index floor(p n), capped) of each run."""
    w = Window.partitionBy(run).orderBy(value)
    total = F.count(F.lit(1)).over(Window.partitionBy(run))
    r = log.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w) - 1, "_n": total})
    at = lambda p: F.max(F.when(F.col("_i") == F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1), F.col(value)))
    return r.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(code).alias("codes"), F.avg(value).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))
