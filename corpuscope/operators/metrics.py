"""Evaluation of binary and multi-class labels and scores.

Every metric is one map-side-combined aggregation, or a running total over
distinct scores from ``ordered_totals``.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.fixed_values import COST_FALSE_NEGATIVE, COST_FALSE_POSITIVE, THRESHOLD_GRID
from corpuscope.operators.ordered import ordered_totals


def zero_divide(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col(truth) == F.col(pred)).alias("correct")
    )


def binary_metrics(df: DataFrame, truth: str, pred: str, positive: int = 1) -> DataFrame:
    """One row: accuracy, precision, recall, f1 of the positive class; 0 where undefined."""
    t, p = F.col(truth) == positive, F.col(pred) == positive
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(truth) == F.col(pred)).alias("hits"),
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        zero_divide(F.col("hits"), F.col("n")).alias("accuracy"),
        zero_divide(tp, tp + fp).alias("precision"),
        zero_divide(tp, tp + fn).alias("recall"),
        zero_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class precision, recall, f1, support, then macro, weighted and micro rows."""
    pairs = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col(truth).alias("c"), F.lit(1).alias("is_true")),
            F.struct(F.col(pred).alias("c"), F.lit(0).alias("is_true")),
        )).alias("s"), "n", (F.col(truth) == F.col(pred)).alias("hit"),
    ).select("s.*", "n", "hit")
    per_class = sides.groupBy("c").agg(
        F.sum(F.when(F.col("is_true") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("is_true") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("is_true") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
    )
    scored = per_class.select(
        F.col("c").cast("string").alias("row"),
        zero_divide(F.col("tp"), F.col("predicted")).alias("precision"),
        zero_divide(F.col("tp"), F.col("support")).alias("recall"),
        zero_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "tp", "predicted",
    )
    measures = ("precision", "recall", "f1")
    weighted = [zero_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures]
    total = F.sum("support").alias("support")
    tp, predicted = F.sum("tp"), F.sum("predicted")
    summary = [
        scored.agg(F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in measures], total),
        scored.agg(F.lit("weighted avg").alias("row"), *weighted, total),
        scored.agg(
            F.lit("micro avg").alias("row"), zero_divide(tp, predicted).alias("precision"),
            zero_divide(tp, F.sum("support")).alias("recall"),
            zero_divide(2 * tp, predicted + F.sum("support")).alias("f1"), total,
        ),
    ]
    report = scored.select("row", *measures, "support")
    for row in summary:
        report = report.unionByName(row)
    return report


def cost_accuracy(df: DataFrame, truth: str, pred: str, fn: float = COST_FALSE_NEGATIVE, fp: float = COST_FALSE_POSITIVE) -> DataFrame:
    """1 - cost / weighted size, with the cost weights in both numerator and denominator."""
    t, p = F.col(truth), F.col(pred)
    missed = F.count_if((t == 1) & (p == 0)) * fn
    false_alarm = F.count_if((t == 0) & (p == 1)) * fp
    right = F.count_if(((t == 0) & (p == 0)) | ((t == 1) & (p == 1)))
    return df.agg((1 - F.try_divide(missed + false_alarm, missed + false_alarm + right)).alias("cost_accuracy"))


def score_totals(df: DataFrame, truth: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives per distinct score with their running totals."""
    t = F.col(truth)
    rows = df.where(t.isNotNull())
    return ordered_totals(rows, score, by, measures={
        "pos": F.when(t == 1, 1).otherwise(0), "neg": F.when(t == 1, 0).otherwise(1),
    })


def roc_auc(df: DataFrame, truth: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the ROC curve from ranks with ties averaged."""
    s = score_totals(df, truth, score, by)
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg_ties") / 2))
    return s.groupBy(*by).agg(
        F.try_divide(area, F.max("pos_total").cast("double") * F.max("neg_total").cast("double")).alias("roc_auc")
    )


def average_precision(df: DataFrame, truth: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Step-wise average precision: sum of recall gain times precision over distinct scores."""
    s = score_totals(df, truth, score, by)
    tp = F.col("pos_total") - F.col("pos_below")
    called = tp + F.col("neg_total") - F.col("neg_below")
    gain = F.try_divide(F.col("pos").cast("double"), F.col("pos_total").cast("double"))
    return s.groupBy(*by).agg(F.sum(gain * tp / called).alias("average_precision"))


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One point per distinct score (all of them) plus the origin at an infinite threshold."""
    s = score_totals(df, truth, score)
    rate = lambda side: F.try_divide(
        (F.col(f"{side}_total") - F.col(f"{side}_below")).cast("double"), F.col(f"{side}_total").cast("double"))
    points = s.select(F.col(score).cast("double").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def threshold_costs(df: DataFrame, truth: str, score: str, fn: float = COST_FALSE_NEGATIVE,
                    fp: float = COST_FALSE_POSITIVE, grid: int = THRESHOLD_GRID) -> DataFrame:
    """Cost at each of ``grid`` thresholds evenly spaced over [0, 1].

    NULL and NaN scores are left out. Each score is counted once, under the number of thresholds it reaches; the
    costs are running sums over those at most grid + 1 counts.
    """
    thresholds = [i / (grid - 1) for i in range(grid)]
    points = [float("-inf"), *thresholds, float("inf")]
    rows = df.select(F.col(truth).alias("_y"), F.col(score).cast("double").alias("_p"))
    rows = rows.where(F.col("_y").isNotNull() & F.col("_p").isNotNull() & ~F.isnan("_p"))
    reached = Bucketizer(splits=points, inputCol="_p", outputCol="_reached").transform(rows)
    counts = reached.groupBy(F.col("_reached").cast("int").alias("_reached")).agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    steps = df.sparkSession.range(grid + 1).select(F.col("id").cast("int").alias("_reached"))
    filled = steps.join(counts, "_reached", "left").na.fill(0, ["pos", "neg"])
    up = Window.orderBy("_reached").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy("_reached").rowsBetween(1, Window.unboundedFollowing)
    # A score that reaches j thresholds is called positive by the first j of them.
    return filled.select(
        "_reached",
        (F.sum("pos").over(up) * fn).alias("missed_cost"),
        (F.coalesce(F.sum("neg").over(down), F.lit(0)) * fp).alias("alarm_cost"),
    ).where(F.col("_reached") < grid).select(
        F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("_reached") + 1).alias("threshold"),
        (F.col("missed_cost") + F.col("alarm_cost")).alias("cost"),
    )


def cost_threshold(df: DataFrame, truth: str, score: str, fn: float = COST_FALSE_NEGATIVE,
                   fp: float = COST_FALSE_POSITIVE, grid: int = THRESHOLD_GRID) -> DataFrame:
    """Cheapest threshold, the lowest one on ties."""
    costs = threshold_costs(df, truth, score, fn, fp, grid)
    return costs.orderBy("cost", "threshold").limit(1)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight of class 0 relative to class 1: n1 / n0 and 1."""
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.try_divide(n1.cast("double"), n0.cast("double")).alias("weight_0"), F.lit(1.0).alias("weight_1"))
