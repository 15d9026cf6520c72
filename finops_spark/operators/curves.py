"""Precision-recall curve, average precision and threshold choice, distributed.

Equal scores collapse to one row first (map-side combine, so a score shared by a
third of the rows is harmless). The running totals over descending scores are
taken inside score ranges and shifted by the totals of the higher ranges; there
is no global sort in one task and no pass for each threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.functions.scalar import above_threshold, expected_cost, f_beta, safe_ratio
from finops_spark.operators.ordered import SPLIT_ROWS, literal_bucket

MAX_RANGES = 65_536


def score_ranges(
    df: DataFrame, score: str = "score", max_ranges: int = MAX_RANGES, split_rows: int = SPLIT_ROWS
) -> list[float]:
    """Cut points that share the rows out evenly, two ranges for each task's worth
    of rows; none when all fit one task. They become literals, so every run of a
    task agrees."""
    rows = df.count()
    if rows <= split_rows:
        return []
    ranges = min(max_ranges, 2 * -(-rows // split_rows))
    wanted = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.agg(F.percentile_approx(score, wanted, 4 * ranges)).first()[0]))


def _checked(df: DataFrame, label: str, score: str) -> DataFrame:
    """The score and label columns; reading a missing score, or a label other than 0 and 1, raises."""
    no_score = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    no_label = F.col(label).isNull() | ~F.col(label).cast("double").isin(0.0, 1.0)
    return df.select(
        F.when(no_score, F.raise_error(F.lit(f"{score} has missing values"))).otherwise(F.col(score)).alias(score),
        F.when(no_label, F.raise_error(F.lit(f"{label} has values other than 0 and 1"))).otherwise(F.col(label)).alias(label),
    )


def threshold_curve(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    fn_cost: float = 10.0,
    fp_cost: float = 1.0,
    beta: float = 2.0,
    max_ranges: int = MAX_RANGES,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """One row for each distinct score used as threshold (score >= threshold).

    (threshold, positives, tp, fp, fn, tn, precision, recall, f_beta, total_cost,
    cost_per_10k), where ``positives`` counts label 1 at exactly that score.
    """
    df = _checked(df, label, score)
    cuts = score_ranges(df, score, max_ranges, split_rows)
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives")
    )
    per_score = per_score.withColumn("_range", literal_bucket("threshold", cuts))
    # One row for each range: at most len(cuts) + 1.
    whole = Window.partitionBy(F.lit(0))
    higher = whole.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        per_score.groupBy("_range")
        .agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
        .select(
            F.col("_range").alias("_r"),
            F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_p_above"),
            F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_n_above"),
            F.sum("_p").over(whole).alias("_p_all"),
            F.sum("_n").over(whole).alias("_n_all"),
        )
    )
    down = (
        Window.partitionBy("_range")
        .orderBy(F.col("threshold").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = per_score.withColumns(
        {"_p_in": F.sum("positives").over(down), "_n_in": F.sum("negatives").over(down)}
    ).join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    tp = F.col("_p_above") + F.col("_p_in")
    fp = F.col("_n_above") + F.col("_n_in")
    counted = running.select(
        "threshold",
        "positives",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.col("_p_all") - tp).alias("fn"),
        (F.col("_n_all") - fp).alias("tn"),
    )
    cost = expected_cost(F.col("fn"), F.col("fp"), fn_cost, fp_cost)
    rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counted.withColumns(
        {
            "precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f_beta": f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta),
            "total_cost": cost,
            "cost_per_10k": cost * F.lit(10000.0) / rows,
        }
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """One row ``average_precision``: steps of recall times precision.

    A step of recall is the positives at that score over all positives, so no
    second ordered pass is needed.
    """
    weighted = F.sum(F.col("positives") * F.col("precision"))
    return curve.agg(safe_ratio(weighted, F.sum("positives")).alias("average_precision"))


def best_thresholds(curve: DataFrame, agreement: float = 0.05) -> DataFrame:
    """One row: F-beta-optimal and cost-optimal threshold and what they give.

    Ties go to the lowest threshold. ``agree`` tells whether the two lie within
    ``agreement``; the counts and ratios are those at the F-beta threshold.
    """
    row = F.struct("threshold", "f_beta", "tp", "fp", "fn", "tn", "precision", "recall", "total_cost", "cost_per_10k")
    chosen = curve.agg(
        F.max_by(row, F.struct("f_beta", (-F.col("threshold")).alias("t"))).alias("f"),
        F.min_by(row, F.struct("total_cost", "threshold")).alias("c"),
    )
    return chosen.select(
        F.col("f.threshold").alias("f2_threshold"),
        F.col("f.f_beta").alias("f2"),
        F.col("c.threshold").alias("cost_threshold"),
        F.col("c.total_cost").alias("min_total_cost"),
        (F.abs(F.col("f.threshold") - F.col("c.threshold")) <= agreement).alias("agree"),
        *[F.col(f"f.{n}").alias(n) for n in ("tp", "fp", "fn", "tn", "precision", "recall")],
        F.col("f.total_cost").alias("total_cost"),
        F.col("f.cost_per_10k").alias("cost_per_10k"),
    )


def confusion_at(
    df: DataFrame,
    threshold: float,
    label: str = "label",
    score: str = "score",
    fn_cost: float = 10.0,
    fp_cost: float = 1.0,
) -> DataFrame:
    """One row: confusion counts, precision, recall, F2 and cost at a threshold."""
    hit = above_threshold(F.col(score), threshold) == 1
    positive = F.col(label) == 1
    counts = df.agg(
        F.count_if(positive & hit).alias("tp"),
        F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"),
        F.count_if(~positive & ~hit).alias("tn"),
        F.count(F.lit(1)).alias("_rows"),
    )
    cost = expected_cost(F.col("fn"), F.col("fp"), fn_cost, fp_cost)
    return counts.select(
        "tp",
        "fp",
        "fn",
        "tn",
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        f_beta(F.col("tp"), F.col("fp"), F.col("fn")).alias("f2"),
        cost.alias("total_cost"),
        safe_ratio(cost * 10000.0, F.col("_rows")).alias("cost_per_10k"),
    )
