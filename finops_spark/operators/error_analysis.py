"""What the missed and the found positives look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.functions.scalar import (
    ERROR_AMOUNT_COLUMNS,
    HOUR_COLUMN,
    above_threshold,
    error_class,
    first_present,
)
from finops_spark.operators.medians import exact_medians

CLASSES = ("FN", "TP")


def with_error_class(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Add ``predicted`` (0/1) and ``error_class`` (FN, FP, TP, TN)."""
    predicted = above_threshold(F.col(score), threshold)
    return df.withColumn("predicted", predicted).withColumn("error_class", error_class(F.col(label), F.col("predicted")))


def class_counts(classed: DataFrame) -> DataFrame:
    return classed.groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


def amount_stats(classed: DataFrame, columns: Sequence[str] = ERROR_AMOUNT_COLUMNS) -> DataFrame | None:
    """(error_class, amount_column, n, mean_amount, median_amount, std_amount) for FN
    and TP; None when no amount column exists. The deviation is the sample one."""
    name = first_present(classed, columns)
    if name is None:
        return None
    amount = F.col(name)
    medians = exact_medians(classed, {c: F.when(F.col("error_class") == c, amount) for c in CLASSES})
    median = F.lit(None).cast("double")
    for c, m in medians.items():
        median = F.when(F.col("error_class") == c, F.lit(m).cast("double")).otherwise(median)
    return (
        classed.filter(F.col("error_class").isin(*CLASSES))
        .groupBy("error_class")
        .agg(
            F.count(amount).alias("n"),
            F.avg(amount).alias("mean_amount"),
            F.stddev_samp(amount).alias("std_amount"),
        )
        .select("error_class", F.lit(name).alias("amount_column"), "n", "mean_amount", median.alias("median_amount"), "std_amount")
    )


def hour_histogram(classed: DataFrame, hour: str = HOUR_COLUMN) -> DataFrame | None:
    """(error_class, hour, n) for FN and TP and every hour 0-23, zeros included."""
    if hour not in classed.columns:
        return None
    counts = (
        classed.filter(F.col("error_class").isin(*CLASSES))
        .groupBy("error_class", F.col(hour).cast("int").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = (
        classed.sparkSession.range(1)
        .select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("error_class"))
        .select("error_class", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    )
    return spine.join(counts, ["error_class", "hour"], "left").select(
        "error_class", "hour", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )
