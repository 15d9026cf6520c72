"""Brier score, binned calibration error and the before/after report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finops_spark.functions.scalar import equal_width_bin, improvement_pct
from finops_spark.operators.gates import enforce, gate_report, not_empty
from finops_spark.operators.rows import side_by_side

# What a calibration has to reach.
MIN_IMPROVEMENT_PCT = 15.0
MAX_CALIBRATION_ERROR = 0.05


def squared_error(label: str, p: str) -> Column:
    return (F.col(p) - F.col(label)) * (F.col(p) - F.col(label))


def brier(df: DataFrame, label: str = "label", p: str = "p", name: str = "brier") -> DataFrame:
    return df.agg(F.avg(squared_error(label, p)).alias(name))


def calibration_bins(df: DataFrame, label: str = "label", p: str = "p", n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) of each non-empty bin of equal width."""
    return (
        df.groupBy(equal_width_bin(F.col(p), n_bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("mean_p"),
            F.avg(F.col(label).cast("double")).alias("mean_y"),
        )
        .withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))
    )


def calibration_error(
    df: DataFrame, label: str = "label", p: str = "p", n_bins: int = 10, name: str = "calibration_error"
) -> DataFrame:
    """Mean gap over non-empty bins, each bin weighing the same."""
    return calibration_bins(df, label, p, n_bins).agg(F.avg("gap").alias(name))


def calibration_report(
    df: DataFrame,
    label: str = "label",
    base: str = "p",
    calibrated: str = "p_cal",
    min_improvement_pct: float = MIN_IMPROVEMENT_PCT,
    max_calibration_error: float = MAX_CALIBRATION_ERROR,
    n_bins: int = 10,
) -> DataFrame:
    """One row comparing two scores of the same rows, at full precision."""
    scores = df.agg(
        F.avg(squared_error(label, base)).alias("brier_base"),
        F.avg(squared_error(label, calibrated)).alias("brier_calibrated"),
    )
    both = side_by_side(
        scores,
        calibration_error(df, label, base, n_bins, "calibration_error_base"),
        calibration_error(df, label, calibrated, n_bins, "calibration_error_calibrated"),
    )
    improved = F.col("improvement_pct") >= min_improvement_pct
    calibrated_ok = F.col("calibration_error_calibrated") <= max_calibration_error
    return (
        both.withColumn("improvement_pct", improvement_pct(F.col("brier_base"), F.col("brier_calibrated")))
        .withColumn("min_improvement_pct", F.lit(float(min_improvement_pct)))
        .withColumn("max_calibration_error", F.lit(float(max_calibration_error)))
        .withColumn("meets_improvement", improved)
        .withColumn("meets_calibration", calibrated_ok)
        .withColumn("passed", F.col("meets_improvement") & F.col("meets_calibration"))
        .withColumn("status", F.when(F.col("passed"), "PASS").otherwise("FAIL"))
    )


def require_rows(df: DataFrame) -> None:
    enforce(gate_report(df, [not_empty()]))
