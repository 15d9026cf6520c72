"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import SchemaError

# Column names with a meaning of their own.
AMOUNT_COLUMNS = ("TransactionAmt", "amount")
ERROR_AMOUNT_COLUMNS = ("log_amount", "TransactionAmt", "amount")
ID_COLUMNS = ("TransactionID", "card1", "addr1", "addr2")
DUPLICATE_ID_COLUMNS = ("TransactionID", "transaction_id")
SECONDS_COLUMN = "TransactionDT"
HOUR_COLUMN = "hour_of_day"


def require(df: DataFrame, columns: Sequence[str], what: str = "input") -> None:
    """Raise when a column is missing; looks at the schema only."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaError(f"{what} lacks columns {missing}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def missing(df: DataFrame, column: str) -> Column:
    """NULL and NaN are the same kind of absence."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) if _is_float(df, column) else c.isNull()


def infinite(df: DataFrame, column: str) -> Column:
    if not _is_float(df, column):
        return F.lit(False)
    return F.abs(F.col(column)) == F.lit(float("inf"))


def null_if_nan(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into NULL, so that aggregates skip it."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if _is_float(df, column) else c


def hour_of_seconds(seconds: Column) -> Column:
    """Hour 0-23 of a count of seconds; floors, so negative counts work too."""
    return F.pmod(F.floor(seconds / F.lit(3600)), F.lit(24)).cast("int")


def weekday_of_seconds(seconds: Column) -> Column:
    """Day number 0-6 of a count of seconds, the origin being day 1."""
    return F.pmod(F.floor(seconds / F.lit(86400)) + F.lit(1), F.lit(7)).cast("int")


def calendar(date: str) -> dict[str, Column]:
    """Calendar fields of a date column; Monday is 0."""
    dow = F.weekday(date)
    angle = dow * F.lit(2.0 * math.pi) / F.lit(7)
    return {
        "day_of_week": dow,
        "month": F.month(date),
        "day_of_month": F.dayofmonth(date),
        "day_of_week_sin": F.sin(angle),
        "day_of_week_cos": F.cos(angle),
    }


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 where the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 2.0) -> Column:
    b2 = beta * beta
    return safe_ratio(F.lit(1.0 + b2) * tp, F.lit(1.0 + b2) * tp + F.lit(b2) * fn + fp)


def expected_cost(fn: Column, fp: Column, fn_cost: float = 10.0, fp_cost: float = 1.0) -> Column:
    return F.lit(float(fn_cost)) * fn + F.lit(float(fp_cost)) * fp


def improvement_pct(base: Column, new: Column) -> Column:
    """Reduction from ``base`` to ``new`` in percent; 0 when ``base`` is 0."""
    return safe_ratio(base - new, base) * F.lit(100.0)


def above_threshold(score: Column, threshold: float | Column) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= limit).cast("int")


def error_class(label: Column, predicted: Column) -> Column:
    return (
        F.when((label == 1) & (predicted == 0), "FN")
        .when((label == 0) & (predicted == 1), "FP")
        .when((label == 1) & (predicted == 1), "TP")
        .otherwise("TN")
    )


def equal_width_bin(p: Column, n_bins: int = 10) -> Column:
    """Bin number of a probability among ``n_bins`` equal widths of [0, 1].

    The inner edges are the doubles ``i * (1 / n_bins)``, each belonging to the
    bin above it; multiplying and flooring would move 0.3, 0.6 and 0.7.
    """
    width = 1.0 / n_bins
    return sum(((p >= F.lit(i * width)).cast("int") for i in range(1, n_bins)), F.lit(0))
