"""Recursive multi-step forecasts of many series, inside the JVM.

The recent values of a series travel as an array no longer than the longest lag
or window; a fold over the steps appends one prediction at a time to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finops_spark.errors import FitError, SchemaError


def recent_history(
    df: DataFrame, rows: int, key: str = "series_id", date: str = "ts", value: str = "value"
) -> DataFrame:
    """(key, history, last_date): the last ``rows`` values, oldest first."""
    newest = Window.partitionBy(key).orderBy(F.col(date).desc())
    last = df.select(key, date, value).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= rows)
    return last.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(date, value))), lambda p: p[value].cast("double")).alias(
            "history"
        ),
        F.max(date).alias("last_date"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, v: a + v)


def _squares_around(values: Column, centre: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, v: a + (v - centre) * (v - centre))


def history_features(
    history: Column,
    lags: Sequence[int],
    windows: Sequence[int] = (),
    with_calendar: bool = False,
    date: Column | None = None,
    compat: bool = False,
) -> Column:
    """Array of features from a history array (most recent last).

    ``compat=True`` takes the population deviation of each window; the default is
    the sample deviation that training uses.
    """
    if with_calendar and date is None:
        raise SchemaError("calendar features need a date")
    parts = [F.element_at(history, -n) for n in lags]
    for size in windows:
        recent = F.slice(history, -size, size)
        mean = _sum(recent) / float(size)
        squares = _squares_around(recent, mean)
        divisor = float(size if compat else size - 1)
        deviation = F.sqrt(squares / divisor) if divisor > 0 else F.lit(None).cast("double")
        parts += [mean, deviation]
    if with_calendar:
        dow = F.weekday(date)
        angle = dow * F.lit(2.0 * math.pi) / F.lit(7)
        parts += [dow, F.month(date), F.dayofmonth(date), F.sin(angle), F.cos(angle)]
    return F.array(*[p.cast("double") for p in parts])


def forecast(
    df: DataFrame,
    models: DataFrame,
    lags: Sequence[int],
    windows: Sequence[int] = (),
    steps: int = 1,
    key: str = "series_id",
    date: str = "ts",
    value: str = "value",
    with_calendar: bool = False,
    compat: bool = False,
    calendar_offset: int = 1,
    strict: bool = True,
) -> DataFrame:
    """(key, step, forecast_date, horizon_days, forecast) for the next ``steps`` days.

    A series without a model or with too short a history raises; with ``strict=False`` it is
    left out, and ``forecast_status`` tells which and why.

    ``models``: one row for each key with coefficients and intercept on the raw
    features (such as fold ALL_ROWS of the cross-validation). A training row pairs
    features up to day t-1 with the value of day t+1, so a model's prediction from
    a history ending on day T belongs to T+2; ``compat=True`` dates it T+1 instead
    and uses population deviations. Calendar features of the first step are those
    of the day ``calendar_offset`` days after the last known one.
    """
    if steps < 1:
        raise SchemaError(f"steps must be at least 1, got {steps}")
    depth = max([*lags, *windows, 1])
    history = recent_history(df, depth, key, date, value)
    ahead = 1 if compat else 2
    joined = history.join(models.select(key, "coefficients", "intercept"), key, "left")
    usable = (F.size("history") >= depth) & F.col("coefficients").isNotNull()
    if not strict:
        joined = joined.filter(usable)
    checked = F.when(usable, F.col("history")).otherwise(
        F.raise_error(F.concat(F.lit("no model, or history shorter than the longest lag or window: "), F.coalesce(F.col(key).cast("string"), F.lit("?"))))
    )
    start = F.struct(checked.alias("h"), F.array().cast("array<double>").alias("p"))

    def step(state: Column, i: Column) -> Column:
        # A training row's calendar is that of its own day, one after its history.
        day = F.date_add(F.col("last_date"), i - 1 + calendar_offset)
        x = history_features(state["h"], lags, windows, with_calendar, day, compat)
        terms = F.zip_with(x, F.col("coefficients"), lambda a, b: a * b)
        y = F.aggregate(terms, F.col("intercept"), lambda a, t: a + t)
        return F.struct(
            F.slice(F.array_append(state["h"], y), -depth, depth).alias("h"), F.array_append(state["p"], y).alias("p")
        )

    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["p"])
    return (
        joined.select(key, "last_date", F.posexplode(run).alias("i", "forecast"))
        .select(
            key,
            (F.col("i") + 1).alias("step"),
            F.date_add("last_date", F.col("i") + ahead).alias("forecast_date"),
            (F.col("i") + ahead).alias("horizon_days"),
            "forecast",
        )
    )


def forecast_status(
    df: DataFrame, models: DataFrame, lags: Sequence[int], windows: Sequence[int] = (), key: str = "series_id"
) -> DataFrame:
    """(key, rows, needed, has_model, used) of every series in ``df`` or ``models``."""
    needed = max([*lags, *windows, 1])
    known = models.select(key).distinct().withColumn("has_model", F.lit(True))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(known, key, "full")
    filled = sizes.select(
        key, F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.lit(needed).alias("needed"), F.coalesce("has_model", F.lit(False)).alias("has_model")
    )
    return filled.withColumn("used", F.col("has_model") & (F.col("rows") >= F.col("needed")))


def require_history(df: DataFrame, depth: int, key: str = "series_id") -> None:
    short = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < depth).limit(5).collect()
    if short:
        raise FitError(f"series shorter than {depth} rows: {[r[key] for r in short]}")
