"""Look-ahead-free features of daily series.

A series has one row a day at most (``gates.enforce_series`` checks it), so its
length is bounded by the calendar and one window by series is balanced however
many series there are. ``split_hot=True`` splits long keys for other clocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from finops_spark.errors import FitError, SchemaError
from finops_spark.functions.scalar import (
    AMOUNT_COLUMNS,
    ID_COLUMNS,
    SECONDS_COLUMN,
    calendar,
    first_present,
    hour_of_seconds,
    require,
    weekday_of_seconds,
)
from finops_spark.operators.ordered import with_bounded_window

# Feature layout of a daily series when none is given.
DEFAULT_LAGS = (1, 2, 3, 7, 14)
DEFAULT_WINDOWS = (7, 14, 28)
CALENDAR_FEATURES = ("day_of_week", "month", "day_of_month", "day_of_week_sin", "day_of_week_cos")


def lag_columns(w: WindowSpec, value: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"lag_{n}": F.lag(value, n).over(w) for n in lags}


def rolling_columns(
    w: WindowSpec,
    value: str,
    windows: Sequence[int],
    min_periods: int | None = None,
    sticky_min_periods: bool = False,
) -> dict[str, Column]:
    """Mean and sample deviation of the ``window`` rows before the current one.

    Each window needs its own size in rows unless ``min_periods`` is given.
    ``sticky_min_periods`` lets the first window's size serve all of them.
    """
    columns = {}
    shared = min_periods or (windows[0] if sticky_min_periods and windows else None)
    for size in windows:
        needed = shared or size
        if needed > size:
            raise SchemaError(f"min_periods {needed} exceeds window {size}")
        frame = w.rowsBetween(-size, -1)
        enough = F.count(value).over(frame) >= needed
        columns[f"rolling_mean_{size}"] = F.when(enough, F.avg(value).over(frame))
        columns[f"rolling_std_{size}"] = F.when(enough, F.stddev_samp(value).over(frame))
    return columns


def _all_present(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def lag_features(
    df: DataFrame,
    lags: Sequence[int],
    key: str = "series_id",
    date: str = "ts",
    value: str = "value",
    drop_na: bool = True,
    split_hot: bool = False,
) -> DataFrame:
    out = with_bounded_window(df, [key], [date], max(lags), 0, lambda w: lag_columns(w, value, lags), split_hot)
    return out.filter(_all_present([f"lag_{n}" for n in lags])) if drop_na else out


def rolling_features(
    df: DataFrame,
    windows: Sequence[int],
    min_periods: int | None = None,
    key: str = "series_id",
    date: str = "ts",
    value: str = "value",
    drop_na: bool = True,
    sticky_min_periods: bool = False,
    split_hot: bool = False,
) -> DataFrame:
    def build(w):
        return rolling_columns(w, value, windows, min_periods, sticky_min_periods)

    out = with_bounded_window(df, [key], [date], max(windows), 0, build, split_hot)
    names = [f"rolling_{s}_{n}" for n in windows for s in ("mean", "std")]
    return out.filter(_all_present(names)) if drop_na else out


def feature_names(lags: Sequence[int], windows: Sequence[int], with_calendar: bool = False) -> list[str]:
    names = [f"lag_{n}" for n in lags]
    names += [f"rolling_{s}_{n}" for n in windows for s in ("mean", "std")]
    return names + (list(CALENDAR_FEATURES) if with_calendar else [])


def feature_matrix(
    df: DataFrame,
    key: str = "series_id",
    date: str = "ts",
    value: str = "value",
    lags: Sequence[int] = DEFAULT_LAGS,
    windows: Sequence[int] = DEFAULT_WINDOWS,
    min_periods: int | None = None,
    with_calendar: bool = False,
    drop_na: bool = True,
    sticky_min_periods: bool = False,
    split_hot: bool = False,
) -> DataFrame:
    """key, date, value, the features and ``target`` (the next row's value).

    All window columns share one partitioning and order, so one shuffle and one
    sort serve them all.
    """
    require(df, [key, date, value], "series")
    lookback = max([*lags, *windows, 1])

    def build(w):
        return {
            **lag_columns(w, value, lags),
            **rolling_columns(w, value, windows, min_periods, sticky_min_periods),
            "target": F.lead(value, 1).over(w),
        }

    out = with_bounded_window(df.select(key, date, value), [key], [date], lookback, 1, build, split_hot)
    if with_calendar:
        out = out.withColumns(calendar(date))
    names = feature_names(lags, windows, with_calendar)
    out = out.select(key, date, value, *names, "target")
    return out.filter(_all_present([*names, "target"])) if drop_na else out


def require_samples(features: DataFrame) -> None:
    if features.isEmpty():
        raise FitError("no rows have all features; use shorter lags or windows")


# --- transaction features -------------------------------------------------------


def log_amount(df: DataFrame, columns: Sequence[str] = AMOUNT_COLUMNS) -> DataFrame:
    """Replace the amount by ``log_amount`` = ln(1 + amount)."""
    name = first_present(df, columns)
    if name is None:
        raise SchemaError(f"no amount column among {list(columns)}")
    return df.withColumn("log_amount", F.log1p(name)).drop(name)


def clock_features(df: DataFrame, seconds: str = SECONDS_COLUMN) -> DataFrame:
    """Hour and weekday from a count of seconds, replacing it; no-op without it."""
    if seconds not in df.columns:
        return df
    c = F.col(seconds)
    return df.withColumns({"hour_of_day": hour_of_seconds(c), "day_of_week": weekday_of_seconds(c)}).drop(seconds)


def drop_ids(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    return df.drop(*columns)
