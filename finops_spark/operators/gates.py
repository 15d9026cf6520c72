"""Data gates: one aggregation pass gives a table of checks and outcomes.

A gate compares one aggregate with an inclusive range. ``gate_report`` evaluates
any number of gates over one scan; ``enforce`` raises when one did not pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import GateError, SchemaError
from finops_spark.functions.scalar import infinite, missing, numeric_columns, require
from finops_spark.operators.ordered import with_bounded_window


@dataclass(frozen=True)
class Gate:
    check: str
    column: str
    observed: Column
    lo: float | None = None
    hi: float | None = None


def gate_report(df: DataFrame, gates: Sequence[Gate], by: Sequence[str] = ()) -> DataFrame:
    """(by..., check, column, observed, lo, hi, passed), one row for each gate."""
    aggregates = [g.observed.cast("double").alias(f"_g{i}") for i, g in enumerate(gates)]
    measured = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    entries = []
    for i, g in enumerate(gates):
        seen = F.col(f"_g{i}")
        lo = F.lit(None if g.lo is None else float(g.lo)).cast("double")
        hi = F.lit(None if g.hi is None else float(g.hi)).cast("double")
        inside = F.lit(True)
        if g.lo is not None:
            inside = inside & (seen >= lo)
        if g.hi is not None:
            inside = inside & (seen <= hi)
        entries.append(
            F.struct(
                F.lit(g.check).alias("check"),
                F.lit(g.column).alias("column"),
                seen.alias("observed"),
                lo.alias("lo"),
                hi.alias("hi"),
                F.coalesce(inside, F.lit(False)).alias("passed"),
            )
        )
    return measured.select(*by, F.explode(F.array(*entries)).alias("g")).select(*by, "g.*")


def enforce(report: DataFrame) -> None:
    """Raise with the first failing checks of a report."""
    failed = report.filter(~F.col("passed")).limit(10).collect()
    if failed:
        shown = "; ".join(
            f"{r['check']}({r['column']}): observed {r['observed']}, allowed [{r['lo']}, {r['hi']}]" for r in failed
        )
        raise GateError(shown)


# --- single gates -----------------------------------------------------------


def not_empty() -> Gate:
    return Gate("not_empty", "*", F.count(F.lit(1)), lo=1)


def row_count(lo: int | None = None, hi: int | None = None) -> Gate:
    """Row count within inclusive bounds; no bounds by default."""
    return Gate("row_count", "*", F.count(F.lit(1)), lo, hi)


def not_all_missing(df: DataFrame, column: str) -> Gate:
    return Gate("not_all_missing", column, F.count_if(~missing(df, column)), lo=1)


def no_missing(df: DataFrame, column: str) -> Gate:
    return Gate("no_missing", column, F.count_if(missing(df, column)), hi=0)


def no_infinite(df: DataFrame, column: str) -> Gate:
    return Gate("no_infinite", column, F.count_if(infinite(df, column)), hi=0)


def finite(column: str) -> Gate:
    """Value can be read as a number and is neither missing, NaN nor infinite."""
    number = F.col(column).try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return Gate("finite", column, F.count_if(bad), hi=0)


def parses_as_date(column: str, fmt: str | None = None) -> Gate:
    text = F.col(column).cast("string")
    day = F.try_to_date(text, fmt) if fmt else text.try_cast("date")
    return Gate("parses_as_date", column, F.count_if(day.isNull()), hi=0)


def binary_label(df: DataFrame, column: str) -> Gate:
    """Label is integer typed (else SchemaError) and holds 0 and 1 only."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise SchemaError(f"label {column} must be an integer column")
    outside = F.col(column).isNull() | ~F.col(column).isin(0, 1)
    return Gate("binary_label", column, F.count_if(outside), hi=0)


def positive_rate(column: str, lo: float = 0.005, hi: float = 0.05) -> Gate:
    return Gate("positive_rate", column, F.avg(F.col(column).cast("double")), lo, hi)


def within(column: str, lo: float, hi: float, check: str = "within") -> Gate:
    outside = F.col(column).isNull() | ~F.col(column).between(lo, hi)
    return Gate(check, column, F.count_if(outside), hi=0)


# --- gate sets of the inputs --------------------------------------------------


def price_gates(df: DataFrame, value: str = "price") -> list[Gate]:
    """Feed contract; run it with ``by=["asset"]`` for an outcome for each asset."""
    return [not_empty(), not_all_missing(df, value), no_missing(df, value), no_infinite(df, value)]


def transaction_gates(
    df: DataFrame,
    label: str = "is_fraud",
    min_rows: int | None = None,
    max_rows: int | None = None,
    min_rate: float = 0.005,  # fixed values: the accepted share of positives
    max_rate: float = 0.05,
) -> list[Gate]:
    """Label and rate gates; the number of rows is bounded only where asked for."""
    return [row_count(min_rows, max_rows), binary_label(df, label), positive_rate(label, min_rate, max_rate)]


def target_gates(df: DataFrame, target: str) -> list[Gate]:
    require(df, [target], "labelled table")
    return [not_empty(), no_missing(df, target)]


def score_gates(df: DataFrame, label: str = "label", score: str = "score", threshold: float | None = None) -> list[Gate]:
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        raise SchemaError(f"threshold must be in [0, 1], got {threshold}")
    outside = F.col(label).isNull() | ~F.col(label).isin(0, 1)
    return [not_empty(), finite(score), Gate("binary_label", label, F.count_if(outside), hi=0)]


def no_missing_anywhere(df: DataFrame) -> list[Gate]:
    return [no_missing(df, c) for c in df.columns]


def series_gates(df: DataFrame, date: str = "ts", value: str = "value", fmt: str | None = None) -> list[Gate]:
    return [not_empty(), parses_as_date(date, fmt), finite(value)]


def class_gates(df: DataFrame, label: str, min_class: int = 2, min_positives: int | None = None) -> DataFrame:
    """Report on the smallest class and, if wanted, the number of positives."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    gates = [Gate("smallest_class", label, F.min("_n"), lo=min_class)]
    if min_positives is not None:
        positives = F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("_n"))), F.lit(0))
        gates.append(Gate("positives", label, positives, lo=min_positives))
    return gate_report(sizes, gates)


# --- gates that return rows ----------------------------------------------------


def duplicate_dates(df: DataFrame, key: str = "series_id", date: str = "ts") -> DataFrame:
    """(key, date, n) of every date that occurs more than once within a key."""
    return df.groupBy(key, date).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def date_gaps(
    df: DataFrame, key: str = "series_id", date: str = "ts", step_days: int = 1, split_hot: bool = True
) -> DataFrame:
    """(key, previous, date, gap_days) wherever two neighbours are not one step apart."""
    seen = with_bounded_window(
        df.select(key, date), [key], [date], 1, 0, lambda w: {"previous": F.lag(date).over(w)}, split_hot
    )
    return (
        seen.withColumn("gap_days", F.datediff(date, "previous"))
        .filter(F.col("previous").isNotNull() & (F.col("gap_days") != step_days))
        .select(key, "previous", date, "gap_days")
    )


def _expected(frequency: str) -> Column:
    """Whether a day is expected at a frequency, in a series that starts on the day ``_first``."""
    day = F.col("_day")
    rules = {
        "D": F.lit(True),
        "B": F.weekday(day) < 5,
        "W": F.pmod(F.datediff(day, "_first"), F.lit(7)) == 0,
        "MS": F.dayofmonth(day) == 1,
        "ME": day == F.last_day(day),
    }
    if frequency not in rules:
        raise SchemaError(f"frequency must be one of {list(rules)}, got {frequency}")
    return rules[frequency]


def frequency_gaps(df: DataFrame, key: str = "series_id", date: str = "ts", frequency: str = "D") -> DataFrame:
    """(key, date, kind) of every day where a series leaves its frequency, between its first and last day.

    The frequency is D (every day), B (Monday to Friday), W (every seventh day from the first one on), MS or ME
    (first or last day of each month). A day is ``missing`` if it is expected but has no row, ``unexpected`` if it
    has a row but is not expected. Repeated days count once, rows without a date are left out, a NULL key is a
    series of its own. Each day answers for the days since the one before it, so a calendar is never moved nor
    grouped; a task holds the distinct days of one series, which the calendar bounds, and they may spill."""
    require(df, [key, date], "series")
    rule = _expected(frequency)
    seen = df.select(F.col(key).alias("_key"), F.col(date).cast("date").alias("_seen")).where("_seen is not null").distinct()
    in_order = Window.partitionBy("_key").orderBy("_seen")
    placed = seen.withColumns({"_first": F.first("_seen").over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lag("_seen").over(in_order)})
    after = F.coalesce(F.date_add("_last", 1), F.col("_seen"))
    if frequency == "W":  # only every seventh day, and the day itself
        weeks = F.ceil(F.datediff(after, "_first") / 7).cast("int") * 7
        after = F.date_add("_first", weeks)
        week = F.expr("interval 7 days")
        days = F.when(after < F.col("_seen"), F.array_union(F.sequence(after, F.col("_seen"), week), F.array("_seen"))).otherwise(F.array("_seen"))
    else:
        days = F.sequence(after, F.col("_seen"))
    kind = F.when(rule, F.lit("missing")).otherwise(F.lit("unexpected"))
    off = placed.withColumn("_day", F.explode(days)).where(rule != (F.col("_day") == F.col("_seen")))
    return off.select(F.col("_key").alias(key), F.col("_day").alias(date), kind.alias("kind"))


def enforce_series(
    df: DataFrame, key: str = "series_id", date: str = "ts", value: str = "value", daily: bool = True, frequency: str | None = None
) -> None:
    """All series checks, raising on the first kind that fails. ``frequency``, if given, takes the place of ``daily``."""
    enforce(gate_report(df, series_gates(df, date, value)))
    twice = duplicate_dates(df, key, date).orderBy(key, date).limit(5).collect()
    if twice:
        raise GateError(f"duplicate dates: {[(r[key], str(r[date])) for r in twice]}")
    if frequency is not None:
        off = frequency_gaps(df, key, date, frequency).orderBy(key, date).limit(5).collect()
        if off:
            raise GateError(f"not of frequency {frequency}: {[(r[key], str(r[date]), r['kind']) for r in off]}")
    elif daily:
        # Dates are unique by now, so a series has at most one row a day.
        gaps = date_gaps(df, key, date, split_hot=False).limit(5).collect()
        if gaps:
            raise GateError(f"not daily: {[(r[key], str(r['previous']), str(r[date])) for r in gaps]}")


def require_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    wrong = sorted(set(columns) - set(numeric_columns(df)))
    if wrong:
        raise SchemaError(f"columns {wrong} must be numeric")


def same_columns(*frames: DataFrame) -> None:
    """Raise unless all frames have the same set of columns."""
    sets = {frozenset(f.columns) for f in frames}
    if len(sets) > 1:
        raise SchemaError("frames differ in their columns")
