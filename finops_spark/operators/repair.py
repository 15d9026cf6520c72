"""Column profiles and null repair, fitted once and applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import FitError
from finops_spark.functions.scalar import (
    AMOUNT_COLUMNS,
    DUPLICATE_ID_COLUMNS,
    first_present,
    missing,
    null_if_nan,
    numeric_columns,
    string_columns,
)
from finops_spark.operators.medians import exact_medians, exact_modes

MAX_NULL_RATE = 0.40
HEAVY_TAIL_RATIO = 1000.0


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, null_rate) for every column, in one pass."""
    columns = df.columns
    measured = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(missing(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n_null")) for i, c in enumerate(columns)]
    )
    return measured.select(F.col("_rows").alias("n_rows"), F.explode(entries).alias("e")).select(
        "e.column",
        "n_rows",
        "e.n_null",
        F.coalesce(F.try_divide(F.col("e.n_null").cast("double"), F.col("n_rows")), F.lit(0.0)).alias("null_rate"),
    )


def value_ranges(df: DataFrame) -> DataFrame:
    """(column, n_values, min_value, max_value, zero_variance) of numeric columns.

    A column has zero variance when its least and greatest values agree and more
    than one row exists; comparing them is exact where a deviation is not.
    """
    columns = numeric_columns(df)
    if not columns:
        raise FitError("no numeric columns")
    aggregates = []
    for i, c in enumerate(columns):
        v = null_if_nan(df, c)
        aggregates += [
            F.count(v).alias(f"_c{i}"),
            F.min(v).cast("double").alias(f"_lo{i}"),
            F.max(v).cast("double").alias(f"_hi{i}"),
        ]
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_c{i}").alias("n_values"),
                F.col(f"_lo{i}").alias("min_value"),
                F.col(f"_hi{i}").alias("max_value"),
                F.coalesce((F.col(f"_lo{i}") == F.col(f"_hi{i}")) & (F.col(f"_c{i}") > 1), F.lit(False)).alias(
                    "zero_variance"
                ),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggregates).select(F.explode(entries).alias("e")).select("e.*")


def duplicate_count(df: DataFrame, id_columns: Sequence[str] = DUPLICATE_ID_COLUMNS) -> DataFrame:
    """One row ``n_duplicates``: rows beyond the first of each id; 0 without an id."""
    key = first_present(df, id_columns)
    if key is None:
        return df.sparkSession.createDataFrame([(0,)], "n_duplicates long")
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("n_duplicates"))


def heavy_tail(df: DataFrame, columns: Sequence[str] = AMOUNT_COLUMNS, ratio: float = HEAVY_TAIL_RATIO) -> DataFrame:
    """One row (column, max_value, median_value, is_heavy): max / median > ratio.

    False when the column is missing, not numeric, or has median 0.
    """
    name = first_present(df, columns)
    spark = df.sparkSession
    schema = "column string, max_value double, median_value double, is_heavy boolean"
    if name is None or name not in numeric_columns(df):
        return spark.createDataFrame([(name, None, None, False)], schema)
    median = exact_medians(df, {name: F.col(name)})[name]
    top = F.max(null_if_nan(df, name)).cast("double")
    flag = F.lit(False) if not median else F.coalesce(top / F.lit(float(median)) > ratio, F.lit(False))
    return df.agg(
        F.lit(name).alias("column"),
        top.alias("max_value"),
        F.lit(median).cast("double").alias("median_value"),
        flag.alias("is_heavy"),
    )


@dataclass(frozen=True)
class Repair:
    """What a repair learned: plain values, so any later batch is treated alike."""

    dropped: tuple[str, ...] = ()
    fills: dict[str, float | str] = field(default_factory=dict)
    n_duplicates: int = 0
    heavy_tail: bool = False

    def sql_columns(self, columns: Sequence[str], schema: T.StructType) -> list[str]:
        """Select list that drops and fills; the form a persisted stage takes."""
        parts = []
        for c in columns:
            if c in self.dropped:
                continue
            if c not in self.fills:
                parts.append(f"`{c}`")
                continue
            kind, value = schema[c].dataType, self.fills[c]
            if isinstance(value, str):
                text = value.replace("\\", "\\\\").replace("'", "\\'")
                parts.append(f"coalesce(`{c}`, '{text}') AS `{c}`")
            elif isinstance(kind, T.IntegralType) and float(value).is_integer():
                parts.append(f"coalesce(`{c}`, cast({int(value)} AS {kind.simpleString()})) AS `{c}`")
            else:
                parts.append(
                    f"coalesce(nanvl(cast(`{c}` AS double), cast(NULL AS double)), {float(value)!r}D) AS `{c}`"
                )
        return parts

    def transform(self, df: DataFrame) -> DataFrame:
        return df.selectExpr(*self.sql_columns(df.columns, df.schema))


def fit_repair(
    df: DataFrame,
    label: str | None = None,
    max_null_rate: float = MAX_NULL_RATE,
    fill_all: bool = False,
    ids: Sequence[str] = (),
    ratio: float = HEAVY_TAIL_RATIO,
) -> Repair:
    """Learn dropped columns, fill values and flags; the label is never touched.

    Sparse columns go first, gaps are then filled (median of numbers, mode of
    texts, booleans left alone), and columns of one value go last. ``fill_all``
    also learns values for columns without gaps in ``df``, for later batches that
    may have some; ``ids`` are columns not worth a value.
    """
    features = df.drop(label) if label else df
    columns, numbers = features.columns, set(numeric_columns(features))
    # One pass for gaps and ranges of all columns.
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggregates.append(F.count_if(missing(features, c)).alias(f"n{i}"))
        if c in numbers:
            v = null_if_nan(features, c)
            aggregates += [F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}")]
    seen = features.agg(*aggregates).first()
    rows = seen["rows"]
    if rows == 0:
        raise FitError("no rows to learn a repair from")
    gaps = {c: seen[f"n{i}"] for i, c in enumerate(columns)}
    top = {c: seen[f"hi{i}"] for i, c in enumerate(columns) if c in numbers}
    sparse = [c for c in columns if gaps[c] / rows > max_null_rate]
    # Filling a column of one value leaves one value, so the raw range decides.
    flat = [
        c
        for i, c in enumerate(columns)
        if c in numbers and c not in sparse and rows > 1 and top[c] is not None and seen[f"lo{i}"] == top[c]
    ]
    kept = features.drop(*sparse)
    wanted = [c for c in kept.columns if (fill_all or gaps[c]) and c not in ids]
    amount = first_present(kept, AMOUNT_COLUMNS)
    measured = {c for c in wanted if c in numbers} | ({amount} & numbers)
    middles = exact_medians(kept, {c: F.col(c) for c in kept.columns if c in measured})
    fills: dict[str, float | str | None] = {c: middles[c] for c in wanted if c in numbers}
    texts = [c for c in string_columns(kept) if c in wanted]
    if texts:
        modes = {r["column"]: r["mode"] for r in exact_modes(kept, texts).collect()}
        fills.update({c: modes.get(c) for c in texts})
    empty = sorted(c for c, v in fills.items() if v is None)
    if empty:
        raise FitError(f"columns {empty} have no values to fill from")
    middle = middles.get(amount)
    return Repair(
        dropped=tuple(sorted({*sparse, *flat})),
        fills={c: v for c, v in fills.items() if c not in flat},
        n_duplicates=duplicate_count(features).first()["n_duplicates"],
        heavy_tail=bool(middle) and top[amount] / middle > ratio,
    )


def repair_report(df: DataFrame, repair: Repair) -> DataFrame:
    """(section, item, detail): the repair as a table."""
    rows = [("dropped", c, None) for c in repair.dropped]
    rows += [("filled", c, str(v)) for c, v in sorted(repair.fills.items())]
    rows += [("duplicates", "rows", str(repair.n_duplicates)), ("log_transform", "flag", str(repair.heavy_tail).lower())]
    return df.sparkSession.createDataFrame(rows, "section string, item string, detail string")
