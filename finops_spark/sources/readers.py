"""Readers: explicit schemas where the layout is fixed, checks as gates.

CSV and Parquet are accepted everywhere; Parquet is the one to use at scale,
since filters and column selections reach its scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import GateError, SchemaError
from finops_spark.functions.scalar import missing, numeric_columns, require
from finops_spark.operators.gates import enforce, enforce_series, gate_report, not_empty, transaction_gates

# The columns every transaction file has, and their types.
TRANSACTION_FIELDS = {
    "TransactionAmt": T.DoubleType(),
    "TransactionDT": T.LongType(),
    "hour_of_day": T.IntegerType(),
    "day_of_week": T.IntegerType(),
    "card_type": T.StringType(),
    "merchant_category": T.StringType(),
    "V1": T.DoubleType(),
    "is_fraud": T.IntegerType(),
}
LABEL = "is_fraud"


def _read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if path.endswith(".parquet") or path.rstrip("/").endswith("_parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return reader.option("inferSchema", True).csv(path)


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise GateError(f"{what} has no rows")
    return df


def read_prices(spark: SparkSession, path: str, date: str = "date", fmt: str | None = None) -> DataFrame:
    """Wide price file (a date and one column for each asset) as asset, date, price."""
    wide = _read(spark, path)
    require(wide, [date], "price file")
    assets = [c for c in wide.columns if c != date]
    if not assets:
        raise SchemaError("price file has no asset columns")
    wrong = sorted(set(assets) - set(numeric_columns(wide)))
    # A wholly empty column is inferred as text; it fails the null check below.
    textual = [c for c in wrong if wide.schema[c].dataType == T.StringType()]
    if len(textual) != len(wrong):
        raise SchemaError(f"price columns {wrong} are not numeric")
    if wide.filter(F.col(date).isNull()).limit(1).count():
        raise GateError(f"{date} has missing values")
    day = F.to_date(F.col(date), fmt) if fmt else F.to_date(F.col(date))
    wide = wide.select(day.alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in assets])
    # One aggregation for all assets: a column without any value is an error.
    filled = wide.agg(*[F.count_if(~missing(wide, c)).alias(c) for c in assets]).first()
    hollow = [c for c in assets if filled[c] == 0]
    if hollow:
        raise GateError(f"assets {hollow} have no prices")
    return wide.unpivot(["date"], assets, "asset", "price").select("asset", "date", "price")


def _with_line_order(raw: DataFrame) -> DataFrame:
    """Add ``seq``: zero-based line over all files, taken by name.

    Spark packs large files first, so row ids follow the lines only within one piece of a
    file. Lines are numbered within their piece (which a task reads) and shifted by the
    lines of the pieces before it, one row for each piece.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    piece = ["_file", "_start"]
    sizes = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_lines").over(earlier), F.lit(0))).drop("_lines")
    numbered = placed.withColumn("_line", F.row_number().over(Window.partitionBy(*piece).orderBy("_id")))
    return numbered.join(shifts, piece).withColumn("seq", F.col("_shift") + F.col("_line") - 1).select(*raw.columns, "seq")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Labelled intervals, by date (asset, start_date, end_date) or by row position
    (asset_id, window_start_idx, window_end_idx); adds ``seq``, the line order, unless the
    file has it."""
    raw = _read(spark, path)
    raw = raw.withColumn("seq", F.col("seq").cast("long")) if "seq" in raw.columns else _with_line_order(raw)
    if {"asset_id", "window_start_idx", "window_end_idx"} <= set(raw.columns):
        return raw.select(
            "seq",
            F.col("asset_id").cast("string").alias("asset_id"),
            F.col("window_start_idx").cast("long").alias("window_start_idx"),
            F.col("window_end_idx").cast("long").alias("window_end_idx"),
        )
    require(raw, ["asset", "start_date", "end_date"], "interval file")
    return raw.select(
        "seq",
        F.col("asset").cast("string").alias("asset"),
        F.to_date("start_date").alias("start_date"),
        F.to_date("end_date").alias("end_date"),
    )


def read_labelled(spark: SparkSession, path: str, target: str = "default") -> DataFrame:
    """Any table with a target column; types are inferred, an empty file raises."""
    df = _not_empty(_read(spark, path), "labelled table")
    require(df, [target], "labelled table")
    if df.filter(missing(df, target)).limit(1).count():
        raise GateError(f"target {target} has missing values")
    return df


def _transaction_schema(spark: SparkSession, path: str, with_label: bool) -> T.StructType | None:
    """Fixed types for the known columns, text or number for any others."""
    if path.endswith(".parquet") or path.rstrip("/").endswith("_parquet"):
        return None
    header = spark.read.option("header", True).csv(path).columns
    wanted = [c for c in TRANSACTION_FIELDS if with_label or c != LABEL]
    absent = sorted(set(wanted) - set(header))
    if absent:
        raise SchemaError(f"transaction file lacks columns {absent}")
    extra = [c for c in header if c not in TRANSACTION_FIELDS]
    # Only files with unknown columns pay for an inference pass.
    inferred = _read(spark, path).schema if extra else None
    return T.StructType([T.StructField(c, TRANSACTION_FIELDS.get(c) or inferred[c].dataType) for c in header])


def read_transactions(
    spark: SparkSession,
    path: str,
    strict: bool = True,
    min_rows: int | None = None,
    max_rows: int | None = None,
    min_rate: float = 0.005,
    max_rate: float = 0.05,
) -> DataFrame:
    """Labelled transactions; ``strict`` enforces label and rate gates, and bounds on
    the number of rows where they are given."""
    df = _read(spark, path, _transaction_schema(spark, path, True))
    require(df, list(TRANSACTION_FIELDS), "transaction file")
    _not_empty(df, "transaction file")
    if strict:
        enforce(gate_report(df, transaction_gates(df, LABEL, min_rows, max_rows, min_rate, max_rate)))
    return df


def read_scoring_input(spark: SparkSession, path: str) -> DataFrame:
    """Transactions to score: the same columns, the label optional."""
    df = _read(spark, path, _transaction_schema(spark, path, False))
    require(df, [c for c in TRANSACTION_FIELDS if c != LABEL], "scoring input")
    enforce(gate_report(df, [not_empty()]))
    return df


def read_series(
    spark: SparkSession,
    path: str,
    date: str = "date",
    value: str = "value",
    fmt: str | None = None,
    series: str | None = None,
    daily: bool = True,
    strict: bool = True,
    frequency: str | None = None,
) -> DataFrame:
    """Series file as series_id, ts, value; ``strict`` runs all series checks, with ``frequency`` in place of ``daily``."""
    header: Sequence[str] = [date, value, *([series] if series else [])]
    if path.endswith(".parquet") or path.rstrip("/").endswith("_parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).csv(path)  # as text; typed below
    require(raw, header, "series file")
    text = F.col(date).cast("string")
    day = F.try_to_date(text, fmt) if fmt else F.coalesce(text.try_cast("date"), text.try_cast("timestamp").cast("date"))
    df = raw.select(
        (F.col(series).cast("string") if series else F.lit("series")).alias("series_id"),
        day.alias("ts"),
        F.col(value).try_cast("double").alias("value"),
    )
    if strict:
        enforce_series(df, daily=daily, frequency=frequency)
    return df
