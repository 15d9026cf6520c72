"""Forecasting: features, folds, ridge, stability gate, refit, forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.operators.features import feature_matrix, feature_names, require_samples
from finops_spark.operators.forecast import forecast
from finops_spark.operators.gates import enforce_series
from finops_spark.operators.ridge import ALL_ROWS, cross_validate, enforce_stability, fold_stability, residual_flags
from finops_spark.session import cut_lineage
from finops_spark.sources.readers import read_series
from finops_spark.sources.writers import write_report


@dataclass(frozen=True)
class ForecastResult:
    metrics: DataFrame
    stability: DataFrame
    models: DataFrame
    metadata: DataFrame
    features: list[str]


def run_forecasting(
    spark: SparkSession,
    source: str | DataFrame,
    date: str = "date",
    value: str = "revenue",
    lags: Sequence[int] = (1, 7, 14),
    windows: Sequence[int] = (7,),
    with_calendar: bool = True,
    n_splits: int = 5,
    valid_size: int = 90,
    gap: int = 0,
    expanding: bool = True,
    train_size: int | None = None,
    initial_train_size: int | None = None,
    alpha: float = 1.0,
    fmt: str | None = None,
    series: str | None = None,
    max_cv_percent: float = 5.0,
    strict: bool = True,
    output_path: str | None = None,
) -> ForecastResult:
    """All folds of all series and the final refit in one pass over the samples."""
    if isinstance(source, str):
        table = read_series(spark, source, date, value, fmt, series, strict=strict)
    else:
        table = source
        if strict:
            enforce_series(table)
    names = feature_names(lags, windows, with_calendar)
    samples = cut_lineage(feature_matrix(table, lags=lags, windows=windows, with_calendar=with_calendar))
    require_samples(samples)
    metrics, models = cross_validate(
        samples,
        names,
        alpha=alpha,
        expanding=expanding,
        n_splits=n_splits,
        valid_size=valid_size,
        gap=gap,
        train_size=train_size,
        initial_train_size=initial_train_size,
    )
    metrics, models = cut_lineage(residual_flags(metrics)), cut_lineage(models)
    stability = fold_stability(metrics, max_cv_percent=max_cv_percent)
    if strict:
        enforce_stability(stability, max_cv_percent=max_cv_percent)
    final = models.filter(F.col("fold") == ALL_ROWS)
    span = table.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("ts").alias("first_date"), F.max("ts").alias("last_date")
    )
    metadata = span.join(stability, "series_id").select(
        F.current_timestamp().alias("created_at"),
        "*",
        F.array(*[F.lit(n) for n in names]).alias("features"),
        F.lit(len(names)).alias("n_features"),
        F.array(*[F.lit(n) for n in lags]).alias("lags"),
        F.array(*[F.lit(n) for n in windows]).cast("array<int>").alias("windows"),
        F.lit(with_calendar).alias("with_calendar"),
        F.lit(float(alpha)).alias("alpha"),
    )
    if output_path:
        final.write.mode("overwrite").parquet(f"{output_path}/models")
        write_report(metrics, f"{output_path}/metrics")
        write_report(metadata, f"{output_path}/metadata")
    return ForecastResult(metrics, stability, final, metadata, names)


def forecast_from(
    spark: SparkSession, series: DataFrame, path: str, steps: int = 1, compat: bool = False, calendar_offset: int = 1
) -> DataFrame:
    """Forecast with saved models, using the layout they were trained with."""
    models = spark.read.parquet(f"{path}/models")
    layout = spark.read.json(f"{path}/metadata").first()
    return forecast(
        series,
        models,
        layout["lags"],
        layout["windows"],
        steps,
        with_calendar=layout["with_calendar"],
        compat=compat,
        calendar_offset=calendar_offset,
    )
