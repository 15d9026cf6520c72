"""Stuck-feed monitor: prices in, alerts and detection quality out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from finops_spark.operators.alerts import alert_summary
from finops_spark.operators.flat import flag_flat
from finops_spark.operators.gates import duplicate_dates, enforce, gate_report, price_gates
from finops_spark.operators.intervals import detection_metrics, intervals_to_dates, row_calendar
from finops_spark.errors import GateError
from finops_spark.session import cut_lineage
from finops_spark.sources.readers import read_intervals, read_prices
from finops_spark.sources.writers import write_alerts, write_report


@dataclass(frozen=True)
class MonitorResult:
    flags: DataFrame
    summary: DataFrame
    metrics: DataFrame | None


def check_prices(prices: DataFrame) -> None:
    enforce(gate_report(prices, price_gates(prices)))
    if not duplicate_dates(prices, "asset", "date").isEmpty():
        raise GateError("an asset has two prices on one date")


def run_monitor(
    spark: SparkSession,
    prices: str | DataFrame,
    intervals: str | DataFrame | None = None,
    window: int = 5,
    threshold: float = 0.01,
    match: str = "first",
    alerts_path: str | None = None,
    metrics_path: str | None = None,
    strict: bool = True,
) -> MonitorResult:
    """Detect flat feeds, write alerts, and score them against labels if given."""
    table = read_prices(spark, prices) if isinstance(prices, str) else prices
    if strict:
        check_prices(table)
    # Dates are unique for an asset, so its length is bounded by the calendar.
    flags = flag_flat(table, window=window, threshold=threshold, split_hot=False)
    # The flags feed the alert file, the summary and the metrics.
    flags = cut_lineage(flags)
    if alerts_path:
        write_alerts(flags, alerts_path)
    metrics = None
    if intervals is not None:
        labelled = read_intervals(spark, intervals) if isinstance(intervals, str) else intervals
        if "asset_id" in labelled.columns:
            labelled = intervals_to_dates(labelled, row_calendar(table))
        metrics = detection_metrics(flags, labelled, match)
        if metrics_path:
            write_report(metrics, metrics_path)
    return MonitorResult(flags, alert_summary(flags), metrics)
