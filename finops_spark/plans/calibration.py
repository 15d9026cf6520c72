"""Credit-risk calibration: split, encode, boost, calibrate, compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.operators.calibrate import calibrated_probability, train_and_calibrate
from finops_spark.operators.calibration_metrics import calibration_report
from finops_spark.operators.encode import fit_feature_pipeline, transform_splits
from finops_spark.operators.models import positive_probability
from finops_spark.operators.split import (
    THREE_WAY,
    enforce_stratification,
    split_part,
    stratification_check,
    stratified_split,
)
from finops_spark.session import cut_lineage, store
from finops_spark.sources.readers import read_labelled
from finops_spark.sources.writers import write_report


@dataclass(frozen=True)
class CalibrationResult:
    report: DataFrame
    scored: DataFrame
    features: PipelineModel
    calibrated: PipelineModel


def run_calibration(
    spark: SparkSession,
    source: str | DataFrame,
    target: str = "default",
    method: str = "sigmoid",
    tolerance: float = 0.02,
    seed: int = 42,
    report_path: str | None = None,
    model_path: str | None = None,
    **gbt,
) -> CalibrationResult:
    table = read_labelled(spark, source, target) if isinstance(source, str) else source
    # Three parts are read many times by the fits below: written once.
    parts = store(stratified_split(table, target, THREE_WAY, seed), "parts", by="split")
    enforce_stratification(stratification_check(parts, target, tolerance=tolerance), target)
    train, held_out, test = (split_part(parts, p) for p in THREE_WAY)
    pipeline, _ = fit_feature_pipeline(train.drop(target))
    train_v, held_v, test_v = (
        f.select("features", target) for f in transform_splits(pipeline, train, held_out, test)
    )
    train_v = cut_lineage(train_v)
    _, calibrated = train_and_calibrate(train_v, held_v, target, method, **gbt)
    scored = calibrated.transform(test_v)
    scored = scored.select(
        F.col(target).cast("int").alias("label"),
        positive_probability().alias("p"),
        calibrated_probability(scored).alias("p_cal"),
    )
    scored = cut_lineage(scored)
    report = calibration_report(scored)
    if report_path:
        write_report(report, report_path)
    if model_path:
        pipeline.write().overwrite().save(f"{model_path}/features")
        calibrated.write().overwrite().save(f"{model_path}/model")
    return CalibrationResult(report, scored, pipeline, calibrated)
