"""Probability calibration of a fitted classifier on held-out rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finops_spark.errors import FitError
from finops_spark.operators.isotonic import pool_violators
from finops_spark.operators.models import train_gbt

METHODS = ("sigmoid", "isotonic")


def margin_stage(raw: str = "rawPrediction", margin: str = "margin") -> VectorSlicer:
    """The score of class 1 as a vector of length one."""
    return VectorSlicer(inputCol=raw, outputCol=margin, indices=[1])


def fit_sigmoid(scored: DataFrame, label: str = "label", margin: str = "margin"):
    """Platt scaling: a logistic curve on the margin with smoothed targets.

    A target t strictly between 0 and 1 is a row of label 1 with weight t and one
    of label 0 with weight 1 - t. Equal (margin, label) pairs are added up first.
    """
    counts = scored.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    if counts["p"] + counts["n"] == 0:
        raise FitError("calibration table is empty")
    high, low = (counts["p"] + 1.0) / (counts["p"] + 2.0), 1.0 / (counts["n"] + 2.0)
    m = vector_to_array(F.col(margin))[0]
    grouped = scored.groupBy(m.alias("m"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("k"))
    t = F.when(F.col("y") == 1, high).otherwise(low)
    rows = grouped.select(
        array_to_vector(F.array("m")).alias(margin),
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("target"), (F.col("k") * t).alias("weight")),
                F.struct(F.lit(0.0).alias("target"), (F.col("k") * (F.lit(1.0) - t)).alias("weight")),
            )
        ).alias("e"),
    ).select(margin, "e.*")
    return LogisticRegression(
        featuresCol=margin,
        labelCol="target",
        weightCol="weight",
        regParam=0.0,
        maxIter=200,
        tol=1e-10,
        rawPredictionCol="calibrated_raw",
        probabilityCol="calibrated_vector",
        predictionCol="calibrated_class",
    ).fit(rows)


def fit_isotonic(scored: DataFrame, label: str = "label", margin: str = "margin"):
    """Isotonic regression of the label on the margin; equal margins are averaged
    first, with their row count as weight.

    Violators are pooled by Spark in ranges; the model is made from the first and last
    margin of each pooled block, which is the curve itself."""
    m = vector_to_array(F.col(margin))[0]
    grouped = scored.groupBy(m.alias("m")).agg(
        F.avg(F.col(label).cast("double")).alias("target"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    blocks = pool_violators(grouped, "m", "target", "weight")
    if blocks.isEmpty():
        raise FitError("calibration table is empty")
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("m")
    corners = blocks.select(ends, (F.col("total") / F.col("weight")).alias("target"), "weight")
    rows = corners.select(array_to_vector(F.array("m")).alias(margin), "target", "weight")
    return IsotonicRegression(
        featuresCol=margin, labelCol="target", weightCol="weight", predictionCol="calibrated_value"
    ).fit(rows)


def calibrate(base, held_out: DataFrame, label: str = "label", method: str = "sigmoid") -> PipelineModel:
    """Base model, margin and fitted curve as one pipeline."""
    if method not in METHODS:
        raise FitError(f"method must be one of {METHODS}, got {method!r}")
    margin = margin_stage()
    scored = margin.transform(base.transform(held_out)).select("margin", label)
    curve = fit_sigmoid(scored, label) if method == "sigmoid" else fit_isotonic(scored, label)
    return PipelineModel(stages=[base, margin, curve])


def calibrated_probability(scored: DataFrame) -> Column:
    """Calibrated probability of class 1 in the output of ``calibrate``'s pipeline."""
    if "calibrated_vector" in scored.columns:
        return vector_to_array(F.col("calibrated_vector"))[1]
    return F.col("calibrated_value")


def train_and_calibrate(
    train: DataFrame, held_out: DataFrame, label: str = "label", method: str = "sigmoid", **gbt
) -> tuple[object, PipelineModel]:
    """(base model, calibrated pipeline)."""
    base = train_gbt(train, label, **gbt)
    return base, calibrate(base, held_out, label, method)
