"""Reason codes: the features of a linear model that speak most for its class 1, row by row.

The contribution of a feature is its coefficient times the distance of its value from the
average of a background table; for a linear model over features taken as independent these are
the Shapley values of the margin. The slots of a one-hot text count as one feature. Everything is
built-in functions over literals, a few numbers for each slot of the vector, so rows are
explained in the scan that scores them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finops_spark.errors import FitError, SchemaError
from finops_spark.functions.scalar import require
from finops_spark.operators.models import ScoringBundle, positive_probability

TOP = 3


@dataclass(frozen=True)
class Explainer:
    """Coefficient and background average of every slot, and the run of slots (first from 1, number) of each feature."""

    vector: str
    coefficients: tuple[float, ...]
    averages: tuple[float, ...]
    features: dict[str, tuple[int, int]]

    def contributions(self, slots: Column) -> dict[str, Column]:
        """Each feature's contribution out of an array with those of all slots."""
        return {
            name: F.element_at(slots, at) if n == 1 else F.aggregate(F.slice(slots, at, n), F.lit(0.0), lambda a, b: a + b)
            for name, (at, n) in self.features.items()
        }

    def slots(self) -> Column:
        """Array with the contribution of every slot of the vector column."""
        apart = F.zip_with(vector_to_array(self.vector), F.array(*map(F.lit, self.averages)), lambda x, m: x - m)
        return F.zip_with(apart, F.array(*map(F.lit, self.coefficients)), lambda d, c: d * c)


def slot_runs(names) -> dict[str, tuple[int, int]]:
    """feature: (first slot from 1, slots); slots named ``feature=level`` that follow each other are one feature."""
    runs: dict[str, tuple[int, int]] = {}
    last = None
    for at, name in enumerate(names, 1):
        feature, level, _ = name.partition("=")
        if level and feature == last:
            runs[feature] = (runs[feature][0], runs[feature][1] + 1)
        elif (feature if level else name) in runs:
            raise SchemaError(f"feature {feature} has slots in two places")
        else:
            runs[feature if level else name] = (at, 1)
        last = feature if level else None
    return runs


def fit_explainer(bundle: ScoringBundle, background: DataFrame) -> Explainer:
    """The bundle's linear model with the slot averages of ``background``, in one pass over it."""
    model = bundle.pipeline.stages[-1]
    if not hasattr(model, "coefficients"):
        raise SchemaError(f"a {type(model).__name__} has no coefficients")
    weights = [float(c) for c in model.coefficients.toArray()]
    if len(weights) != len(bundle.feature_names):
        raise SchemaError(f"{len(weights)} coefficients but {len(bundle.feature_names)} feature names")
    vector = model.getFeaturesCol()
    require(background, bundle.required_columns, "background table")
    vectors = PipelineModel(stages=bundle.pipeline.stages[:-1]).transform(background)
    # grouped, so that an empty table gives no row, for which the summarizer has no mean
    row = vectors.groupBy(F.lit("all")).agg(Summarizer.mean(F.col(vector)).alias("m")).first()
    if row is None:
        raise FitError("background table is empty")
    return Explainer(vector, tuple(weights), tuple(float(x) for x in row["m"].toArray()), slot_runs(bundle.feature_names))


def reason_codes(
    df: DataFrame, bundle: ScoringBundle, explainer: Explainer, codes: Mapping[str, str], top: int = TOP, probability: str = "probability_adverse"
) -> DataFrame:
    """The adverse rows of ``df``, those at or above the bundle's threshold, with their probability and ``reasons``.

    ``reasons`` is an array of (rank, feature, contribution, code): the ``top`` features with the largest
    contributions towards class 1, largest first, ties by name. Only positive contributions are reasons, so
    there may be fewer; where the intercept alone decides there are none. ``codes`` must have every feature
    of the model. An empty table gives no rows."""
    without = sorted(set(explainer.features) - set(codes))
    if without:
        raise SchemaError(f"features {without} have no reason code")
    if top < 1:
        raise SchemaError(f"top must be 1 or more, got {top}")
    require(df, bundle.required_columns, "table to explain")
    scored = bundle.pipeline.transform(df).withColumn(probability, positive_probability())
    scored = scored.where(F.col(probability) >= bundle.threshold).withColumn("_slots", explainer.slots())
    each = [
        F.struct((-c).alias("down"), F.lit(name).alias("feature"), F.lit(codes[name]).alias("code"))
        for name, c in explainer.contributions(F.col("_slots")).items()
    ]
    best = F.slice(F.array_sort(F.filter(F.array(*each), lambda e: e["down"] < 0)), 1, top)
    ranked = F.transform(
        best, lambda e, i: F.struct((i + 1).alias("rank"), e["feature"].alias("feature"), (-e["down"]).alias("contribution"), e["code"].alias("code"))
    )
    return scored.select(*df.columns, probability, ranked.alias("reasons"))
