"""Feature pipelines as persisted MLlib stages.

Fitted statistics end up as literals in SQLTransformer stages, so a saved
pipeline holds everything scoring needs, runs inside the JVM, and loads through
``PipelineModel.load`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import FitError, SchemaError
from finops_spark.functions.scalar import null_if_nan, numeric_columns, string_columns
from finops_spark.operators.gates import same_columns
from finops_spark.operators.levels import LevelIndexer, SlotNames
from finops_spark.operators.medians import exact_medians, exact_modes


def column_roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns by type; booleans are categorical."""
    numeric = numeric_columns(df)
    bools = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    categorical = [c for c in df.columns if c in {*string_columns(df), *bools}]
    other = sorted(set(df.columns) - {*numeric, *categorical})
    if other:
        raise SchemaError(f"columns {other} are neither numeric nor categorical")
    return numeric, categorical


def _number(value: float) -> str:
    return f"cast('{float(value)!r}' AS double)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class NumericFit:
    fill: float | None
    mean: float
    scale: float


def fit_numeric(train: DataFrame, columns: Sequence[str], fill: bool = True) -> dict[str, NumericFit]:
    """Median for gaps, then mean and population deviation; a zero deviation
    becomes 1. All columns share the passes; without ``fill`` there is one."""
    medians = exact_medians(train, {c: F.col(c) for c in columns}) if fill else {}
    empty = sorted(c for c, m in medians.items() if m is None)
    if empty:
        raise FitError(f"columns {empty} have no values")
    aggregates = []
    for i, c in enumerate(columns):
        value = null_if_nan(train, c).cast("double")
        value = F.coalesce(value, F.lit(float(medians[c]))) if fill else value
        aggregates += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
    row = train.agg(*aggregates).first() if columns else None
    return {
        c: NumericFit(medians.get(c), row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] else 1.0)
        for i, c in enumerate(columns)
    }


def standardized(column: str, fit: NumericFit, name: str | None = None) -> str:
    """SQL for the filled and standardised column."""
    value = f"nanvl(cast(`{column}` AS double), cast(NULL AS double))"
    if fit.fill is not None:
        value = f"coalesce({value}, {_number(fit.fill)})"
    return f"({value} - {_number(fit.mean)}) / {_number(fit.scale)} AS `{name or column}`"


def _with_columns(expressions: Sequence[str]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(expressions)} FROM __THIS__")


def fit_feature_pipeline(
    train: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    features_col: str = "features",
) -> tuple[PipelineModel, SlotNames]:
    """Fill, standardise and one-hot encode; fitted on the training rows only.

    Returns the pipeline and the names of the vector's entries, numeric block
    first. Every training level keeps its own column; a level not seen in
    training becomes all zeros.
    """
    if numeric is None or categorical is None:
        numeric, categorical = column_roles(train)
    if train.isEmpty():
        raise FitError("training table is empty")
    stages: list = []
    inputs: list[str] = []
    names = SlotNames(numeric)
    if numeric:
        fits = fit_numeric(train, numeric)
        scaled = _with_columns([standardized(c, fits[c], f"{c}__std") for c in numeric])
        stages.append(scaled)
        inputs += [f"{c}__std" for c in numeric]
    if categorical:
        texts = train.select(*[F.col(c).cast("string").alias(c) for c in categorical])
        modes = {r["column"]: r["mode"] for r in exact_modes(texts, categorical).collect()}
        empty = sorted(set(categorical) - set(modes))
        if empty:
            raise FitError(f"columns {empty} have no values")
        filled = _with_columns(
            [f"coalesce(cast(`{c}` AS string), {_text(modes[c])}) AS `{c}__cat`" for c in categorical]
        )
        current = filled.transform(train)
        indexer = LevelIndexer.fit_columns(current, {f"{c}__cat": f"{c}__idx" for c in categorical}, unseen=None)
        encoder = OneHotEncoder(
            inputCols=[f"{c}__idx" for c in categorical],
            outputCols=[f"{c}__hot" for c in categorical],
            dropLast=True,  # drops the slot of unseen levels only
        ).fit(indexer.transform(current))
        stages += [filled, indexer, encoder]
        inputs += [f"{c}__hot" for c in categorical]
        names = SlotNames(numeric, indexer, {f"{c}__cat": c for c in categorical})
    assembler = VectorAssembler(inputCols=inputs, outputCol=features_col, handleInvalid="keep")
    return PipelineModel(stages=[*stages, assembler]), names


def transform_splits(pipeline: PipelineModel, *frames: DataFrame) -> list[DataFrame]:
    """Apply one fitted pipeline to several splits with the same columns."""
    same_columns(*frames)
    return [pipeline.transform(f) for f in frames]


def fit_ordinal_encoder(train: DataFrame, columns: Sequence[str]) -> list:
    """Stages adding ``<column>_code``: alphabetical codes from 0, unseen levels -1."""
    columns = list(columns)
    return [LevelIndexer.fit_columns(train, {c: f"{c}_code" for c in columns})] if columns else []


def ordinal_encode(df: DataFrame, encoder: Sequence, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by their codes, keeping names and places."""
    coded = df
    for stage in encoder:
        coded = stage.transform(coded)
    return coded.select(*[F.col(f"{c}_code").alias(c) if c in columns else F.col(c) for c in df.columns])
