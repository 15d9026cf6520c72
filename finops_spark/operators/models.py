"""Classifiers, model choice and the versioned scoring bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import FitError, SchemaError
from finops_spark.functions.scalar import AMOUNT_COLUMNS, ID_COLUMNS, SECONDS_COLUMN, above_threshold, first_present
from finops_spark.functions.scalar import numeric_columns, require, string_columns
from finops_spark.operators.curves import average_precision, threshold_curve
from finops_spark.operators.encode import _number, _text, _with_columns, fit_numeric, fit_ordinal_encoder, standardized
from finops_spark.operators.repair import Repair

SEED = 42


def positive_probability(column: str = "probability") -> Column:
    """Probability of class 1 out of a model's probability vector."""
    return vector_to_array(F.col(column))[1]


def _require_rows(df: DataFrame, what: str = "training table") -> None:
    if df.isEmpty():
        raise FitError(f"{what} is empty")


# --- classifiers --------------------------------------------------------------------


def train_gbt(
    train: DataFrame,
    label: str = "label",
    features: str = "features",
    n_trees: int = 100,
    max_depth: int = 3,
    learning_rate: float = 0.1,
    min_leaf_rows: int = 5,
    subsample: float = 0.8,
    seed: int = SEED,
):
    """Gradient-boosted trees. MLlib has no least node size for splitting; the
    least leaf size bounds it from below."""
    _require_rows(train)
    return GBTClassifier(
        labelCol=label,
        featuresCol=features,
        maxIter=n_trees,
        maxDepth=max_depth,
        stepSize=learning_rate,
        minInstancesPerNode=min_leaf_rows,
        subsamplingRate=subsample,
        seed=seed,
    ).fit(train)


def balanced_weights(train: DataFrame, label: str = "label", name: str = "class_weight") -> tuple[DataFrame, int]:
    """Add a weight n / (classes * n_class); returns the frame and the row count.

    The weights of all rows add up to the row count.
    """
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if set(counts) != {0, 1}:
        raise FitError(f"both classes 0 and 1 are needed, found {sorted(counts, key=str)}")
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    return train.withColumn(name, weight), n


def train_logistic(
    train: DataFrame, label: str = "label", features: str = "features", c: float = 0.1, max_iter: int = 1000, weight: str | None = None
):
    """Logistic regression with penalty strength 1/c on given features; balanced, or with a column of weights.

    MLlib divides the loss by the sum of weights, so its penalty is 1 / (c * sum).
    """
    if weight is None:
        weighted, n = balanced_weights(train, label)
    else:
        weighted, n = train, train.agg(F.sum(weight)).first()[0]
        if not n or n <= 0:
            raise FitError(f"the weights in {weight} do not add up to more than 0")
    return LogisticRegression(
        labelCol=label,
        featuresCol=features,
        weightCol=weight or "class_weight",
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-8,
    ).fit(weighted)


def train_forest(
    train: DataFrame,
    label: str = "label",
    features: str = "features",
    n_trees: int = 100,
    max_depth: int = 10,
    seed: int = SEED,
    bootstrap: bool = True,
    group_mb: int = 256,
):
    """Balanced random forest; without ``bootstrap`` every tree takes every row. ``group_mb`` bounds the counts of
    the nodes grown in one pass: fewer stay in a core's cache, more save passes where vectors are wide."""
    weighted, _ = balanced_weights(train, label)
    return RandomForestClassifier(
        labelCol=label,
        featuresCol=features,
        weightCol="class_weight",
        numTrees=n_trees,
        maxDepth=max_depth,
        seed=seed,
        bootstrap=bootstrap,
        maxMemoryInMB=group_mb,
    ).fit(weighted)


def feature_importance(spark: SparkSession, model, names: Sequence[str], top: int = 10) -> DataFrame:
    """(feature, importance): forest importances or absolute coefficients, best first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        raise SchemaError(f"no importances in a {type(model).__name__}")
    if len(values) != len(names):
        raise SchemaError(f"{len(values)} importances but {len(names)} feature names")
    table = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)


# --- transaction features as pipeline stages ------------------------------------------


@dataclass(frozen=True)
class TransactionPipeline:
    """Repair, features and codes as stages, with raw and standardised vectors."""

    base: list
    scaling: list
    feature_names: list[str]


def fit_transaction_pipeline(
    train: DataFrame,
    repair: Repair,
    label: str = "is_fraud",
    use_log: bool | None = None,
    ids: Sequence[str] = ID_COLUMNS,
) -> TransactionPipeline:
    """Everything between a raw transaction and its feature vector.

    The stages read raw columns by name and only add columns, so scoring keeps
    the input as it came and ignores a label that happens to be there.
    """
    use_log = repair.heavy_tail if use_log is None else use_log
    skip = {label, *ids, *repair.dropped}
    flags = [f.name for f in train.schema if isinstance(f.dataType, T.BooleanType)]
    numeric = [c for c in train.columns if c in {*numeric_columns(train), *flags} and c not in skip]
    texts = [c for c in string_columns(train) if c not in skip]
    exprs: dict[str, str] = {}
    for c in numeric:
        value = f"cast(cast(`{c}` AS int) AS double)" if c in flags else f"nanvl(cast(`{c}` AS double), cast(NULL AS double))"
        exprs[c] = f"coalesce({value}, {_number(repair.fills[c])})" if c in repair.fills else value
    if use_log:
        amount = first_present(train.select(*[c for c in numeric if c not in flags]), AMOUNT_COLUMNS)
        if amount is None:
            raise SchemaError(f"no amount column among {list(AMOUNT_COLUMNS)}")
        exprs = {("log_amount" if c == amount else c): (f"log1p({e})" if c == amount else e) for c, e in exprs.items()}
    if SECONDS_COLUMN in exprs:
        seconds = exprs.pop(SECONDS_COLUMN)
        exprs["hour_of_day"] = f"cast(pmod(floor({seconds} / 3600), 24) AS double)"
        exprs["day_of_week"] = f"cast(pmod(floor({seconds} / 86400) + 1, 7) AS double)"
    filled_text = {c: f"coalesce(`{c}`, {_text(repair.fills[c])})" if c in repair.fills else f"`{c}`" for c in texts}
    prepare = _with_columns(
        [f"{e} AS `f_{c}`" for c, e in exprs.items()] + [f"{e} AS `f_{c}`" for c, e in filled_text.items()]
    )
    prepared = prepare.transform(train)
    encoder = fit_ordinal_encoder(prepared, [f"f_{c}" for c in texts])
    names = [*exprs, *texts]
    inputs = [f"f_{c}" for c in exprs] + [f"f_{c}_code" for c in texts]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    coded = prepared
    for stage in encoder:
        coded = stage.transform(coded)
    fits = fit_numeric(coded, inputs, fill=False)  # the gaps are filled above
    scale = _with_columns([standardized(c, fits[c], f"{c}__std") for c in inputs])
    scaled = VectorAssembler(inputCols=[f"{c}__std" for c in inputs], outputCol="scaled_features")
    return TransactionPipeline([prepare, *encoder, assemble], [scale, scaled], names)


def run_stages(df: DataFrame, stages: Sequence) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df


# --- choice and bundle ---------------------------------------------------------------


def selection_table(spark: SparkSession, scores: Mapping[str, float]) -> DataFrame:
    """(model, pr_auc, selected): the best average precision, the first on ties."""
    best = max(scores.values())
    winner = next(m for m, s in scores.items() if s == best)
    rows = [(m, float(s), m == winner) for m, s in scores.items()]
    return spark.createDataFrame(rows, "model string, pr_auc double, selected boolean")


def score_average_precision(scored: DataFrame, label: str, score: str = "score") -> float:
    return average_precision(threshold_curve(scored, label, score)).first()["average_precision"]


@dataclass(frozen=True)
class ScoringBundle:
    pipeline: PipelineModel
    threshold: float
    model_name: str
    feature_names: tuple[str, ...]
    required_columns: tuple[str, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        """Pipeline and metadata in one folder; the threshold keeps all its digits."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        row = [(self.threshold, self.model_name, list(self.feature_names), list(self.required_columns))]
        schema = "threshold double, model string, features array<string>, required array<string>"
        spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ScoringBundle:
        pipeline = PipelineModel.load(f"{path}/pipeline")
        row = spark.read.parquet(f"{path}/metadata").first()
        if row is None or not 0.0 <= row["threshold"] <= 1.0:
            raise SchemaError(f"bundle {path} has no threshold in [0, 1]")
        return ScoringBundle(pipeline, row["threshold"], row["model"], tuple(row["features"]), tuple(row["required"]))


def score_batch(
    df: DataFrame, bundle: ScoringBundle, probability: str = "fraud_probability", prediction: str = "predicted_fraud"
) -> DataFrame:
    """Input columns plus probability and 0/1 prediction; also works on a stream."""
    require(df, bundle.required_columns, "scoring input")
    scored = bundle.pipeline.transform(df).withColumn(probability, positive_probability())
    return scored.select(
        *df.columns, probability, above_threshold(F.col(probability), bundle.threshold).alias(prediction)
    )


def scored_summary(scored: DataFrame, prediction: str = "predicted_fraud") -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.sum(F.col(prediction).cast("long")).alias("predicted_positive"),
        F.avg(F.col(prediction).cast("double")).alias("predicted_rate"),
    )
