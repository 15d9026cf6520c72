"""Ridge regression for many series and folds from one aggregation pass.

A ridge fit needs only counts, sums and sums of products. Those add up, so each
row is aggregated once into the block between two fold boundaries, and the
statistics of a fold's training range are merged from its blocks: rows are not
repeated for each fold. Folds use centred moments, which merge without losing digits. A fit is then one small linear solve for each (series,
fold) row, done in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finops_spark.errors import FitError, GateError
from finops_spark.functions.scalar import safe_ratio
from finops_spark.operators.ordered import SPLIT_ROWS
from finops_spark.operators.split import (
    first_train_end,
    fold_bounds,
    training_block,
    validation_fold,
    with_series_rows,
)

ALL_ROWS = -1  # fold number of the final fit on every row
_MODEL = [
    T.StructField("coefficients", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("feature_mean", T.ArrayType(T.DoubleType())),
    T.StructField("feature_scale", T.ArrayType(T.DoubleType())),
]


def _statistics(features: Sequence[str], label: str) -> dict[str, Column]:
    """Sums that determine the fit: counts, first moments and products."""
    y = F.col(label)
    sums = {"n": F.count(F.lit(1)), "s_y": F.sum(y), "s_yy": F.sum(y * y)}
    for i, f in enumerate(features):
        sums[f"s_{i}"] = F.sum(F.col(f).cast("double"))
        sums[f"s_{i}_y"] = F.sum(F.col(f) * y)
        for j in range(i, len(features)):
            sums[f"s_{i}_{j}"] = F.sum(F.col(f) * F.col(features[j]))
    return sums


def gram(df: DataFrame, features: Sequence[str], label: str = "target", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """(by..., n, s_y, s_yy, s_i, s_i_y, s_i_j): additive statistics of each group."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _statistics(features, label).items()])


def _models(n, mean, y_mean, centred, target, alpha: float, fit_intercept: bool) -> dict:
    """Fits from counts, means and centred products of k groups at once."""
    d = mean.shape[1]
    spread = np.sqrt(np.maximum(np.einsum("kii->ki", centred) / n[:, None], 0.0))
    scale = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean)), spread, 1.0)
    lhs = centred / (scale[:, :, None] * scale[:, None, :]) + alpha * np.eye(d)
    weights = np.linalg.solve(lhs, (target / scale)[:, :, None])[:, :, 0]
    raw = weights / scale
    # Standardised features are centred, so the intercept is the mean of y.
    start = (y_mean if fit_intercept else 0.0) - (raw * mean).sum(axis=1)
    return {"coefficients": list(raw), "intercept": start, "feature_mean": list(mean), "feature_scale": list(scale)}


def _solve_batches(d: int, alpha: float, fit_intercept: bool):
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            sx = b[[f"s_{i}" for i in range(d)]].to_numpy(float)
            sxy = b[[f"s_{i}_y" for i in range(d)]].to_numpy(float)
            sxx = np.empty((len(b), d, d))
            for i, j in upper:
                sxx[:, i, j] = sxx[:, j, i] = b[f"s_{i}_{j}"].to_numpy(float)
            sy = b["s_y"].to_numpy(float)
            mean = sx / n[:, None]
            centred = sxx - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
            fitted = _models(n, mean, sy / n, centred, sxy - mean * sy[:, None], alpha, fit_intercept)
            yield b[[c for c in b.columns if not c.startswith("s_")]].assign(**fitted)

    return run


def _moments(features: Sequence[str], label: str) -> dict[str, Column]:
    """Count, means and centred products of features and label; Spark merges partial ones pairwise, so nothing far
    from zero is squared."""
    columns = [F.col(c).cast("double") for c in (*features, label)]
    n = F.count(F.lit(1))
    products = [F.covar_pop(a, b) * n for i, a in enumerate(columns) for b in columns[i:]]
    return {"n": n, "means": F.array(*[F.avg(c) for c in columns]), "products": F.array(*products)}


def merged_moments(n, means, products):
    """Moments of several stretches taken together, by the update of Chan, Golub and LeVeque."""
    total, mean, product = float(n[0]), means[0].copy(), products[0].copy()
    for k in range(1, len(n)):
        apart, both = means[k] - mean, total + n[k]
        product += products[k] + np.outer(apart, apart) * (total * n[k] / both)
        mean += apart * (n[k] / both)
        total = both
    return total, mean, product


def _solve_folds(d: int, alpha: float, fit_intercept: bool):
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = []
            for parts in b["parts"]:
                products = np.zeros((len(parts), d + 1, d + 1))
                for k, p in enumerate(parts):
                    products[k][upper] = p["products"]
                    products[k] += np.triu(products[k], 1).T
                whole.append(merged_moments([p["n"] for p in parts], [np.array(p["means"], float) for p in parts], products))
            n = np.array([w[0] for w in whole])
            mean = np.array([w[1] for w in whole]).reshape(-1, d + 1)
            product = np.array([w[2] for w in whole]).reshape(-1, d + 1, d + 1)
            fitted = _models(n, mean[:, :d], mean[:, d], product[:, :d, :d], product[:, :d, d], alpha, fit_intercept)
            yield b.drop(columns="parts").assign(n=n.astype("int64"), **fitted)

    return run


def solve_ridge(
    statistics: DataFrame, features: Sequence[str], alpha: float = 1.0, fit_intercept: bool = True
) -> DataFrame:
    """One model for each row of ``statistics``: coefficients on the raw features.

    Features are standardised by their population deviation inside the fit, and
    ``alpha`` penalises the standardised coefficients (not the intercept).
    """
    if alpha <= 0:
        raise FitError(f"alpha must be positive, got {alpha}")
    kept = [f for f in statistics.schema.fields if not f.name.startswith("s_")]
    return statistics.mapInPandas(_solve_batches(len(features), alpha, fit_intercept), T.StructType(kept + _MODEL))


def predict(features: Sequence[str], coefficients: Column, intercept: Column) -> Column:
    total = intercept
    for i, f in enumerate(features):
        total = total + coefficients[i] * F.col(f)
    return total


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    label: str = "target",
    by: Sequence[str] = ("series_id",),
    alpha: float = 1.0,
    fit_intercept: bool = True,
) -> DataFrame:
    """One model for each group; groups of any size, sums combine map-side."""
    return solve_ridge(gram(df, features, label, by), features, alpha, fit_intercept)


# --- cross-validation over time ---------------------------------------------------


def cv_models(
    samples: DataFrame,
    features: Sequence[str],
    key: str = "series_id",
    label: str = "target",
    alpha: float = 1.0,
    fit_intercept: bool = True,
    expanding: bool = True,
    **layout,
) -> DataFrame:
    """(key, fold, n, coefficients, intercept, ...) of all folds and of all rows.

    ``samples`` has row_idx and n_rows. Fold ALL_ROWS is the final refit.
    """
    bounds = fold_bounds(F.col("n_rows"), expanding=expanding, **layout)
    base = first_train_end(F.col("n_rows"), expanding=expanding, **layout)
    blocks = (
        samples.withColumn("_block", training_block(F.col("row_idx"), base, expanding, **layout))
        .groupBy(key, "n_rows", "_block")
        .agg(*[c.alias(n) for n, c in _moments(features, label).items()])
    )
    everything = F.struct(
        F.lit(ALL_ROWS).alias("fold"), F.lit(0).cast("long").alias("train_lo"), F.col("n_rows").alias("train_hi")
    )
    ranges = F.concat(
        F.transform(
            bounds,
            lambda f: F.struct(f["fold"].alias("fold"), f["train_lo"].alias("train_lo"), f["train_hi"].alias("train_hi")),
        ),
        F.array(everything),
    )
    users = F.filter(ranges, lambda f: (F.col("_block") >= f["train_lo"]) & (F.col("_block") < f["train_hi"]))
    # A series has a few blocks for each fold, whatever its length.
    part = F.struct("_block", "n", "means", "products")
    folds = blocks.withColumn("_f", F.explode(users)).groupBy(key, F.col("_f.fold").alias("fold")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    if alpha <= 0:
        raise FitError(f"alpha must be positive, got {alpha}")
    kept = [f for f in folds.schema.fields if f.name != "parts"]
    return folds.mapInPandas(_solve_folds(len(features), alpha, fit_intercept), T.StructType(kept + [T.StructField("n", T.LongType())] + _MODEL))


def cv_predictions(
    samples: DataFrame, models: DataFrame, features: Sequence[str], key: str = "series_id", label: str = "target",
    expanding: bool = True, **layout
) -> DataFrame:
    """(key, fold, row_idx, y, y_hat) of every validation row."""
    base = first_train_end(F.col("n_rows"), expanding=expanding, **layout)
    fold = validation_fold(F.col("row_idx"), base, expanding, **layout)
    valid = samples.withColumn("fold", fold).filter(F.col("fold").isNotNull())
    # The few models of a series travel as one map, so that the join is on the key
    # the samples are partitioned and sorted by: a merge join moves only the models.
    of_series = models.groupBy(key).agg(
        F.map_from_entries(
            F.collect_list(F.struct("fold", F.struct(F.col("coefficients").alias("c"), F.col("intercept").alias("b"))))
        ).alias("_models")
    )
    joined = valid.hint("merge").join(of_series, key).withColumn("_m", F.element_at("_models", F.col("fold")))
    y_hat = predict(features, F.col("_m.c"), F.col("_m.b"))
    return joined.select(key, "fold", "row_idx", F.col(label).alias("y"), y_hat.alias("y_hat"))


def rmse(y: Column, y_hat: Column) -> Column:
    return F.sqrt(F.avg((y - y_hat) * (y - y_hat)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL when one side is constant or has under 2 rows."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def fold_metrics(predictions: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, fold, n_samples, rmse, residual_time_correlation, running_cv_percent)."""
    residual = F.col("y") - F.col("y_hat")
    scored = predictions.groupBy(key, "fold").agg(
        F.count(F.lit(1)).alias("n_samples"),
        rmse(F.col("y"), F.col("y_hat")).alias("rmse"),
        correlation(residual, F.col("row_idx").cast("double")).alias("residual_time_correlation"),
    )
    so_far = Window.partitionBy(key).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    running = safe_ratio(F.stddev_pop("rmse").over(so_far), F.avg("rmse").over(so_far)) * 100.0
    return scored.withColumn("running_cv_percent", F.when(F.col("fold") > 0, running))


def residual_flags(metrics: DataFrame, limit: float = 0.05) -> DataFrame:
    """Add ``drifts``: whether residuals of a fold correlate with time beyond ``limit``. A flag, no gate."""
    return metrics.withColumn("drifts", F.abs("residual_time_correlation") > limit)


def fold_stability(metrics: DataFrame, key: str = "series_id", max_cv_percent: float = 5.0) -> DataFrame:
    """(key, folds, rmse_mean, rmse_std, cv_percent, stable) over the folds."""
    return (
        metrics.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("folds"),
            F.avg("rmse").alias("rmse_mean"),
            F.stddev_pop("rmse").alias("rmse_std"),
        )
        .withColumn("cv_percent", safe_ratio(F.col("rmse_std"), F.col("rmse_mean")) * 100.0)
        .withColumn("stable", F.col("cv_percent") <= max_cv_percent)
    )


def enforce_stability(stability: DataFrame, key: str = "series_id", max_cv_percent: float = 5.0) -> None:
    unstable = stability.filter(~F.col("stable")).limit(5).collect()
    if unstable:
        shown = [(r[key], round(r["cv_percent"], 2)) for r in unstable]
        raise GateError(
            f"fold RMSE varies by more than {max_cv_percent}%: {shown}; "
            "look for trend or breaks, train longer in early folds, or raise the limit"
        )


def cross_validate(
    features_df: DataFrame,
    features: Sequence[str],
    key: str = "series_id",
    date: str = "ts",
    label: str = "target",
    alpha: float = 1.0,
    expanding: bool = True,
    split_rows: int = SPLIT_ROWS,
    **layout,
) -> tuple[DataFrame, DataFrame]:
    """(fold metrics, models): every fold of every series, plus the final refit.

    A series may be of any length: positions of one above ``split_rows`` come from ranges, its moments
    are combined on the map side, and its rows meet its models in a join that may be split."""
    # A row without a series is an error, not a row less. Stated once here, the filter
    # the join needs is the same in every branch, and the branches share one shuffle.
    named = F.coalesce(F.col(key), F.raise_error(F.lit(f"{key} has missing values")))
    present = features_df.withColumn(key, named).filter(F.col(key).isNotNull()).select(key, date, *features, label)
    samples = with_series_rows(present, key, date, split_rows)
    models = cv_models(samples, features, key, label, alpha, True, expanding, **layout)
    metrics = fold_metrics(cv_predictions(samples, models, features, key, label, expanding, **layout), key)
    return metrics, models
