"""Drift and leakage of features, from counts in bins.

Bin edges of all numbers come from one pass over a reference batch with mergeable quantile
sketches; the levels of a text are bins as they are. Both audits then make one pass each over
long rows (feature, bin), summed on the map side, so neither the number of rows nor a common
value gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finops_spark.errors import FitError, SchemaError
from finops_spark.functions.scalar import missing, null_if_nan, numeric_columns, require, string_columns
from finops_spark.operators.ordered import literal_bucket

# A feature beyond the first is unstable; all features together beyond the second raise an alert.
FEATURE_LIMIT, TOTAL_LIMIT = 0.1, 0.2
# Share that an empty bin counts with.
LEAST_SHARE = 1e-4
# Fixed value: correlation beyond which a feature is taken for leakage.
CORRELATION_LIMIT = 0.8
MISSING = "missing"


@dataclass(frozen=True)
class FittedBins:
    """Sorted inner edges of each number, a few for each feature; texts have none."""

    edges: dict[str, tuple[float, ...]]
    texts: tuple[str, ...]

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.texts]

    def bin(self, df: DataFrame, feature: str) -> Column:
        """Bin of a value as text: how many edges lie at or below it, or the level; "missing" for NULL and NaN."""
        if feature in self.texts:
            return F.coalesce(F.concat(F.lit("="), F.col(feature).cast("string")), F.lit(MISSING))
        return F.when(missing(df, feature), F.lit(MISSING)).otherwise(literal_bucket(feature, self.edges[feature]).cast("string"))


def fit_bins(reference: DataFrame, features: Sequence[str], bins: int = 10, accuracy: int = 10_000) -> FittedBins:
    """Quantile edges of the numbers among ``features``, all in one pass. Equal edges are made one; a quantile is
    off by at most a share of 1 / ``accuracy`` of the rows."""
    require(reference, features, "reference batch")
    if bins < 2:
        raise FitError(f"bins must be 2 or more, got {bins}")
    numbers = [c for c in features if c in numeric_columns(reference)]
    texts = tuple(c for c in features if c in string_columns(reference))
    other = sorted(set(features) - {*numbers, *texts})
    if other:
        raise SchemaError(f"columns {other} are neither numeric nor text")
    shares = [i / bins for i in range(1, bins)]
    row = reference.agg(*[F.percentile_approx(null_if_nan(reference, c).cast("double"), shares, accuracy).alias(f"q{i}") for i, c in enumerate(numbers)]).first() if numbers else []
    empty = [c for c, q in zip(numbers, row) if q is None]
    if empty:
        raise FitError(f"columns {empty} have no values")
    return FittedBins({c: tuple(sorted(set(q))) for c, q in zip(numbers, row)}, texts)


def _long(df: DataFrame, fitted: FittedBins, *kept: Column) -> DataFrame:
    """A row for each row of ``df`` and feature: the kept columns, feature, bin, x (numbers, as a double)."""
    each = [
        F.struct(F.lit(c).alias("feature"), fitted.bin(df, c).alias("bin"), (F.lit(None).cast("double") if c in fitted.texts else null_if_nan(df, c).cast("double")).alias("x"))
        for c in fitted.features
    ]
    return df.select(*kept, F.explode(F.array(*each)).alias("_e")).select(*[c for c in df.select(*kept).columns], "_e.*")


def bin_counts(reference: DataFrame, current: DataFrame, fitted: FittedBins) -> DataFrame:
    """(feature, bin, n_reference, n_current) of both batches in one pass; bins that neither has are not listed."""
    columns = fitted.features
    both = reference.select(*columns, F.lit(0).alias("_batch")).unionByName(current.select(*columns, F.lit(1).alias("_batch")))
    rows = _long(both, fitted, F.col("_batch"))
    return rows.groupBy("feature", "bin").agg(F.count_if(F.col("_batch") == 0).alias("n_reference"), F.count_if(F.col("_batch") == 1).alias("n_current"))


def psi_by_feature(reference: DataFrame, current: DataFrame, fitted: FittedBins, limit: float = FEATURE_LIMIT) -> DataFrame:
    """(feature, n_reference, n_current, bins, psi, unstable): population stability index of each feature.

    The sum over bins of (q - p) ln(q / p), p and q being the shares of a bin in either batch; a bin that
    is empty in one counts there with LEAST_SHARE. A feature is unstable beyond ``limit``. An empty batch
    has LEAST_SHARE in all bins."""
    counts = bin_counts(reference, current, fitted)
    totals = counts.groupBy(F.col("feature").alias("_f")).agg(F.sum("n_reference").alias("_r"), F.sum("n_current").alias("_c"))
    p, q = (F.greatest(F.coalesce(F.try_divide(n, t), F.lit(0.0)), F.lit(LEAST_SHARE)) for n, t in (("n_reference", "_r"), ("n_current", "_c")))
    joined = counts.join(totals, F.col("feature") == F.col("_f"))
    out = joined.groupBy("feature").agg(F.sum("n_reference").alias("n_reference"), F.sum("n_current").alias("n_current"), F.count(F.lit(1)).alias("bins"), F.sum((q - p) * F.log(q / p)).alias("psi"))
    return out.withColumn("unstable", F.col("psi") > limit)


def psi_alert(by_feature: DataFrame, limit: float = TOTAL_LIMIT) -> DataFrame:
    """(features, unstable_features, total_psi, alert) over all features."""
    return by_feature.agg(F.count(F.lit(1)).alias("features"), F.count_if("unstable").alias("unstable_features"), F.sum("psi").alias("total_psi")).withColumn("alert", F.coalesce(F.col("total_psi") > limit, F.lit(False)))


def leakage_audit(df: DataFrame, fitted: FittedBins, label: str, period: str, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """(period, feature, n, correlation, mutual_information, leaks) of each feature against a 0/1 label by time window.

    ``period`` is a column of windows, such as a month; NULL is a window of its own. Rows without a label are
    left out. The correlation (Pearson) takes rows with a value, and is NULL where a side is constant or the
    feature is a text; the information (in nats) takes all bins, missing values included. A feature leaks in a
    window where the correlation is beyond ``limit`` either way."""
    require(df, [label, period], "table to audit")
    rows = _long(df.where(F.col(label).isNotNull()), fitted, F.col(period).alias("period"), F.col(label).cast("double").alias("y"))
    # Centred moments of each cell, which Spark merges pairwise: values far from zero keep their digits.
    x, y = F.col("x"), F.when(F.col("x").isNotNull(), F.col("y"))
    k = F.count("x")
    moments = {"k": k, "mx": F.avg(x), "my": F.avg(y), "xx": F.var_pop(x) * k, "xy": F.covar_pop(x, y) * k, "yy": F.var_pop(y) * k}
    cells = rows.groupBy("period", "feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n1"), *[c.alias(a) for a, c in moments.items()])
    # from here on a few rows for each window and feature, or one for each level of a text
    margins = cells.groupBy(F.col("period").alias("_p"), F.col("feature").alias("_f")).agg(
        F.sum("n").alias("_n"), F.sum("n1").alias("_n1"), *[F.try_divide(F.sum(F.col("k") * F.col(m)), F.sum("k")).alias(f"_{m}") for m in ("mx", "my")]
    )
    joined = cells.join(margins, F.col("period").eqNullSafe(F.col("_p")) & (F.col("feature") == F.col("_f")))

    def part(cell: Column, side: Column) -> Column:
        return F.when(cell > 0, cell / F.col("_n") * F.log(cell * F.col("_n") / (F.col("n") * side))).otherwise(F.lit(0.0))

    information = part(F.col("n1"), F.col("_n1")) + part(F.col("n") - F.col("n1"), F.col("_n") - F.col("_n1"))
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    whole = {"xx": dx * dx, "xy": dx * dy, "yy": dy * dy}
    out = joined.groupBy("period", "feature").agg(
        F.sum("n").alias("n"), F.sum(information).alias("mutual_information"), F.sum("k").alias("k"), F.max(F.abs("_mx")).alias("_mx"),
        *[F.sum(F.col(m) + F.col("k") * apart).alias(m) for m, apart in whole.items()],
    )
    # a constant is off its mean by rounding only
    varies = (F.col("xx") > F.col("k") * F.pow(1e-13 * F.col("_mx"), 2)) & (F.col("yy") > 1e-24)
    out = out.withColumn("correlation", F.when((F.col("k") > 1) & varies, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))))
    return out.select("period", "feature", "n", "correlation", "mutual_information", F.coalesce(F.abs("correlation") > limit, F.lit(False)).alias("leaks"))
