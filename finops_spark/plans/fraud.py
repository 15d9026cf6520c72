"""Fraud training (repair, features, choice, threshold, errors) and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.errors import SchemaError
from finops_spark.functions.scalar import ID_COLUMNS
from finops_spark.operators.curves import best_thresholds, threshold_curve
from finops_spark.operators.error_analysis import amount_stats, class_counts, hour_histogram, with_error_class
from finops_spark.operators.gates import class_gates, enforce, gate_report, not_empty, score_gates, transaction_gates
from finops_spark.operators.models import (
    ScoringBundle,
    feature_importance,
    fit_transaction_pipeline,
    positive_probability,
    run_stages,
    score_average_precision,
    score_batch,
    selection_table,
    train_forest,
    train_logistic,
)
from finops_spark.operators.repair import fit_repair, repair_report
from finops_spark.operators.split import TWO_WAY, split_part, stratified_split
from finops_spark.session import cut_lineage, spread, store
from finops_spark.sources.readers import LABEL, read_scoring_input, read_transactions
from finops_spark.sources.writers import write_predictions, write_report

# Counts of the nodes that a pass over the rows grows: the vectors here are narrow, so few passes are added.
FOREST_GROUP_MB = 32


@dataclass(frozen=True)
class FraudResult:
    bundle: ScoringBundle
    repair: DataFrame
    selection: DataFrame
    thresholds: DataFrame
    curve: DataFrame
    error_counts: DataFrame
    error_amounts: DataFrame | None
    error_hours: DataFrame | None
    importance: DataFrame


def run_fraud_training(
    spark: SparkSession,
    source: str | DataFrame,
    label: str = LABEL,
    fit_scope: str = "train",
    seed: int = 42,
    fn_cost: float = 10.0,
    fp_cost: float = 1.0,
    min_test_positives: int = 100,
    forest_trees: int = 100,
    forest_depth: int = 10,
    strict: bool = True,
    min_rows: int | None = None,
    max_rows: int | None = None,
    min_rate: float = 0.005,
    max_rate: float = 0.05,
    output_path: str | None = None,
) -> FraudResult:
    """``fit_scope="train"`` learns repair and codes from training rows only;
    ``"all"`` learns them from every row, before the split. ``strict`` puts files and
    DataFrames to the same gates; row bounds hold only where given."""
    if fit_scope not in ("train", "all"):
        raise SchemaError(f"fit_scope must be 'train' or 'all', got {fit_scope!r}")
    table = read_transactions(spark, source, strict=False) if isinstance(source, str) else source
    if strict:
        enforce(gate_report(table, [not_empty(), *transaction_gates(table, label, min_rows, max_rows, min_rate, max_rate)]))
    parts = store(stratified_split(table, label, TWO_WAY, seed), "parts", by="split")
    train, test = split_part(parts, "train"), split_part(parts, "test")
    enforce(class_gates(parts, label))
    enforce(class_gates(test, label, 1, min_test_positives))

    learn_from = train if fit_scope == "train" else parts.drop("split")
    repair = fit_repair(learn_from, label, fill_all=True, ids=ID_COLUMNS)
    steps = fit_transaction_pipeline(learn_from, repair, label)
    all_steps = [*steps.base, *steps.scaling]
    # The rows are dealt over all cores before they are kept: fitting and scoring take a task for each part.
    # Within a part they lie sorted by their features, codes first, so that neighbours walk the same paths of a tree.
    alike = [F.col(f"`{c}`") for c in reversed(steps.base[-1].getInputCols())]
    ordered = run_stages(spread(train), all_steps).sortWithinPartitions(*alike)
    ready = cut_lineage(ordered.select(F.col(label).cast("int").alias("label"), "features", "scaled_features"))
    # Error analysis reads the prepared amount and hour beside the vectors.
    shown = {"f_log_amount": "log_amount", "f_TransactionAmt": "TransactionAmt", "f_amount": "amount", "f_hour_of_day": "hour_of_day"}
    prepared = run_stages(spread(test), all_steps)
    extra = [F.col(k).alias(v) for k, v in shown.items() if k in prepared.columns]
    held = cut_lineage(prepared.select(F.col(label).cast("int").alias("label"), "features", "scaled_features", *extra))

    candidates = {
        "logistic": (train_logistic(ready, features="scaled_features"), all_steps),
        "forest": (train_forest(ready, n_trees=forest_trees, max_depth=forest_depth, seed=seed, group_mb=FOREST_GROUP_MB), steps.base),
    }
    scored, scores = {}, {}
    for name, (model, _) in candidates.items():
        out = model.transform(held).withColumn("score", positive_probability())
        scored[name] = cut_lineage(out.select("label", "score", *shown_columns(held)))
        scores[name] = score_average_precision(scored[name], "label")
    selection = selection_table(spark, scores)
    winner = selection.filter("selected").first()["model"]
    best = scored[winner]
    enforce(gate_report(best, score_gates(best)))

    curve = threshold_curve(best, fn_cost=fn_cost, fp_cost=fp_cost)
    thresholds = cut_lineage(best_thresholds(curve))
    threshold = thresholds.first()["f2_threshold"]
    classed = with_error_class(best, threshold)
    model, stages = candidates[winner]
    required = tuple(c for c in table.columns if c != label and c not in repair.dropped)
    bundle = ScoringBundle(PipelineModel(stages=[*stages, model]), threshold, winner, tuple(steps.feature_names), required)
    result = FraudResult(
        bundle,
        repair_report(table, repair),
        selection,
        thresholds,
        curve,
        class_counts(classed),
        amount_stats(classed),
        hour_histogram(classed),
        feature_importance(spark, model, steps.feature_names),
    )
    if output_path:
        save_fraud_result(spark, result, output_path)
    return result


def shown_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("label", "features", "scaled_features")]


def save_fraud_result(spark: SparkSession, result: FraudResult, path: str) -> None:
    """Bundle and all reports under one folder."""
    result.bundle.save(spark, f"{path}/bundle")
    tables = {
        "repair": result.repair,
        "selection": result.selection,
        "thresholds": result.thresholds,
        "error_counts": result.error_counts,
        "error_amounts": result.error_amounts,
        "error_hours": result.error_hours,
        "importance": result.importance,
    }
    for name, table in tables.items():
        if table is not None:
            write_report(table, f"{path}/{name}")


def run_fraud_scoring(
    spark: SparkSession,
    source: str | DataFrame,
    bundle: str | ScoringBundle,
    output_path: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Score a batch with a saved bundle: training statistics, never the batch's."""
    table = read_scoring_input(spark, source) if isinstance(source, str) else source
    loaded = ScoringBundle.load(spark, bundle) if isinstance(bundle, str) else bundle
    scored = score_batch(table if table.isStreaming else spread(table), loaded)
    if output_path:
        write_predictions(scored, output_path, fmt)
    return scored
