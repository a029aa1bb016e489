"""Accuracy by level, and diagnostics of coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.metrics import Metric, scales
from tallytree.hierarchy import Hierarchy
from tallytree.operators.reconcile import coherence_residual

OVERALL = "Overall"
#: The least benchmark that scores are divided by: the smallest step of 32-bit floats at 1.
LEAST = 1.1920928955078125e-07


def levels_of(tags: Hierarchy | DataFrame) -> DataFrame:
    """(level, unique_id) with every id also in the level Overall once."""
    nodes = tags.nodes if isinstance(tags, Hierarchy) else tags
    if not nodes.where(F.col("level") == OVERALL).isEmpty():
        raise ValueError(f"No level may be named {OVERALL}.")
    own = nodes.select("level", "unique_id").distinct()
    return own.unionByName(own.select(F.lit(OVERALL).alias("level"), "unique_id").distinct())


def per_series(df: DataFrame, metrics: list[Metric], train: DataFrame | None = None) -> DataFrame:
    """(unique_id, model, metric, value) from rows unique_id, ds, model, y, yhat."""
    out = None
    for m in metrics:
        rows = df
        if m.scale:
            if train is None:
                raise ValueError(f"The metric {m.name} needs training values.")
            rows = df.join(scales(train, m.season), "unique_id")
        value = m.value()
        if m.scale in ("abs", "sq"):
            value = F.try_divide(value, F.first(m.scale))
        elif m.scale == "sq_root":
            value = F.sqrt(F.try_divide(value, F.first("sq")))
        one = rows.groupBy("unique_id", "model").agg(value.alias("value")).withColumn("metric", F.lit(m.name))
        out = one if out is None else out.unionByName(one)
    return out.select("unique_id", "model", "metric", "value")


def evaluate(df: DataFrame, metrics: list[Metric], tags: Hierarchy | DataFrame, train: DataFrame | None = None, agg_fn: str | None = "mean", benchmark: str | None = None) -> DataFrame:
    """(level, metric, model, value), by one join with all levels; agg_fn None keeps a row per id.

    benchmark: a model whose value divides the others', in metrics named ``-scaled``.
    """
    scores = per_series(df, metrics, train)
    at = levels_of(tags)
    found = scores.join(at, "unique_id")
    keys = ["level", "metric", "model"]
    if agg_fn is None:
        keys = ["level", "unique_id", "metric", "model"]
    else:
        from tallytree.functions.aggregates import BY_NAME

        found = found.groupBy(*keys).agg(BY_NAME[agg_fn](F.col("value")).alias("value"))
    if benchmark is not None:
        on = [k for k in keys if k != "model"]
        base = found.where(F.col("model") == benchmark).select(*on, F.greatest("value", F.lit(LEAST)).alias("_base"))
        found = found.join(base, on).select(*keys, (F.col("value") / F.col("_base")).alias("value")).withColumn("metric", F.concat("metric", F.lit("-scaled")))
    return found.select(*keys, "value")


def wide_scores(scores: DataFrame, models: list[str]) -> DataFrame:
    """One column per model."""
    keys = [c for c in scores.columns if c not in ("model", "value")]
    return scores.groupBy(*keys).pivot("model", models).agg(F.first("value"))


def diagnostics(h: Hierarchy, before: DataFrame, after: DataFrame, atol: float = 1e-6) -> DataFrame:
    """(level, model, metric, value): residuals of coherence, adjustments and negatives before and after.

    before, after: unique_id, ds, model, yhat. Overall also tells whether all is coherent.
    """
    by = ["ds", "model"]
    r0 = coherence_residual(h, before, by).withColumnRenamed("residual", "r0")
    r1 = coherence_residual(h, after, by).withColumnRenamed("residual", "r1")
    rows = before.withColumnRenamed("yhat", "y0").join(after.withColumnRenamed("yhat", "y1"), ["unique_id", *by]).join(r0, ["unique_id", *by]).join(r1, ["unique_id", *by])
    rows = rows.join(levels_of(h), "unique_id").withColumn("a", F.abs(F.col("y1") - F.col("y0")))
    neg0, neg1 = F.col("y0") < 0, F.col("y1") < 0
    n = lambda c: F.count_if(c).cast("double")
    values = {
        "coherence_residual_mae_before": F.avg(F.abs("r0")),
        "coherence_residual_rmse_before": F.sqrt(F.avg(F.col("r0") ** 2)),
        "coherence_residual_mae_after": F.avg(F.abs("r1")),
        "coherence_residual_rmse_after": F.sqrt(F.avg(F.col("r1") ** 2)),
        "adjustment_mae": F.avg("a"),
        "adjustment_rmse": F.sqrt(F.avg(F.col("a") ** 2)),
        "adjustment_max": F.max("a"),
        "adjustment_mean": F.avg(F.col("y1") - F.col("y0")),
        "negative_count_before": n(neg0),
        "negative_count_after": n(neg1),
        "negative_introduced": n(~neg0 & neg1),
        "negative_removed": n(neg0 & ~neg1),
        "is_coherent": F.when(F.max(F.abs("r1")) <= atol, 1.0).otherwise(0.0),
        "coherence_max_violation": F.max(F.abs("r1")),
    }
    found = rows.groupBy("level", "model").agg(*(v.alias(k) for k, v in values.items()))
    long = found.unpivot(["level", "model"], list(values), "metric", "value")
    return long.where((F.col("level") == OVERALL) | ~F.col("metric").isin("is_coherent", "coherence_max_violation")).select("level", "model", "metric", "value")
