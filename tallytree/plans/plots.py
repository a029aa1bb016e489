"""Frames that are ready to be plotted; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.naming import tick
from tallytree.hierarchy import Hierarchy


class HierarchicalPlot:
    def __init__(self, hierarchy: Hierarchy):
        self.h = hierarchy

    def summing_matrix(self) -> DataFrame:
        """(row, column, weight) of the cells that are not zero, numbered in level order."""
        order = self.h.places.withColumn("row", F.col("place") + 1)
        bottom = self.h.nodes.where("is_bottom").select(F.col("unique_id").alias("bottom_id"), F.col("pos").alias("column"))
        return self.h.summing.join(order.select("unique_id", "row"), "unique_id").join(bottom, "bottom_id").select("row", "column", "weight")

    def series(self, df: DataFrame, series: str, models: list[str] | None = None, level: list[float] | None = None, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> DataFrame:
        """One series' values, forecasts and bands."""
        ids = {id_col, time_col, target_col}
        models = models or [c for c in df.columns if c not in ids and "-lo-" not in c and "-hi-" not in c]
        bands = [c for m in models for x in level or [] for c in (f"{m}-lo-{x}", f"{m}-hi-{x}") if c in df.columns]
        return df.where(F.col(tick(id_col)) == series).select(tick(time_col), *(tick(c) for c in [target_col, *models, *bands] if c in df.columns))

    def linked_series(self, df: DataFrame, bottom_series: str, id_col: str = "unique_id") -> DataFrame:
        """All series that a bottom series is part of, with their level."""
        linked = self.h.summing.where(F.col("bottom_id") == bottom_series).select(F.col("unique_id").alias("_id"))
        at = linked.join(self.h.nodes.select(F.col("unique_id").alias("_id"), "level", "level_ord"), "_id")
        return df.join(at, F.col(tick(id_col)) == F.col("_id")).drop("_id")

    def predictions_gap(self, df: DataFrame, models: list[str], id_col: str = "unique_id", time_col: str = "ds") -> DataFrame:
        """Each level's sum of each model over time."""
        at = self.h.nodes.select(F.col("unique_id").alias("_id"), "level", "level_ord")
        joined = df.join(at, F.col(tick(id_col)) == F.col("_id"))
        return joined.groupBy("level", "level_ord", tick(time_col)).agg(*(F.sum(tick(m)).alias(m) for m in models))
