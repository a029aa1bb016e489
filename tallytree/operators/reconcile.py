"""Reconciliation by sums and shares: bottom-up, top-down and middle-out.

Forecasts are long: unique_id, the columns of ``by`` (time, model, sample and so on) and
yhat. Results have the same columns. Nothing is collected; each level is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallytree.hierarchy import Hierarchy

#: Sums of siblings below this are split equally.
NO_SUM = 1e-8
#: What a zero forecast counts as where shares are not split equally.
EPS = 2.220446049250313e-16


def summed(h: Hierarchy, bottom: DataFrame, by: list[str], value: str = "yhat") -> DataFrame:
    """All nodes from bottom values: the summing matrix times the bottom, as a join and a sum."""
    one = bottom.withColumnRenamed("unique_id", "bottom_id")
    return h.summing.join(one, "bottom_id").groupBy("unique_id", *by).agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def bottom_of(h: Hierarchy, fcst: DataFrame) -> DataFrame:
    return fcst.join(h.nodes.where("is_bottom").select("unique_id"), "unique_id", "left_semi")


def bottom_up(h: Hierarchy, fcst: DataFrame, by: list[str]) -> DataFrame:
    return summed(h, bottom_of(h, fcst).select("unique_id", *by, "yhat"), by)


def need_strict(h: Hierarchy, names: list[str]) -> None:
    if not h.is_strict:
        raise ValueError(f"These methods need a strictly hierarchical structure: {names}")


def top_down_forecast(h: Hierarchy, fcst: DataFrame, by: list[str], split_equally: bool = True, root_level: int = 0) -> DataFrame:
    """Each child's share of its parent is its share of the siblings' forecasts; roots keep theirs.

    split_equally: siblings whose forecasts sum to nothing share alike; otherwise zero
    forecasts count as EPS.
    """
    at = fcst.join(h.nodes.select("unique_id", "level_ord"), "unique_id").select("unique_id", "level_ord", *by, "yhat")
    if not split_equally:
        at = at.withColumn("yhat", F.when(F.col("yhat") == 0, F.lit(EPS)).otherwise(F.col("yhat")))
    level = at.where(F.col("level_ord") == root_level).select("unique_id", *by, "yhat")
    found = [level]
    siblings = Window.partitionBy("parent_id", *by)
    edges = h.edges.select("parent_id", F.col("child_id").alias("unique_id"))
    for k in range(root_level + 1, len(h.levels)):
        child = at.where(F.col("level_ord") == k).join(edges, "unique_id")
        child = child.withColumn("_sum", F.sum("yhat").over(siblings)).withColumn("_n", F.count(F.lit(1)).over(siblings))
        up = level.select(F.col("unique_id").alias("parent_id"), *by, F.col("yhat").alias("_parent"))
        share = F.try_divide(F.col("yhat"), F.col("_sum"))
        if split_equally:
            share = F.when(F.abs("_sum") < NO_SUM, 1 / F.col("_n")).otherwise(share)
        level = child.join(up, ["parent_id", *by]).select("unique_id", *by, (F.col("_parent") * share).alias("yhat"))
        found.append(level)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def proportions(h: Hierarchy, insample: DataFrame, method: str, root_level: int = 0, skip_missing: bool = True) -> DataFrame:
    """(bottom_id, root_id, p): each bottom series' share of its root in sample.

    insample: unique_id, ds, y. ``average_proportions`` averages the ratio, ``proportion_averages``
    divides the averages. skip_missing: nulls are left out; otherwise a null makes the share null.
    """
    roots = h.summing.join(h.nodes.where(F.col("level_ord") == root_level).select("unique_id"), "unique_id").select(F.col("unique_id").alias("root_id"), "bottom_id")
    y = insample.select("unique_id", "ds", F.when(~F.isnan("y"), F.col("y").cast("double")).alias("y")) if dict(insample.dtypes)["y"] in ("double", "float") else insample.select("unique_id", "ds", F.col("y").cast("double").alias("y"))
    own = y.select(F.col("unique_id").alias("bottom_id"), "ds", F.col("y").alias("_own"))
    top = y.select(F.col("unique_id").alias("root_id"), "ds", F.col("y").alias("_top"))
    both = roots.join(own, "bottom_id").join(top, ["root_id", "ds"])
    if method == "average_proportions":
        p, missing = F.avg(F.try_divide("_own", "_top")), F.count_if(F.col("_own").isNull() | F.col("_top").isNull())
    elif method == "proportion_averages":
        p, missing = F.try_divide(F.avg("_own"), F.avg("_top")), F.count_if(F.col("_own").isNull() | F.col("_top").isNull())
    else:
        raise ValueError(f"Unknown method {method}")
    found = both.groupBy("bottom_id", "root_id").agg(p.alias("p"), missing.alias("_missing"))
    if not skip_missing:
        found = found.withColumn("p", F.when(F.col("_missing") == 0, F.col("p")))
    return found.drop("_missing")


def top_down_shares(h: Hierarchy, fcst: DataFrame, by: list[str], shares: DataFrame) -> DataFrame:
    """Bottom series are their shares of the root's forecast; the others are their sums."""
    root = fcst.select(F.col("unique_id").alias("root_id"), *by, "yhat")
    bottom = shares.join(root, "root_id").select(F.col("bottom_id").alias("unique_id"), *by, (F.col("p") * F.col("yhat")).alias("yhat"))
    return summed(h, bottom, by)


def top_down(h: Hierarchy, fcst: DataFrame, by: list[str], method: str, insample: DataFrame | None = None, sparse: bool = False) -> DataFrame:
    need_strict(h, ["TopDownSparse" if sparse else "TopDown"])
    if method == "forecast_proportions":
        return top_down_forecast(h, fcst, by, split_equally=not sparse)
    if insample is None:
        raise ValueError(f"The method {method} needs values in sample.")
    return top_down_shares(h, fcst, by, proportions(h, insample, method, skip_missing=not sparse))


def middle_out(h: Hierarchy, fcst: DataFrame, by: list[str], middle_level: str, method: str, insample: DataFrame | None = None, sparse: bool = False) -> DataFrame:
    """Sums of the middle level above it, top-down from each of its nodes below it."""
    need_strict(h, ["MiddleOutSparse" if sparse else "MiddleOut"])
    if middle_level not in h.levels:
        raise ValueError(f"{middle_level} is not a level of the hierarchy.")
    m = h.levels.index(middle_level)
    at = h.summing.join(h.nodes.select("unique_id", "level_ord"), "unique_id")
    above = at.where(F.col("level_ord") < m).select("unique_id", "bottom_id")
    middle = at.where(F.col("level_ord") == m).select(F.col("unique_id").alias("_middle"), "bottom_id")
    links = above.join(middle, "bottom_id").select("unique_id", "_middle").distinct()
    up = links.join(fcst.withColumnRenamed("unique_id", "_middle"), "_middle").groupBy("unique_id", *by).agg(F.sum("yhat").alias("yhat"))
    if method == "forecast_proportions":
        down = top_down_forecast(h, fcst, by, split_equally=not sparse, root_level=m)
    else:
        if insample is None:
            raise ValueError(f"The method {method} needs values in sample.")
        down = top_down_shares(h, fcst, by, proportions(h, insample, method, root_level=m, skip_missing=not sparse))
        down = down.join(h.nodes.where(F.col("level_ord") > m).select("unique_id"), "unique_id", "left_semi")
        down = down.unionByName(fcst.join(h.nodes.where(F.col("level_ord") == m).select("unique_id"), "unique_id", "left_semi").select("unique_id", *by, "yhat"))
    return up.unionByName(down)


def coherence_residual(h: Hierarchy, values: DataFrame, by: list[str], value: str = "yhat") -> DataFrame:
    """unique_id, by, residual: each node less the sum of its bottom series."""
    sums = summed(h, bottom_of(h, values).select("unique_id", *by, value), by, value).withColumnRenamed(value, "_sum")
    return values.join(sums, ["unique_id", *by]).select("unique_id", *by, (F.col(value) - F.col("_sum")).alias("residual"))
