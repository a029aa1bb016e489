"""Exact passes over the levels of a strict hierarchy with diagonal weights.

Upwards every node combines its own value with its children's sum by their precisions; downwards it
spreads what is left to its children by their variances. The same two passes carry the variances of
what comes out when the values have independent errors of any size. Each level is one sum up, one
join with the level's own rows and one join down. A weight of zero holds a value as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.hierarchy import Hierarchy


def solved(h: Hierarchy, weighted: DataFrame, by: list[str]) -> DataFrame:
    """unique_id, by, yhat: the coherent values next to weighted (unique_id, by, yhat, w) by weights 1 / w."""
    last = len(h.levels) - 1
    at = weighted.join(h.parents, "unique_id")
    ups = {last: at.where(F.col("level_ord") == last).select("unique_id", "parent_id", *by, F.col("yhat").alias("m"), F.col("w").alias("v"))}
    for k in range(last - 1, -1, -1):
        below = ups[k + 1].groupBy(F.col("parent_id").alias("unique_id"), *by).agg(F.sum("m").alias("sm"), F.sum("v").alias("sv"))
        own = at.where(F.col("level_ord") == k).join(below, ["unique_id", *by])
        total = F.col("w") + F.col("sv")
        m = F.when(total == 0, F.col("sm")).otherwise(F.try_divide(F.col("yhat") * F.col("sv") + F.col("sm") * F.col("w"), total))
        v = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("w") * F.col("sv"), total))
        ups[k] = own.select("unique_id", "parent_id", *by, m.alias("m"), v.alias("v"), "sm", "sv")
    level = ups[0].withColumn("yhat", F.col("m"))
    out = level.select("unique_id", *by, "yhat")
    for k in range(1, last + 1):
        above = level.select(F.col("unique_id").alias("parent_id"), *by, (F.col("yhat") - F.col("sm")).alias("_left"), F.col("sv").alias("_sv"))
        share = F.when(F.col("_sv") == 0, F.lit(0.0)).otherwise(F.try_divide("v", "_sv"))
        level = ups[k].join(above, ["parent_id", *by]).withColumn("yhat", F.col("m") + share * F.col("_left"))
        out = out.unionByName(level.select("unique_id", *by, "yhat"))
    return out


def variances(h: Hierarchy, rows: DataFrame, by: list[str]) -> DataFrame:
    """unique_id, by, v: variances of what ``solved`` gives, from rows (unique_id, by, w, e), e the values' own variances.

    q is the variance of a node's combined value, a the weight of its own value in it, and d how much
    the solved value moves with the combined one. Children's subtrees have no error in common,
    so all covariances that are needed are multiples of q.
    """
    last = len(h.levels) - 1
    at = rows.join(h.parents, "unique_id")
    ups = {last: at.where(F.col("level_ord") == last).select("unique_id", "parent_id", *by, F.col("e").alias("q"), F.col("w").alias("p"))}
    for k in range(last - 1, -1, -1):
        below = ups[k + 1].groupBy(F.col("parent_id").alias("unique_id"), *by).agg(F.sum("q").alias("sq"), F.sum("p").alias("sp"))
        own = at.where(F.col("level_ord") == k).join(below, ["unique_id", *by])
        total = F.col("w") + F.col("sp")
        a = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide("sp", total))
        own = own.withColumn("a", a)
        q = F.col("a") * F.col("a") * F.col("e") + (1 - F.col("a")) * (1 - F.col("a")) * F.col("sq")
        ups[k] = own.select("unique_id", "parent_id", *by, q.alias("q"), (F.col("w") * F.col("a")).alias("p"), "a", "sq", "sp")
    level = ups[0].withColumn("v", F.col("q")).withColumn("d", F.lit(1.0))
    out = level.select("unique_id", *by, "v")
    for k in range(1, last + 1):
        moves = F.col("d") * (1 - F.col("a"))
        above = level.select(F.col("unique_id").alias("parent_id"), *by, moves.alias("_b"), (F.col("v") + (1 - 2 * moves) * F.col("sq")).alias("_left"), F.col("sp").alias("_sp"))
        child = ups[k].join(above, ["parent_id", *by])
        s = F.when(F.col("_sp") == 0, F.lit(0.0)).otherwise(F.try_divide("p", "_sp"))
        child = child.withColumn("s", s).withColumn("v", F.col("q") + F.col("s") * F.col("s") * F.col("_left") + 2 * F.col("s") * F.col("q") * (F.col("_b") - 1))
        level = child.withColumn("d", 1 + F.col("s") * (F.col("_b") - 1))
        out = out.unionByName(level.select("unique_id", *by, "v"))
    return out
