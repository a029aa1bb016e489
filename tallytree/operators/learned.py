"""Projections learned from values and fitted forecasts in sample.

The projections of emint and of closed empirical risk are b x n matrices that are never made:
applied to forecasts they are sums over the times in sample, weighted by the solution of a
system of that size.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.arrays import packed
from tallytree.hierarchy import Hierarchy
from tallytree.operators import lasso
from tallytree.operators.projection import SERIES, Projection, diagonal, learned
from tallytree.operators.reconcile import bottom_of, summed
from tallytree.session import settled


def complete(fitted: DataFrame, last: int | None = None) -> DataFrame:
    """fitted at the times where every series of a model has a forecast; of these the last ones."""
    bad = fitted.groupBy("model", "ds").agg(F.max(F.col("yhat").isNull() | F.isnan("yhat")).alias("_bad"))
    if not bad.where("_bad").isEmpty():
        warnings.warn("Times with missing fitted values are left out.", stacklevel=2)
    good = bad.where("NOT _bad").select("model", "ds")
    if last is not None:
        from pyspark.sql import Window

        good = good.withColumn("_k", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("ds")))).where(F.col("_k") <= last).drop("_k")
    return fitted.join(good, ["model", "ds"], "left_semi")


def emint(h: Hierarchy, fitted: DataFrame) -> Projection:
    good = complete(fitted)
    bottom = bottom_of(h, good).select("model", "unique_id", F.col("ds").alias("t"), F.col("y").cast("double").alias("b"))
    return learned(h, bottom, good.select("model", "unique_id", F.col("ds").alias("t"), F.col("yhat").cast("double").alias("x")))


def erm_closed(h: Hierarchy, fcst: DataFrame, fitted: DataFrame) -> Projection:
    horizon = fcst.agg(F.count_distinct("ds")).first()[0]
    good = settled(complete(fitted, horizon), "fitted")
    y = good.select("unique_id", "ds", "model", F.col("y").cast("double").alias("yhat"), F.lit(1.0).alias("w"))
    fit = bottom_of(h, diagonal(h, y, ["ds", "model"])).select("model", "unique_id", F.col("ds").alias("t"), F.col("yhat").alias("b"))
    return learned(h, fit, good.select("model", "unique_id", F.col("ds").alias("t"), F.col("yhat").cast("double").alias("x")))


def erm_lasso(h: Hierarchy, fcst: DataFrame, fitted: DataFrame, around_bottom_up: bool, lam: float | None, vec_order: str = "reference") -> DataFrame:
    """(model, unique_id, source, x): sparse projections to the bottom series by lasso.

    vec_order: ``math`` reads the coefficients as the design is ordered, ``reference`` in the
    transposed order that published implementations use.
    """
    n, b = h.shape
    horizon = fcst.agg(F.count_distinct("ds")).first()[0]
    good = complete(fitted, horizon)
    rows = settled(packed(good, SERIES, "ds", x=F.col("yhat").cast("double"), z=F.col("y").cast("double")), "insample")
    n_times = rows.select(F.max(F.size("x"))).first()[0]
    at = settled(h.places, "places")
    k = F.col("place").cast("long") - (n - b)  # places of the bottom series among themselves
    z = rows.select(*SERIES, "z")
    if around_bottom_up:
        # The coefficients of bottom-up in the order in which the design reads them.
        flat = (F.col("place").cast("long") * b + k)
        ones = at.where(F.col("place") >= n - b).select((flat / n).cast("long").alias("row"), F.pmod(flat, F.lit(n)).alias("source"))
        own = at.where(F.col("place") >= n - b).select(F.col("unique_id").alias("bottom"), k.alias("row"))
        made = ones.join(at.select(F.col("unique_id").alias("_source"), F.col("place").cast("long").alias("source")), "source").join(own, "row")
        each = made.join(rows.select("model", F.col("unique_id").alias("_source"), "x"), "_source").select(F.col("bottom").alias("unique_id"), "model", F.posexplode("x").alias("t", "yhat"))
        sums = packed(summed(h, each.groupBy("unique_id", "model", "t").agg(F.sum("yhat").alias("yhat")), ["model", "t"]), SERIES, "t", y=F.col("yhat"))
        z = z.join(sums, SERIES, "left").select(*SERIES, F.when(F.col("y").isNull(), F.col("z")).otherwise(F.zip_with("z", "y", lambda v, y: v - y)).alias("z"))
    found = lasso.coefficients(h, rows.select(*SERIES, "x"), z, lam, n_times).join(at, "unique_id").withColumn("i", k)
    if vec_order == "math":
        found = found.select("model", F.col("i").alias("bottom"), F.col("j").cast("long").alias("source"), "x")
    else:
        flat = F.col("i") * n + F.col("j")
        found = found.select("model", F.pmod(flat, F.lit(b)).alias("bottom"), (flat / b).cast("long").alias("source"), "x")
    named = found.join(at.select((F.col("place").cast("long") - (n - b)).alias("bottom"), "unique_id"), "bottom").join(at.select(F.col("place").cast("long").alias("source"), F.col("unique_id").alias("_source")), "source")
    named = named.select("model", "unique_id", F.col("_source").alias("source"), "x")
    if around_bottom_up:
        same = h.nodes.where("is_bottom").select("unique_id").join(rows.select("model").distinct(), F.lit(True))  # a row per model
        named = named.unionByName(same.select("model", "unique_id", F.col("unique_id").alias("source"), F.lit(1.0).alias("x")))
    return named.groupBy("model", "unique_id", "source").agg(F.sum("x").alias("x"))
