"""Panels over the sample tables, and simple forecasts for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallytree.hierarchy import Hierarchy
from tallytree.operators.aggregate import aggregate
from tallytree.session import settled

HORIZON = 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """total, region, nation, segment, ds (quarter), y (cents) of every order; small tables join by size."""
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    quarter = F.date_trunc("quarter", F.col("o_orderdate")).cast("date")
    return joined.select(F.lit("total").alias("total"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), quarter.alias("ds"), F.round(F.col("o_totalprice") * 100).cast("long").alias("y"), "o_custkey")


def dense(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every combination of keys at every time, with y 0 where there was none."""
    sums = df.groupBy(*keys, "ds").agg(F.sum("y").alias("y"))
    times = df.agg(F.array_sort(F.collect_set("ds")).alias("_t"))  # as many as there are times
    every = df.select(*keys).distinct().join(F.broadcast(times), F.lit(True)).select(*keys, F.explode("_t").alias("ds"))
    return every.join(sums, [*keys, "ds"], "left").select(*keys, "ds", F.coalesce("y", F.lit(0)).alias("y"))


@dataclass(frozen=True)
class Panel:
    """actual, train: unique_id, ds, y. fcst: unique_id, ds, model, yhat. fitted: also y."""

    h: Hierarchy
    train: DataFrame
    test: DataFrame
    fcst: DataFrame
    fitted: DataFrame


def forecasts(panel: DataFrame, h: Hierarchy, season: int, horizon: int) -> Panel:
    """naive and seasonal naive forecasts, raised by 5 and 3 % per level so that they do not add up."""
    order = Window.partitionBy("unique_id").orderBy("ds")
    back = F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ds")))
    # Series and forecasts are read several times by every method; they are small beside the facts.
    h = h.settle()
    rows = settled(panel.select("unique_id", "ds", "y", "level_ord", back.alias("back")), "panel")
    raised: dict[str, Column] = {"naive": 1 + F.lit(0.05) * F.col("level_ord"), "snaive": 1 + F.lit(0.03) * F.col("level_ord")}
    train, test = rows.where(F.col("back") > horizon), rows.where(F.col("back") <= horizon)
    lags = train.withColumn("naive", F.lag("y", 1).over(order)).withColumn("snaive", F.lag("y", season).over(order))
    last = train.groupBy("unique_id").agg(F.max_by("y", "ds").alias("naive"))
    before = train.where(F.col("back") <= horizon + season).select("unique_id", F.col("y").alias("snaive"), "back")
    # The test row at place back is season (or a multiple) after one of the last rows of training.
    ahead = F.lit(horizon) - F.col("back")
    source = F.lit(horizon + season) - F.pmod(ahead, F.lit(season))
    ahead_rows = test.withColumn("_source", source).join(last, "unique_id").join(before.withColumnRenamed("back", "_source"), ["unique_id", "_source"])

    def long(df: DataFrame, keep: list[str]) -> DataFrame:
        cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), (F.col(m).cast("double") * k).alias("yhat")) for m, k in raised.items()))).alias("c")
        return df.select("unique_id", "ds", *keep, cells).select("unique_id", "ds", *keep, "c.model", "c.yhat")

    fitted = long(lags.where(F.col("snaive").isNotNull()), ["y"]).withColumn("y", F.col("y").cast("double"))
    return Panel(h, train.select("unique_id", "ds", "y"), test.select("unique_id", "ds", "y"), settled(long(ahead_rows, []), "forecasts"), settled(fitted, "fitted"))


GEO = [["total"], ["total", "region"], ["total", "region", "nation"]]
CROSSED = [["total"], ["total", "region"], ["total", "segment"], ["total", "region", "segment"]]


def geo(spark: SparkSession, sf_dir: str) -> Panel:
    """Quarterly revenue by total, region and nation: a tree."""
    bottom = dense(order_rows(spark, sf_dir), GEO[-1])
    panel, h = aggregate(bottom, GEO, check=False)
    return forecasts(panel, h, 4, HORIZON)


def crossed(spark: SparkSession, sf_dir: str) -> Panel:
    """Quarterly revenue by region and market segment: not a tree."""
    bottom = dense(order_rows(spark, sf_dir), ["total", "region", "segment"])
    panel, h = aggregate(bottom, CROSSED, check=False)
    return forecasts(panel, h, 4, HORIZON)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """total, kind, ds (day), y (hundredths) of every event."""
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("total").alias("total"), F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("ds"), F.round(F.col("value") * 100).cast("long").alias("y"))


def events(spark: SparkSession, sf_dir: str) -> Panel:
    """Daily value by total and event type: two levels."""
    bottom = dense(event_rows(spark, sf_dir), ["total", "kind"])
    panel, h = aggregate(bottom, [["total"], ["total", "kind"]], check=False)
    return forecasts(panel, h, 7, 7)
