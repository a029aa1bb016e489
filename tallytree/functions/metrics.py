"""Accuracy per series as aggregates of rows y, yhat (and scales from training values)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """value: an aggregate over a series' rows; scale: a column of the training scales to divide by, or none."""

    name: str
    value: Callable[[], Column]
    scale: str | None = None
    season: int = 1


def _e() -> Column:
    return F.col("y") - F.col("yhat")


def mae() -> Metric:
    return Metric("mae", lambda: F.avg(F.abs(_e())))


def mse() -> Metric:
    return Metric("mse", lambda: F.avg(_e() * _e()))


def rmse() -> Metric:
    return Metric("rmse", lambda: F.sqrt(F.avg(_e() * _e())))


def mase(season: int = 1) -> Metric:
    """mae over the training values' mean absolute seasonal difference."""
    return Metric("mase", lambda: F.avg(F.abs(_e())), "abs", season)


def msse(season: int = 1) -> Metric:
    return Metric("msse", lambda: F.avg(_e() * _e()), "sq", season)


def rmsse(season: int = 1) -> Metric:
    return Metric("rmsse", lambda: F.avg(_e() * _e()), "sq_root", season)


def rel_mse() -> Metric:
    """Squared error over that of the last training value as forecast."""
    return Metric("rel_mse", lambda: F.try_divide(F.avg(_e() * _e()), F.avg((F.col("y") - F.col("last")) ** 2)), "last")


def scaled_crps(quantiles: list[float]) -> Metric:
    """Twice the mean quantile loss over the sum of absolute values; rows need q, an array for these quantiles."""

    def value() -> Column:
        losses = []
        for k, p in enumerate(quantiles):
            e = F.col("y") - F.col("q")[k]
            losses.append(F.sum(F.greatest(p * e, (p - 1) * e)))
        total = losses[0]
        for x in losses[1:]:
            total = total + x
        return F.try_divide(2 * total / len(quantiles), F.sum(F.abs("y")))

    return Metric("scaled_crps", value)


def scales(train: DataFrame, season: int) -> DataFrame:
    """(unique_id, abs, sq, last) from training rows unique_id, ds, y."""
    w = Window.partitionBy("unique_id").orderBy("ds")
    d = train.withColumn("_d", F.col("y").cast("double") - F.lag(F.col("y").cast("double"), season).over(w))
    return d.groupBy("unique_id").agg(F.avg(F.abs("_d")).alias("abs"), F.avg(F.col("_d") * F.col("_d")).alias("sq"), F.max_by(F.col("y").cast("double"), "ds").alias("last"))
