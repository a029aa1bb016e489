"""Weights of minimum-trace reconciliation, and the dense solution for errors with gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.hierarchy import Hierarchy
from tallytree.operators import covariance as C
from tallytree.operators.reconcile import bottom_of, summed

DENSE = 2000
FLUSH = 1e-10


def structural(h: Hierarchy) -> DataFrame:
    """(unique_id, w): how many bottom series a node sums."""
    return h.summing.groupBy("unique_id").agg(F.sum("weight").alias("w"))


def identity(h: Hierarchy) -> DataFrame:
    return h.nodes.select("unique_id", F.lit(1.0).alias("w"))


def guard(fitted: DataFrame) -> None:
    """Raises ValueError where more than 98 % of the series have errors that sum to nothing."""
    bad = C.zero_errors(C.errors(fitted)).where("share > 0.98").collect()  # a row per model
    if bad:
        raise ValueError(f"The errors in sample are close to 0 for {[r.model for r in bad]}: share {bad[0].share}.")


def error_variance(fitted: DataFrame, centred: bool = False) -> DataFrame:
    """(model, unique_id, w): mean squared error over all times of the model; or the centred sample variance."""
    e = C.errors(fitted)
    if centred:
        return e.groupBy("model", "unique_id").agg(F.var_samp("e").alias("w"))
    times = e.groupBy("model").agg(F.count_distinct("ds").alias("T"))
    s = e.groupBy("model", "unique_id").agg(F.coalesce(F.sum(F.col("e") * F.col("e")), F.lit(0.0)).alias("s"))
    return s.join(F.broadcast(times), "model").select("model", "unique_id", (F.col("s") / F.col("T") + C.RIDGE).alias("w"))  # a row per model


def _arrays(df: DataFrame, row: str, column: str, value: str) -> tuple[list, list, np.ndarray]:
    """A small table as a dense array, with its row and column keys sorted."""
    got = df.select(row, column, value).toPandas()
    wide = got.pivot(index=row, columns=column, values=value).sort_index().sort_index(axis=1)
    return list(wide.index), list(wide.columns), wide.to_numpy(dtype=float)


def has_gaps(fitted: DataFrame) -> bool:
    """Whether some series of a model lacks an error at a time that others have."""
    e = C.errors(fitted).groupBy("model").agg(F.count_distinct("ds").alias("T"), F.count("e").alias("n"), F.count_distinct("unique_id").alias("s"))
    return not e.where("n <> T * s").isEmpty()


def gap_map(h: Hierarchy, fitted: DataFrame, models: list[str], method: str, ridge: float = C.RIDGE, most: int = DENSE) -> DataFrame:
    """(model, unique_id, source, x): mint_cov's and mint_shrink's maps to the bottom series for errors with gaps.

    Pairwise covariances have no factor, so the matrix has a row per series, of which at most ``most`` are allowed.
    """
    n, b = h.shape
    if n > most:
        raise ValueError(f"Errors with gaps need a dense matrix of all {n} series; at most {most} are allowed.")
    ids = [r[0] for r in h.nodes.orderBy("level_ord", "pos").select("unique_id").collect()]
    at, s = {x: k for k, x in enumerate(ids)}, h.to_numpy()
    ut = np.hstack([np.eye(n - b), -s[: n - b]])
    e = C.errors(fitted)
    out = []
    for model in models:
        part = e.where(F.col("model") == model)
        pairs = (C.masked_covariance(part) if method == "mint_cov" else C.masked_shrunk(part, ridge)).toPandas()  # at most ``most`` squared
        w = np.zeros((n, n))
        i, j = pairs["id1"].map(at).to_numpy(), pairs["id2"].map(at).to_numpy()
        w[i, j] = w[j, i] = pairs["cov"].to_numpy()
        k = ut @ w @ ut.T
        try:
            change = w[n - b :] @ ut.T @ np.linalg.solve(np.where(np.abs(k) < FLUSH, 0.0, k), ut)
        except np.linalg.LinAlgError:
            raise ValueError(f"min_trace ({method}) is ill-conditioned. Use another reconciliation method.") from None
        m = np.eye(n)[n - b :] - change
        out += [(model, ids[n - b + i], ids[j], float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return h.spark.createDataFrame(out, "model string, unique_id string, source string, x double")


def non_negative(rec: DataFrame, h: Hierarchy, by: list[str]) -> DataFrame:
    """Bottom values below zero become zero, and all others are summed again."""
    bottom = bottom_of(h, rec).withColumn("yhat", F.greatest("yhat", F.lit(0.0)))
    return summed(h, bottom.select("unique_id", *by, "yhat"), by)
