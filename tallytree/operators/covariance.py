"""Variances and covariances of in-sample errors, kept as rows or as factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.arrays import dot, gram, packed
from tallytree.session import settled

RIDGE = 2e-8
EPS = 2e-8


def errors(fitted: DataFrame) -> DataFrame:
    """unique_id, ds, model, e from unique_id, ds, model, y, yhat; NaN becomes null."""
    e = F.col("y").cast("double") - F.col("yhat").cast("double")
    return fitted.select("unique_id", "ds", "model", F.when(~F.isnan(e), e).alias("e"))


def _masked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs of rows of two series x times arrays with gaps (NaN), over the times that both have:
    the covariance, the variance of their mean product when standardised, that product's square, and their number.

    Everything comes from products of the arrays, their squares and masks.
    """

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = ~np.isnan(v)
        n = np.maximum(seen.sum(1, keepdims=True), 1)
        mean = np.where(seen, v, 0.0).sum(1, keepdims=True) / n
        c = np.where(seen, v - mean, 0.0)
        return seen.astype(float), c, np.sqrt((c * c).sum(1, keepdims=True) / n) + EPS

    (m1, a, s1), (m2, b, s2) = parts(x), parts(y)
    k = m1 @ m2.T
    some = np.maximum(k, 1.0)
    cov = np.where(k > 1, (a @ b.T - (a @ m2.T) * (m1 @ b.T) / some) / np.maximum(k - 1, 1.0), 0.0)
    a, b = a / s1, b / s2
    a2, b2 = a * a, b * b
    sa, sb = a @ m2.T, m1 @ b.T
    mu, nu = sa / some, sb / some
    mean = a @ b.T / some - mu * nu
    squares = a2 @ b2.T - 2 * nu * (a2 @ b.T) + nu * nu * (a2 @ m2.T) - 2 * mu * (a @ b2.T) + 4 * mu * nu * (a @ b.T) - 2 * mu * nu * nu * sa + mu * mu * (m1 @ b2.T) - 2 * mu * mu * nu * sb + k * mu * mu * nu * nu
    spread = np.where(k > 1, (squares - k * mean * mean) / (some * np.maximum(k - 1, 1.0)), 0.0)
    return cov, spread, np.where(k > 1, mean * mean, 0.0), k


#: Series in a block of a masked product.
BLOCK = 128


def masked_pairs(e: DataFrame) -> DataFrame:
    """(model, id1, id2, cov, spread, square, n), id1 <= id2, of errors with gaps, over the times that both series have.

    cov is 0 for one time or none. Series are packed into blocks of about BLOCK with an array over all times
    each; a task makes all pairs of two blocks. The result has a row per pair of series by definition.
    """
    times = e.groupBy("model").agg(F.array_sort(F.collect_set("ds")).alias("_ts"))  # a row per model
    own = e.where("e IS NOT NULL").groupBy("model", "unique_id").agg(F.map_from_entries(F.collect_list(F.struct("ds", "e"))).alias("_e"))
    every = e.select("model", "unique_id").distinct().join(own, ["model", "unique_id"], "left").join(F.broadcast(times), "model")
    none = F.lit(float("nan"))
    value = F.when(F.col("_e").isNull(), F.transform("_ts", lambda t: none)).otherwise(F.transform("_ts", lambda t: F.coalesce(F.element_at("_e", t), none)))
    blocks = max(1, -(-e.select("unique_id").distinct().count() // BLOCK))
    rows = every.select("model", F.pmod(F.xxhash64("unique_id"), F.lit(blocks)).alias("block"), F.struct("unique_id", value.alias("x")).alias("s"))
    packed = settled(rows.groupBy("model", "block").agg(F.collect_list("s").alias("s")), "blocks")
    other = packed.select(F.col("model").alias("model"), F.col("block").alias("block2"), F.col("s").alias("s2"))
    pairs = packed.join(other, "model").where("block <= block2").repartition("model", "block", "block2").select("model", "block", "s", "block2", "s2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, ids2 = (np.array([x["unique_id"] for x in r[c]], dtype=object) for c in ("s", "s2"))
                x, y = (np.array([v["x"] for v in r[c]], dtype=float).reshape(len(r[c]), -1) for c in ("s", "s2"))
                found = _masked(x, y)
                i, j = np.nonzero(np.triu(np.ones(found[0].shape))) if r["block"] == r["block2"] else np.nonzero(np.ones(found[0].shape))
                first, second = ids[i], ids2[j]
                low = first <= second
                yield pa.RecordBatch.from_arrays([pa.array([r["model"]] * len(i)), pa.array(np.where(low, first, second), pa.string()), pa.array(np.where(low, second, first), pa.string()), *(pa.array(m[i, j]) for m in found)], names=["model", "id1", "id2", "cov", "spread", "square", "n"])

    return pairs.mapInArrow(work, "model string, id1 string, id2 string, cov double, spread double, square double, n double")


def masked_covariance(e: DataFrame) -> DataFrame:
    """(model, id1, id2, cov, n), id1 <= id2: over the n times that both series have; 0 for one time or none."""
    return masked_pairs(e).select("model", "id1", "id2", "cov", "n")


def masked_shrunk(e: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """(model, id1, id2, cov, n), id1 <= id2: the shrunk covariances of errors with gaps."""
    pairs = settled(masked_pairs(e), "pairs")
    off = pairs.groupBy("model").agg(F.sum(F.when(F.col("id1") != F.col("id2"), F.col("spread"))).alias("v"), F.sum(F.when(F.col("id1") != F.col("id2"), F.col("square"))).alias("s"))
    lam = F.least(F.greatest(F.coalesce(F.col("v") / (F.col("s") + EPS), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    cov = F.when(F.col("id1") == F.col("id2"), F.greatest("cov", F.lit(ridge))).otherwise((1 - F.col("lam")) * F.col("cov"))
    return pairs.join(F.broadcast(off.select("model", lam.alias("lam"))), "model").select("model", "id1", "id2", cov.alias("cov"), "n")  # a row per model


def centred(e: DataFrame) -> DataFrame:
    """(model, unique_id, ds, c, var, std, T): errors less their mean, sample variance, population deviation."""
    s = e.groupBy("model", "unique_id").agg(F.avg("e").alias("_m"), F.var_samp("e").alias("var"), F.stddev_pop("e").alias("std"), F.count("e").alias("T"))
    return e.join(s, ["model", "unique_id"]).select("model", "unique_id", "ds", (F.col("e") - F.col("_m")).alias("c"), "var", "std", "T")


def shrinkage(c: DataFrame) -> DataFrame:
    """(model, lam): how far the correlations are drawn to zero, from errors without gaps.

    All pairs' sums come from Gram sums over time: no row per pair of series is made.
    """
    x = c.select("model", "unique_id", "ds", (F.col("c") / (F.col("std") + EPS)).alias("x"), "T")
    rows = packed(x, ["model", "unique_id", "T"], "ds", x=F.col("x"))
    own = rows.withColumn("q", dot("x", "x")).groupBy("model").agg(F.sum(F.col("q") * F.col("q")).alias("own"), F.max("T").alias("T"))
    per_time = x.groupBy("model", "ds").agg(F.sum(F.col("x") ** 2).alias("s2"), F.sum(F.col("x") ** 4).alias("s4"))
    squares = per_time.groupBy("model").agg(F.sum(F.col("s2") * F.col("s2") - F.col("s4")).alias("squares"))
    # The Gram matrix over time has as many rows as there are pairs of times.
    cells = gram(rows, "model", F.col("x"), F.col("x")).groupBy("model").agg(F.sum(F.col("x") * F.col("x")).alias("gram"))
    t = F.col("T").cast("double")
    mean_sq = (F.col("gram") - F.col("own")) / (t * t) / 2
    var = (F.col("squares") / 2 - t * mean_sq) / (t * (t - 1))
    lam = F.least(F.greatest(F.try_divide(var, mean_sq + EPS), F.lit(0.0)), F.lit(1.0))
    return own.join(squares, "model").join(cells, "model").select("model", lam.alias("lam"))


def shrunk_masked(res: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The shrunk covariance of a dense series x times array with gaps (NaN)."""
    w, spread, square, _ = _masked(res, res)
    off = ~np.eye(len(res), dtype=bool)
    keep = 1 - min(max(spread[off].sum() / 2 / (square[off].sum() / 2 + EPS), 0.0), 1.0)
    return np.where(off, keep * w, np.maximum(np.diag(w), ridge)[:, None])


def zero_errors(e: DataFrame) -> DataFrame:
    """(model, share): share of series whose errors sum to nearly nothing."""
    sums = e.groupBy("model", "unique_id").agg(F.abs(F.sum("e")).alias("s"))
    return sums.groupBy("model").agg(F.avg(F.when(F.col("s") < 1e-4, 1.0).otherwise(0.0)).alias("share"))
