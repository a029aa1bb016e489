"""Probabilistic forecasts: Gaussian, bootstrap, copula-based and conformal, as rows.

Samples are rows with a sample number; a reconciliation maps them like forecasts. Random
choices of times in sample come from one numpy generator on the driver, as many numbers as
there are samples. Gaussian draws are functions of hashes of seed, series, time and sample,
so they do not depend on how rows are placed.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallytree.functions.naming import level_quantiles
from tallytree.hierarchy import Hierarchy
from tallytree.operators import covariance as C
from tallytree.operators.mintrace import has_gaps
from tallytree.operators.projection import correlation as factor_correlation
from tallytree.operators.projection import factor
from tallytree.operators.reconcile import need_strict
from tallytree.operators.reconcilers import BottomUp, Fitted, Method, TopDown, as_fitted, linear_map, models_of
from tallytree.session import observed, settled

BY = ["ds", "model"]


def z_of(q: float) -> float:
    return NormalDist().inv_cdf(q)


def sigma_from_bounds(pairs: list[tuple[float, Column, Column]]) -> Column:
    """Mean over levels of the half-widths by their normal quantiles, at least 0. A level 0 tells nothing."""
    usable = [(x, lo, hi) for x, lo, hi in pairs if x > 0]
    if not usable:
        raise ValueError("Forecasts need a pair of lower and upper bounds of one level.")
    total = None
    for x, lo, hi in usable:
        one = (hi - lo) / F.lit(2 * z_of(0.5 + x / 200))
        total = one if total is None else total + one
    return F.greatest(total / len(usable), F.lit(0.0))


def normality(h: Hierarchy, method: Method | Fitted, rec: DataFrame, sigma: DataFrame, fitted: DataFrame | None, correlation: DataFrame | str | None = None) -> DataFrame:
    """rec with sigma: the deviation of each reconciled forecast. sigma: unique_id, ds, model, sigma.

    correlation: None for independent errors; ``full`` or ``shrink`` for that of the errors in sample, as a
    factor over the times in sample; or rows (model, id1, id2, r) with id1 <= id2. Written maps on
    trees need no row per pair of series: the variances come from passes over the levels and from
    the map's and the errors' factors. Crossed structures, errors with gaps, and rows of
    correlations take the matrix of the map, of at most 2000 series.
    """
    made = as_fitted(method, h, sigma, fitted)
    if isinstance(made.method, BottomUp) and correlation is None:
        bottom = sigma.select(F.col("unique_id").alias("bottom_id"), *BY, "sigma")
        parts = h.summing.join(bottom, "bottom_id").withColumn("c", F.col("weight") * F.col("sigma"))
        variance = parts.groupBy("unique_id", *BY).agg(F.sum(F.col("c") * F.col("c")).alias("v"))
    elif isinstance(made.method, TopDown) and correlation is None:  # one error, the root's, is spread by the shares
        spread = made.predict(sigma.select("unique_id", *BY, F.col("sigma").alias("yhat")), BY)
        variance = spread.select("unique_id", *BY, (F.col("yhat") * F.col("yhat")).alias("v"))
    elif made.maps and not isinstance(correlation, DataFrame) and (h.is_strict or made.maps[0].base != "solved") and (correlation is None or not has_gaps(fitted)):
        x = None if correlation is None else factor_correlation(factor(fitted, correlation, getattr(made.method, "mint_shr_ridge", C.RIDGE))[0])
        variance = made.variance(sigma, BY, x)
    else:
        rows = correlations(fitted, correlation) if isinstance(correlation, str) else correlation
        variance = _variance_of_map(linear_map(made, models_of(rec)), sigma, rows)
    return rec.join(variance.select("unique_id", *BY, F.sqrt(F.greatest("v", F.lit(0.0))).alias("sigma")), ["unique_id", *BY])


def _variance_of_map(m: DataFrame, sigma: DataFrame, correlation: DataFrame | None) -> DataFrame:
    """unique_id, ds, model, v from the rows of a map's matrix."""
    s = sigma.select(F.col("unique_id").alias("source"), *BY, "sigma")
    parts = m.join(s, ["source", "model"]).withColumn("c", F.col("x") * F.col("sigma"))
    variance = parts.groupBy("unique_id", *BY).agg(F.sum(F.col("c") * F.col("c")).alias("v"))
    if correlation is None:
        return variance
    off = correlation.where("id1 <> id2 AND r <> 0")
    a = parts.select("unique_id", *BY, F.col("source").alias("id1"), F.col("c").alias("c1"))
    b = parts.select("unique_id", *BY, F.col("source").alias("id2"), F.col("c").alias("c2"))
    cross = a.join(off, ["id1", "model"]).join(b, ["unique_id", *BY, "id2"]).groupBy("unique_id", *BY).agg(F.sum(2 * F.col("r") * F.col("c1") * F.col("c2")).alias("w"))
    return variance.join(cross, ["unique_id", *BY], "left").select("unique_id", *BY, (F.col("v") + F.coalesce("w", F.lit(0.0))).alias("v"))


def correlations(fitted: DataFrame, kind: str = "full", ridge: float = C.RIDGE) -> DataFrame:
    """(model, id1, id2, r) of errors in sample: ``full`` or ``shrink``; deviations are at least 1e-8."""
    e = C.errors(fitted)
    if kind == "shrink":
        cov = C.masked_shrunk(e, ridge)
    elif kind == "full":
        cov = C.masked_covariance(e)
    else:
        raise ValueError(f"Unknown covariance type: {kind}")
    cov, told = observed(cov, "covariances", short=F.count_if((F.col("id1") == F.col("id2")) & (F.col("n") < 2)))
    if told["short"]:
        raise ValueError(f"{told['short']} series have fewer than 2 errors in sample; a correlation needs 2.")
    std = cov.where("id1 = id2").select("model", F.col("id1").alias("id"), F.greatest(F.sqrt("cov"), F.lit(1e-8)).alias("s"))
    both = cov.join(std.withColumnsRenamed({"id": "id1", "s": "s1"}), ["model", "id1"]).join(std.withColumnsRenamed({"id": "id2", "s": "s2"}), ["model", "id2"])
    r = F.least(F.greatest(F.col("cov") / (F.col("s1") * F.col("s2")), F.lit(-1.0)), F.lit(1.0))
    return both.select("model", "id1", "id2", F.when(F.col("id1") == F.col("id2"), 1.0).otherwise(r).alias("r"))


def normal_quantiles(rec: DataFrame, quantiles: list[float]) -> DataFrame:
    """rec (yhat, sigma) with q: array of normal quantiles."""
    return rec.withColumn("q", F.array(*(F.col("yhat") + F.lit(z_of(q)) * F.col("sigma") for q in quantiles)))


def seeded(seed: int | list[int]) -> tuple[list[int], list[str]]:
    """The seeds, and the column that tells them apart where there are several."""
    return (seed, ["seed"]) if isinstance(seed, list) else ([seed], [])


def each_seed(df: DataFrame, seeds: list[int]) -> DataFrame:
    """df for every seed, in a column ``seed``."""
    return df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))


def hashed_normal(seed: int | str, *keys: str) -> Column:
    """A standard normal number that is a function of the seed (a number, or a column's name) and the keys."""
    seed = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    u = lambda k: (F.pmod(F.xxhash64(seed, F.lit(k), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))


def independent_samples(rec: DataFrame, n: int, seed: int | list[int] = 0) -> DataFrame:
    """n draws of each forecast (yhat, sigma) by itself: unique_id, ds, model, sample_id, yhat, and seed for a list of seeds."""
    seeds, more = seeded(seed)
    each = each_seed(rec.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), seeds)
    return each.select("unique_id", *BY, *more, "sample_id", (F.col("yhat") + F.col("sigma") * hashed_normal("seed", "unique_id", "ds", "model", "sample_id")).alias("yhat"))


def normal_samples(h: Hierarchy, method: Method | Fitted, fcst: DataFrame, sigma: DataFrame, fitted: DataFrame | None, n: int, seed: int | list[int] = 0, kind: str | None = None) -> DataFrame:
    """n coherent draws of the reconciled forecasts: unique_id, ds, model, sample_id, yhat, and seed for a list of seeds.

    The forecasts' own errors are drawn and mapped as the forecasts are. kind: None for
    uncorrelated errors; ``full`` or ``shrink`` gives them the correlation of the errors in
    sample, by normal weights on the times in sample, so no row per pair of series is made.
    """
    seeds, more = seeded(seed)
    draws = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_id")
    each = each_seed(fcst.join(sigma, ["unique_id", *BY]).select("unique_id", *BY, "yhat", "sigma", draws), seeds)
    own = hashed_normal("seed", "unique_id", "ds", "model", "sample_id")
    if kind is None:
        z = own
    else:
        past = settled(C.centred(C.errors(fitted)), "errors")
        lam = C.shrinkage(past).select("model", "lam") if kind == "shrink" else past.select("model", F.lit(0.0).alias("lam")).distinct()
        past = past.where("var > 1e-16").select("model", "unique_id", F.col("ds").alias("_t"), (F.col("c") / F.sqrt(F.col("var") * (F.col("T") - 1))).alias("_x"))
        grid = each.select(*BY, "seed", "sample_id").distinct().join(past.select("model", "_t").distinct(), "model").withColumn("_g", hashed_normal("seed", "_t", "ds", "model", "sample_id"))
        common = grid.join(past, ["model", "_t"]).groupBy("unique_id", *BY, "seed", "sample_id").agg(F.sum(F.col("_g") * F.col("_x")).alias("_z"))
        each = each.join(common, ["unique_id", *BY, "seed", "sample_id"], "left").join(lam, "model")
        z = F.when(F.col("_z").isNull(), own).otherwise(F.sqrt(1 - F.col("lam")) * F.col("_z") + F.sqrt("lam") * own)
    drawn = each.select("unique_id", *BY, *more, "sample_id", (F.col("yhat") + F.col("sigma") * z).alias("yhat"))
    return as_fitted(method, h, fcst, fitted).predict(drawn, [*BY, *more, "sample_id"])


def residual_rows(fitted: DataFrame) -> DataFrame:
    """(model, unique_id, ordinal from 0, e) over the times where all series of a model have errors."""
    e = C.errors(fitted)
    good = e.groupBy("model", "ds").agg(F.count_if(F.col("e").isNull()).alias("bad")).where("bad = 0")
    good = good.withColumn("ordinal", F.row_number().over(Window.partitionBy("model").orderBy("ds")) - 1)
    return e.join(good.select("model", "ds", "ordinal"), ["model", "ds"]).select("model", "unique_id", "ordinal", "e")


def ranks_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows (keys, an ordinal, e) with rank: from 0 by e, ties by the ordinal."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("e", order)) - 1)


def drawn_starts(n_times: int, horizon: int, n: int, seed: int) -> list[int]:
    """Where n blocks of errors begin."""
    if n_times - horizon < 1:
        raise ValueError(f"A bootstrap needs more than {horizon} times in sample; there are {n_times}.")
    return np.random.default_rng(seed).choice(np.arange(n_times - horizon), size=n).tolist()


def _choices(found: list[list[int]], seeds: list[int]) -> Column:
    """(seed, sample_id, choice) of each seed's choices; as many as there are seeds and samples."""
    cells = (F.struct(F.lit(x).alias("seed"), F.lit(k).alias("sample_id"), F.lit(int(c)).alias("choice")) for x, own in zip(seeds, found, strict=True) for k, c in enumerate(own))
    return F.explode(F.array(*cells)).alias("_c")


def bootstrap_samples(h: Hierarchy, method: Method | Fitted, fcst: DataFrame, fitted: DataFrame, n: int, seed: int | list[int] = 0) -> DataFrame:
    """Forecasts plus blocks of errors, reconciled: unique_id, ds, model, sample_id, yhat, and seed for a list of seeds."""
    seeds, more = seeded(seed)
    res = residual_rows(fitted)
    step = fcst.withColumn("_h", F.row_number().over(Window.partitionBy("unique_id", "model").orderBy("ds")) - 1)
    n_times = res.agg(F.max("ordinal")).first()[0] + 1
    horizon = step.agg(F.max("_h")).first()[0] + 1
    starts = _choices([drawn_starts(n_times, horizon, n, x) for x in seeds], seeds)
    each = step.select("unique_id", *BY, "yhat", "_h", starts).select("unique_id", *BY, "yhat", "_c.seed", "_c.sample_id", (F.col("_c.choice") + F.col("_h")).alias("ordinal"))
    moved = each.join(res, ["unique_id", "model", "ordinal"]).select("unique_id", *BY, *more, "sample_id", (F.col("yhat") + F.col("e")).alias("yhat"))
    return as_fitted(method, h, fcst, fitted).predict(moved, [*BY, *more, "sample_id"])


def quantiles_of(samples: DataFrame, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """unique_id, by, q: interpolated quantiles of the samples."""
    return samples.groupBy("unique_id", *(by or BY)).agg(F.percentile("yhat", F.array(*map(F.lit, quantiles))).alias("q"))


def conformal_scores(h: Hierarchy, method: Method | Fitted, fitted: DataFrame) -> DataFrame:
    """(unique_id, ds, model, score): values less the reconciled fitted forecasts, where all have both."""
    good = fitted.groupBy("model", "ds").agg(F.count_if(F.col("y").isNull() | F.isnan(F.col("y").cast("double")) | F.col("yhat").isNull() | F.isnan("yhat")).alias("bad")).where("bad = 0")
    part = fitted.join(good.select("model", "ds"), ["model", "ds"], "left_semi")
    values = part.select("unique_id", *BY, F.col("yhat").cast("double").alias("yhat"))
    rec = as_fitted(method, h, values, fitted).predict(values, BY)
    return part.select("unique_id", *BY, F.col("y").cast("double").alias("y")).join(rec, ["unique_id", *BY]).select("unique_id", *BY, (F.col("y") - F.col("yhat")).alias("score"))


def conformal(h: Hierarchy, method: Method | Fitted, rec: DataFrame, fitted: DataFrame, quantiles: list[float]) -> DataFrame:
    """rec with q: forecasts plus the scores' interpolated quantiles."""
    scores = conformal_scores(h, method, fitted)
    q = scores.groupBy("unique_id", "model").agg(F.percentile("score", F.array(*map(F.lit, quantiles))).alias("_q"), F.count("score").alias("_n"))
    return rec.join(q.where("_n >= 2"), ["unique_id", "model"]).withColumn("q", F.transform("_q", lambda x: x + F.col("yhat"))).drop("_q", "_n")


def conformal_levels(scores: DataFrame, rec: DataFrame, level: float) -> DataFrame:
    """rec with lo and hi by the rank rule for finite samples."""
    a = 1 - level / 100
    w = Window.partitionBy("unique_id", "model")
    ranked = scores.withColumn("k", F.row_number().over(w.orderBy("score")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    lo = F.least(F.greatest(F.floor((F.col("n") + 1) * (a / 2)), F.lit(0)), F.col("n") - 1)
    hi = F.least(F.greatest(F.ceil((F.col("n") + 1) * (1 - a / 2)) - 1, F.lit(0)), F.col("n") - 1)
    bounds = ranked.groupBy("unique_id", "model").agg(F.max(F.when(F.col("k") == lo, F.col("score"))).alias("_lo"), F.max(F.when(F.col("k") == hi, F.col("score"))).alias("_hi"))
    return rec.join(bounds, ["unique_id", "model"]).withColumn("lo", F.col("yhat") + F.col("_lo")).withColumn("hi", F.col("yhat") + F.col("_hi")).drop("_lo", "_hi")


def conformal_samples(h: Hierarchy, method: Method | Fitted, rec: DataFrame, fitted: DataFrame, n: int, seed: int | list[int] = 0) -> DataFrame:
    """n draws (by seed, for a list of seeds): at one time and sample all series take their scores of the same time in sample."""
    if n <= 0:
        raise ValueError("The number of samples must be positive.")
    scores = conformal_scores(h, method, fitted)
    times = scores.select("model", "ds").distinct().withColumn("k", F.row_number().over(Window.partitionBy("model").orderBy("ds")) - 1)
    count = times.agg(F.max("k")).first()[0] + 1
    numbered = scores.join(times, ["model", "ds"]).select("model", "unique_id", "k", "score")
    seeds, more = seeded(seed)
    pick = F.pmod(F.xxhash64("seed", "ds", "sample_id"), F.lit(count)).cast("int")
    each = each_seed(rec.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), seeds).withColumn("k", pick)
    return each.join(numbered, ["model", "unique_id", "k"]).select("unique_id", *BY, *more, "sample_id", (F.col("yhat") + F.col("score")).alias("yhat"))


def permbu_samples(h: Hierarchy, rec: DataFrame, sigma: DataFrame, fitted: DataFrame, n: int | None = None, seed: int | list[int] = 0, sort_first: bool = True) -> DataFrame:
    """Copula samples on a tree, bottom upwards: unique_id, ds, model, sample_id, yhat, and seed for a list of seeds.

    Sorted Gaussian draws of the children take the order of the ranks of their errors and are
    summed to the parent's draws, level by level, so the siblings' dependence is that of the
    errors. A parent's draws are then put in a random order, keyed by seed and series, before they are reordered
    as a child's. sort_first=False keeps the draws unsorted before they are reordered.
    """
    need_strict(h, ["PERMBU"])
    res = residual_rows(fitted)
    n_times = res.agg(F.max("ordinal")).first()[0] + 1
    n = n or n_times
    seeds, more = seeded(seed)
    picks = [np.random.default_rng(x).choice(n_times, size=n, replace=n > n_times).tolist() for x in seeds]
    chosen = h.spark.range(1).select(_choices(picks, seeds)).select("_c.seed", "_c.sample_id", F.col("_c.choice").alias("ordinal"))
    ranks = res.join(F.broadcast(chosen), "ordinal")  # a row per seed and sample
    ranks = ranks_of(ranks, ["model", "unique_id", "seed"], "sample_id").select("model", "unique_id", "seed", "sample_id", "rank")
    by = [*BY, "seed"]
    draws = independent_samples(rec.select("unique_id", *BY, "yhat").join(sigma, ["unique_id", *BY]), n, seeds)
    at = draws.join(h.nodes.select("unique_id", "level_ord"), "unique_id")
    edges = h.edges.select("parent_id", F.col("child_id").alias("unique_id"))

    def reordered(d: DataFrame) -> DataFrame:
        order = Window.partitionBy("unique_id", *by).orderBy("yhat", "sample_id") if sort_first else Window.partitionBy("unique_id", *by).orderBy("sample_id")
        placed = d.withColumn("rank", F.row_number().over(order) - 1).drop("sample_id")
        return placed.join(ranks, ["model", "unique_id", "seed", "rank"]).select("unique_id", *by, "sample_id", "yhat")

    def shuffled(d: DataFrame) -> DataFrame:
        """Draws in another order, a function of seed and series alone; the same at all times ahead."""
        key = F.xxhash64("seed", F.lit("order"), "unique_id", "sample_id")
        order = Window.partitionBy("unique_id", *by).orderBy(key, "sample_id")
        return d.withColumn("sample_id", (F.row_number().over(order) - 1).cast("int"))

    level = reordered(at.where(F.col("level_ord") == len(h.levels) - 1).select("unique_id", *by, "sample_id", "yhat"))
    out = level
    for k in range(len(h.levels) - 2, -1, -1):
        parent = shuffled(level.join(edges, "unique_id").groupBy(F.col("parent_id").alias("unique_id"), *by, "sample_id").agg(F.sum("yhat").alias("yhat")))
        out = out.unionByName(parent)
        level = reordered(parent) if k else parent
    return out.select("unique_id", *BY, *more, "sample_id", "yhat")


def samples_to_quantiles(samples: DataFrame, quantiles: list[float] | None = None, level: list[float] | None = None, model: str = "model") -> DataFrame:
    """Mean and quantiles of samples (unique_id, ds, sample_id, yhat) in wide columns named by the model."""
    from tallytree.functions.naming import level_outputs, quantile_outputs

    if (quantiles is None) == (level is None):
        raise ValueError("Give either quantiles or levels.")
    qs, names = quantile_outputs(quantiles) if level is None else level_outputs(level)
    found = samples.groupBy("unique_id", "ds").agg(F.avg("yhat").alias(model), F.percentile("yhat", F.array(*map(F.lit, qs))).alias("_q"))
    return found.select("unique_id", "ds", f"`{model}`", *(F.col("_q")[k].alias(model + n) for k, n in enumerate(names)))


def interval_quantiles(level: list[float]) -> list[float]:
    return level_quantiles(sorted(level))
