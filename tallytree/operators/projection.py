"""Linear maps of forecasts that are fitted once, written, and applied to any values.

A map is B - C Q. B solves with diagonal weights, keeps values or drops them. C and Q come from the errors or
the fitted forecasts in sample: a column of C and a row of Q for each time, so each series
carries two arrays as long as the history, and no matrix of all series is made. Systems of
the history's size are solved on the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.arrays import dot, gram, packed, with_few
from tallytree.hierarchy import Hierarchy
from tallytree.operators import covariance as C
from tallytree.operators import trees
from tallytree.operators.crossed import constrained
from tallytree.operators.reconcile import coherence_residual, summed
from tallytree.session import observed, settled

SERIES = ["model", "unique_id"]


def diagonal(h: Hierarchy, weighted: DataFrame, by: list[str]) -> DataFrame:
    """The coherent values next to weighted (unique_id, by, yhat, w): exact on trees, by conjugate gradients otherwise."""
    return trees.solved(h, weighted, by) if h.is_strict else constrained(h, weighted, by)


@dataclass(frozen=True)
class Projection:
    """table: model, unique_id, w, c, q. base: ``solved``, ``same`` or ``none`` of the values is B. times: the arrays' length, 0 for no arrays."""

    h: Hierarchy
    table: DataFrame
    base: str
    times: int = 0

    def _base(self, values: DataFrame, by: list[str]) -> DataFrame:
        if self.base == "solved":
            return diagonal(self.h, values.join(self.table.select(*SERIES, "w"), SERIES).select("unique_id", *by, "yhat", "w"), by)
        return values.select("unique_id", *by, (F.col("yhat") if self.base == "same" else F.lit(0.0)).alias("yhat"))

    def apply(self, values: DataFrame, by: list[str]) -> DataFrame:
        """The map of values (unique_id, by, yhat); model is in ``by``."""
        if not self.times:
            return self._base(values, by)
        values = settled(values.select("unique_id", *by, "yhat"), "values")
        key = ["unique_id", *by]
        base = self._base(values, by)
        if self.base == "solved":  # Q of a value is Q of what B leaves of it, which is smaller
            base = settled(base, "bases")
            left = values.join(base.withColumnRenamed("yhat", "_b"), key).withColumn("yhat", F.col("yhat") - F.col("_b"))
        else:
            left = values
        parts = left.join(self.table.select(*SERIES, "q"), SERIES).select(*by, "yhat", F.posexplode("q").alias("k", "_q"))
        z = parts.groupBy(*by, "k").agg(F.sum(F.col("_q") * F.col("yhat")).alias("z"))
        z = settled(packed(z, by, "k", z=F.col("z")), "systems")
        moved = with_few(base.join(self.table.select(*SERIES, "c"), SERIES), z, by, z.count() * self.times)
        return moved.select(*key, (F.col("yhat") - dot("c", "z")).alias("yhat"))

    def variance(self, errors: DataFrame, by: list[str], x: DataFrame | None = None) -> DataFrame:
        """unique_id, by, v: variances of mapped values whose errors (unique_id, by, sigma) have these deviations.

        x: (model, unique_id, x, delta) gives the errors the correlation x x' off the diagonal, delta being
        what is left on it; without it errors are independent.
        """
        key = ["unique_id", *by]
        own = F.col("sigma") * F.col("sigma")
        errors = errors.select(*key, "sigma").join(self.table.select(*SERIES), SERIES, "left_semi")
        if x is None:
            e = errors.select(*key, own.alias("e"))
        else:
            errors = settled(errors.join(x, SERIES), "deviations")
            e = errors.select(*key, (own * F.col("delta")).alias("e"))
        e = settled(e, "variances")
        parts = [self._independent(e, by)]
        if x is not None:
            at = errors.select(*key, "sigma", F.posexplode("x").alias("_t", "_x")).select(*key, "_t", (F.col("sigma") * F.col("_x")).alias("yhat"))
            parts.append(self.apply(at, [*by, "_t"]).groupBy(*key).agg(F.sum(F.col("yhat") * F.col("yhat")).alias("v")))
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total.groupBy(*key).agg(F.greatest(F.sum("v"), F.lit(0.0)).alias("v"))

    def _independent(self, e: DataFrame, by: list[str]) -> DataFrame:
        """Terms of diag(M E M'), as rows to be added up: B's own, B with C Q, and C Q's own."""
        key = ["unique_id", *by]
        if self.base == "none":
            out = e.select(*key, F.lit(0.0).alias("v"))
        elif self.base == "same":
            out = e.select(*key, F.col("e").alias("v"))
        elif self.h.is_strict:
            out = trees.variances(self.h, e.join(self.table.select(*SERIES, "w"), SERIES).select(*key, "w", "e"), by)
        else:
            raise NotImplementedError("Variances of crossed structures come from their map.")
        if not self.times:
            return out
        table = self.table.select(*SERIES, "c", "q")
        both = e.join(table, SERIES)
        if self.base != "none":
            at = both.select(*key, F.posexplode("q").alias("_t", "_q"), "e").select(*key, "_t", (F.col("e") * F.col("_q")).alias("yhat"))
            mixed = self._base(at, [*by, "_t"]).join(table.select(*SERIES, "c"), SERIES)
            out = out.unionByName(mixed.groupBy(*key).agg(F.sum(-2 * F.col("yhat") * F.get("c", F.col("_t"))).alias("v")))
        name = F.to_json(F.struct(*by))
        n = gram(both.withColumn("_by", name), "_by", F.transform("q", lambda v: v * F.col("e")), F.col("q"))
        n = settled(packed(packed(n, ["_by", "i"], "j", row=F.col("x")), ["_by"], "i", n=F.col("row")), "systems")
        own = with_few(both.withColumn("_by", name), n, ["_by"], n.count() * self.times**2)
        return out.unionByName(own.select(*key, dot("c", F.transform("n", lambda row: dot(row, "c"))).alias("v")))


def from_weights(h: Hierarchy, weights: DataFrame, models: list[str]) -> Projection:
    """The least weighted change with diagonal weights (unique_id, w, and model if they differ by model)."""
    if "model" not in weights.columns:
        weights = weights.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    table, told = observed(weights.select(*SERIES, "w"), "weights", bad=F.count_if(F.col("w").isNull() | F.isnan("w") | (F.col("w") <= 0)))
    if told["bad"]:
        raise ValueError(f"{told['bad']} weights are missing or not positive; variances must be above 0.")
    return Projection(h, table, "solved")


def factor(fitted: DataFrame, method: str, ridge: float) -> tuple[DataFrame, dict[str, float]]:
    """(model, unique_id, var, total, f) and each model's lambda: the errors' covariance is f f' off the diagonal, and total on it.

    f: the centred errors, scaled, by time. Only for errors without gaps.
    """
    if method not in ("mint_cov", "mint_shrink", "full", "shrink"):
        raise ValueError(f"Unknown covariance type: {method}")
    c, told = observed(C.centred(C.errors(fitted)), "errors", least=F.min("T"), series=F.approx_count_distinct("unique_id"))
    if (told["least"] or 0) < 2:
        raise ValueError(f"Some series have {told['least'] or 0} errors in sample; a covariance needs at least 2.")
    if method == "full" and told["series"] > told["least"]:
        warnings.warn(f"About {told['series']} series have {told['least']} errors in sample: their full covariance is not positive definite; shrink is more stable.", stacklevel=3)
    lam = {r.model: r.lam for r in C.shrinkage(c).collect()} if method in ("mint_shrink", "shrink") else {}
    models = [r[0] for r in c.select("model").distinct().collect()]
    share = F.create_map(*(F.lit(x) for m in models for x in (m, float(np.sqrt(1.0 - lam.get(m, 0.0))))))
    rows = packed(c, [*SERIES, "var", "T"], "ds", c=F.col("c"))
    rows = rows.withColumn("_s", F.element_at(share, F.col("model")) / F.sqrt(F.col("T") - 1)).select(*SERIES, "var", F.transform("c", lambda v: v * F.col("_s")).alias("f"))
    total = F.greatest("var", F.lit(ridge)) if method in ("mint_shrink", "shrink") else F.col("var")
    return settled(rows.withColumn("total", total), "factors"), lam


def correlation(f: DataFrame) -> DataFrame:
    """(model, unique_id, x, delta) from ``factor``'s rows: correlations are x x' off the diagonal, and 1 on it."""
    s = F.greatest(F.sqrt("total"), F.lit(1e-8))
    rows = f.withColumn("_s", s).select(*SERIES, F.transform("f", lambda v: v / F.col("_s")).alias("x"))
    return settled(rows.withColumn("delta", 1 - dot("x", "x")), "correlations")


def from_errors(h: Hierarchy, fitted: DataFrame, method: str, ridge: float = C.RIDGE) -> list[Projection]:
    """mint_cov and mint_shrink of errors without gaps: a map of the models that are shrunk, and one of the others."""
    f, lam = factor(fitted, method, ridge)
    times = f.select(F.max(F.size("f"))).first()[0]
    whole = [m for m, x in lam.items() if x > 0.0]
    out = [_shrunk(h, f.where(F.col("model").isin(whole)), times)] if whole else []
    rest = f if not lam else f.where(~F.col("model").isin(whole))
    return [*out, _unshrunk(h, rest, times, method)] if len(whole) < len(lam) or not lam else out


def _shrunk(h: Hierarchy, f: DataFrame, times: int) -> Projection:
    # The covariance is diag(w) + f f'. By the matrix inversion lemma the map is B - C Q with C = B f,
    # G = f - C, and Q the solution of (I + G'G / w) Q = G' / w.
    rows = settled(f.select(*SERIES, (F.col("total") - dot("f", "f")).alias("w"), "f"), "weights")
    at = rows.select("unique_id", "model", "w", F.posexplode("f").alias("t", "yhat"))
    columns = packed(diagonal(h, at, ["model", "t"]), SERIES, "t", c=F.col("yhat"))
    both = rows.join(columns, SERIES).withColumn("g", F.zip_with("f", "c", lambda x, y: x - y))
    both = settled(both, "columns")
    cells = gram(both, "model", F.transform("g", lambda v: v / F.col("w")), F.col("g")).collect()  # times x times for each model
    return Projection(h, _with_q(both, _inverses(cells, times, 1.0), F.transform("g", lambda v: v / F.col("w")), "c"), "solved", times)


def _inverses(cells: list, times: int, diagonal_: float) -> dict[str, np.ndarray]:
    systems: dict[str, np.ndarray] = {}
    for r in cells:
        systems.setdefault(r.model, np.eye(times) * diagonal_)[r.i, r.j] += r.x
    return {m: np.linalg.pinv((a + a.T) / 2, hermitian=True) if not diagonal_ else np.linalg.inv(a) for m, a in systems.items()}


def _with_q(rows: DataFrame, systems: dict[str, np.ndarray], g, c: str) -> DataFrame:
    """model, unique_id, w, c, q: q is the model's matrix times g."""
    spark = rows.sparkSession
    few = spark.createDataFrame([(m, a.tolist()) for m, a in systems.items()], "model string, a array<array<double>>")
    size = sum(a.size for a in systems.values())
    q = F.transform("a", lambda row: dot(row, "_g"))
    return settled(with_few(rows.withColumn("_g", g), few, ["model"], size).select(*SERIES, "w", F.col(c).alias("c"), q.alias("q")), "projection")


def _unshrunk(h: Hierarchy, f: DataFrame, times: int, method: str) -> Projection:
    # The covariance is f f': the smallest change within the span of f that makes values coherent.
    n_aggregates = h.nodes.where("NOT is_bottom").count()
    if n_aggregates > times - 1:
        raise ValueError(f"min_trace ({method}) is ill-conditioned: {n_aggregates} aggregates, {times} times in sample. Use another reconciliation method.")
    at = f.select("unique_id", "model", F.posexplode("f").alias("t", "yhat"))
    aggregates = h.nodes.where("NOT is_bottom").select("unique_id")
    u = packed(coherence_residual(h, at, ["model", "t"]).join(aggregates, "unique_id", "left_semi"), SERIES, "t", u=F.col("residual")).collect()  # fewer rows than times
    out = []
    for model in dict.fromkeys(r.model for r in u):
        own = [r for r in u if r.model == model]
        m = np.array([r.u for r in own])
        if np.linalg.matrix_rank(m) < len(own):
            raise ValueError(f"min_trace ({method}) is ill-conditioned. Use another reconciliation method.")
        inverse = np.linalg.pinv(m)
        out += [(model, r.unique_id, inverse[:, k].tolist()) for k, r in enumerate(own)]
    q = h.spark.createDataFrame(out, "model string, unique_id string, q array<double>")
    below = h.summing.join(q.select("model", "unique_id", F.posexplode("q").alias("t", "_q")), "unique_id").groupBy("model", F.col("bottom_id").alias("unique_id"), "t").agg(F.sum(-F.col("weight") * F.col("_q")).alias("_q"))
    every = q.unionByName(packed(below, SERIES, "t", q=F.col("_q")))
    return Projection(h, settled(f.join(every, SERIES).select(*SERIES, F.lit(0.0).alias("w"), F.col("f").alias("c"), "q"), "projection"), "same", times)


def learned(h: Hierarchy, bottom: DataFrame, fitted: DataFrame) -> Projection:
    """Bottom values (model, unique_id, t, b) as learned from the fitted forecasts (model, unique_id, t, x) at the same times, and summed.

    The map is the bottom values times the pseudo-inverse of the fitted forecasts.
    """
    x = settled(packed(fitted, SERIES, "t", g=F.col("x")), "fitted")
    times = x.select(F.max(F.size("g"))).first()[0]
    systems = _inverses(gram(x, "model", F.col("g"), F.col("g")).collect(), times, 0.0)  # times x times for each model
    values = summed(h, bottom.select("unique_id", "model", "t", F.col("b").alias("yhat")), ["model", "t"])
    sums = packed(values, SERIES, "t", c=-F.col("yhat"))
    return Projection(h, _with_q(x.join(sums, SERIES).withColumn("w", F.lit(0.0)), systems, F.col("g"), "c"), "none", times)
