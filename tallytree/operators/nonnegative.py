"""Coherent values without negative ones, next to forecasts by least squares: block principal pivoting.

The bottom series are split into those held at zero and the free ones. One round solves for the free ones
with an exact solution of the structure (a held series has weight and value zero), and gets the slope
of the sum of squares at the held ones. Free series below zero and held ones with a negative slope
change sides; all at once as long as their number falls, the last one alone otherwise, which ends
in finitely many rounds. Each column of ``by`` has its own sides. What comes out meets the
optimality conditions to a relative 1e-9, or an error is raised.

Weights are a diagonal, or a diagonal plus a factor with a column for each time in sample; the factor's
columns are solved with the same sides, and a system of the history's size for each column of ``by``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.arrays import dot, gram, packed, with_few
from tallytree.hierarchy import Hierarchy
from tallytree.operators.dense import nnls
from tallytree.operators.projection import SERIES, diagonal
from tallytree.operators.reconcile import summed
from tallytree.session import dropped, settled

TOLERANCE = 1e-9
#: How often all series may change sides without a fall in their number.
PATIENCE = 3


def least_squares(h: Hierarchy, weighted: DataFrame, by: list[str], factor: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """unique_id, by, yhat >= 0 next to weighted (unique_id, by, yhat, w); factor: (model, unique_id, f).

    Values below zero count as zero. The weights' inverse is diag(w), or diag(w) + f f'.
    """
    key = ["unique_id", *by]
    y = weighted.select(*key, F.greatest("yhat", F.lit(0.0)).alias("y"), "w")
    y = settled(y if factor is None else y.join(factor.select(*SERIES, "f"), SERIES), "forecasts")
    # What counts as zero, for values and for slopes of each column.
    scale = y.groupBy(*by).agg((F.max("y") * TOLERANCE).alias("tx"), (F.max(F.col("y") / F.col("w")) * len(h.levels) * TOLERANCE).alias("ts"), F.lit(1 << 62).alias("fewest"), F.lit(PATIENCE).alias("patience"))
    progress = settled(scale, "progress")
    n_by = progress.count()
    times = 0 if factor is None else y.select(F.max(F.size("f"))).first()[0] or 0
    bottom = h.nodes.where("is_bottom").select("unique_id", "pos")
    held = None
    for _ in range(rounds):
        x = _round(h, y, held, by, n_by * times)
        told = x.join(bottom, "unique_id")
        told = with_few(told, progress, by, n_by)
        wrong = F.when(F.col("held"), F.col("slope") < -F.col("ts")).otherwise(F.col("x") < -F.col("tx"))
        told = settled(told.select(*key, "pos", "x", "held", wrong.alias("wrong")), "sides")
        if told.where("wrong").isEmpty():
            zero = F.when(F.col("held"), F.lit(0.0)).otherwise(F.greatest("x", F.lit(0.0)))
            return summed(h, told.select(*key, zero.alias("yhat")), by)
        # Columns whose number of wrong series has fallen start anew; others have some patience.
        now = told.groupBy(*by).agg(F.count_if("wrong").alias("n"), F.max(F.when(F.col("wrong"), F.col("pos"))).alias("last"))
        fell = F.col("n") < F.col("fewest")
        after = progress.join(now, by).select(*by, "tx", "ts", F.least("n", "fewest").alias("fewest"), F.when(fell, PATIENCE).otherwise(F.greatest(F.col("patience") - 1, F.lit(-1))).alias("patience"), "last")
        after = settled(after, "progress")
        changes = F.col("wrong") & ((F.col("patience") >= 0) | (F.col("pos") == F.col("last")))
        sides = with_few(told, after, by, n_by).withColumn("held", F.col("held") != changes)
        new = settled(sides.where("held").select(*key), "held")
        dropped(told, progress, *([held] if held is not None else []))
        held, progress = new, after.drop("last")
    raise ValueError(f"Non-negative values were not found in {rounds} rounds; the weights may be ill-conditioned.")


def _round(h: Hierarchy, y: DataFrame, held: DataFrame | None, by: list[str], n_cells: int) -> DataFrame:
    """unique_id, by, x, slope, held of the bottom series, where the held ones are zero."""
    key = ["unique_id", *by]
    rows = y.withColumn("held", F.lit(False)) if held is None else y.join(held.withColumn("_h", F.lit(True)), key, "left").withColumn("held", F.col("_h").isNotNull()).drop("_h")
    rows = settled(rows, "rows")
    off = lambda c: F.when(F.col("held"), F.lit(0.0)).otherwise(F.col(c))
    base = diagonal(h, rows.select(*key, off("y").alias("yhat"), off("w").alias("w")), by).withColumnRenamed("yhat", "x")
    both = rows.join(base, key)
    if "f" not in y.columns:
        pull = (F.col("x") - F.col("y")) / F.col("w")
    else:
        at = rows.select(*key, "held", off("w").alias("w"), F.posexplode("f").alias("t", "f"))
        columns = diagonal(h, at.select(*key, "t", off("f").alias("yhat"), "w"), [*by, "t"])
        both = both.join(packed(columns, key, "t", c=F.col("yhat")), key)
        both = settled(both.withColumn("g", F.zip_with("f", "c", lambda a, b: a - b)), "columns")
        name = F.to_json(F.struct(*by))
        cells = gram(both.withColumn("_by", name), "_by", F.transform("g", lambda v: v / F.col("w")), F.concat("g", F.array(F.col("y") - F.col("x"))))
        z = settled(cells.groupBy("_by").applyInPandas(_solution, "_by string, z array<double>"), "systems")
        both = with_few(both.withColumn("_by", name), z, ["_by"], n_cells).withColumn("x", F.col("x") - dot("c", "z"))
        pull = (F.col("x") - F.col("y") + dot("f", "z")) / F.col("w")
    both = settled(both.select(*key, "x", "held", pull.alias("pull")), "values")
    slope = h.summing.join(both.select(*key, "pull"), "unique_id").groupBy(F.col("bottom_id").alias("unique_id"), *by).agg(F.sum(F.col("weight") * F.col("pull")).alias("slope"))
    return both.select(*key, "x", "held").join(slope, key)


def _solution(cells: pd.DataFrame) -> pd.DataFrame:
    """(I + A) z = b of one column; its cells are as many as there are pairs of times in sample."""
    n = int(cells["i"].max()) + 1
    a = np.zeros((n, n + 1))
    a[cells["i"], cells["j"]] = cells["x"]
    z = np.linalg.solve(np.eye(n) + a[:, :n], a[:, n])
    return pd.DataFrame({"_by": [cells["_by"].iloc[0]], "z": [z]})


def least_squares_in_span(h: Hierarchy, fcst: DataFrame, by: list[str], factor: DataFrame) -> DataFrame:
    """The same where the weights' inverse is the pseudo-inverse of f f' alone, as for mint_cov.

    It has one solution only if there are fewer bottom series than times in sample, so the system of
    the bottom series is small; it is built by sums over the series and solved for each column of ``by``.
    """
    bottoms = h.nodes.where("is_bottom").select("unique_id", "pos")
    b, times = bottoms.count(), factor.select(F.max(F.size("f"))).first()[0]
    if b > times - 1:
        raise ValueError(f"min_trace (mint_cov) is ill-conditioned: {b} bottom series, {times} times in sample. Set nonnegative=False or use another reconciliation method.")
    inner: dict[str, np.ndarray] = {}
    for r in gram(factor, "model", F.col("f"), F.col("f")).collect():  # times x times for each model
        inner.setdefault(r.model, np.zeros((times, times)))[r.i, r.j] = r.x
    # pinv(f f') = h h' with h = f pinv(f'f), so the problem is that of h's columns.
    few = h.spark.createDataFrame([(m, np.linalg.pinv((a + a.T) / 2, hermitian=True).tolist()) for m, a in inner.items()], "model string, a array<array<double>>")
    rows = with_few(factor, few, ["model"], times * times * len(inner)).select(*SERIES, F.transform("a", lambda row: dot(row, "f")).alias("g"))
    rows = settled(rows, "columns")
    at = h.summing.join(rows.select(*SERIES, F.posexplode("g").alias("t", "g")), "unique_id")
    sg = at.groupBy("model", F.col("bottom_id").alias("unique_id"), "t").agg(F.sum(F.col("weight") * F.col("g")).alias("x")).join(bottoms, "unique_id").collect()  # fewer bottom series than times, by times
    order = [r.unique_id for r in bottoms.orderBy("pos").collect()]
    place = {x: k for k, x in enumerate(order)}
    systems: dict[str, np.ndarray] = {}
    for r in sg:
        systems.setdefault(r.model, np.zeros((b, times)))[place[r.unique_id], r.t] = r.x
    for model, m in systems.items():
        if np.linalg.matrix_rank(m) < b:
            raise ValueError(f"min_trace (mint_cov) is ill-conditioned for {model}. Set nonnegative=False or use another reconciliation method.")
    y = fcst.select("unique_id", *by, F.greatest("yhat", F.lit(0.0)).alias("yhat")).join(rows, SERIES)
    gy = packed(y.select(*by, "yhat", F.posexplode("g").alias("t", "g")).groupBy(*by, "t").agg(F.sum(F.col("g") * F.col("yhat")).alias("z")), by, "t", z=F.col("z"))
    model_at = by.index("model")

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = systems[key[model_at]]
        x = nnls(m @ m.T, m @ pdf["z"].iloc[0])
        out = pd.DataFrame({"unique_id": order})
        for name, value in zip(by, key, strict=True):
            out[name] = value
        return out.assign(yhat=x)[["unique_id", *by, "yhat"]]

    return summed(h, gy.groupBy(*by).applyInPandas(solve, fcst.select("unique_id", *by, F.col("yhat").cast("double")).schema), by)
