"""Sparse projections to the bottom series: accelerated proximal gradient on the rows of coefficients.

The coefficients minimise half the squared distance of the summed projections of the fitted forecasts
from the values, plus the sum of their sizes times a strength. A bottom series' row of coefficients
enters only by what it makes of the fitted forecasts, a vector over the few times that are used. One round
sums those vectors to all nodes, sums the distances back down, and solves for every row by itself
the small lasso that is left, on the forecasts that its conditions admit (all others are screened out
by one product). At most as many coefficients of a row as there are times are not zero.

The steps are those of Beck and Teboulle, with a restart where the direction turns. The fitted forecasts, series
by times, go to every task, so their cells are bounded; the coefficients are rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.hierarchy import Hierarchy
from tallytree.session import dropped, settled

SERIES = ["model", "unique_id"]
MOST_CELLS = 8_000_000


def row_lasso(p: np.ndarray, x: np.ndarray, strength: float, beta: dict[int, float], tolerance: float = 1e-11) -> dict[int, float]:
    """The beta that minimises |p - x'beta|^2 / 2 + strength |beta|_1, from a first guess; x: series by times.

    Coordinate descent on an active set, to which the series that break their conditions most are added.
    """
    norms = np.einsum("ij,ij->i", x, x)
    left = p - sum((v * x[j] for j, v in beta.items()), np.zeros(len(p)))
    beta = dict(beta)
    scale = max(float(np.abs(p).max(initial=0.0)), 1e-300)
    for _ in range(10_000):
        for _ in range(10_000):
            most = 0.0
            for j in list(beta):
                pull = beta[j] + float(x[j] @ left) / norms[j]
                new = float(np.sign(pull) * max(abs(pull) - strength / norms[j], 0.0))
                if new != beta[j]:
                    left = left - (new - beta[j]) * x[j]
                    most = max(most, abs(new - beta[j]) * norms[j] ** 0.5)
                    beta[j] = new
            if most <= tolerance * scale:
                break
        beta = {j: v for j, v in beta.items() if v}
        over = np.abs(x @ left) - strength
        over[norms < 1e-8] = -np.inf
        worst = [int(j) for j in np.argsort(-over)[:8] if over[j] > 1e-9 * max(strength, scale * norms[j] ** 0.5) and j not in beta]
        if not worst:
            return beta
        beta |= dict.fromkeys(worst, 0.0)
    raise ValueError("The lasso of a row has not converged.")


def coefficients(h: Hierarchy, x: DataFrame, z: DataFrame, lam: float | None, n_times: int, tolerance: float = 1e-9, rounds: int = 5000) -> DataFrame:
    """(model, unique_id, j, x): coefficients of the bottom series unique_id that are not zero; j: the place of a series in level order.

    x, z: (model, unique_id, x) and (model, unique_id, z), arrays of fitted forecasts and of what they should sum to. lam: the
    strength by cell of z; None: the largest slope at zero, which leaves no coefficients.
    """
    at = h.places
    n = at.count()
    if n * n_times > MOST_CELLS:
        raise ValueError(f"The lasso needs {n} x {n_times} fitted forecasts in every task; at most {MOST_CELLS} are allowed. Use another method.")
    fit: dict[str, np.ndarray] = {}
    for r in x.join(at, "unique_id").toLocalIterator():
        fit.setdefault(r.model, np.zeros((n, n_times)))[r.place] = r.x
    bottom = h.nodes.where("is_bottom").select("unique_id")
    sizes = h.summing.groupBy("unique_id").agg(F.sum(F.abs("weight")).alias("s"))
    step = h.summing.join(sizes, "unique_id").groupBy("bottom_id").agg(F.sum(F.abs("weight") * F.col("s")).alias("l")).agg(F.max("l")).first()[0]
    z = settled(z, "targets")
    zero = F.array_repeat(F.lit(0.0), n_times)
    models = F.explode(F.array(*map(F.lit, fit))).alias("model")
    state = bottom.select("unique_id", models, zero.alias("y"), zero.alias("c"), F.expr("cast(array() as array<int>)").alias("j"), F.expr("cast(array() as array<double>)").alias("b"))
    strength = _largest(h, z, fit, n_times) if lam is None else {m: lam for m in fit}
    strength = {m: v * n * n_times / step for m, v in strength.items()}
    state, k = settled(state, "coefficients"), 1.0
    for _ in range(rounds):
        pulled = state.join(_slopes(h, z, state, n_times), SERIES)
        after = 0.5 + (0.25 + k * k) ** 0.5
        new = settled(pulled.mapInArrow(_rows(fit, strength, step, (k - 1) / after), "model string, unique_id string, y array<double>, c array<double>, j array<int>, b array<double>, moved double, size double, turn double"), "coefficients")
        told = new.agg(F.max("moved"), F.max("size"), F.sum("turn")).first()
        dropped(state)
        state = new.drop("moved", "size", "turn")
        if told[0] <= tolerance * max(told[1], 1e-300):
            return state.select(*SERIES, F.explode(F.arrays_zip("j", "b")).alias("_c")).select(*SERIES, "_c.j", F.col("_c.b").alias("x"))
        if told[2] > 0:  # the direction has turned: start the acceleration anew
            state, k = state.withColumn("y", F.col("c")), 1.0
        else:
            k = after
    raise ValueError(f"The lasso has not converged in {rounds} rounds.")


def _slopes(h: Hierarchy, z: DataFrame, state: DataFrame, n_times: int) -> DataFrame:
    """(model, unique_id, s): for each bottom series the sum of what is left at the nodes that it is part of."""
    sums = lambda df, key, value: df.groupBy("model", F.col(key).alias("unique_id")).agg(*(F.sum(F.col("weight") * F.get(value, F.lit(t))).alias(f"_{t}") for t in range(n_times)))
    array = F.array(*(f"_{t}" for t in range(n_times)))
    up = sums(h.summing.join(state.select("model", F.col("unique_id").alias("bottom_id"), "y"), "bottom_id"), "unique_id", "y").select(*SERIES, array.alias("_y"))
    left = z.join(up, SERIES).select(*SERIES, F.zip_with("z", "_y", lambda a, b: a - b).alias("r"))
    return sums(h.summing.join(left, "unique_id"), "bottom_id", "r").select(*SERIES, array.alias("s"))


def _largest(h: Hierarchy, z: DataFrame, fit: dict[str, np.ndarray], n_times: int) -> dict[str, float]:
    """The largest slope at zero of each model."""
    none = h.nodes.where("is_bottom").select("unique_id", F.explode(F.array(*map(F.lit, fit))).alias("model"), F.array_repeat(F.lit(0.0), n_times).alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            most = [float(np.abs(fit[r["model"]] @ np.array(r["s"])).max()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["model"] for r in rows], pa.string()), pa.array(most, pa.float64())], names=["model", "most"])

    found = _slopes(h, z, none, n_times).select("model", "s").mapInArrow(work, "model string, most double")
    return {r.model: r.most for r in found.groupBy("model").agg(F.max("most").alias("most")).collect()}


def _rows(fit: dict[str, np.ndarray], strength: dict[str, float], step: float, momentum: float):
    names = ["model", "unique_id", "y", "c", "j", "b", "moved", "size", "turn"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x, y, c = fit[r["model"]], np.array(r["y"]), np.array(r["c"])
                beta = row_lasso(y + np.array(r["s"]) / step, x, strength[r["model"]], dict(zip(r["j"], r["b"], strict=True)))
                j = sorted(beta)
                new = np.array([beta[i] for i in j]) @ x[j] if j else np.zeros_like(c)
                turn = float((y - new) @ (new - c))
                out.append((r["model"], r["unique_id"], new + momentum * (new - c), new, j, [beta[i] for i in j], float(np.abs(new - y).max()), float(np.abs(new).max()), turn))
            kinds = [pa.string(), pa.string(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.int32()), pa.list_(pa.float64()), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=names)

    return work

