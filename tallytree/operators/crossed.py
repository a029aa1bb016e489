"""Diagonal weights on structures that are not trees: conjugate gradients on the constraints.

The change that makes values coherent is W U lam, with U'WU lam the values' residuals. Products with
U'WU are a join and a sum down to the bottom series and up again. Levels of the structure that form a tree
are solved exactly in every round as a preconditioner; the other aggregates are divided by
their own diagonal. All columns of ``by`` are solved at once, each by its own steps. Every round
is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.arrays import with_few
from tallytree.hierarchy import Hierarchy
from tallytree.operators.reconcile import coherence_residual
from tallytree.operators.trees import solved
from tallytree.session import dropped, settled


def constrained(h: Hierarchy, weighted: DataFrame, by: list[str], tolerance: float = 1e-10, rounds: int = 200) -> DataFrame:
    """unique_id, by, yhat: the coherent values next to weighted (unique_id, by, yhat, w) by weights 1 / w.

    Raises ValueError if some column's residual is not ``tolerance`` times its first one after ``rounds``.
    """
    key = ["unique_id", *by]
    weighted = settled(weighted.select(*key, "yhat", "w"), "weighted")
    n_by = weighted.select(*by).distinct().count()
    aggregates = h.nodes.where("NOT is_bottom").select("unique_id")
    rows = h.summing.join(aggregates, "unique_id", "left_semi")
    bottom = weighted.join(h.nodes.where("is_bottom").select("unique_id"), "unique_id", "left_semi").select(F.col("unique_id").alias("bottom_id"), *by, F.col("w").alias("wb"))
    own = rows.join(bottom, "bottom_id").groupBy(*key).agg(F.sum(F.col("weight") * F.col("weight") * F.col("wb")).alias("own"))
    residual = coherence_residual(h, weighted, by).join(own, key).join(weighted.select(*key, "w"), key)
    start = residual.select(*key, "w", (F.col("own") + F.col("w")).alias("kii"), F.lit(0.0).alias("lam"), F.col("residual").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("old"))
    chain = h.chain
    chained = chain.nodes.where("NOT is_bottom").select("unique_id") if len(chain.levels) > 1 else None
    leaves = bottom.select(F.col("bottom_id").alias("unique_id"), *by, F.lit(0.0).alias("yhat"), F.col("wb").alias("w"))

    def conditioned(state: DataFrame) -> DataFrame:
        """state with z: the tree's solution of its residuals, or the residual by its own diagonal."""
        if chained is None:
            return state.withColumn("z", F.col("r") / F.col("kii"))
        values = state.join(chained, "unique_id", "left_semi").select(*key, F.col("r").alias("yhat"), "w").unionByName(leaves)
        x = solved(chain, values, by).withColumnRenamed("yhat", "_x").join(chained, "unique_id", "left_semi")
        z = F.when(F.col("_x").isNull(), F.col("r") / F.col("kii")).otherwise((F.col("r") - F.col("_x")) / F.col("w"))
        return state.join(x, key, "left").withColumn("z", z).drop("_x")

    def times(state: DataFrame) -> DataFrame:
        down = rows.join(state.select(*key, "p"), "unique_id").groupBy("bottom_id", *by).agg(F.sum(F.col("weight") * F.col("p")).alias("d"))
        up = rows.join(down.join(bottom, ["bottom_id", *by]), "bottom_id").groupBy(*key).agg(F.sum(F.col("weight") * F.col("wb") * F.col("d")).alias("u"))
        return state.join(up, key).withColumn("Kp", F.col("u") + F.col("w") * F.col("p")).drop("u")

    def summed_by(df: DataFrame, **sums) -> DataFrame:
        return with_few(df, df.groupBy(*by).agg(*(F.sum(v).alias(k) for k, v in sums.items())), by, n_by)

    def directed(state: DataFrame) -> DataFrame:
        """The next direction of search, and r'z of each column."""
        z = summed_by(conditioned(state), rz=F.col("r") * F.col("z"))
        step = F.coalesce(F.try_divide("rz", "old"), F.lit(0.0))
        return z.select(*key, "w", "kii", "lam", "r", (F.col("z") + step * F.col("p")).alias("p"), F.col("rz").alias("old"))

    first = settled(start, "residuals")
    scale = settled(first.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("scale")), "scales")
    state = settled(directed(first), "gradients")
    for _ in range(rounds):
        left = state.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr")).join(scale, by).where(F.col("rr") > F.col("scale") * tolerance**2)
        if left.isEmpty():
            break
        s = summed_by(times(state), pKp=F.col("p") * F.col("Kp"))
        a = F.coalesce(F.try_divide("old", "pKp"), F.lit(0.0))
        s = s.select(*key, "w", "kii", (F.col("lam") + a * F.col("p")).alias("lam"), (F.col("r") - a * F.col("Kp")).alias("r"), "p", "old")
        stepped = settled(s, "steps")
        after = settled(directed(stepped), "gradients")
        dropped(state, stepped)
        state = after
    else:
        raise ValueError(f"Conjugate gradients have not converged in {rounds} rounds; the weights may be ill-conditioned.")
    lam = state.select(*key, "lam")
    spread = rows.join(lam, "unique_id").groupBy(F.col("bottom_id").alias("unique_id"), *by).agg(F.sum(F.col("weight") * F.col("lam")).alias("g"))
    change = lam.select(*key, (-F.col("lam")).alias("g")).unionByName(spread)
    return weighted.join(change, key).select(*key, (F.col("yhat") + F.col("w") * F.col("g")).alias("yhat"))
