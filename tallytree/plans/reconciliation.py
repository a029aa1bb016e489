"""Reconciling wide frames: checks, the methods' plans, intervals, samples and diagnostics."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallytree.functions.naming import is_model, level_outputs, tick
from tallytree.hierarchy import Hierarchy
from tallytree.operators import intervals as I
from tallytree.operators.evaluate import diagnostics as diagnosed
from tallytree.operators.reconcile import need_strict
from tallytree.operators.reconcilers import Fitted, as_method
from tallytree.session import settled

INTERVALS = ("normality", "bootstrap", "permbu", "conformal")
#: Draws behind bootstrap and copula intervals; num_samples only sets the sample columns.
DRAWS = 200
BY = ["ds", "model"]
#: Methods whose weights correlate the errors, and how their correlation is estimated.
KINDS = {"mint_cov": "full", "mint_shrink": "shrink"}


def long_forecasts(df: DataFrame, models: list[str], id_col: str, time_col: str) -> DataFrame:
    """unique_id, ds, model, yhat from one column per model."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(tick(m)).cast("double").alias("yhat")) for m in models))).alias("c")
    return df.select(F.col(tick(id_col)).alias("unique_id"), F.col(tick(time_col)).alias("ds"), cells).select("unique_id", "ds", "c.model", "c.yhat")


def long_fitted(df: DataFrame, models: list[str], id_col: str, time_col: str, target_col: str) -> DataFrame:
    """unique_id, ds, model, y, yhat from values and fitted forecasts in sample."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(tick(m)).cast("double").alias("yhat")) for m in models))).alias("c")
    y = F.col(tick(target_col)).cast("double").alias("y")
    return df.select(F.col(tick(id_col)).alias("unique_id"), F.col(tick(time_col)).alias("ds"), y, cells).select("unique_id", "ds", "c.model", "y", "c.yhat")


class HierarchicalReconciliation:
    """Reconciles forecasts of several models by several methods.

    After ``reconcile``: execution_times (seconds of planning), level_names, sample_names and
    model_names by output column, and diagnostics if asked for.
    """

    def __init__(self, reconcilers: list):
        self.reconcilers = [as_method(r) for r in reconcilers]
        self.orig_reconcilers = list(reconcilers)
        self.insample = any(r.insample for r in self.reconcilers)
        self.fitted: dict[str, Fitted] = {}
        self.execution_times: dict[str, float] = {}
        self.level_names: dict[str, list[str]] = {}
        self.sample_names: dict[str, list[str]] = {}
        self.model_names: dict[str, str] = {}
        self.diagnostics: DataFrame | None = None

    def _checked(self, y_hat: DataFrame, h: Hierarchy, y: DataFrame | None, level: list[float] | None, method: str, id_col: str, time_col: str, target_col: str, temporal_id: str | None) -> list[str]:
        if temporal_id:
            if y is not None:
                raise NotImplementedError("Temporal reconciliation takes no values in sample.")
            if wrong := [r.name for r in self.reconcilers if r.insample]:
                raise NotImplementedError(f"Temporal reconciliation has no methods in sample: {wrong}")
            if method in ("bootstrap", "permbu"):
                raise NotImplementedError(f"Temporal reconciliation has no intervals by {method}.")
            if missing := {id_col, time_col, temporal_id} - set(y_hat.columns):
                raise ValueError(f"The forecasts lack the columns {sorted(missing)}.")
            largest = h.summing.groupBy("unique_id").agg(F.sum("weight").alias("n")).agg(F.max("n")).first()[0]
            horizon = y_hat.groupBy(tick(id_col)).agg(F.count_distinct(tick(time_col)).alias("n")).agg(F.max("n")).first()[0]
            if horizon < largest:
                raise ValueError(f"The forecast horizon ({horizon}) is shorter than the largest bucket ({largest}).")
        key = temporal_id or id_col
        if method not in INTERVALS:
            raise ValueError(f"Unknown interval method: {method}")
        if y is None:
            if wrong := [r.name for r in self.reconcilers if r.insample]:
                raise ValueError(f"Values in sample (Y_df) are needed by {wrong}.")
            if level and method in ("bootstrap", "permbu", "conformal"):
                raise ValueError(f"Values in sample (Y_df) are needed for intervals by {method}.")
        if level and method in ("normality", "permbu") and not all(0 <= x < 100 for x in level):
            raise ValueError("Levels must be in [0, 100).")
        ids = {id_col, time_col, target_col, temporal_id}
        names = [c for c in y_hat.columns if c not in ids]
        for c in names:
            if not isinstance(y_hat.schema[c].dataType, NumericType):
                raise ValueError(f"The column {c} of the forecasts is not numeric.")
        models = [c for c in names if is_model(c)]
        # One pass over the forecasts: rows per id, and nulls per model.
        counts = y_hat.groupBy(F.col(tick(key)).alias("_id")).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(tick(c)).isNull()).alias(f"_c{k}") for k, c in enumerate(names)))
        told = counts.agg(F.min("_n"), F.max("_n"), *(F.sum(f"_c{k}") for k in range(len(names)))).first()
        if told[0] != told[1] and not temporal_id:
            raise ValueError("There are missing times: all series must have the same number of forecasts.")
        if null := [c for k, c in enumerate(names) if told[2 + k]]:
            raise ValueError(f"The columns {null} of the forecasts hold nulls.")
        if y is not None and (self.insample or level) and (missing := set(models) - set(y.columns)):
            raise ValueError(f"The values in sample lack the columns {sorted(missing)}.")
        if not h.check_bottom_identity():
            raise ValueError("The bottom part of the summing matrix must be an identity matrix.")
        named = h.nodes.select(F.col("unique_id").alias("_id"))
        present = counts.select("_id")
        pairs = [("the hierarchy", "the forecasts", named, present), ("the forecasts", "the hierarchy", present, named)]
        if y is not None:
            own = y.select(F.col(tick(id_col)).alias("_id")).distinct()
            pairs += [("the values in sample", "the forecasts", own, present), ("the forecasts", "the values in sample", present, own)]
        lost = None  # all differences in one job
        for k, (_, _, left, right) in enumerate(pairs):
            one = left.join(right, "_id", "left_anti").limit(5).select(F.lit(k).alias("k"), F.col("_id").cast("string").alias("_id"))
            lost = one if lost is None else lost.union(one)
        if some := sorted(tuple(r) for r in lost.collect()):
            a, b = pairs[some[0][0]][:2]
            raise ValueError(f"There are ids in {a} that are not in {b}: {[i for k, i in some if k == some[0][0]]}")
        strict = [r.name for r in self.reconcilers if r.strict]
        if strict or (level and method == "permbu"):
            need_strict(h, strict or ["PERMBU"])
        return models

    def reconcile(
        self,
        Y_hat_df: DataFrame,
        hierarchy: Hierarchy,
        Y_df: DataFrame | None = None,
        level: list[float] | None = None,
        intervals_method: str = "normality",
        num_samples: int = -1,
        seed: int = 0,
        id_col: str = "unique_id",
        time_col: str = "ds",
        target_col: str = "y",
        id_time_col: str = "temporal_id",
        temporal: bool = False,
        diagnostics: bool = False,
        diagnostics_atol: float = 1e-6,
        seeds: list[int] | None = None,
    ) -> DataFrame:
        """Y_hat_df with columns ``<model>/<method>`` (and bounds ``-lo-L``, ``-hi-L``, and ``-sample-i``).

        seeds: rows for each of several seeds, told apart by a column ``seed``; one fit and one plan for all.
        """
        h, level = hierarchy, sorted(level) if level else None
        seed = seeds or seed
        models = self._checked(Y_hat_df, h, Y_df, level, intervals_method, id_col, time_col, target_col, id_time_col if temporal else None)
        if temporal:
            # A series' k-th bucket of each level is one column of the problem; ids are the buckets.
            wide = Y_hat_df.withColumn("_series", F.col(tick(id_col)))
            fcst = long_forecasts(wide, models, id_time_col, "_series")
        else:
            fcst = long_forecasts(Y_hat_df, models, id_col, time_col)
        fcst = settled(fcst, "forecasts")
        fitted = None if Y_df is None else settled(long_fitted(Y_df, [m for m in models if m in Y_df.columns], id_col, time_col, target_col), "fitted")
        found, names = None, []
        for r in self.reconcilers:
            began = time.time()
            made = self.fitted[r.name] = r.fit(h, fcst, fitted)
            rec = settled(made.predict(fcst, BY), "means")
            if seeds:
                rec = I.each_seed(rec, seeds)
            if level:
                rec = self._intervals(made, h, Y_hat_df, fcst, fitted, rec, models, level, intervals_method, seed, id_col, time_col)
            if num_samples > 0 and level:
                rec = self._samples(made, h, Y_hat_df, fcst, fitted, rec, models, intervals_method, num_samples, seed, id_col, time_col)
            for m in models:
                out = f"{m}/{r.name}"
                self.model_names[out] = m
                self.execution_times[out] = time.time() - began
                q = level_outputs(level)[1][1:] if level else []
                self.level_names[out] = [out + x for x in q]
                self.sample_names[out] = [f"{out}-sample-{k}" for k in range(num_samples)] if num_samples > 0 and level else []
                names.append((out, m, r.name))
            # Written once: the columns, the diagnostics and every later plan start from here.
            one = settled(rec, "reconciled").withColumn("_rec", F.lit(r.name))
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        cells = found.withColumn("_column", F.concat_ws("/", "model", "_rec"))
        more = ["seed"] if seeds else []
        wide = self._wide(cells, [n[0] for n in names], level, num_samples, more)
        if diagnostics:
            parts = [diagnosed(h, fcst, found.where(F.col("_rec") == r.name).select("unique_id", *BY, "yhat").distinct(), diagnostics_atol).withColumn("model", F.concat(F.col("model"), F.lit(f"/{r.name}"))) for r in self.reconcilers]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            self.diagnostics = every
        on = {"unique_id": id_time_col, "ds": id_col} if temporal else {"unique_id": id_col, "ds": time_col}
        return Y_hat_df.join(wide.withColumnsRenamed(on), list(on.values()), "left")

    def _wide(self, cells: DataFrame, columns: list[str], level: list[float] | None, num_samples: int, more: list[str]) -> DataFrame:
        values = [F.first("yhat").alias("mean")]
        if level:
            values.append(F.first("q").alias("q"))
        if level and num_samples > 0:
            values.append(F.first("samples").alias("samples"))
        packed = cells.groupBy("unique_id", "ds", *more).pivot("_column", columns).agg(F.struct(*values)) if len(values) > 1 else cells.groupBy("unique_id", "ds", *more).pivot("_column", columns).agg(values[0])
        if len(values) == 1:
            return packed
        out = [F.col(c) for c in ("unique_id", "ds", *more)]
        for c in columns:
            out.append(F.col(f"{tick(c)}.mean").alias(c))
            # q ascends: bounds from the widest lower one to the widest upper one.
            out += [F.col(f"{tick(c)}.q")[k].alias(c + n) for k, n in enumerate(level_outputs(level)[1][1:])]
            if num_samples > 0:
                out += [F.col(f"{tick(c)}.samples")[k].alias(f"{c}-sample-{k}") for k in range(num_samples)]
        return packed.select(*out)

    def _sigma(self, wide: DataFrame, models: list[str], id_col: str, time_col: str) -> DataFrame:
        """unique_id, ds, model, sigma from the models' own bounds."""
        structs = []
        for m in models:
            found = {}
            for c in wide.columns:
                if match := re.fullmatch(rf"{re.escape(m)}-(lo|hi)-(\d+(?:\.\d+)?)", c):
                    found.setdefault(float(match[2]), {})[match[1]] = F.col(tick(c))
            pairs = [(x, b["lo"], b["hi"]) for x, b in sorted(found.items()) if len(b) == 2]
            structs.append(F.struct(F.lit(m).alias("model"), I.sigma_from_bounds(pairs).alias("sigma")))
        return wide.select(F.col(tick(id_col)).alias("unique_id"), F.col(tick(time_col)).alias("ds"), F.explode(F.array(*structs)).alias("s")).select("unique_id", "ds", "s.*")

    def _intervals(self, made, h, wide, fcst, fitted, rec, models, level, method, seed, id_col, time_col) -> DataFrame:
        r, qs, by = made.method, I.interval_quantiles(level), [*BY, *I.seeded(seed)[1]]
        mean = rec.select("unique_id", *BY, "yhat").distinct()
        if method == "conformal":
            return I.conformal(h, made, rec, fitted, qs)
        if method == "bootstrap":
            if not r.linear and getattr(r, "nonnegative", False):
                raise ValueError("Non-negative methods have no bootstrap intervals.")
            samples = I.bootstrap_samples(h, made, fcst, fitted, DRAWS, seed)
            return rec.join(I.quantiles_of(samples, qs, by), ["unique_id", *by])
        if not r.linear:
            raise ValueError(f"{r.name} has no intervals by {method}.")
        sigma = self._sigma(wide, models, id_col, time_col)
        if method == "permbu":
            samples = I.permbu_samples(h, mean, sigma, fitted, DRAWS, seed)
            return rec.join(I.quantiles_of(samples, qs, by), ["unique_id", *by])
        kind = KINDS.get(getattr(r, "method", ""))
        return I.normal_quantiles(I.normality(h, made, rec, sigma, fitted, kind), qs).drop("sigma")

    def _samples(self, made, h, wide, fcst, fitted, rec, models, method, n, seed, id_col, time_col) -> DataFrame:
        mean, by = rec.select("unique_id", *BY, "yhat").distinct(), [*BY, *I.seeded(seed)[1]]
        if method == "conformal":
            s = I.conformal_samples(h, made, mean, fitted, n, seed)
        elif method == "bootstrap":
            s = I.bootstrap_samples(h, made, fcst, fitted, n, seed)
        else:
            sigma = self._sigma(wide, models, id_col, time_col)
            s = I.permbu_samples(h, mean, sigma, fitted, n, seed) if method == "permbu" else made.sample(fcst, sigma, n, seed, KINDS.get(getattr(made.method, "method", "")))
        packed = s.groupBy("unique_id", *by).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "yhat"))), lambda x: x["yhat"]).alias("samples"))
        return rec.join(packed, ["unique_id", *by])

    def bootstrap_reconcile(self, Y_hat_df: DataFrame, hierarchy: Hierarchy, Y_df: DataFrame, num_seeds: int = 1, **more: object) -> DataFrame:
        """``reconcile`` for the seeds 0, 1, ..., with a column ``seed``: fitted once, drawn together."""
        return self.reconcile(Y_hat_df, hierarchy, Y_df, seeds=list(range(num_seeds)), **more)


class CodeTimer:
    """Prints how long its block took."""

    def __init__(self, name: str | None = None, verbose: bool = True, tell: Callable[[str], None] = print):
        self.name, self.verbose, self.tell = f" '{name}'" if name else "", verbose, tell

    def __enter__(self) -> CodeTimer:
        self.start = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.took = time.perf_counter() - self.start
        if self.verbose:
            self.tell(f"Code block{self.name} took:\t{self.took:.5f} seconds")



__all__ = ["CodeTimer", "HierarchicalReconciliation", "long_fitted", "long_forecasts"]
