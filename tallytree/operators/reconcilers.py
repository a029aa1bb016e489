"""Reconciliation methods as objects: a name, what they need, and how they map forecasts.

``fit`` writes what a method has learned; what it returns maps any values without another fit.
Own classes need ``fit_predict`` alone: it gets what its arguments name (see ``Own``).
"""

from __future__ import annotations

import inspect
import warnings
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallytree.functions.naming import method_name
from tallytree.hierarchy import Hierarchy
from tallytree.operators import learned, mintrace, nonnegative, projection
from tallytree.operators import reconcile as R
from tallytree.operators.projection import Projection, diagonal
from tallytree.session import settled

#: Up to this many series the map of a method may be written out as rows (series x series).
MOST_MAPPED = 2000
BY = ["ds", "model"]


def models_of(fcst: DataFrame) -> list[str]:
    return [r[0] for r in fcst.select("model").distinct().collect()]


class Method:
    """insample: needs values and fitted forecasts. strict: needs a tree. linear: a fixed map of the forecasts."""

    insample = False
    strict = False
    linear = True
    kind = ""
    hidden = ("num_threads", "vec_order", "qp")

    @property
    def name(self) -> str:
        shown = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in self.hidden} if is_dataclass(self) else {}
        if shown.get("mint_shr_ridge") == 2e-8 or shown.get("method") != "mint_shrink":
            shown.pop("mint_shr_ridge", None)
        return method_name(self.kind or type(self).__name__, shown)

    def maps(self, h: Hierarchy, fcst: DataFrame, fitted: DataFrame | None) -> list[Projection] | None:
        """The method as written maps, each of some models; None if it is no such map."""
        return None

    def fit(self, h: Hierarchy, fcst: DataFrame, fitted: DataFrame | None = None) -> Fitted:
        """What the method learns for the models (and the horizon) of the forecasts."""
        return Fitted(self, h, self.maps(h, fcst, fitted), fitted)

    def mean(self, h: Hierarchy, fcst: DataFrame, fitted: DataFrame | None, by: list[str]) -> DataFrame:
        return self.fit(h, fcst, fitted).predict(fcst, by)


@dataclass(frozen=True)
class Fitted:
    """A method that has been fitted: ``predict`` and ``sample`` start no other fit."""

    method: Method
    h: Hierarchy
    maps: list[Projection] | None
    fitted: DataFrame | None

    def predict(self, values: DataFrame, by: list[str] = BY) -> DataFrame:
        """Coherent values (unique_id, by, yhat) from values of the models that were fitted."""
        if self.maps is None:
            return self.method.mean(self.h, values, self.fitted, by)
        out = self.maps[0].apply(values, by)
        for m in self.maps[1:]:
            out = out.unionByName(m.apply(values, by))
        return out

    def sample(self, fcst: DataFrame, sigma: DataFrame, n: int, seed: int = 0, correlation: str | None = None) -> DataFrame:
        """n coherent Gaussian draws: unique_id, ds, model, sample_id, yhat (see ``normal_samples``)."""
        from tallytree.operators.intervals import normal_samples

        return normal_samples(self.h, self, fcst, sigma, self.fitted, n, seed, correlation)

    def variance(self, errors: DataFrame, by: list[str], x: DataFrame | None = None) -> DataFrame:
        """unique_id, by, v: variances of mapped values, by the written maps alone."""
        out = self.maps[0].variance(errors, by, x)
        for m in self.maps[1:]:
            out = out.unionByName(m.variance(errors, by, x))
        return out


def as_fitted(method: Method | Fitted, h: Hierarchy, fcst: DataFrame, fitted: DataFrame | None) -> Fitted:
    return method if isinstance(method, Fitted) else method.fit(h, fcst, fitted)


class Own(Method):
    """A user's class with ``fit_predict``, which gets by name what it asks for and returns unique_id, by and yhat.

    Known names: hierarchy, forecasts (unique_id, ds, model, yhat), insample (unique_id, ds, model, y,
    yhat), by, summing and tags (rows of the summing matrix and of the levels). Attributes insample, strict
    and linear count if the class has them; a class with ``predict`` too maps other values with it.
    """

    def __init__(self, user: object):
        self.user = user
        self.insample = getattr(user, "insample", False)
        self.strict = getattr(user, "is_strictly_hierarchical", getattr(user, "strict", False))
        self.linear = getattr(user, "linear", False)

    @property
    def name(self) -> str:
        if is_dataclass(self.user):
            return method_name(type(self.user).__name__, {f.name: getattr(self.user, f.name) for f in fields(self.user)})
        return type(self.user).__name__

    def mean(self, h, fcst, fitted, by):
        known = {"hierarchy": h, "forecasts": fcst, "insample": fitted, "by": by, "summing": h.summing, "tags": h.nodes}
        wanted = inspect.signature(self.user.fit_predict).parameters
        missing = [n for n, p in wanted.items() if n not in known and p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)]
        if missing:
            raise ValueError(f"{type(self.user).__name__}.fit_predict asks for {missing}; known are {sorted(known)}.")
        return self.user.fit_predict(**{n: known[n] for n in wanted if n in known}).select("unique_id", *by, "yhat")


def as_method(method: object) -> Method:
    if isinstance(method, Method):
        return method
    if not callable(getattr(method, "fit_predict", None)):
        raise ValueError(f"{type(method).__name__} is no reconciliation method: it lacks fit_predict.")
    return Own(method)


@dataclass
class BottomUp(Method):
    def mean(self, h, fcst, fitted, by):
        return R.bottom_up(h, fcst, by)


class BottomUpSparse(BottomUp):
    pass


@dataclass
class TopDown(Method):
    method: str = "forecast_proportions"
    strict = True
    sparse = False

    def __post_init__(self):
        self.insample = self.method != "forecast_proportions"
        self.linear = self.insample

    def mean(self, h, fcst, fitted, by):
        y = None if fitted is None else fitted.groupBy("unique_id", "ds").agg(F.max("y").alias("y"))
        return R.top_down(h, fcst, by, self.method, y, self.sparse)


class TopDownSparse(TopDown):
    sparse = True


@dataclass
class MiddleOut(Method):
    middle_level: str = ""
    top_down_method: str = "forecast_proportions"
    strict = True
    sparse = False
    linear = False

    def __post_init__(self):
        self.insample = self.top_down_method != "forecast_proportions"

    def mean(self, h, fcst, fitted, by):
        y = None if fitted is None else fitted.groupBy("unique_id", "ds").agg(F.max("y").alias("y"))
        return R.middle_out(h, fcst, by, self.middle_level, self.top_down_method, y, self.sparse)


class MiddleOutSparse(MiddleOut):
    sparse = True


@dataclass
class MinTrace(Method):
    method: str = "ols"
    nonnegative: bool = False
    mint_shr_ridge: float = 2e-8
    num_threads: int = 1
    METHODS = ("ols", "wls_struct", "wls_var", "mint_cov", "mint_shrink", "emint")

    def __post_init__(self):
        if self.method not in self.METHODS:
            raise ValueError(f"Unknown reconciliation method {self.method}; known are {list(self.METHODS)}")
        self.insample = self.method in ("wls_var", "mint_cov", "mint_shrink", "emint")
        self.linear = not self.nonnegative

    def weights(self, h: Hierarchy, fitted: DataFrame | None) -> DataFrame:
        if self.method in ("ols", "emint"):
            return mintrace.identity(h)
        if self.method == "wls_struct":
            return mintrace.structural(h)
        if fitted is None:
            raise ValueError(f"The method {self.method} needs values in sample.")
        mintrace.guard(fitted)
        return mintrace.error_variance(fitted)

    def maps(self, h, fcst, fitted):
        if self.nonnegative:
            return None
        if self.method == "emint":
            return [learned.emint(h, fitted)]
        if self.method in ("mint_cov", "mint_shrink"):
            return projection.from_errors(h, fitted, self.method, self.mint_shr_ridge)
        return [projection.from_weights(h, self.weights(h, fitted), models_of(fcst))]

    def mean(self, h, fcst, fitted, by):
        if self.nonnegative:
            return self._non_negative(h, fcst, fitted, by)
        return self.fit(h, fcst, fitted).predict(fcst, by)

    def fit(self, h, fcst, fitted=None):
        if self.nonnegative or self.method not in ("mint_cov", "mint_shrink"):
            return super().fit(h, fcst, fitted)
        mintrace.guard(fitted)
        if mintrace.has_gaps(fitted):
            return FittedRows(self, h, None, fitted, settled(mintrace.gap_map(h, fitted, models_of(fcst), self.method, self.mint_shr_ridge), "projection"))
        return super().fit(h, fcst, fitted)

    def _non_negative(self, h, fcst, fitted, by):
        if not fcst.where("yhat < 0").isEmpty():
            warnings.warn("Forecasts below zero count as zero.", stacklevel=3)
        if self.method not in ("mint_cov", "mint_shrink"):
            return nonnegative.least_squares(h, weighted(fcst, self.weights(h, fitted)), by)
        mintrace.guard(fitted)
        if mintrace.has_gaps(fitted):
            raise ValueError("Non-negative mint_cov and mint_shrink need errors without gaps.")
        f, lam = projection.factor(fitted, self.method, self.mint_shr_ridge)
        whole = [m for m in models_of(fcst) if lam.get(m, 0.0) > 0.0]
        out = None
        for names in (whole, [m for m in models_of(fcst) if m not in whole]):
            if not names:
                continue
            own, rows = fcst.where(F.col("model").isin(names)), f.where(F.col("model").isin(names))
            if names is whole:
                w = rows.select("model", "unique_id", (F.col("total") - projection.dot("f", "f")).alias("w"))
                one = nonnegative.least_squares(h, weighted(own, w), by, rows)
            else:
                one = nonnegative.least_squares_in_span(h, own, by, rows)
            out = one if out is None else out.unionByName(one)
        return out


def weighted(fcst: DataFrame, weights: DataFrame) -> DataFrame:
    """Forecasts with their weights (unique_id, w, and model if they differ by model)."""
    return fcst.join(weights, ["unique_id", "model"] if "model" in weights.columns else ["unique_id"])


@dataclass
class MinTraceSparse(Method):
    method: str = "ols"
    nonnegative: bool = False
    num_threads: int = 1
    qp: bool = True

    def __post_init__(self):
        if self.method not in ("ols", "wls_struct", "wls_var"):
            raise ValueError(f"Unknown reconciliation method {self.method}")
        self.insample = self.method == "wls_var"
        self.linear = not self.nonnegative

    def weights(self, h: Hierarchy, fitted: DataFrame | None) -> DataFrame:
        if self.method == "ols":
            return mintrace.identity(h)
        if self.method == "wls_struct":
            return mintrace.structural(h)
        w = mintrace.error_variance(fitted, centred=True)
        if not w.where("w IS NULL OR isnan(w) OR w < 1e-8").isEmpty():
            raise ValueError("Errors in sample have variances near zero or missing. Use another method.")
        return w

    def maps(self, h, fcst, fitted):
        return None if self.nonnegative else [projection.from_weights(h, self.weights(h, fitted), models_of(fcst))]

    def mean(self, h, fcst, fitted, by):
        if not self.nonnegative:
            return self.fit(h, fcst, fitted).predict(fcst, by)
        rows = weighted(fcst, self.weights(h, fitted))
        return nonnegative.least_squares(h, rows, by) if self.qp else mintrace.non_negative(diagonal(h, rows, by), h, by)


class OptimalCombination(MinTrace):
    def __init__(self, method: str = "ols", nonnegative: bool = False, num_threads: int = 1):
        warnings.warn("OptimalCombination is MinTrace with ols or wls_struct; use that.", DeprecationWarning, stacklevel=2)
        if method not in ("ols", "wls_struct"):
            raise ValueError(f"Optimal combination has no method {method}")
        super().__init__(method=method, nonnegative=nonnegative, num_threads=num_threads)


@dataclass
class ERM(Method):
    method: str = "closed"
    lambda_reg: float | None = 1e-2
    vec_order: str = "reference"
    insample = True

    def __post_init__(self):
        if self.method not in ("closed", "reg", "reg_bu"):
            raise ValueError(f"Unknown reconciliation method {self.method}")

    def maps(self, h, fcst, fitted):
        return [learned.erm_closed(h, fcst, fitted)] if self.method == "closed" else None

    def fit(self, h, fcst, fitted=None):
        if self.method == "closed":
            return super().fit(h, fcst, fitted)
        return FittedRows(self, h, None, fitted, settled(learned.erm_lasso(h, fcst, fitted, self.method == "reg_bu", self.lambda_reg, self.vec_order), "projection"))


@dataclass(frozen=True)
class FittedRows(Fitted):
    """A map to the bottom series as the rows (model, unique_id, source, x) of its matrix that are not zero."""

    rows: DataFrame | None = None

    def predict(self, values: DataFrame, by: list[str] = BY) -> DataFrame:
        v = values.withColumnRenamed("unique_id", "source")
        return R.summed(self.h, self.rows.join(v, ["model", "source"]).groupBy("unique_id", *by).agg(F.sum(F.col("x") * F.col("yhat")).alias("yhat")), by)


def linear_map(made: Fitted, models: list[str]) -> DataFrame:
    """(model, unique_id, source, x): the matrix of a fitted method, from its images of the unit vectors."""
    h = made.h
    n = h.nodes.count()
    if n > MOST_MAPPED:
        raise ValueError(f"The map of {made.method.name} has {n} x {n} cells; at most {MOST_MAPPED} series are allowed.")
    ids = h.nodes.select("unique_id")
    model = F.explode(F.array(*map(F.lit, models))).alias("model")
    units = ids.join(ids.withColumnRenamed("unique_id", "ds"), F.lit(True)).select("unique_id", "ds", model, F.when(F.col("unique_id") == F.col("ds"), 1.0).otherwise(0.0).alias("yhat"))
    return made.predict(units, BY).select("model", "unique_id", F.col("ds").alias("source"), F.col("yhat").alias("x"))
