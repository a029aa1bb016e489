"""Fitted maps, their variances, non-negative solutions and errors with gaps against dense numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_reconcile import BY, CROSS, TREE, H, T, dense, gls, map_of, shrunk, world
from tallytree.operators import covariance as C
from tallytree.operators import intervals, nonnegative, projection
from tallytree.operators import reconcilers as K
from tallytree.operators.lasso import row_lasso
from tallytree.plans.reconciliation import HierarchicalReconciliation


@pytest.fixture(scope="module")
def tree(spark):
    return world(spark, TREE, 3)


@pytest.fixture(scope="module")
def cross(spark):
    return world(spark, CROSS, 4)


def frame(spark, ids, values, name="yhat"):
    return spark.createDataFrame(pd.DataFrame([(ids[i], k, "m", float(values[i, k])) for i in range(len(ids)) for k in range(values.shape[1])], columns=["unique_id", *BY, name]))


def test_variances_need_no_matrix(spark, tree, monkeypatch):
    """Deviations of every written map equal those of its dense matrix, with and without correlation."""
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    monkeypatch.setattr(intervals, "linear_map", lambda *_: pytest.fail("a matrix of all series was made"))
    n, b = s.shape
    e = y - fit
    sd = np.random.default_rng(1).uniform(0.5, 4, (n, H))
    sigma = frame(spark, ids, sd, "sigma")
    p = {"emint": y[-b:] @ np.linalg.pinv(fit), "closed": np.linalg.solve(s.T @ s, s.T @ y[:, -H:]) @ np.linalg.pinv(fit[:, -H:])}
    maps = [
        (K.MinTrace("ols"), map_of(s, np.eye(n))),
        (K.MinTrace("wls_var"), map_of(s, np.diag((e**2).mean(1) + 2e-8))),
        (K.MinTrace("mint_shrink"), map_of(s, shrunk(e)[1])),
        (K.MinTrace("mint_cov"), map_of(s, np.cov(e))),
        (K.MinTrace("emint"), s @ p["emint"]),
        (K.ERM("closed"), s @ p["closed"]),
        (K.TopDown("average_proportions"), s @ np.outer((y[-b:] / y[0]).mean(1), np.eye(n)[0])),
    ]
    for method, m in maps:
        made = method.fit(h, fcst, fitted)
        rec = made.predict(fcst)
        assert np.allclose(dense(rec, ids), m @ y_hat, rtol=1e-6)
        got = dense(intervals.normality(h, made, rec, sigma, fitted).drop("yhat").withColumnRenamed("sigma", "yhat"), ids)
        assert np.allclose(got, np.sqrt((m**2) @ (sd**2)), rtol=1e-6), method
    corr = np.corrcoef(e)
    made = K.MinTrace("mint_cov").fit(h, fcst, fitted)
    got = dense(intervals.normality(h, made, fcst, sigma, fitted, "full").drop("yhat").withColumnRenamed("sigma", "yhat"), ids)
    m = maps[3][1]
    assert np.allclose(got, np.column_stack([np.sqrt(np.maximum(np.diag(m @ (corr * np.outer(v, v)) @ m.T), 0)) for v in sd.T]), rtol=1e-6)


def optimal(s, w, y_hat, got):
    """Whether bottom values meet the conditions of the least squares without negative values."""
    x, wi = got[-s.shape[1] :], np.linalg.pinv(w)
    slope = s.T @ wi @ (s @ x - np.maximum(y_hat, 0))
    scale = np.abs(s.T @ wi @ np.maximum(y_hat, 0)).max()
    return (x >= 0).all() and np.allclose(got, s @ x) and (slope > -1e-6 * scale).all() and np.abs(x * slope).max() < 1e-6 * scale * np.abs(y_hat).max()


def test_non_negative_solutions_are_optimal(spark, tree, cross):
    for h, s, ids, y_hat, y, fit, _, fitted in (tree, cross):
        low = y_hat.copy()
        low[-4], low[-3, 0], low[-1] = 1.0, -30.0, 300.0  # the sums are far below the largest series
        fcst, e = frame(spark, ids, low), y - fit
        weights = {"wls_struct": np.diag(s.sum(1)), "mint_shrink": shrunk(e)[1], "mint_cov": np.cov(e)}
        for method in ["wls_struct", "mint_shrink", "mint_cov"] if h.is_strict else ["wls_struct"]:
            with pytest.warns(UserWarning):
                got = dense(K.MinTrace(method, nonnegative=True).mean(h, fcst, fitted, BY), ids)
            assert optimal(s, weights[method], low, got), method
            assert (gls(s, weights[method], np.maximum(low, 0))[-4:] < 0).any() and (got[-4:] == 0).any()


def test_pivoting_ends_on_random_problems(spark):
    """Many columns at once, with their own sides."""
    h, s, ids, *_ = world(spark, TREE, 7)
    rng = np.random.default_rng(8)
    values, w = rng.normal(5, 30, (len(ids), 40)), rng.uniform(0.1, 5, len(ids))
    rows = frame(spark, ids, values).join(spark.createDataFrame(list(zip(ids, map(float, w), strict=True)), "unique_id string, w double"), "unique_id")
    got = dense(nonnegative.least_squares(h, rows, BY), ids)
    for k in range(40):
        assert optimal(s, np.diag(w), values[:, k : k + 1], got[:, k : k + 1])
    with pytest.raises(ValueError, match="not found"):
        nonnegative.least_squares(h, rows, BY, rounds=1)


def test_too_short_a_history(spark, tree):
    h, *_, fcst, fitted = tree
    with pytest.raises(ValueError, match="ill-conditioned"):
        K.MinTrace("mint_cov", nonnegative=True).mean(h, fcst, fitted.where("ds < 4"), BY)
    with pytest.raises(ValueError, match="ill-conditioned"):
        K.MinTrace("mint_cov").mean(h, fcst, fitted.where("ds < 3"), BY)


def naive_pairs(res):
    n = len(res)
    mean, std = np.nanmean(res, 1), np.nanstd(res, 1) + 2e-8
    w, num, den = np.zeros((n, n)), 0.0, 0.0
    for i in range(n):
        for j in range(i + 1):
            both = ~np.isnan(res[i]) & ~np.isnan(res[j])
            k = both.sum()
            if k <= 1:
                continue
            a, b = res[i][both], res[j][both]
            w[i, j] = w[j, i] = ((a - a.mean()) * (b - b.mean())).sum() / (k - 1)
            if i != j:
                x, z = (a - mean[i]) / std[i], (b - mean[j]) / std[j]
                q = (x - x.mean()) * (z - z.mean())
                num += ((q - q.mean()) ** 2).sum() / (k * (k - 1))
                den += q.mean() ** 2
    keep = 1 - min(max(num / (den + 2e-8), 0), 1)
    return w, np.where(np.eye(n, dtype=bool), np.maximum(w, 2e-8), keep * w)


def test_errors_with_gaps(spark, tree, monkeypatch):
    """Pairwise covariances by blocks equal a loop over pairs; reconciliation uses them."""
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    rng = np.random.default_rng(2)
    res = np.where(rng.random((len(ids), T)) < 0.2, np.nan, y - fit)
    res[0, :-1] = np.nan  # one time left
    rows = [(ids[i], k, "m", float(y[i, k]), None if np.isnan(res[i, k]) else float(y[i, k] - res[i, k])) for i in range(len(ids)) for k in range(T) if not (np.isnan(res[i, k]) and k % 2)]
    gaps = spark.createDataFrame(rows, "unique_id string, ds long, model string, y double, yhat double")
    monkeypatch.setattr(C, "BLOCK", 3)
    for got, want in ((C.masked_covariance(C.errors(gaps)), naive_pairs(res)[0]), (C.masked_shrunk(C.errors(gaps)), naive_pairs(res)[1])):
        pairs = got.collect()
        assert len(pairs) == len(ids) * (len(ids) + 1) // 2 and all(r.id1 <= r.id2 for r in pairs)
        assert all(np.isclose(r["cov"], want[ids.index(r.id1), ids.index(r.id2)], atol=1e-9) for r in pairs)
    assert np.allclose(C.shrunk_masked(res), naive_pairs(res)[1])
    made = K.MinTrace("mint_shrink").fit(h, fcst, gaps)
    assert np.allclose(dense(made.predict(fcst), ids), gls(s, naive_pairs(res)[1], y_hat), rtol=1e-6)
    assert np.allclose(dense(made.predict(fcst.withColumn("ds", F.col("ds") + 5)), ids), gls(s, naive_pairs(res)[1], y_hat), rtol=1e-6)


class Halved:
    """A user's method: half of the bottom-up forecasts, by what it asks for by name."""

    insample = True
    calls = 0

    def fit_predict(self, hierarchy, forecasts, by, insample=None):
        self.calls += 1
        assert "y" in insample.columns
        return K.BottomUp().mean(hierarchy, forecasts, None, by).withColumn("yhat", F.col("yhat") / 2)


def test_own_methods_and_a_second_predict(spark, tree, monkeypatch):
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    wide = fcst.select("unique_id", "ds", F.col("yhat").alias("m"))
    past = fitted.select("unique_id", "ds", "y", F.col("yhat").alias("m"))
    own = Halved()
    engine = HierarchicalReconciliation([own, K.MinTrace("wls_var")])
    out = engine.reconcile(wide, h, past).toPandas()
    got = out.pivot(index="unique_id", columns="ds", values="m/Halved").loc[ids].to_numpy()
    assert np.allclose(got, s @ y_hat[-4:] / 2) and own.calls == 1
    made = engine.fitted["MinTrace_method-wls_var"]
    for name in ("maps", "mean"):
        monkeypatch.setattr(K.MinTrace, name, lambda *_: pytest.fail("fitted again"))
    w = np.diag(((y - fit) ** 2).mean(1) + 2e-8)
    assert np.allclose(dense(made.predict(frame(spark, ids, 3 * y_hat)), ids), 3 * gls(s, w, y_hat))
    draws = made.sample(fcst.where("ds = 0"), frame(spark, ids, np.ones((len(ids), 1)), "sigma"), 2).toPandas()
    for _, one in draws.groupby("sample_id"):
        v = one.set_index("unique_id").yhat[ids].to_numpy()
        assert np.allclose(v, s @ v[-4:])
    with pytest.raises(ValueError, match="lacks fit_predict"):
        HierarchicalReconciliation([object()])

    class Asking:
        def fit_predict(self, weather):
            return weather

    with pytest.raises(ValueError, match="weather"):
        HierarchicalReconciliation([Asking()]).reconcile(wide, h)


def test_copula_draws_follow_the_ranks_of_errors(spark, tree):
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    rec = K.BottomUp().mean(h, fcst, None, BY)
    sigma = frame(spark, ids, np.ones((len(ids), H)), "sigma")
    draws = [intervals.permbu_samples(h, rec.repartition(k), sigma, fitted, None, seed).toPandas() for k, seed in ((1, 0), (5, 0), (1, 1))]
    order = ["unique_id", "ds", "sample_id"]
    first, again, other = (d.sort_values(order).reset_index(drop=True) for d in draws)
    assert np.allclose(first.yhat, again.yhat) and not np.allclose(first.yhat, other.yhat)
    picks = np.random.default_rng(0).choice(T, size=T, replace=False)
    res = (y - fit)[:, picks]
    for ds in range(H):
        for i in range(len(ids) - 4, len(ids)):
            v = first[(first.unique_id == ids[i]) & (first.ds == ds)].sort_values("sample_id").yhat.to_numpy()
            assert (v.argsort().argsort() == res[i].argsort().argsort()).all()
    # A parent's draws are its children's sums in another order, the same at all times ahead.
    orders = []
    for ds in range(H):
        at = first[first.ds == ds].pivot(index="unique_id", columns="sample_id", values="yhat")
        sums = at.loc[ids[-4:-2]].sum().to_numpy()
        own = at.loc[ids[1]].to_numpy()
        assert np.allclose(np.sort(own), np.sort(sums)) and not np.allclose(own, sums)
        orders.append([int(np.abs(sums - v).argmin()) for v in own])
    assert orders[0] == orders[1]


def descent(x, z, lam):
    """Plain cyclic descent on a dense design."""
    beta, left, norm = np.zeros(x.shape[1]), z.copy(), (x**2).sum(0)
    for _ in range(100_000):
        old = beta.copy()
        for j in range(x.shape[1]):
            rho = beta[j] + x[:, j] @ left / norm[j]
            new = np.sign(rho) * max(abs(rho) - lam * len(z) / norm[j], 0.0)
            left, beta[j] = left - (new - beta[j]) * x[:, j], new
        if np.abs(beta - old).max() < 1e-10:
            return beta
    raise AssertionError("the check has not converged")


def test_the_lasso_equals_descent_by_coordinates(spark, tree):
    """Rows of coefficients against descent on the whole design, at strengths that keep some of them."""
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    n, b = s.shape
    x, z = fit[:, -H:], y[:, -H:]
    start = np.vstack([np.zeros((n - b, b)), np.eye(b)])
    for share, around, order in ((0.3, False, "math"), (0.05, True, "reference")):
        target = z - s @ start.reshape(b, n) @ x if around else z
        lam = share * np.abs(s.T @ target @ x.T).max() / z.size
        beta = descent(np.kron(s, x.T), target.reshape(-1), lam).reshape(b, n)
        assert 0 < (beta != 0).sum() < b * n
        p = ((beta.T if order == "math" else beta.reshape(-1).reshape(n, b)) + (start if around else 0)).T
        made = K.ERM("reg_bu" if around else "reg", lam, order).fit(h, fcst, fitted)
        assert np.allclose(dense(made.predict(fcst), ids), s @ p @ y_hat, rtol=1e-4, atol=1e-5 * np.abs(y_hat).max()), order
        if order == "math":
            got = np.zeros((b, n))
            for r in made.rows.collect():
                got[ids.index(r.unique_id) - (n - b), ids.index(r.source)] = r.x
            objective = lambda v: ((target - s @ v @ x) ** 2).sum() / 2 + lam * z.size * np.abs(v).sum()
            assert objective(got) <= objective(beta) * (1 + 1e-7)


def test_row_lasso_meets_its_conditions():
    rng = np.random.default_rng(6)
    for n, t, strength in ((3, 8, 0.1), (200, 4, 0.5), (50, 12, 2.0), (5, 5, 1e9)):
        x, p = rng.normal(size=(n, t)), rng.normal(size=t) * 5
        beta = row_lasso(p, x, strength, {0: 1.0})
        left = p - sum((v * x[j] for j, v in beta.items()), np.zeros(t))
        pull = x @ left
        assert (np.abs(pull) <= strength + 1e-7).all() and len(beta) <= t
        assert all(abs(pull[j] - strength * np.sign(v)) < 1e-6 for j, v in beta.items())


def test_many_seeds_in_one_plan(spark, tree):
    """Every seed's columns equal those of a run with that seed alone."""
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    wide = fcst.select("unique_id", "ds", F.col("yhat").alias("m"), (F.col("yhat") - 3).alias("m-lo-80"), (F.col("yhat") + 3).alias("m-hi-80"))
    past = fitted.select("unique_id", "ds", "y", F.col("yhat").alias("m"))
    for method, r in (("bootstrap", K.MinTrace("ols")), ("permbu", K.BottomUp())):
        more = {"level": [80], "intervals_method": method, "num_samples": 2}
        every = HierarchicalReconciliation([r]).bootstrap_reconcile(wide, h, past, num_seeds=2, **more).toPandas()
        assert len(every) == 2 * len(ids) * H and set(every.seed) == {0, 1}
        one = HierarchicalReconciliation([r]).reconcile(wide, h, past, seed=1, **more).toPandas()
        key = ["unique_id", "ds"]
        got = every[every.seed == 1].drop(columns="seed").sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(got[one.columns.tolist()], one.sort_values(key).reset_index(drop=True))
        assert method != "bootstrap" or not np.allclose(*(every[every.seed == k].sort_values(key)[f"m/{r.name}-sample-0"] for k in (0, 1)))


def test_checks_of_errors_and_weights(spark, tree):
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    sigma = frame(spark, ids, np.ones((len(ids), H)), "sigma")
    made = K.MinTrace("ols").fit(h, fcst, fitted)
    with pytest.raises(ValueError, match="at least 2"):
        intervals.normality(h, made, fcst, sigma, fitted.where("ds = 0"), "shrink")
    few = fitted.where((F.col("unique_id") != ids[0]) | (F.col("ds") == 0))
    with pytest.raises(ValueError, match="fewer than 2"):
        intervals.normality(h, made, fcst, sigma, few, "full")
    with pytest.raises(ValueError, match="Unknown covariance type"):
        intervals.normality(h, made, fcst, sigma, fitted, "diagonal?")
    with pytest.warns(UserWarning, match="positive definite"):
        intervals.normality(h, made, fcst, sigma, fitted.where("ds < 4"), "full")
    with pytest.raises(ValueError, match="not positive"):
        projection.from_weights(h, h.nodes.select("unique_id", F.when(F.col("is_bottom"), 1.0).otherwise(0.0).alias("w")), ["m"])
