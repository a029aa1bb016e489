"""Reconciliation against dense numpy solutions on a small tree and a crossed structure."""

import numpy as np
import pandas as pd
import pytest

from tallytree.operators import aggregate as A
from tallytree.operators import covariance as C
from tallytree.operators import crossed, intervals, mintrace
from tallytree.operators import reconcilers as K
from tallytree.operators.dense import nnls
from tallytree.plans.reconciliation import HierarchicalReconciliation

BY = ["ds", "model"]
H, T = 2, 12
TREE = [["t"], ["t", "g"], ["t", "g", "b"]]
CROSS = [["t"], ["t", "g"], ["t", "x"], ["t", "g", "x"]]


def world(spark, spec, seed=0):
    """The hierarchy, its matrix S, ids, forecasts (n x H) and in-sample y and fitted (n x T), also as frames."""
    rng = np.random.default_rng(seed)
    keys = [("T", "A", "1"), ("T", "A", "2"), ("T", "B", "1"), ("T", "B", "2")]
    cols = spec[-1]
    base = spark.createDataFrame(pd.DataFrame([(*k, 0, 1.0) for k in keys], columns=[*cols, "ds", "y"]))
    _, h = A.aggregate(base, spec)
    h = h.settle()
    s = h.to_numpy()
    ids = [r[0] for r in h.nodes.orderBy("level_ord", "pos").select("unique_id").collect()]
    n, b = s.shape
    y_hat = rng.normal(50, 10, (n, H))
    y = s @ rng.normal(20, 5, (b, T))
    fit = y + rng.normal(0, 3, (n, T))
    fcst = spark.createDataFrame(pd.DataFrame([(ids[i], k, "m", y_hat[i, k]) for i in range(n) for k in range(H)], columns=["unique_id", *BY, "yhat"]))
    fitted = spark.createDataFrame(pd.DataFrame([(ids[i], k, "m", y[i, k], fit[i, k]) for i in range(n) for k in range(T)], columns=["unique_id", *BY, "y", "yhat"]))
    return h, s, ids, y_hat, y, fit, fcst, fitted


@pytest.fixture(scope="module")
def tree(spark):
    return world(spark, TREE)


@pytest.fixture(scope="module")
def cross(spark):
    return world(spark, CROSS)


def dense(df, ids):
    p = df.toPandas().pivot(index="unique_id", columns="ds", values="yhat")
    return p.loc[ids].to_numpy()


def gls(s, w, y_hat):
    wi = np.linalg.inv(w)
    return s @ np.linalg.solve(s.T @ wi @ s, s.T @ wi @ y_hat)


def shrunk(e):
    n, t = e.shape
    w = np.cov(e)
    x = (e - e.mean(1, keepdims=True)) / (e.std(1, keepdims=True) + 2e-8)
    num = den = 0.0
    for i in range(n):
        for j in range(i):
            p = x[i] * x[j]
            num += ((p - p.mean()) ** 2).sum() / (t * (t - 1))
            den += p.mean() ** 2
    lam = min(max(num / (den + 2e-8), 0), 1)
    return lam, np.where(np.eye(n, dtype=bool), np.maximum(w, 2e-8), (1 - lam) * w)


@pytest.mark.parametrize("method", ["ols", "wls_struct", "wls_var", "mint_shrink"])
def test_minimum_trace_equals_least_squares(tree, cross, method):
    for h, s, ids, y_hat, y, fit, fcst, fitted in (tree, cross):
        e = y - fit
        w = {"ols": np.eye(len(s)), "wls_struct": np.diag(s.sum(1)), "wls_var": np.diag((e**2).mean(1) + 2e-8), "mint_shrink": shrunk(e)[1]}[method]
        got = dense(K.MinTrace(method).mean(h, fcst, fitted, BY), ids)
        assert np.allclose(got, gls(s, w, y_hat), atol=1e-7)


def test_full_covariance_and_gaps(tree):
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    e = y - fit
    got = dense(K.MinTrace("mint_cov").mean(h, fcst, fitted, BY), ids)
    assert np.allclose(got, gls(s, np.cov(e), y_hat), atol=1e-6)
    gap = fitted.withColumn("yhat", mintrace.F.when((mintrace.F.col("unique_id") == ids[-1]) & (mintrace.F.col("ds") == 0), None).otherwise(mintrace.F.col("yhat")))
    for m in ("mint_cov", "mint_shrink"):
        got = dense(K.MinTrace(m).mean(h, fcst, gap, BY), ids)
        assert np.allclose(got, s @ got[-4:], atol=1e-8)
    assert np.isclose(C.shrinkage(C.centred(C.errors(fitted))).first().lam, shrunk(e)[0])
    cov = {(r.id1, r.id2): r["cov"] for r in C.masked_covariance(C.errors(fitted)).collect()}
    assert np.isclose(cov[min(ids[0], ids[1]), max(ids[0], ids[1])], np.cov(e)[0, 1])
    assert np.allclose(C.shrunk_masked(e), shrunk(e)[1])


def test_conjugate_gradients_equal_the_dense_system(spark, cross):
    h, s, ids, y_hat, *_, fcst, _ = cross
    assert h.chain.levels == (h.levels[0], h.levels[2], h.levels[3]) and h.chain.is_strict
    w = np.linspace(0.5, 3.0, len(ids))
    rows = fcst.join(spark.createDataFrame([(i, float(x)) for i, x in zip(ids, w, strict=True)], "unique_id string, w double"), "unique_id")
    got = dense(crossed.constrained(h, rows, BY), ids)
    assert np.allclose(got, gls(s, np.diag(w), y_hat), rtol=1e-8)
    with pytest.raises(ValueError, match="not converged"):
        crossed.constrained(h, rows, BY, rounds=1)


def test_sums_and_shares(tree):
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    assert np.allclose(dense(K.BottomUp().mean(h, fcst, None, BY), ids), s @ y_hat[-4:])
    p = (y[-4:] / y[0]).mean(1)
    assert np.allclose(dense(K.TopDown("average_proportions").mean(h, fcst, fitted, BY), ids), s @ np.outer(p, y_hat[0]))
    p = y[-4:].mean(1) / y[0].mean()
    assert np.allclose(dense(K.TopDownSparse("proportion_averages").mean(h, fcst, fitted, BY), ids), s @ np.outer(p, y_hat[0]))
    down = dense(K.TopDown("forecast_proportions").mean(h, fcst, None, BY), ids)
    a = y_hat[0] * y_hat[1] / (y_hat[1] + y_hat[2])
    assert np.allclose(down[0], y_hat[0]) and np.allclose(down[1], a) and np.allclose(down[3], a * y_hat[3] / (y_hat[3] + y_hat[4]))
    for m in ("forecast_proportions", "average_proportions", "proportion_averages"):
        mid = dense(K.MiddleOut(h.levels[1], m).mean(h, fcst, fitted, BY), ids)
        assert np.allclose(mid[1:3], y_hat[1:3]) and np.allclose(mid[0], y_hat[1] + y_hat[2]) and np.allclose(mid, s @ mid[-4:])


def test_zero_siblings(spark, tree):
    h, s, ids, y_hat, *_ = tree
    z = y_hat.copy()
    z[3:5] = 0
    f = spark.createDataFrame(pd.DataFrame([(ids[i], k, "m", z[i, k]) for i in range(len(ids)) for k in range(H)], columns=["unique_id", *BY, "yhat"]))
    for kind in (K.TopDown, K.TopDownSparse):
        got = dense(kind("forecast_proportions").mean(h, f, None, BY), ids)
        assert np.allclose(got[3], got[1] / 2) and np.allclose(got, s @ got[-4:])


def test_learned_projections(tree):
    h, s, ids, y_hat, y, fit, fcst, fitted = tree
    p = y[-4:] @ fit.T @ np.linalg.pinv(fit @ fit.T)
    assert np.allclose(dense(K.MinTrace("emint").mean(h, fcst, fitted, BY), ids), s @ p @ y_hat, atol=1e-5)
    bt = np.linalg.solve(s.T @ s, s.T @ y[:, -H:])
    p = (np.linalg.pinv(fit[:, -H:].T) @ bt.T).T
    assert np.allclose(dense(K.ERM("closed").mean(h, fcst, fitted, BY), ids), s @ p @ y_hat, atol=1e-6)
    assert np.allclose(dense(K.ERM("reg_bu", None).mean(h, fcst, fitted, BY), ids), s @ y_hat[-4:], atol=1e-6)


def test_kernels():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(8, 5))
    a, c = m.T @ m + np.eye(5), rng.normal(size=5)
    x = nnls(a, c)
    g = a @ x - c
    assert (x >= 0).all() and (g > -1e-8).all() and abs(x @ g) < 1e-8
    with pytest.raises(ValueError, match="not converged"):
        nnls(a, np.abs(c) + 1, rounds=1)


def test_non_negative(spark, tree):
    h, s, ids, y_hat, *_ = tree
    low = y_hat.copy()
    low[3] = -80
    f = spark.createDataFrame(pd.DataFrame([(ids[i], k, "m", low[i, k]) for i in range(len(ids)) for k in range(H)], columns=["unique_id", *BY, "yhat"]))
    for m in (K.MinTrace("wls_struct", nonnegative=True), K.MinTraceSparse("ols", nonnegative=True), K.MinTraceSparse("ols", nonnegative=True, qp=False)):
        got = dense(m.mean(h, f, None, BY), ids)
        assert (got > -1e-9).all() and np.allclose(got, s @ got[-4:])


def test_recovery_of_coherent_forecasts(spark, tree):
    h, s, ids, y_hat, y, fit, _, fitted = tree
    c = s @ y_hat[-4:]
    f = spark.createDataFrame(pd.DataFrame([(ids[i], k, "m", c[i, k]) for i in range(len(ids)) for k in range(H)], columns=["unique_id", *BY, "yhat"]))
    for m in (K.BottomUp(), K.TopDown("forecast_proportions"), K.MinTrace("wls_var"), K.MinTrace("mint_shrink"), K.MiddleOut(h.levels[1])):
        assert np.allclose(dense(m.mean(h, f, fitted, BY), ids), c, atol=1e-7)


def test_strictness_and_names(cross):
    h, *_, fcst, fitted = cross
    with pytest.raises(ValueError, match="strict"):
        K.TopDown("forecast_proportions").mean(h, fcst, fitted, BY)
    assert K.MinTrace("ols").name == "MinTrace_method-ols"
    assert K.MinTrace("mint_shrink", mint_shr_ridge=1e-4).name == "MinTrace_method-mint_shrink_mint_shr_ridge-0.0001"
    assert K.MinTrace("ols", nonnegative=True).name == "MinTrace_method-ols_nonnegative-True"
    assert K.ERM("reg", 0.01).name == "ERM_method-reg_lambda_reg-0.01"
    with pytest.warns(DeprecationWarning):
        K.OptimalCombination("ols")
    with pytest.raises(ValueError):
        K.MinTrace("zzz")


def wide(ids, a, extra=()):
    return pd.DataFrame([(ids[i], k, a[i, k], a[i, k] - 5.0, a[i, k] + 5.0) for i in range(len(ids)) for k in range(a.shape[1])], columns=["unique_id", "ds", "m", "m-lo-90", "m-hi-90"])


def test_wide_frames_intervals_samples_and_diagnostics(spark, tree):
    h, s, ids, y_hat, y, fit, *_ = tree
    y_hat_df = spark.createDataFrame(wide(ids, y_hat))
    y_df = spark.createDataFrame(pd.DataFrame([(ids[i], k, y[i, k], fit[i, k]) for i in range(len(ids)) for k in range(T)], columns=["unique_id", "ds", "y", "m"]))
    for method in ("normality", "bootstrap", "permbu", "conformal"):
        engine = HierarchicalReconciliation([K.BottomUp(), K.MinTrace("ols")])
        out = engine.reconcile(y_hat_df, h, y_df, level=[80, 95], intervals_method=method, num_samples=3, diagnostics=method == "normality").toPandas()
        for r in ("m/BottomUp", "m/MinTrace_method-ols"):
            lo, hi = [f"{r}-lo-95", f"{r}-lo-80"], [f"{r}-hi-80", f"{r}-hi-95"]
            assert (np.diff(out[[*lo, *hi]].to_numpy(), axis=1) >= -1e-9).all()
            assert engine.level_names[r] == [*lo, *hi] and set(engine.sample_names[r]) <= set(out.columns)
        if method == "normality":
            sd = 10 / (2 * 1.6448536269514722)
            row = out[(out.unique_id == ids[0]) & (out.ds == 0)].iloc[0]
            assert np.isclose(row["m/BottomUp-hi-80"] - row["m/BottomUp"], 1.2815515655446004 * sd * 2)
            told = {(r.level, r.metric, r.model): r.value for r in engine.diagnostics.collect()}
            assert told["Overall", "is_coherent", "m/BottomUp"] == 1.0
        if method == "conformal":
            score = y[0] - fit[-4:].sum(0)
            assert np.isclose(row0(out, ids[0])["m/BottomUp-lo-80"], y_hat[-4:, 0].sum() + np.quantile(score, 0.1))
        if method == "bootstrap":
            res = y - fit
            starts = np.random.default_rng(0).choice(np.arange(T - H), size=200)
            draws = np.array([(y_hat[-4:] + res[-4:, t : t + H]).sum(0) for t in starts])
            assert np.isclose(row0(out, ids[0])["m/BottomUp-lo-80"], np.quantile(draws[:, 0], 0.1))


def row0(out, i):
    return out[(out.unique_id == i) & (out.ds == 0)].iloc[0]


def test_errors(spark, tree):
    h, s, ids, y_hat, y, fit, *_ = tree
    good = wide(ids, y_hat)
    engine = HierarchicalReconciliation([K.BottomUp()])
    frame = spark.createDataFrame(good)
    with pytest.raises(ValueError, match="Unknown interval method"):
        engine.reconcile(frame, h, intervals_method="zzz")
    with pytest.raises(ValueError, match="Levels"):
        engine.reconcile(frame, h, level=[100])
    with pytest.raises(ValueError, match="not numeric"):
        engine.reconcile(spark.createDataFrame(good.assign(z="a")), h)
    with pytest.raises(ValueError, match="missing times"):
        engine.reconcile(spark.createDataFrame(good.iloc[1:]), h)
    with pytest.raises(ValueError, match="ids in the hierarchy"):
        engine.reconcile(spark.createDataFrame(good[good.unique_id != ids[1]]), h)
    with pytest.raises(ValueError, match="nulls"):
        engine.reconcile(frame.withColumn("m", mintrace.F.when(mintrace.F.col("ds") > 0, mintrace.F.col("m"))), h)
    with pytest.raises(ValueError, match="in sample"):
        HierarchicalReconciliation([K.MinTrace("wls_var")]).reconcile(frame, h)
    with pytest.raises(NotImplementedError):
        engine.reconcile(frame, h, frame, temporal=True)


def test_gaussian_samples_are_coherent_and_weights_correlate(spark, tree):
    """Draws add up along the tree; bounds of mint_shrink use the correlation of its weights."""
    h, s, ids, y_hat, y, fit, *_ = tree
    rows = [(ids[i], k, "m", float(y_hat[i, k]), 1.0 + i) for i in range(len(ids)) for k in range(1)]
    base = spark.createDataFrame(rows, "unique_id string, ds long, model string, yhat double, sigma double")
    fcst, sigma = base.drop("sigma"), base.drop("yhat")
    fitted = spark.createDataFrame([(ids[i], k, "m", float(y[i, k]), float(fit[i, k])) for i in range(len(ids)) for k in range(T)], "unique_id string, ds long, model string, y double, yhat double")
    method = K.MinTrace("mint_shrink")
    got = intervals.normal_samples(h, method, fcst, sigma, fitted, 3, 1, "shrink").toPandas()
    assert len(got) == 3 * len(ids)
    for _, one in got.groupby("sample_id"):
        v = one.set_index("unique_id").yhat[ids].to_numpy()
        assert np.allclose(v, s @ v[-s.shape[1] :], atol=1e-6)
    pairs = intervals.correlations(fitted, "shrink")
    corr = np.eye(len(ids))
    for r in pairs.collect():
        corr[ids.index(r.id1), ids.index(r.id2)] = corr[ids.index(r.id2), ids.index(r.id1)] = r.r
    sd = np.array([1.0 + i for i in range(len(ids))])
    m = map_of(s, shrunk(y - fit)[1])
    want = np.sqrt(np.diag(m @ (corr * np.outer(sd, sd)) @ m.T))
    made = method.fit(h, fcst, fitted)
    rec = made.predict(fcst)
    told = {r.unique_id: r.sigma for r in intervals.normality(h, made, rec, sigma, fitted, "shrink").collect()}
    assert np.allclose([told[i] for i in ids], want)
    rows = {r.unique_id: r.sigma for r in intervals.normality(h, made, rec, sigma, fitted, pairs).collect()}
    assert np.allclose([rows[i] for i in ids], want)


def map_of(s, w):
    """The matrix of least squares with the weights' inverse w."""
    wi = np.linalg.inv(w)
    return s @ np.linalg.solve(s.T @ wi @ s, s.T @ wi)
