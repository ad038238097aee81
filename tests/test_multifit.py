"""Fits of several parameters recover what spectra were made from; derivatives against differences."""

import numpy as np
import pytest

from tofcube import constants as K
from tofcube.operators import multifit as X

E = np.linspace(2.0, 40.0, 240)
DIPS = {"a": [(6.0, 400.0), (22.0, 250.0)], "b": [(11.0, 300.0), (30.0, 500.0)]}


def sigma(e, t=293.6):
    return np.array([5.0 + sum(h / (1 + ((e - c) / (0.3 + t / 2000)) ** 2) for c, h in DIPS[g]) for g in DIPS])


def model(temperature=False, fine=False, resolution=False):
    grid = np.linspace(1.0, 60.0, 6000) if fine else None
    x = E if grid is None else grid
    nodes = np.array([200.0, 300.0, 400.0, 500.0]) if temperature else np.array([293.6])
    r = np.exp(-(((E[:, None] - E) / 0.25) ** 2)) if resolution else None
    return X.Model(list(DIPS), E, np.stack([sigma(x, t) for t in nodes], 1), grid, nodes, None if r is None else r / r.sum(1, keepdims=True))


ALL = ["temperature", "t0_us", "l_scale", "a", "b_a", "b_b", "b_c", "b_d", "b_f"]


def test_derivatives():
    m = model(True, True, True)
    names = X.Fit(free=tuple(ALL)).names(m)
    x = np.array([[0.002, 0.003, 341.0, 0.3, 1.001, 0.97, 0.01, 0.02, -0.002, 0.05, 2.0], [0.004, 0.001, 420.0, -0.7, 0.999, 1.02, 0.0, 0.01, 0.001, 0.02, 1.0]])
    t, j = X.evaluate(m, names, x)
    for k, c in enumerate(names):
        h = np.zeros(len(names))
        h[k] = 1e-6 * max(1.0, abs(x[0, k])) if c not in ("t0_us", "l_scale") else 1e-7
        diff = (X.evaluate(m, names, x + h)[0] - X.evaluate(m, names, x - h)[0]) / (2 * h[k])
        # the grid is piecewise linear: a step over a knot changes the slope a little
        assert np.allclose(j[:, :, k], diff, rtol=2e-3, atol=2e-3 * np.abs(diff).max()), c


def cells(spark, m, truth, names, solver, n=30, seed=5):
    rng = np.random.default_rng(seed)
    x = np.array([[truth[c] * (1 + 0.2 * (p / n - 0.5)) if c.startswith("n_") else truth[c] for c in names] for p in range(n)])
    t = X.evaluate(m, names, x, False)[0]
    if solver == "kl":
        a, b = rng.poisson(2e4 * t).astype(float), rng.poisson(2e4, t.shape).astype(float)
    else:
        b = np.full(t.shape, 0.004)
        a = t + rng.normal(0, 0.004, t.shape)
    rows = [(p // 6, p % 6, i, float(a[p, i]), float(b[p, i])) for p in range(n) for i in range(len(E))]
    return spark.createDataFrame(rows, "y int, x int, i int, a double, b double"), x


@pytest.mark.parametrize(
    "solver,free,kind",
    [("lm", (), {}), ("kl", (), {}), ("kl", ("a", "b_a", "b_b"), {}), ("lm", ("a", "b_a", "b_b", "b_c"), {"resolution": True}), ("lm", ("temperature",), {"temperature": True}), ("kl", ("t0_us", "l_scale"), {"fine": True}), ("lm", ("t0_us", "a", "b_a"), {"fine": True, "resolution": True}), ("poisson", (), {})],
)
def test_recovers(spark, solver, free, kind):
    m = model(**kind)
    truth = {"n_a": 0.002, "n_b": 0.003, "temperature": 361.0, "t0_us": 0.4, "l_scale": 1.0015, "a": 0.96, "b_a": 0.02, "b_b": 0.03, "b_c": -0.002}
    fit = X.Fit(solver, free, density=0.0015)
    df, x = cells(spark, m, truth, fit.names(m), solver)
    got = {(r["y"], r["x"]): r for r in X.fit_pixels(df, ["y", "x"], m, fit).collect()}
    assert len(got) == 30
    worst = []
    for p in range(30):
        r = got[p // 6, p % 6]
        assert r["converged"] and (solver == "poisson" or 0.6 < r["objective_r"] < 1.5)
        worst.append([(r[c] - x[p, k]) / r[f"err_{c}"] for k, c in enumerate(fit.names(m))])
    assert np.abs(worst).max() < 5 and (solver == "poisson" or 0.5 < np.std(worst) < 1.6)


def test_cases(spark):
    m = model()
    df, x = cells(spark, m, {"n_a": 0.002, "n_b": 0.003}, ["n_a", "n_b"], "lm", 6)
    some = df.where("x <> 3 OR i = 7").unionByName(df.where("x = 4 AND i < 3").selectExpr("y + 9 AS y", "x", "i", "double('nan') AS a", "b"))
    got = {(r["y"], r["x"]): r for r in X.fit_pixels(some, ["y", "x"], m, X.Fit(fixed=("b",), start={"n_b": 0.003}, window=(3.0, 20.0))).collect()}
    assert not got[0, 3]["converged"] or got[0, 3]["iterations"] >= 0
    assert not got[9, 4]["converged"] and np.isnan(got[9, 4]["n_a"])
    assert got[0, 1]["n_b"] == 0.003 and got[0, 1]["err_n_b"] == 0.0 and got[0, 1]["converged"]
    assert X.fit_pixels(df.limit(0), ["y", "x"], m).count() == 0
    for bad in (dict(solver="simplex"), dict(free=("b_d",)), dict(free=("speed",)), dict(solver="kl", free=("b_b",)), dict(solver="kl", free=("b_d", "b_f")), dict(charge=0.0)):
        with pytest.raises(ValueError):
            X.Fit(**bad)
    with pytest.raises(ValueError):
        X.Model(["a"], E, np.zeros((2, 1, len(E))))


def test_information(spark):
    m = model()
    df, _ = cells(spark, m, {"n_a": 0.002, "n_b": 0.003}, ["n_a", "n_b"], "kl", 1)
    jac, info, mu = X.jacobian_and_fisher(df, m, ["n_a", "n_b"], [0.002, 0.003])
    s = sigma(E)
    t = np.exp(-0.002 * s[0] - 0.003 * s[1])
    o = np.array([r["b"] for r in df.orderBy("i").collect()])
    assert np.allclose(mu, o * t) and np.allclose(jac, -(o * s * t).T) and np.allclose(info, (o * s * t) @ s.T)


    by_steps = X.jacobian_and_fisher(df, m, ["n_a", "n_b"], [0.002, 0.003], 1e-8)
    assert np.allclose(by_steps[0], jac, rtol=1e-3, atol=1e-4 * np.abs(jac).max()) and np.allclose(by_steps[1], info, rtol=1e-3) and np.allclose(by_steps[2], mu)


def test_differences_step_back_from_an_upper_bound():
    m = model()
    names = ["n_a", "n_b", "a", "b_a", "b_b", "b_c"]
    x = np.array([[0.002, 0.003, 2.0, 0.5, 0.5, 0.5], [0.001, 0.0, 1.0, 0.0, 0.0, -0.5]])
    _, j = X.evaluate(m, names, x)
    assert np.allclose(X.differences(m, names, x, 1e-8), j, rtol=1e-3, atol=1e-4 * np.abs(j).max())
    seen = []
    plain = X.evaluate
    try:
        X.evaluate = lambda m, names, x, slopes=True: (seen.append(x), plain(m, names, x, slopes))[1]
        X.differences(m, names, x)
    finally:
        X.evaluate = plain
    assert all((v[:, 2] <= 2.0).all() and (v[:, 3:] <= 0.5).all() for v in seen)


def test_energy_scale_is_the_axis_formula():
    m = model(fine=True)
    tof = K.TOF_FACTOR * m.flight_m / np.sqrt(E)
    e = (K.TOF_FACTOR * m.flight_m * 1.002 / (tof - 0.7)) ** 2
    t = X.evaluate(m, ["n_a", "n_b", "t0_us", "l_scale"], np.array([[0.002, 0.003, 0.7, 1.002]]), False)[0][0]
    assert np.allclose(t, np.exp(-np.array([0.002, 0.003]) @ sigma(e)), rtol=1e-3)


def test_map_of_groups(spark):
    from tofcube.operators import spatial as P

    m = model()
    truth = {"n_a": 0.002, "n_b": 0.003, "a": 0.97}
    df, x = cells(spark, m, truth, ["n_a", "n_b", "a"], "kl", 12)
    sample, beam = df.selectExpr("i AS tof_bin", "y", "x", "a AS value"), df.selectExpr("i AS tof_bin", "y", "x", "b AS value")
    dead = spark.createDataFrame([(0, 1)], "y int, x int")
    for solver in ("kl", "lm"):
        got = {(r["y"], r["x"]): r for r in P.fit_groups(P.from_counts(sample, beam), m, P.FitConfig(solver, rois=[(0, 2, 0, 5)]), ("a",), dead).collect()}
        assert set(got) == {(p // 6, p % 6) for p in range(12) if p % 6 < 5} - {(0, 1)}
        for (y, c), r in got.items():
            assert r["converged"] and abs(r["n_a"] - x[6 * y + c, 0]) < 5 * r["err_n_a"] and abs(r["a"] - 0.97) < 5 * r["err_a"]
    for free, solver in ((("t0_us",), "lm"), (("t0_us", "temperature"), "kl")):
        with pytest.raises(ValueError):
            P.fit_groups(P.from_counts(sample, beam), m, P.FitConfig(solver), free)
