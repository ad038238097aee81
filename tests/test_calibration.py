"""Calibration, the simplex, the tail of the resolution and the derivative of broadening against plain versions."""

import math

import numpy as np

from tofcube import constants as K
from tofcube.operators import broaden as B
from tofcube.operators import calibrate
from tofcube.plans import fits


def test_planted_offsets_are_found(spark, tmp_path):
    parts = [(k, f"Brand#{b}") for k, b in enumerate((11, 13, 25, 34))]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = fits.QUERIES["calibrate_energy"](spark, str(tmp_path)).collect()
    assert len(got) == 4
    for r in got:
        k = int(r["p_brand"][-2:])
        assert abs(r["flight_path_m"] / 25 - 1 - (k % 7 - 3) * 0.002) < 3e-4 and abs(r["t0_us"] - (k % 5 - 1)) < 0.15 and abs(r["total_density"] / 1.5e-4 - 1) < 0.02 and r["n_bins"] == 400


def test_another_isotope_and_bad_bins(spark):
    grid = np.arange(1.0, 60.0, 0.004)
    s = 10 + 4000 / (1 + ((grid - 36.7) / 0.2) ** 2) + 8000 / (1 + ((grid - 4.3) / 0.1) ** 2)
    e = np.geomspace(2.0, 50.0, 600)
    at = (K.TOF_FACTOR * 10.0 * 1.004 / (K.TOF_FACTOR * 10.0 / np.sqrt(e) - 2.0)) ** 2
    t = np.exp(-2e-4 * np.interp(at, grid, s))
    rows = [("r", float(a), math.nan if k == 9 else float(b), 0.0 if k == 10 else 0.01) for k, (a, b) in enumerate(zip(e, t, strict=True))] + [("bad", 3.0, math.nan, 0.1)]
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(grid, s, strict=True)], "e double, sigma double")
    got = {r["k"]: r for r in calibrate.calibrate_energy(spark.createDataFrame(rows, "k string, e double, t double, sigma double"), ["k"], table, 10.0).collect()}
    r = got["r"]
    assert r["n_bins"] == 598 and abs(r["flight_path_m"] - 10.04) < 2e-3 and abs(r["t0_us"] - 2.0) < 0.1 and abs(r["total_density"] - 2e-4) < 4e-6
    assert got["bad"]["n_bins"] == 0


def test_simplex():
    low, high = np.array([-5.0, -5.0]), np.array([5.0, 5.0])
    rosen = lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2
    x, v, ok = calibrate.nelder_mead(rosen, np.array([-1.2, 1.0]), low, high)
    assert ok and np.allclose(x, 1.0, atol=1e-6)
    x, v, ok = calibrate.nelder_mead(lambda p: (p[0] - 9) ** 2 + p[1] ** 2 if p[1] < 4 else math.nan, np.array([0.0, 3.0]), low, high)
    assert ok and np.allclose(x, [5.0, 0.0], atol=1e-6)


def test_tail_against_quadrature(spark):
    e = np.linspace(4.0, 9.0, 1500)
    v = 1 - 0.8 * np.exp(-(((e - 6.0) / 0.15) ** 2))
    df = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(e, v, strict=True)], "grp string, e double, value double")
    got = np.array([r["value"] for r in B.gaussian_resolution(df, 25.0, 0.5, 0.01, ["grp"], 1.2).orderBy("e").collect()])
    f = K.TOF_FACTOR * 25.0
    for k in range(300, 1200, 60):
        w, we = math.hypot(2 * 0.5 * e[k] ** 1.5 / f, 2 * 0.01 * e[k] / 25), 2 * 1.2 * e[k] ** 1.5 / f
        g = np.linspace(e[k] - 8 * w, e[k] + 14 * we, 20001)
        # exponential tail towards higher energies, blurred by the Gaussian; its peak is put at the energy
        kern = lambda d: np.array([np.exp((w / we) ** 2 / 4 - x / we) * math.erfc(w / (2 * we) - x / w) for x in d])  # noqa: B023, E731
        fine = np.linspace(-2 * w, 3 * we, 4001)
        k0 = kern(g - e[k] + fine[np.argmax(kern(fine))])
        cut = (g - e[k] + fine[np.argmax(kern(fine))]) / w - w / (2 * we) <= 5.01
        want = np.trapezoid(k0 * cut * np.interp(g, e, v), g) / np.trapezoid(k0 * cut, g)
        assert abs(got[k] - want) < 4e-3, (e[k], got[k], want)
    flat = df.withColumn("value", df["value"] * 0 + 0.7)
    assert all(math.isclose(r["value"], 0.7, rel_tol=1e-9) for r in B.gaussian_resolution(flat, 25.0, 0.5, 0.01, ["grp"], 1.2).collect())


def test_derivative_by_temperature():
    e = np.linspace(4.0, 9.0, 400)
    s = 10 + 500 / (1 + ((e - 6.67) / 0.05) ** 2)
    _, d = B.free_gas(e, s, 300.0, 238.0)
    diff = (B.free_gas(e, s, 300.5, 238.0)[0] - B.free_gas(e, s, 299.5, 238.0)[0])
    assert np.allclose(d[20:-20], diff[20:-20], rtol=2e-3, atol=2e-3 * np.abs(diff).max())


def test_several_masses(spark):
    e = np.linspace(4.0, 9.0, 200)
    rows = [(g, float(x), float(10 + 300 / (1 + ((x - c) / 0.05) ** 2)), a) for g, c, a in (("u", 6.67, 238.0), ("h", 7.8, 177.0)) for x in e]
    df = spark.createDataFrame(rows, "grp string, e double, sigma double, awr double")
    got = {g: np.array([r["sigma"] for r in B.doppler(df, 400.0, "awr", ["grp"]).where(f"grp = '{g}'").orderBy("e").collect()]) for g in "uh"}
    for g, c, a in (("u", 6.67, 238.0), ("h", 7.8, 177.0)):
        assert np.allclose(got[g], B.free_gas(e, 10 + 300 / (1 + ((e - c) / 0.05) ** 2), 400.0, a)[0])


def test_every_pixel_of_the_query_recovers(spark, tmp_path):
    spark.createDataFrame([(k, "g", [0.1]) for k in (0, 3, 41, 1999)], "vec_id bigint, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["y"] * 20 + r["x"]: r for r in fits.QUERIES["fit_multi_parameter"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 3, 41, 1999}
    for k, r in got.items():
        assert r["converged"] and abs(r["n_a"] - 0.005 - k % 4 * 0.004) < 5e-4 and abs(r["n_b"] - 0.02 + k % 5 * 0.003) < 5e-4 and abs(r["a"] - 0.9 - k % 3 * 0.05) < 0.02
