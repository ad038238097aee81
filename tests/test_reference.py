"""Operators of the imaging side against plain versions and known cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofcube import catalogue
from tofcube.functions import scalars as S
from tofcube.operators import axes, broaden, fit
from tofcube.operators import cube as C
from tofcube.operators import models as M
from tofcube.sources import project, tiff
from tofcube.streaming import histogram as H


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_normalise_cases(spark):
    d = lambda v: F.lit(float(v))
    r = one(spark, t=S.transmission(d(50), d(100)), s=S.transmission_sigma(d(50), d(100)), s0=S.transmission_sigma(d(0), d(100)), t0=S.transmission(d(5), d(0)), si=S.transmission_sigma(d(5), d(0)))
    assert r["t"] == 0.5 and math.isclose(r["s"], 0.5 * math.sqrt(1 / 50 + 1 / 100)) and math.isclose(r["s0"], math.sqrt(0.5) / 100) and r["t0"] == 0 and r["si"] == math.inf


def test_normalise_rejects_charges(spark):
    with pytest.raises(ValueError):
        C.normalize(spark.range(0), spark.range(0), 0.0)


def test_event_classes(spark):
    b = C.Binning(4, 0.0, 8.0, 3, 3)
    rows = [(1.0, 0.0, 0.0), (math.nan, 0.0, 0.0), (9.0, math.nan, 0.0), (1.0, math.inf, 0.0), (1.0, 2.5, 0.0), (1.0, -0.5, 0.0), (7.999, 2.4, 2.4), (8.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "tof double, x double, y double")
    assert tuple(C.retention(df, b).first()) == (8, 2, 2, 2, 2)
    assert {tuple(r) for r in C.histogram(df, b).collect()} == {(0, 0, 0, 1), (3, 2, 2, 1)}


def test_rebin_short_last_group(spark):
    cube = spark.createDataFrame([(t, 0, 0, float(t)) for t in range(7)], "tof_bin int, y int, x int, value double")
    assert [r["value"] for r in C.rebin(cube, 3).orderBy("tof_bin").collect()] == [3.0, 12.0, 6.0]
    assert [r["value"] for r in C.rebin(cube, 3, "avg").orderBy("tof_bin").collect()] == [1.0, 4.0, 6.0]
    assert C.rebin(cube, 1).count() == 7


def test_erfc(spark):
    xs = [x / 50 for x in range(-400, 401)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(broaden.erfc(F.col("x"))).collect()]
    assert all(math.isclose(g, math.erfc(x), rel_tol=1e-10, abs_tol=1e-15) for g, x in zip(sorted(got), sorted(map(lambda x: x, xs), reverse=True), strict=True))


def plain_doppler(e, sig, temp, awr):
    u = math.sqrt(8.617333262e-5 * temp / awr)
    v = np.sqrt(e)
    y = v * sig
    v = np.concatenate(([max(v[0] - 6 * u, 1e-12)], v, [v[-1] + 6 * u]))
    y = np.concatenate(([y[0]], y, [y[-1]]))
    out = []
    for x in np.sqrt(e):
        # fine quadrature of the piecewise-linear function against the kernel
        w = np.linspace(max(x - 6.5 * u, v[0]), min(x + 6.5 * u, v[-1]), 20001)
        k = np.exp(-(((w - x) / u) ** 2))
        out.append(np.trapezoid(k * np.interp(w, v, y), w) / np.trapezoid(k, w) / x)
    return np.array(out)


def test_doppler(spark):
    e = np.linspace(4.0, 9.0, 120)
    sig = 10 + 500 / (1 + ((e - 6.67) / 0.05) ** 2)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(e, sig, strict=True)], "grp string, e double, sigma double")
    got = np.array([r["sigma"] for r in broaden.doppler(df, 293.6, 238.0, ["grp"]).orderBy("e").collect()])
    assert len(got) == 120 and np.allclose(got, plain_doppler(e, sig, 293.6, 238.0), rtol=2e-4)


def test_resolution_keeps_constants_and_blurs(spark):
    e = np.linspace(4.0, 9.0, 200)
    v = 1 - 0.8 * np.exp(-(((e - 6.0) / 0.03) ** 2))
    rows = [("c", float(a), 0.7) for a in e] + [("d", float(a), float(b)) for a, b in zip(e, v, strict=True)]
    df = spark.createDataFrame(rows, "grp string, e double, value double")
    out = broaden.gaussian_resolution(df, 25.0, 0.8, 0.01, ["grp"]).orderBy("e").collect()
    assert all(math.isclose(r["value"], 0.7, rel_tol=1e-9) for r in out if r["grp"] == "c")
    got = np.array([r["value"] for r in out if r["grp"] == "d"])
    want = []
    for x in e:
        w = math.sqrt((2 * 0.8 * x**1.5 / (72.2982543982928 * 25)) ** 2 + (2 * 0.01 * x / 25) ** 2)
        g = np.linspace(max(x - 5 * w, e[0]), min(x + 5 * w, e[-1]), 20001)
        k = np.exp(-(((g - x) / w) ** 2))
        want.append(np.trapezoid(k * np.interp(g, e, v), g) / np.trapezoid(k, g))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def spectra(spark, kind):
    rng = np.random.default_rng(1)
    s = 5 + 60 * np.exp(-(((np.arange(60) - 30) / 6.0) ** 2))
    rows = []
    for p in range(30):
        n = 0.005 + 0.001 * p
        t = np.exp(-n * s)
        if kind == "lm":
            bins = [(float(x), 1e4, float(y)) for x, y in zip(t + rng.normal(0, 0.01, 60), s, strict=True)]
        else:
            bins = [(float(rng.poisson(2000 * x)), 2000.0, float(y)) for x, y in zip(t, s, strict=True)]
        rows.append((0, p, bins))
    rows += [(1, 0, []), (1, 1, [(1.0, 1.0, 0.0)] * 4)]
    names = "t double, w double, s double" if kind == "lm" else "k double, o double, s double"
    return spark.createDataFrame(rows, f"y int, x int, bins array<struct<{names.replace(' double', ':double')}>>")


@pytest.mark.parametrize("kind", ["lm", "kl"])
def test_fit_recovers(spark, kind):
    got = {(r["y"], r["x"]): r for r in fit.fit_map(spectra(spark, kind), F.col("bins"), kind).collect()}
    for p in range(30):
        r = got[0, p]
        assert r["converged"] and abs(r["density"] - 0.005 - 0.001 * p) < 5 * r["uncertainty"] + 1e-9 and 0.3 < r["objective_r"] < 2.5
    assert not got[1, 0]["converged"] and math.isnan(got[1, 0]["density"])
    assert not got[1, 1]["converged"]  # no curvature


def test_kl_gradient_is_the_slope(spark):
    bins = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(900.0).alias("o"), F.lit(s).alias("s")) for k, s in ((400, 10.0), (700, 3.0), (0, 30.0))])
    at = fit.joint_poisson(bins, 1.1)
    lo, mid, hi = (one(spark, e=at(F.lit(n)))["e"] for n in (0.05 - 1e-6, 0.05, 0.05 + 1e-6))
    assert math.isclose((hi["f"] - lo["f"]) / 2e-6, -2 * mid["g"], rel_tol=1e-5)


def test_single_resonance_peaks_and_unitarity(spark):
    res = spark.createDataFrame([("u", 236.006, 9.48, 0, 0.5, 6.67, 0.0015, 0.023, 0.0)], "za string, awr double, radius double, l int, j double, er double, gn double, gg double, gf double")
    e = spark.createDataFrame([("u", 1.0 + 0.01 * k) for k in range(1200)], "za string, e double")
    tables = {f.__name__: f(e, res).orderBy("e").collect() for f in (M.slbw, M.mlbw, M.reich_moore)}
    for rows in tables.values():
        assert abs(max(rows, key=lambda r: r["total"])["e"] - 6.67) < 0.02
        assert all(r["capture"] > -1e-9 and r["elastic"] > 0 for r in rows)
    for a, b, c in zip(*tables.values(), strict=True):
        assert math.isclose(a["total"], b["total"], rel_tol=0.05, abs_tol=0.05) and math.isclose(b["total"], c["total"], rel_tol=0.05, abs_tol=0.05), (a, b, c)


def test_interpolation_laws(spark):
    pts = [(1.0, 2.0), (2.0, 8.0), (4.0, 4.0)]
    table = spark.createDataFrame([(str(law), x, y, law) for law in range(1, 7) for x, y in pts], "k string, x double, y double, law int")
    xs = spark.createDataFrame([(str(law), x) for law in range(1, 7) for x in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["y"] for r in M.interpolate(xs, table, ["k"]).collect()}
    assert len(got) == 42 and all(got[str(law), 0.5] == 2.0 and got[str(law), 9.0] == 4.0 and got[str(law), 2.0] == 8.0 for law in range(1, 7))
    assert got["1", 1.5] == 2 and got["2", 1.5] == 5 and math.isclose(got["3", 3.0], 8 - 4 * math.log(1.5) / math.log(2)) and math.isclose(got["4", 1.5], 4) and math.isclose(got["5", 3.0], 8 * 1.5**-1)


def test_axis_errors_and_dedup(spark):
    with pytest.raises(Exception, match="positive"):
        axes.edges_to_energy(axes.linspace_edges(spark, 0.0, 10.0, 5), 25.0).collect()
    v = spark.createDataFrame([(x,) for x in (1.0, 1.0 + 0.6e-10, 1.0 + 1.2e-10, 2.0)], "value double")
    assert [r["value"] for r in axes.dedup_sorted(v).orderBy("i").collect()] == [1.0, 1.0 + 1.2e-10, 2.0]


def test_tiff_folder_and_round_trip(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f_{k:02}.{'TIF' if k == 1 else 'tif'}").write_bytes(tiff.tiff_bytes(np.arange(6.0).reshape(2, 3) + 10 * k))
    (tmp_path / "note.txt").write_text("x")
    cube = tiff.load_tiff(spark, str(tmp_path), "f_*.tif")
    assert {tuple(r) for r in cube.collect()} == {(k, i // 3, i % 3, 10.0 * k + i) for k in range(3) for i in range(6)}
    maps = spark.createDataFrame([("density", "U-238", 0, 1, 2.5), ("density", "U-238", 1, 2, 4.0)], "metric string, label string, y int, x int, value double")
    raw = project.map_tiff(maps, 2, 3).first()["tiff"]
    (page,) = tiff.frames(bytes(raw))
    assert page[0, 1] == 2.5 and page[1, 2] == 4.0 and np.isnan(page[0, 0])


def test_project_and_report(spark, tmp_path):
    fits = spark.createDataFrame([("U|8", 1.0, True), ("U|8", 3.0, True), ("U|8", math.nan, False), ("Fe", math.nan, False)], "label string, density double, converged boolean")
    project.save_project(spark, str(tmp_path / "p"), {"solver": "lm"}, {"fits": fits})
    config, tables = project.load_project(spark, str(tmp_path / "p"))
    assert config == {"solver": "lm"} and tables["fits"].count() == 4
    text = project.markdown_report(fits, "T", [("now", "fit", "a|b")])
    assert "| U\\|8 | 2.000000e+00 | 1.000000e+00 |" in text and "| Fe | N/A | N/A |" in text and "a\\|b" in text


def test_streaming_equals_batch(spark, tmp_path):
    b = C.Binning(5, 0.0, 50.0, 4, 4)
    rows = spark.range(400).select((F.col("id") * 600).cast("timestamp").alias("ts"), (F.col("id") % 60).cast("double").alias("tof"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = H.windowed_histogram(stream, b).writeStream.format("memory").queryName("hist").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT tof_bin, y, x, sum(value) FROM hist GROUP BY ALL").collect()}
    assert got == {tuple(r) for r in C.histogram(rows, b).collect()}


def test_catalogue_names_agree():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def line(*fields, mat=9237, mf=2, mt=151):
    return "".join(f"{x:>11}" for x in fields).ljust(66) + f"{mat:4d}{mf:2d}{mt:3d}"


def test_resonance_file(spark):
    from tofcube.sources import resonance

    head = [line("9.223800+4", "2.360060+2", 0, 0, 1, 0), line("9.223800+4", "1.000000+0", 0, 0, 2, 0)]
    rm = [line("1.000000-5", "1.000000+2", 1, 3, 0, 0), line("0.0", "9.480000-1", 0, 0, 1, 0), line("2.360060+2", "0.0", 0, 0, 12, 2), line("6.674280+0", "5.000000-1", "1.492300-3", "2.271100-2", "0.0", "9.990000-9"), line("-1.0+1", "5.000000-1", "1.0-3", "2.3-2", "", "")]
    bw = [line("1.000000+2", "2.000000+2", 1, 2, 1, 1), line("0.0", "0.0", 0, 0, 1, 4), line(4, 2), line(1.0, 2.0, 3.0, 4.0, 5.0, 6.0), line(1.0, 2.0), line("0.5", "9.0-1", 0, 0, 1, 0), line("2.360060+2", "0.0", 1, 0, 6, 1), line("1.5+2", "1.5", "3.3-2", "1.0-2", "2.3-2", "1.0-4")]
    rows = [line("x", mf=1)] + head + rm + bw + [line(0, mt=0)]
    df = spark.createDataFrame([("u", k, t) for k, t in enumerate(rows)], "file string, lineno int, line string")
    got = resonance.resonance_table(df).orderBy("range_idx", "er").collect()
    assert [(r["range_idx"], r["l"], r["er"], r["gn"], r["gg"]) for r in got] == [(0, 0, -10.0, 1e-3, 2.3e-2), (0, 0, 6.67428, 1.4923e-3, 2.2711e-2), (1, 1, 150.0, 1e-2, 2.3e-2)]
    assert got[1]["za"] == 92238 and math.isclose(got[1]["radius_fm"], 9.48) and got[2]["gfa"] == 1e-4 and got[2]["spin"] == 0.5
    e = spark.range(600).select(F.lit("92238").alias("za"), (6.0 + F.col("id") * 0.002).alias("e"))
    top = M.reich_moore(e, resonance.resolved(resonance.resonance_table(df)).where("l = 0 AND er > 0")).orderBy(F.desc("total")).first()
    assert abs(top["e"] - 6.67428) < 0.005


def test_map_query(spark):
    from tofcube.operators import spatial as P

    rng = np.random.default_rng(3)
    s = 5 + 60 * np.exp(-(((np.arange(40) - 20) / 5.0) ** 2))
    truth = {(y, x): 0.004 + 0.002 * (3 * y + x) for y in range(3) for x in range(3)}
    rows = [(t, y, x, float(rng.poisson(4000 * math.exp(-n * s[t]))), 4000.0) for (y, x), n in truth.items() for t in range(40)]
    df = spark.createDataFrame(rows, "tof_bin int, y int, x int, k double, o double")
    sample, beam = df.selectExpr("tof_bin", "y", "x", "k AS value"), df.selectExpr("tof_bin", "y", "x", "o AS value")
    sigma = spark.createDataFrame([(t, 1.0 + t, float(v)) for t, v in enumerate(s)], "tof_bin int, energy double, sigma double")
    dead = spark.createDataFrame([(1, 1)], "y int, x int")
    t = C.normalize(sample, beam)
    trans = P.from_transmission(t.selectExpr("tof_bin", "y", "x", "transmission AS value"), t.selectExpr("tof_bin", "y", "x", "sigma AS value"))
    for data, config in ((P.from_counts(sample, beam), P.FitConfig()), (P.from_counts(sample, beam), P.FitConfig("lm")), (trans, P.FitConfig()), (trans, P.FitConfig("poisson")), (P.from_counts_with_nuisance(sample, beam), P.FitConfig(window=(3.0, 35.0)))):
        got = P.with_all_pixels(P.fit_cube(data, sigma, config, dead), sample.select("y", "x").distinct()).collect()
        assert len(got) == 9
        for r in got:
            if (r["y"], r["x"]) == (1, 1):
                assert math.isnan(r["density"]) and not r["converged"]
            else:
                assert r["converged"] and abs(r["density"] - truth[r["y"], r["x"]]) < 1.5e-3
    for data, config in ((P.from_counts_with_nuisance(sample, beam), P.FitConfig("lm")), (trans, P.FitConfig("kl", window=(3.0, 9.0))), (P.from_counts_with_nuisance(sample, beam, beam), P.FitConfig())):
        with pytest.raises(ValueError):
            P.fit_cube(data, sigma, config)
    with pytest.raises(ValueError):
        P.FitConfig("simplex")
    none = P.fit_cube(P.from_counts(sample, beam), sigma, P.FitConfig(), sample.select("y", "x").distinct())
    assert none.count() == 0
