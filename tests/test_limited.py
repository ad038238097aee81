"""R-matrix limited ranges, unresolved tables and Coulomb functions."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.test_reference import line
from tofcube.operators import limited as L
from tofcube.operators import models as M
from tofcube.sources import resonance


def test_coulomb_functions():
    rho = np.array([0.3, 1.0, 4.0, 11.0])
    f, g, df, dg = L.coulomb(0, np.zeros(4), rho)
    assert np.allclose(f, np.sin(rho), atol=1e-9) and np.allclose(g, np.cos(rho), atol=1e-9) and np.allclose(dg, -np.sin(rho), atol=1e-9)
    for l in range(4):
        p, s, phi = L.hard_sphere(l, rho)
        f, g, df, dg = L.coulomb(l, np.zeros(4), rho)
        assert np.allclose(rho / (f * f + g * g), p, rtol=1e-7) and np.allclose(rho * (f * df + g * dg) / (f * f + g * g), s, rtol=1e-6, atol=1e-8)
        assert np.allclose(np.sin(2 * np.arctan2(f, g)), np.sin(2 * phi), atol=1e-7)
    # tabulated to five digits: F0 and G0 at eta 1, rho 5
    f, g, df, dg = L.coulomb(0, np.array([1.0]), np.array([5.0]))
    assert abs(f[0] - 0.68494) < 1e-4 and abs(g[0] + 0.89841) < 2e-4
    for eta, r, l in ((2.5, 3.0, 1), (0.7, 9.0, 3)):
        h = 1e-4
        w = [L.coulomb(l, np.array([eta]), np.array([r + k * h])) for k in (-1, 0, 1)]
        for k in (0, 1):
            second = (w[2][k][0] - 2 * w[1][k][0] + w[0][k][0]) / h**2
            assert math.isclose(second, (2 * eta / r + l * (l + 1) / r**2 - 1) * w[1][k][0], rel_tol=2e-3, abs_tol=1e-3)
        assert math.isclose(w[1][2][0] * w[1][1][0] - w[1][0][0] * w[1][3][0], 1.0, rel_tol=1e-9)


def test_closed_shift():
    k = np.array([0.3, 0.7, 2.0])
    assert np.allclose(L.closed_shift(1, k), -1 / (1 - k**2)) and np.allclose(L.closed_shift(2, k), -(18 - 3 * k**2) / (9 - 3 * k**2 + k**4))


def one_group(krm=3, extra=()):
    n = dict(ma=1.0, mb=236.006, za=0.0, zb=92.0, q=0.0, shf=0, mt=2, l=0, bnd=0.0, ape=9.48, apt=9.48)
    return dict(awr=236.006, spin=0.0, j=0.5, krm=krm, channels=[n, *extra], resonances=[dict(er=6.67, gg=0.023, widths=[0.0015, *[0.01] * len(extra)]), dict(er=20.9, gg=0.023, widths=[0.0087, *[-0.02] * len(extra)])])


def test_matches_reich_moore(spark):
    """One neutron channel, and one with fission as a channel without a barrier: the same as Reich-Moore."""
    e = spark.range(500).select(F.lit("u").alias("za"), (1.0 + F.col("id") * 0.05).alias("e"))
    fission = dict(ma=0.0, mb=0.0, za=0.0, zb=0.0, q=0.0, shf=0, mt=18, l=0, bnd=0.0, ape=1.0, apt=1.0)
    for extra in ((), (fission,)):
        g = one_group(extra=extra)
        row = ("u", 0.0, 100.0, 0, g["awr"], g["spin"], g["j"], g["krm"], g["channels"], g["resonances"])
        got = L.limited(e, spark.createDataFrame([row], L.GROUPS)).orderBy("e").collect()
        res = spark.createDataFrame([("u", 236.006, 9.48, 0, 0.5, r["er"], r["widths"][0], 0.023, r["widths"][1] if extra else 0.0) for r in g["resonances"]], "za string, awr double, radius double, l int, j double, er double, gn double, gg double, gf double")
        want = M.reich_moore(e, res).orderBy("e").collect()
        for a, b in zip(got, want, strict=True):
            assert all(math.isclose(a[c], b[c], rel_tol=1e-7, abs_tol=1e-9) for c in ("elastic", "fission", "total")) and math.isclose(a["capture"], max(b["capture"], 0), rel_tol=1e-6, abs_tol=1e-7)


def test_inelastic_threshold_and_charged_channel():
    ine = dict(ma=1.0, mb=236.006, za=0.0, zb=92.0, q=-10.0, shf=1, mt=51, l=0, bnd=0.0, ape=9.48, apt=9.48)
    e = np.linspace(5.0, 25.0, 300)
    total, elastic, capture, fission = L.spin_group(e, one_group(extra=(ine,)))
    rest = total - elastic - capture - fission
    below = e * 236.006 / 237.006 < 10.0
    assert np.abs(rest[below]).max() < 1e-9 and rest[~below].max() > 0.1 and (elastic > 0).all()
    alpha = dict(ma=3.97, mb=9.9, za=2.0, zb=3.0, q=2.79e6, shf=0, mt=800, l=0, bnd=0.0, ape=4.0, apt=4.0)
    t2, e2, c2, f2 = L.spin_group(e, one_group(extra=(alpha,)))
    assert np.isfinite(t2).all() and (t2 - e2 - c2 - f2 > -1e-9).all() and (t2 - e2 - c2 - f2).max() > 0.1


def test_files(spark):
    head = [line("9.223800+4", "2.360060+2", 0, 0, 1, 0), line("9.223800+4", "1.000000+0", 0, 0, 3, 0)]
    rml = [line("1.0-5", "1.0+2", 1, 7, 0, 0), line("0.0", "9.480000-1", 0, 3, 1, 0), line(0, 0, 1, 0, 12, 2), line("1.0", "2.36006+2", 0, 92, 0.5, 0.0), line(0.0, 1, 0, 2, 1.0, 1.0), line("0.5", "1.0", 0, 0, 12, 2), line(0, 0, 0, 0, 0, 0), line(1, 0, 0.5, 0.0, 0.0, "9.48-1"), line(0, 0, 0, 2, 12, 2), line(6.67, 0.023, 0.0015), line(20.9, 0.023, 0.0087)]
    urr2 = [line("1.0+2", "1.0+3", 2, 2, 0, 0), line("0.5", "9.0-1", 0, 0, 1, 0), line("2.36006+2", 0, 1, 0, 1, 0), line("1.5", 0, 5, 0, 24, 3), line(0, 0, 0, 1, 0, 1), line(100.0, 20.0, 0.0, 0.002, 0.023, 0.0), line(500.0, 19.0, 0.001, 0.004, 0.023, 0.0), line(1000.0, 18.0, 0.002, 0.006, 0.023, 0.0)]
    urr1 = [line("1.0+3", "1.0+4", 2, 1, 0, 0), line("0.0", "9.0-1", 0, 0, 1, 0), line("2.36006+2", 0, 0, 0, 12, 2), line(20.0, 0.5, 1, 0.002, 0.023, 0.0), line(15.0, 1.5, 1, 0.001, 0.022, 0.01)]
    rows = head + rml + urr2 + urr1
    df = spark.createDataFrame([("u", k, t) for k, t in enumerate(rows)], "file string, lineno int, line string")
    (g,) = resonance.limited_groups(df).collect()
    assert g["za"] == "92238" and g["krm"] == 3 and len(g["channels"]) == 1 and g["channels"][0]["mt"] == 2 and math.isclose(g["channels"][0]["ape"], 9.48) and [r["er"] for r in g["resonances"]] == [6.67, 20.9] and list(g["resonances"][1]["widths"]) == [0.0087]
    t = resonance.unresolved_table(df)
    got = [(r["e_low"], r["l"], r["j"], r["law"], r["reduced"], r["x"], r["spacing"], r["gn"]) for r in t.orderBy("e_low", "j", "x").collect()]
    assert got == [(100.0, 1, 1.5, 5, False, 100.0, 20.0, 0.002), (100.0, 1, 1.5, 5, False, 500.0, 19.0, 0.004), (100.0, 1, 1.5, 5, False, 1000.0, 18.0, 0.006), (1000.0, 0, 0.5, 2, True, 1000.0, 20.0, 0.002), (1000.0, 0, 1.5, 2, True, 1000.0, 15.0, 0.001)]
    assert [(r["range_idx"], r["resonances"]) for r in resonance.resonance_counts(resonance.resonance_table(df)).orderBy("range_idx").collect()] == [(0, 0), (1, 0), (2, 0)]
    xs = M.unresolved(spark.createDataFrame([("92238", e) for e in (50.0, 223.0, 5000.0)], "za string, e double"), t).orderBy("e").collect()
    assert [r["e"] for r in xs] == [223.0, 5000.0]
    at = lambda a, b: math.exp(math.log(a) + math.log(b / a) * math.log(223 / 100) / math.log(5))
    gn, gg, gx, d = at(0.002, 0.004), 0.023, 0.001 * (223 - 100) / 400, at(20.0, 19.0)
    hc = 6.582119569e-16 * 2.99792458e8 * 1e15
    k2 = 2 * 939.56542052e6 * (236.006 / 237.006) ** 2 * 223 / hc**2
    pre = math.pi / k2 / 100 * 4 / 4 * 2 * math.pi * gn / d / (gn + gg + gx)
    assert math.isclose(xs[0]["capture"], pre * gg, rel_tol=1e-9) and math.isclose(xs[0]["total"], pre * (gn + gg + gx) + 4 * math.pi * 0.81, rel_tol=1e-9)


def test_background_terms(spark):
    """A real R added to the neutron channel: against the one-channel formula in numpy."""
    e = np.linspace(1.0, 60.0, 80)
    t = spark.createDataFrame([("u", float(x)) for x in e], "za string, e double")
    res = spark.createDataFrame([("u", 236.006, 9.48, 0, 0.5, 6.67, 0.0015, 0.023, 0.0), ("u", 236.006, 9.48, 1, 0.5, 11.0, 1e-6, 0.023, 0.0)], "za string, awr double, radius double, l int, j double, er double, gn double, gg double, gf double")
    ext = spark.createDataFrame([("u", 0, -0.5, 0.05, 1e-4, 1e-6, 0.02, 1e-4, -100.0, 900.0)], "za string, l int, j double, con double, lin double, quad double, s_con double, s_lin double, e_low double, e_up double")
    got = np.array([r["total"] for r in M.reich_moore(t, res, external=ext).orderBy("e").collect()])
    plain = np.array([r["total"] for r in M.reich_moore(t, res).orderBy("e").collect()])
    only = np.array([r["total"] for r in M.reich_moore(t, res.where("l = 0")).orderBy("e").collect()])
    k = lambda x: L.wave_number(x * 236.006 / 237.006, 236.006 / 237.006)
    rho = k(e) * 9.48
    bg = 0.05 + 1e-4 * e + 1e-6 * e * e - (0.02 + 1e-4 * e) * np.log((900 - e) / (e + 100)) + 1e-4 * 1000
    r = (0.0015 / (2 * k(np.array([6.67])) * 9.48)) / (6.67 - e - 0.0115j)
    total = lambda r: 2 * math.pi / k(e) ** 2 / 100 * (1 - (np.exp(-2j * rho) * (1 + 1j * rho * r) / (1 - 1j * rho * r)).real)
    assert np.allclose(only, total(r), rtol=1e-8) and np.allclose(got - plain, total(r + bg) - total(r), rtol=1e-6, atol=1e-7)


def test_no_row_holds_a_ranges_groups(spark):
    """A range of many (l, j) moves point by point: nothing in the plan collects them. Clamped ends, one point, shared ends and tables of unequal length as before."""
    rows = [("1", 178.0, 3.5, 7.5, lo, hi, k % 3, 0.5 + k, 2, False, x, 2.0 + 0.1 * x, 0.0, 0.01 * (1 + k % 2), 0.06, 0.0) for lo, hi in ((2.0, 10.0), (10.0, 35.0)) for k in range(40) for x in ([lo + 1.0] if k % 4 == 0 else [lo + 1.0, lo + 3.0, hi])]
    t = spark.createDataFrame(rows, "za string, awr double, spin double, radius double, e_low double, e_high double, l int, j double, law int, reduced boolean, x double, spacing double, gx double, gn double, gg double, gf double")
    at = [2.0, 2.5, 3.0, 4.0, 9.0, 10.0, 11.5, 35.0, 36.0]
    out = M.unresolved(spark.createDataFrame([("1", e) for e in at], "za string, e double"), t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "parts" not in plan
    got = {r["e"]: r for r in out.collect()}
    assert sorted(got) == at[:-1]
    for e in at[:-1]:
        capture = 0.0
        for lo, hi in ((2.0, 10.0), (10.0, 35.0)):
            if lo <= e <= hi:
                pi_k2 = float(spark.range(1).select(M.S.pi_over_k2_barns(F.lit(e), F.lit(178.0))).first()[0])
                for k in range(40):
                    x = lo + 1.0 if k % 4 == 0 else min(max(e, lo + 1.0), hi)
                    gn = 0.01 * (1 + k % 2)
                    capture += pi_k2 * (2 * (0.5 + k) + 1) / 16 * 2 * np.pi * gn * 0.06 / (2.0 + 0.1 * x) / (gn + 0.06)
        assert abs(got[e]["capture"] / capture - 1) < 1e-9, e
