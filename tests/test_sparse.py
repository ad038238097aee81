"""Compiled resolution plans and energy-dependent radii."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofcube.operators import extras as X
from tofcube.operators import models as M
from tofcube.operators import sparse as P
from tofcube.sources import resonance


@pytest.fixture(scope="module")
def plan(spark):
    e = [1.0 + 0.25 * i + 0.01 * (i % 3) for i in range(80)]
    axis = spark.createDataFrame(list(enumerate(e)), "i int, e double")
    kernels = spark.createDataFrame([(r, k, (k - 3.3) * 0.3, w) for r in (2.0, 9.0, 30.0) for k, w in enumerate((0.1, 0.5, 2.0, 1.0, 0.0, 0.2, 0.1))], "ref_energy double, k int, offset double, weight double")
    return np.array(e), axis, kernels, P.compile_plan(axis, kernels, 25.0)


def test_plan_gives_what_the_kernels_give(spark, plan):
    """A curve through the plan's rows is the curve through the kernels one by one."""
    e, axis, kernels, rows = plan
    value = np.exp(-3 / (1 + (e - 9.0) ** 2))
    curve = spark.createDataFrame([(float(a), float(v)) for a, v in zip(e, value, strict=True)], "e double, value double")
    want = {r["e"]: r["value"] for r in X.tabulated_resolution(curve, kernels, 25.0).collect()}
    spectra = spark.createDataFrame([(k, [float(v) for v in value * k]) for k in (1, 2)], "s int, values array<double>").withColumn("i", F.lit(0))
    for most in (P.MOST_WEIGHTS, 0):  # brought to the tasks, and joined
        for r in P.apply_plan(rows, spectra, ["s"], most=most).collect():
            got = dict(zip([e[x["i"]] for x in rows.orderBy("i").collect()], r["values"], strict=True))
            assert got.keys() == want.keys() and all(abs(got[k] - r["s"] * want[k]) < 1e-12 for k in want)


def test_rows_of_a_plan(plan):
    facts = P.plan_facts(plan[3]).collect()
    assert len(facts) > 70 and all(abs(r["total"] - 1) < 1e-12 and 0 < r["nnz"] <= 14 for r in facts)
    assert all(r["start"] <= r["i"] + 12 for r in facts) and len({r["start"] for r in facts}) > 40
    with pytest.raises(ValueError):
        P.apply_plan(plan[3].limit(0), plan[1], ["i"], "e")


def test_radius_tables_are_read_and_used(spark):
    """A range with a table of radii: read by interval and law, and in the cross section at each energy."""
    table = [(0, 0, 0, 0, 2, 4), (2, 1, 4, 2, 0, 0), (1.0, 0.5, 3.0, 0.7, 5.0, 0.9), (99.0, 1.3, 0.0, 0.0, 0.0, 0.0)]
    body = [(0.0, 0.8, 0, 0, 1, 0), (236.0, 0.0, 0, 0, 6, 1), (6.67, 0.5, 0.025, 0.002, 0.023, 0.0)]
    out = resonance.read([(92238.0, 236.0, 0, 0, 1, 0), (92238.0, 1.0, 0, 0, 1, 0), (1.0, 99.0, 1, 2, 1, 1), *table, *body])
    assert out["radii"] == [("92238", 1.0, 1.0, 5.0, 1), ("92238", 1.0, 3.0, 7.0, 2), ("92238", 1.0, 5.0, 9.0, 2), ("92238", 1.0, 99.0, 13.0, 2)]
    flat = spark.createDataFrame([("f", *r) for r in out["flat"]], resonance.FLAT)
    radii = spark.createDataFrame([("f", *r) for r in out["radii"]], resonance.RADII).drop("file")
    res = resonance.resolved(flat)
    e = [1.5, 3.0, 4.0, 6.0, 52.0]
    points = spark.createDataFrame([("92238", x) for x in e], "za string, e double")
    at = {r["x"]: r["y"] for r in M.radius_at(points.select("za", F.lit(1.0).alias("e_low"), F.col("e").alias("x")), radii).collect()}
    assert at == pytest.approx({1.5: 5.0, 3.0: 7.0, 4.0: 8.0, 6.0: 9.0 + 4.0 / 94, 52.0: 11.0})
    got = {r["e"]: r["total"] for r in M.slbw(points, res, radii=radii).collect()}
    for x in e:
        one = res.withColumns({"radius": F.lit(at[x]), "phase_radius": F.lit(at[x])})
        # l is 0, so the penetrability's ratio to that at the resonance follows both radii
        ratio = at[x] / (9.0 + 4.0 * 1.67 / 94)
        scaled = one.withColumn("gn", F.col("gn") * ratio)
        assert got[x] == pytest.approx(M.slbw(points.where(F.col("e") == x), scaled).first()["total"], rel=1e-9)
    assert {r["e"]: r["total"] for r in M.slbw(points, res).collect()} != got


def test_phase_shift_keeps_its_own_radius(spark):
    """NAPS 0: penetrabilities take the radius of the mass, phase shifts that of the file."""
    flat = spark.createDataFrame([("f", 92238, 236.0, 0, 1, 2, 1.0, 99.0, 0.0, 9.5, 0, 0, 236.0, 0.0, 0.0, 0, 6.67, 0.5, 0.002, 0.023, 0.0, 0.0)], resonance.FLAT)
    r = resonance.resolved(flat).first()
    assert r["phase_radius"] == 9.5 and r["radius"] == pytest.approx((0.123 * 236.0 ** (1 / 3) + 0.08) * 10) and r["phase_tabled"] and not r["radius_tabled"]
