"""Resonances and energies in blocks: the sums don't depend on the cuts, and pairs are no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tofcube.operators import models as M


def sides(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [("a" if k % 4 else "b", 178.0, 7.5, k % 3, 0.5 + k % 2, float(rng.uniform(0.5, 40)), 0.002, 0.06, 0.01 * (k % 2)) for k in range(n)]
    rows += rows[:50] + [("a", 178.0, 7.5, 1, 0.5, 5.0, None, 0.06, 0.0)]
    res = spark.createDataFrame(rows, "za string, awr double, radius double, l int, j double, er double, gn double, gg double, gf double")
    return spark.range(60).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("none"))).alias("za"), (0.7 + F.col("id") * 0.61).alias("e")), res


@pytest.mark.parametrize("name", ["slbw", "mlbw", "reich_moore"])
def test_blocks(spark, monkeypatch, name):
    energies, res = sides(spark)
    f = getattr(M, name)
    whole = f(energies, res)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan  # pairs were rows of a join before
    monkeypatch.setattr(M, "BLOCK_E", 7)
    monkeypatch.setattr(M, "BLOCK_R", 11)
    cut = f(energies, res)
    a, b = (x.orderBy("za", "e").toPandas() for x in (whole, cut))
    assert len(a) == 120 and list(a.za) == list(b.za)
    for c in ("elastic", "capture", "fission", "total"):
        assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-12), c
    # copies count as often as they are there, a resonance with a missing width not at all
    once = f(energies, res.where("gn IS NOT NULL")).orderBy("za", "e").toPandas()
    assert np.allclose(once.capture, a.capture, rtol=1e-12) and not np.allclose(f(energies, res.distinct()).orderBy("za", "e").toPandas().capture, a.capture, rtol=1e-3)
