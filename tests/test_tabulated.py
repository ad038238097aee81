"""Tabulated kernels over dense curves: pieces meet the pieces that their kernel points fall on, and no others."""

from threading import Timer

import numpy as np
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators import extras as X
from tofcube.operators import pieces

KERNELS = [(e, k, (k - 4) * 0.1 * e**0.2, 1.0 / (1 + abs(k - 4))) for e in (2.0, 20.0) for k in range(9)] + [(90.0, k, (k - 2) * 0.3, 0.2 * (k != 1)) for k in range(5)]


def test_a_dense_curve(spark, monkeypatch):
    """400,000 points between 1 and 4000 eV, hundreds to thousands of segments to a bucket of ln E: before, each kernel point met them all."""
    monkeypatch.setattr(pieces, "PIECE_ROWS", 5000)
    n = 400_000
    kernels = spark.createDataFrame(KERNELS, "ref_energy double, k int, offset double, weight double")
    e = 1.0 + F.col("id") * 0.01
    curve = spark.range(n).select(e.alias("e"), F.sin(e * 3.0).alias("value"), F.explode(F.array(F.lit("a"), F.lit(None))).alias("c")).withColumn("value", F.col("value") * F.when(F.col("c") == "a", 1.0).otherwise(2.0))
    out = X.tabulated_resolution(curve, kernels, 25.0, ["c"]).toPandas()
    x, want = 1.0 + np.arange(n) * 0.01, {}
    at = [0, 99, 100, 1900, 5000, 7000, 8899, 8900, *range(9000, n, 39_011), n - 1]
    rows = {(r["e"], r["k"]): r for r in X.kernels_at(spark.createDataFrame([(float(x[i]),) for i in at], "e double"), kernels).collect()}
    for i in at:
        r = [rows[x[i], k] for k in range(9) if (x[i], k) in rows]
        o, w = np.array([p["offset"] for p in r]), np.array([p["weight"] for p in r])
        w = w * np.abs(np.concatenate(([o[1] - o[0]], (o[2:] - o[:-2]) / 2, [o[-1] - o[-2]])))
        to = (K.TOF_FACTOR * 25.0 / (K.TOF_FACTOR * 25.0 / np.sqrt(x[i]) + o)) ** 2
        inside = (w > 0) & (to >= x[0]) & (to <= x[-1])
        want[x[i]] = (w[inside] * np.interp(to[inside], x, np.sin(x * 3.0))).sum() / w[inside].sum()
    for c, times in (("a", 1.0), (None, 2.0)):
        got = out[out.c == "a"] if c else out[out.c.isna()]
        assert len(got) == n
        got = got.set_index("e").value
        assert all(abs(got[a] - times * b) < 1e-9 for a, b in want.items())


def test_rows_without_a_kernel_point_on_the_curve_are_left_out(spark):
    kernels = spark.createDataFrame([(1.0, 0, 50.0, 1.0), (1.0, 1, 51.0, 1.0)], "ref_energy double, k int, offset double, weight double")
    curve = spark.createDataFrame([(float(a), 1.0) for a in range(1, 40)], "e double, value double")
    low = [a for a in range(1, 40) if (K.TOF_FACTOR * 25.0 / (K.TOF_FACTOR * 25.0 / np.sqrt(a) + 50.0)) ** 2 < 1.0]
    assert sorted(r["e"] for r in X.tabulated_resolution(curve, kernels, 25.0).collect()) == [float(a) for a in range(1, 40) if a not in low]
    assert X.tabulated_resolution(curve, kernels.where("false"), 25.0).count() == 0


def test_one_curve_of_many_points_in_a_narrow_range(spark):
    """200,000 points within a hundredth of ln E, of which each kernel point met all before: 1e11 pairs, stopped here after two minutes."""
    n, offsets, weights = 200_000, (-0.3, 0.0, 0.3), (1.0, 2.0, 1.0)
    kernels = spark.createDataFrame([(5.0, k, o, w) for k, (o, w) in enumerate(zip(offsets, weights, strict=True))], "ref_energy double, k int, offset double, weight double")
    e = 10.0 + F.col("id") * 5e-7
    curve = spark.range(n).select(e.alias("e"), F.sin(e * 300.0).alias("value"))
    stop = Timer(120, spark.sparkContext.cancelJobsWithTag, ["narrow-range"])
    spark.sparkContext.addJobTag("narrow-range")
    stop.start()
    try:
        got = X.tabulated_resolution(curve, kernels, 25.0).toPandas().sort_values("e")
    finally:
        stop.cancel()
        spark.sparkContext.removeJobTag("narrow-range")
    x = 10.0 + np.arange(n) * 5e-7
    to = (K.TOF_FACTOR * 25.0 / (K.TOF_FACTOR * 25.0 / np.sqrt(x)[:, None] + offsets)) ** 2
    wt = np.where((to >= x[0]) & (to <= x[-1]), weights, 0.0)
    assert np.array_equal(got.e, x[wt.any(1)])
    assert np.abs(got.value - ((wt * np.interp(to, x, np.sin(x * 300.0))).sum(1) / wt.sum(1))).max() < 1e-9
