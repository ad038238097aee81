"""Fits per pixel, broadening and the forward model, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators import broaden as B
from tofcube.operators import calibrate, cube, fit, spatial
from tofcube.operators import models as M
from tofcube.operators import multifit as X
from tofcube.plans import cubes as C
from tofcube.plans import models as P
from tofcube.plans import scans


def pixel_bins(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """y, x, bins: pixels made of embeddings (vec_id), true density 0.01 to 0.05; deterministic pseudo-noise."""
    sp = P.spectra(spark, sf).select("iso", "i", (F.col("sigma") + 1.0).alias("sig"))
    n = 0.01 + F.col("iso") % 5 * 0.01
    wob = (F.col("iso") * 31 + F.col("i") * 17) % 13 - 6
    t = F.exp(-n * F.col("sig"))
    if kind == "lm":
        one = F.struct(F.col("i"), (t + wob * 0.001).alias("t"), F.lit(1e4).alias("w"), F.col("sig").alias("s"))
    else:
        one = F.struct(F.col("i"), F.round(t * 1000 + wob * 2).alias("k"), F.lit(1000.0).alias("o"), F.col("sig").alias("s"))
    held = sp.select("iso", one.alias("b")).groupBy("iso").agg(F.array_sort(F.collect_list("b")).alias("bins"))
    return held.select(F.floor(F.col("iso") / 20).cast("int").alias("y"), (F.col("iso") % 20).cast("int").alias("x"), "bins")


def spatial_map(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return fit.fit_map(pixel_bins(spark, sf, kind), F.col("bins"), kind)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("y", "x", F.round("density", 5).alias("density"), "converged")


def event_map(spark: SparkSession, sf: str) -> DataFrame:
    """The whole map query on the event cubes: dead pixels out, likelihood with the mean open beam."""
    sigma = spark.range(50).select(F.col("id").cast("int").alias("tof_bin"), (1.0 + F.col("id")).alias("energy"), (1.0 + 20.0 / (1.0 + F.pow((F.col("id") - 12.0) / 4.0, F.lit(2.0)))).alias("sigma"))
    sample = C.full(spark, sf, "view")
    fits = spatial.fit_cube(spatial.from_counts(sample, C.full(spark, sf, "click")), sigma, spatial.FitConfig(start=0.05), cube.dead_pixels(sample))
    return spatial.with_all_pixels(fits, sample.select("y", "x").distinct())


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """grp, e, sigma of single-level resonances on a fine grid for every isotope."""
    z = P.energies(spark, sf).select("za").distinct()
    e = z.select("za", F.explode(F.sequence(F.lit(0), F.lit(799))).alias("m")).select("za", (1.0 + F.col("m") * 0.02).alias("e"))
    return M.slbw(e, P.resonances(spark, sf)).select(F.col("za").alias("grp"), "e", F.col("total").alias("sigma"))


AXIS = np.linspace(2.0, 30.0, 64)


def dips(spark: SparkSession) -> DataFrame:
    """e, sigma: two isotopes' dips on a fine grid."""
    e = 1.5 + F.col("id") * 0.01
    dip = lambda c, h, w: h / (1.0 + F.pow((e - c) / w, F.lit(2.0)))
    return spark.range(3500).select(e.alias("e"), (20.0 + dip(6.67, 9000.0, 0.15) + dip(20.9, 7000.0, 0.3) + dip(11.2, 5000.0, 0.2)).alias("sigma"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A spectrum for each brand of part: nominal energies, transmission of the dips at a path and an offset of its own."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().withColumn("k", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int"))
    path, t0 = 25.0 * (1.0 + (F.col("k") % 7 - 3) * 0.002), F.col("k") % 5 - 1.0
    bins = p.select("p_brand", path.alias("path"), t0.alias("t0"), F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i")).withColumn("e", 2.0 + F.col("i") * 0.07)
    at = F.pow(K.TOF_FACTOR * F.col("path") / (K.TOF_FACTOR * 25.0 / F.sqrt("e") - F.col("t0")), F.lit(2.0))
    dip = lambda c, h, w: h / (1.0 + F.pow((at - c) / w, F.lit(2.0)))
    sigma = 20.0 + dip(6.67, 9000.0, 0.15) + dip(20.9, 7000.0, 0.3) + dip(11.2, 5000.0, 0.2)
    wob = (F.col("i") * 17 % 13 - 6) * 0.0005
    return bins.select("p_brand", "e", (F.exp(-1.5e-4 * sigma) + wob).alias("t"), F.lit(0.002).alias("sigma"))


def multi_model(spark: SparkSession, sf: str) -> X.Model:
    """Two groups on 64 bins, dips of their own; the axis is that of the spectra made from embeddings."""
    one = [5.0 + 60.0 / (1.0 + ((AXIS - c) / 1.2) ** 2) for c in (9.0, 19.0)]
    return X.Model(["a", "b"], AXIS, np.array(one)[:, None])


def multi_cells(spark: SparkSession, sf: str, model: X.Model) -> DataFrame:
    """Counts of pixels made of embeddings: two densities and a normalisation of its own for each, deterministic pseudo-noise."""
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(model.sigma[:, 0].T)], "i int, sa double, sb double")
    p = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("iso"))
    rows = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).join(F.broadcast(table), "i")  # one row for each bin
    t = (0.9 + F.col("iso") % 3 * 0.05) * F.exp(-(0.005 + F.col("iso") % 4 * 0.004) * F.col("sa") - (0.02 - F.col("iso") % 5 * 0.003) * F.col("sb"))
    wob = (F.col("iso") * 31 + F.col("i") * 17) % 13 - 6
    return rows.select(F.floor(F.col("iso") / 20).cast("int").alias("y"), (F.col("iso") % 20).cast("int").alias("x"), "i", F.round(t * 10000 + wob * 5).alias("a"), F.lit(10000.0).alias("b"))


def fit_multi(spark: SparkSession, sf: str) -> DataFrame:
    m = multi_model(spark, sf)
    out = X.fit_pixels(multi_cells(spark, sf, m), ["y", "x"], m, X.Fit("kl", ("a",), density=0.01))
    return out.select("y", "x", F.round("n_a", 6).alias("n_a"), F.round("n_b", 6).alias("n_b"), F.round("a", 5).alias("a"), "converged")


QUERIES = {
    "fit_multi_parameter": fit_multi,
    "calibrate_energy": lambda s, d: calibrate.calibrate_energy(runs(s, d), ["p_brand"], dips(s), 25.0).select("p_brand", F.round("flight_path_m", 6).alias("flight_path_m"), F.round("t0_us", 4).alias("t0_us"), F.round("total_density", 9).alias("total_density"), "n_bins"),
    "doppler_derivative": lambda s, d: B.doppler_with_derivative(curves(s, d), 293.6, 178.0, ["grp"]).select("grp", F.round("e", 6).alias("e"), F.round("sigma", 4).alias("sigma"), F.round("d_sigma", 6).alias("d_sigma")),
    "resolution_tail": lambda s, d: B.gaussian_resolution(curves(s, d).select("grp", "e", F.exp(-0.01 * F.col("sigma")).alias("value")), 25.0, 0.5, 0.01, ["grp"], 1.5).select("grp", F.round("e", 6).alias("e"), F.round("value", 9).alias("value")),
    "fit_spectrum_lm": lambda s, d: _rounded(spatial_map(s, d, "lm")),
    "fit_counts_kl": lambda s, d: _rounded(spatial_map(s, d, "kl")),
    "spatial_map": lambda s, d: event_map(s, d).select("y", "x", F.round("density", 5).alias("density"), "converged"),
    "map_report": lambda s, d: fit.map_summary(spatial_map(s, d, "lm")).select("n_total", "n_converged", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")),
    "doppler_broaden": lambda s, d: B.doppler(curves(s, d), 293.6, 178.0, ["grp"]).select("grp", F.round("e", 6).alias("e"), F.round("sigma", 4).alias("sigma")),
    "resolution_broaden": lambda s, d: B.gaussian_resolution(curves(s, d).select("grp", "e", F.exp(-0.01 * F.col("sigma")).alias("value")), 25.0, 0.5, 0.01, ["grp"]).select("grp", F.round("e", 6).alias("e"), F.round("value", 9).alias("value")),
    "forward_model": lambda s, d: B.forward(curves(s, d), P.energies(s, d).select(F.col("za").alias("grp")).distinct().withColumn("n", F.lit(0.002)), 293.6, 178.0, 25.0, 0.5, 0.01).select(F.round("e", 6).alias("e"), F.round("value", 9).alias("value")),
}
_SEEN = "cv AS MATERIALIZED (SELECT grp, e, exp(-0.01::DOUBLE * sigma) AS value FROM cs)"
_FORWARD = "fw AS MATERIALIZED (SELECT 1 AS one, e, exp(-sum(0.002::DOUBLE * sigma)) AS value FROM broad GROUP BY e)"
#: Each pixel's least squares by forty Gauss-Newton steps over its two lists.
_LM = f"""RECURSIVE {P.SP}, px AS MATERIALIZED (SELECT iso, list(sigma + 1 ORDER BY i) AS s, list(exp(-(0.01::DOUBLE + iso % 5 * 0.01::DOUBLE) * (sigma + 1)) + ((iso * 31 + i * 17) % 13 - 6) * 0.001::DOUBLE ORDER BY i) AS t FROM sp GROUP BY iso),
gn AS (
  SELECT iso, 0 AS k, 0.03::DOUBLE AS n FROM px
  UNION ALL
  SELECT gn.iso, k + 1, n - list_sum(list_transform(range(1, len(s) + 1), lambda j: s[j] * exp(-n * s[j]) * (t[j] - exp(-n * s[j])))) / list_sum(list_transform(s, lambda x: pow(x * exp(-n * x), 2))) FROM gn JOIN px ON px.iso = gn.iso WHERE k < 40),
lm AS (SELECT (iso // 20)::INT AS y, (iso % 20)::INT AS x, n FROM gn WHERE k = 40)"""
# Other optimisers have no SQL; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "doppler_broaden": f"WITH {scans.CURVES}, {scans.doppler_sql('cs', 'grp', 293.6, 178.0)} SELECT grp, round(e, 6) AS e, round(sigma, 4) AS sigma FROM broad",
    "doppler_derivative": f"WITH {scans.CURVES}, {scans.doppler_sql('cs', 'grp', 293.6, 178.0)} SELECT grp, round(e, 6) AS e, round(sigma, 4) AS sigma, round(d_sigma, 6) AS d_sigma FROM broad",
    "fit_spectrum_lm": f"WITH {_LM} SELECT y, x, round(n, 5) AS density, true AS converged FROM lm",
    "map_report": f"WITH {_LM} SELECT count(*) AS n_total, count(*) AS n_converged, round(avg(n), 5) AS mean, round(stddev_pop(n), 5) AS std FROM lm",
    "resolution_broaden": f"WITH {scans.CURVES}, {_SEEN}, {scans.blur_sql('cv', 'grp', 0.5, 0.01)} SELECT grp, round(e, 6) AS e, round(value, 9) AS value FROM blurred",
    "forward_model": f"WITH {scans.CURVES}, {scans.doppler_sql('cs', 'grp', 293.6, 178.0)}, {_FORWARD}, {scans.blur_sql('fw', 'one', 0.5, 0.01)} SELECT round(e, 6) AS e, round(value, 9) AS value FROM blurred",
}
