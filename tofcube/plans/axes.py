"""Axis queries: an edge of time and an energy for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.functions import scalars as S
from tofcube.operators import axes as A
from tofcube.operators import cube as C

L, DELAY = 25.0, 1.5
LO, HI = 100.0, 2100.0


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """An edge of time for each part, rising, unevenly by its price."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").cast("int").alias("i"), (LO + F.col("p_partkey") * 10.0 + (F.col("p_retailprice") - 900.0) * 0.05).alias("value"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """An energy for each part, rising from 1 eV, unevenly by its price."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").cast("int").alias("i"), (1.0 + F.col("p_partkey") * 0.1 + (F.col("p_retailprice") - 900.0) * 0.0005).alias("value"))


def parts(spark: SparkSession, sf: str) -> int:
    return spark.read.parquet(f"{sf}/part.parquet").count()


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Part prices in key order as an axis that is not monotonic."""
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("int").alias("i"), F.col("p_retailprice").alias("value"))


R = lambda c, n=9: F.round(c, n)


def _r(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


ED = f"ed AS (SELECT p_partkey::INT AS i, {LO}::DOUBLE + p_partkey * 10.0::DOUBLE + (p_retailprice - 900) * 0.05::DOUBLE AS value FROM part)"
GR = "gr AS (SELECT p_partkey::INT AS i, 1.0::DOUBLE + p_partkey * 0.1::DOUBLE + (p_retailprice - 900) * 0.0005::DOUBLE AS value FROM part)"
ENERGY = lambda t: f"0.5::DOUBLE * {K.NEUTRON_MASS_KG!r}::DOUBLE * pow({L}::DOUBLE / (({t}) * 1e-6::DOUBLE), 2) / {K.CHARGE_C!r}::DOUBLE"
EN = f"en AS (SELECT (row_number() OVER (ORDER BY e) - 1)::INT AS i, e AS value FROM (SELECT {ENERGY(f'value - {DELAY}')} AS e FROM ed))"
GW = lambda e: f"sqrt(pow(2 * 0.5::DOUBLE * pow({e}, 1.5) / ({K.TOF_FACTOR!r}::DOUBLE * {L}), 2) + pow(2 * 0.01::DOUBLE * {e} / {L}, 2))"
F_L = f"({K.TOF_FACTOR!r}::DOUBLE * {L})"

QUERIES = {
    "linspace_tof_edges": lambda s, d: _r(A.linspace_edges(s, LO, HI, parts(s, d)), "value"),
    "tof_to_energy": lambda s, d: _r(A.edges_to_energy(edges(s, d), L, DELAY), "value", digits=6),
    "energy_centers": lambda s, d: _r(A.centers(A.edges_to_energy(edges(s, d), L, DELAY)), "value", digits=6),
    "energy_to_tof": lambda s, d: grid(s, d).select("i", R(S.energy_to_tof(F.col("value"), L), 6).alias("tof")),
    "wavelength": lambda s, d: grid(s, d).select("i", R(S.wavelength(F.col("value"))).alias("angstrom")),
    "axis_energies": lambda s, d: _r(A.axis_energies(edges(s, d), "tof", "edges", L), "value", digits=6),
    "rebin_edges": lambda s, d: _r(C.rebin_edges(edges(s, d), 7), "value"),
    "rebin_centers": lambda s, d: _r(C.rebin_centers(A.centers(edges(s, d), geometric=False), 7), "value"),
    "monotonic_violations": lambda s, d: A.violations(prices(s, d)),
    "axis_frame_check": lambda s, d: A.frame_check(edges(s, d), parts(s, d) - 1),
    "active_mask_count": lambda s, d: A.active(grid(s, d), (7.0, 60.0)).agg(F.count("*").alias("n"), F.count_if("active").alias("n_active")),
    "widened_energy_range": lambda s, d: _r(A.widened(grid(s, d), (7.0, 60.0), L, 0.5, 0.01), "value"),
    "corrected_energies": lambda s, d: _r(A.corrected(grid(s, d), L, 2.5, 1.003), "value", "d_t0", "d_l_scale"),
    "kernel_widths": lambda s, d: _r(A.kernel_widths(prices(s, d).select((F.col("i") % 40).alias("k"), F.floor(F.col("i") / 40).cast("int").alias("i"), "value"), ["k"]), "value", "width", digits=6),
    "grid_densify": lambda s, d: _r(A.densify(grid(s, d), grid(s, d).select("i", (0.1 + F.col("i") % 5 * 0.2).alias("width"))), "value"),
    "grid_dedup": lambda s, d: _r(A.dedup_sorted(grid(s, d).select(F.explode(F.array(F.col("value"), F.col("value") * (1 + 0.6e-10), F.col("value") * (1 + 1.2e-10))).alias("value"))), "value", digits=6),
    "resolution_widths": lambda s, d: grid(s, d).select("i", R(S.gaussian_width(F.col("value"), L, 0.5, 0.01)).alias("gaussian"), R(S.exp_width(F.col("value"), L, 0.3)).alias("exponential"), R(S.doppler_width(F.col("value"), 293.6, 177.0)).alias("doppler")),
}

ORACLES = {
    "linspace_tof_edges": f"SELECT i::INT AS i, round({LO}::DOUBLE + i * ({HI}::DOUBLE - {LO}::DOUBLE) / n, 9) AS value FROM (SELECT count(*) AS n FROM part), unnest(range(n + 1)) t(i)",
    "tof_to_energy": f"WITH {ED}, {EN} SELECT i, round(value, 6) AS value FROM en",
    "energy_centers": f"WITH {ED}, {EN} SELECT i, round(sqrt(value * nxt), 6) AS value FROM (SELECT *, lead(value) OVER (ORDER BY i) AS nxt FROM en) WHERE nxt IS NOT NULL",
    "energy_to_tof": f"WITH {GR} SELECT i, round({L} / sqrt(2 * value * {K.CHARGE_C!r}::DOUBLE / {K.NEUTRON_MASS_KG!r}::DOUBLE) * 1e6, 6) AS tof FROM gr",
    "wavelength": f"WITH {GR} SELECT i, round({K.WAVELENGTH_FACTOR} / sqrt(value), 9) AS angstrom FROM gr",
    "axis_energies": f"WITH {ED}, en AS (SELECT (row_number() OVER (ORDER BY e) - 1)::INT AS i, e AS value FROM (SELECT {ENERGY('value')} AS e FROM ed)) SELECT i, round(sqrt(value * nxt), 6) AS value FROM (SELECT *, lead(value) OVER (ORDER BY i) AS nxt FROM en) WHERE nxt IS NOT NULL",
    "rebin_edges": f"WITH {ED} SELECT ceil(i / 7)::INT AS i, round(value, 9) AS value FROM ed WHERE i % 7 = 0 OR i = (SELECT max(i) FROM ed)",
    "rebin_centers": f"WITH {ED}, c AS (SELECT i, (value + lead(value) OVER (ORDER BY i)) / 2 AS value FROM ed) SELECT (i // 7)::INT AS i, round(avg(value), 9) AS value FROM c WHERE value IS NOT NULL GROUP BY 1",
    "monotonic_violations": "SELECT i, value, before FROM (SELECT p_partkey::INT AS i, p_retailprice AS value, lag(p_retailprice) OVER (ORDER BY p_partkey) AS before FROM part) WHERE value <= before",
    "axis_frame_check": "SELECT count(*) AS n_values, 'edges' AS kind FROM part",
    "active_mask_count": f"WITH {GR} SELECT count(*) AS n, count(*) FILTER (WHERE value BETWEEN 7 AND 60) AS n_active FROM gr",
    "widened_energy_range": f"WITH {GR} SELECT i, round(value, 9) AS value, value BETWEEN 7 AND 60 AS active FROM gr WHERE value BETWEEN 7 - 10 * sqrt(ln(2)) * {GW('7.0::DOUBLE')} AND 60 + 10 * sqrt(ln(2)) * {GW('60.0::DOUBLE')}",
    "corrected_energies": f"WITH {GR}, t AS (SELECT i, {F_L} / sqrt(value) - 2.5 AS c FROM gr), e AS (SELECT i, c, pow({F_L} * 1.003::DOUBLE / c, 2) AS e FROM t) SELECT i, round(e, 9) AS value, round(2 * e / c, 9) AS d_t0, round(2 * e / 1.003::DOUBLE, 9) AS d_l_scale FROM e",
    "kernel_widths": "WITH p AS (SELECT (p_partkey % 40)::INT AS k, (p_partkey // 40)::INT AS i, p_retailprice AS value FROM part), w AS (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY i) AS lo, lead(value) OVER (PARTITION BY k ORDER BY i) AS hi FROM p) SELECT k, i, round(value, 6) AS value, round(CASE WHEN lo IS NULL AND hi IS NULL THEN 1 WHEN lo IS NULL THEN hi - value WHEN hi IS NULL THEN value - lo ELSE (hi - lo) / 2 END, 6) AS width FROM w",
    "grid_densify": f"WITH {GR}, g AS (SELECT value, lead(value) OVER (ORDER BY i) AS nxt, 0.1::DOUBLE + i % 5 * 0.2::DOUBLE AS width FROM gr), n AS (SELECT *, (ceil((nxt - value) / (width / 4)) - 1)::INT AS n FROM g WHERE nxt - value > width / 4) SELECT round(value + (nxt - value) * k / (n + 1), 9) AS value FROM n, unnest(range(1, n + 1)) t(k) WHERE n > 0",
    "grid_dedup": f"WITH {GR}, v AS (SELECT unnest([value, value * (1 + 1.2e-10::DOUBLE)]) AS value FROM gr) SELECT (row_number() OVER (ORDER BY value) - 1)::INT AS i, round(value, 6) AS value FROM v",
    "resolution_widths": f"WITH {GR} SELECT i, round({GW('value')}, 9) AS gaussian, round(2 * 0.3::DOUBLE * pow(value, 1.5) / {F_L}, 9) AS exponential, round(sqrt({4 * K.BOLTZMANN_EV_K * 293.6 / 177.0!r}::DOUBLE * value), 9) AS doppler FROM gr",
}
