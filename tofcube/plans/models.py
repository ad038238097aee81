"""Isotope tables, interpolation, cross sections, goodness of fit, detectability and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.functions import scalars as S
from tofcube.operators import calibrate, isotopes as I
from tofcube.operators import models as M
from tofcube.plans import cubes as P

# -- stand-ins ---------------------------------------------------------------------------

def abundances(spark: SparkSession, sf: str) -> DataFrame:
    """z, a, fraction from parts: ten elements of five isotopes, with shares by the mean price; of some the shares don't sum to 1."""
    p = spark.read.parquet(f"{sf}/part.parquet").select((1 + F.col("p_partkey") % 10 * 9).cast("int").alias("z"), (F.col("p_size") % 5).alias("k"), "p_retailprice")
    p = p.groupBy("z", (2 * F.col("z") + F.col("k")).cast("int").alias("a")).agg(F.avg("p_retailprice").alias("m"))
    off = F.when(F.col("z") % 3 == 0, 1.0).when(F.col("z") % 2 == 0, 1.0005).otherwise(1.01)
    return p.select("z", "a", (F.col("m") / F.sum("m").over(W.partitionBy("z")) * off).alias("fraction"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """k, text: isotopes' names from parts, in several ways, some of them wrong."""
    k, a = F.col("p_partkey"), (F.col("p_size") * 6).cast("string")
    s = I.z_to_symbol((1 + k % 92).cast("int"))
    ways = [F.concat(s, F.lit("-"), a), F.concat(F.lower(s), F.lit("-"), a), F.concat(F.lit(" "), s, F.lit(" - "), a), F.concat(s, F.lit("-")), F.col("p_name"), F.concat(s, F.lit("-"), a, F.lit("x")), F.lit("n-1")]
    text = F.lit("")
    for n, way in enumerate(ways):
        text = F.when(k % 8 == n, way).otherwise(text)
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("k"), text.alias("text"))


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """iso, i, sigma from embeddings: |x| * 100 barns, and the group (label)."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("iso"), F.col("label").cast("string").alias("grp"), F.posexplode("embedding").alias("i", "x")).select("iso", "grp", "i", (F.abs(F.col("x").cast("double")) * 100.0).alias("sigma"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("iso"), F.col("label").cast("string").alias("grp"))
    n = e.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("n"))
    return e.join(n, F.col("grp") == F.col("g")).select("grp", "iso", (1.0 / F.col("n")).alias("ratio"))


def resonances(spark: SparkSession, sf: str) -> DataFrame:
    """Resonance rows from parts: the brand is the isotope."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        F.hex(F.substring("p_brand", -2, 2)).alias("za"), F.lit(178.0).alias("awr"), F.lit(7.5).alias("radius"), (k % 3).cast("int").alias("l"), (0.5 + k % 2).cast("double").alias("j"),
        (0.5 + size * 0.8 + (k % 97) * 0.01).alias("er"), (0.001 + (k % 5) * 0.0005).alias("gn"), (0.05 + (k % 7) * 0.004).alias("gg"), F.when(k % 4 == 0, 0.01).otherwise(0.0).alias("gf"),
    )


def energies(spark: SparkSession, sf: str) -> DataFrame:
    """za and e: 40 energies for each isotope."""
    z = spark.read.parquet(f"{sf}/part.parquet").select(F.hex(F.substring("p_brand", -2, 2)).alias("za")).distinct()
    return z.select("za", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("m")).select("za", (0.7 + F.col("m") * 1.03).alias("e"))


def averages(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of unresolved ranges from parts: each part a (l, j) of its brand, every second a reduced width at one
    point, the others tables of three points with a law each."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    one = p.select(F.hex(F.substring("p_brand", -2, 2)).alias("za"), F.lit(178.0).alias("awr"), F.lit(3.5).alias("spin"), F.lit(7.5).alias("radius"), F.lit(2.0).alias("e_low"), F.lit(35.0).alias("e_high"), (k % 6).cast("int").alias("l"), (0.5 + k).cast("double").alias("j"), (k % 5 + 1).cast("int").alias("law"), (k % 2 == 0).alias("reduced"), F.explode(F.when(k % 2 == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(3))))).alias("m"), k.alias("k"))
    m = F.col("m")
    return one.select("za", "awr", "spin", "radius", "e_low", "e_high", "l", "j", "law", "reduced", (3.0 + 9.0 * m).alias("x"), (2.0 + F.col("k") % 9 + 0.5 * m).alias("spacing"), (0.001 * m).alias("gx"), (0.002 + 0.001 * m).alias("gn"), (0.06 - 0.004 * m).alias("gg"), F.when(F.col("k") % 4 == 1, 0.01 + 0.002 * m).otherwise(0.0).alias("gf"))


def fit_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Counts cells with a smooth model: s, o, t, and transmission data with sigma."""
    both = P.full(spark, sf, "view").select("tof_bin", "y", "x", F.col("value").cast("double").alias("s")).join(P.full(spark, sf, "click").select("tof_bin", "y", "x", F.col("value").cast("double").alias("o")), ["tof_bin", "y", "x"])
    t = F.exp(-(0.1 + F.col("tof_bin") * 0.02))
    return both.select("*", t.alias("t"), t.alias("model"), S.transmission(F.col("s"), F.col("o")).alias("data"), S.counts_transmission_sigma(F.col("s"), F.col("o")).alias("sigma"), F.col("tof_bin").between(5, 44).alias("active"))


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- SQL pieces -----------------------------------------------------------------------------

AB = """ab AS (SELECT z, a, m / sum(m) OVER (PARTITION BY z) * CASE WHEN z % 3 = 0 THEN 1.0 WHEN z % 2 = 0 THEN 1.0005 ELSE 1.01 END::DOUBLE AS fraction
 FROM (SELECT (1 + p_partkey % 10 * 9)::INT AS z, (2 * (1 + p_partkey % 10 * 9) + p_size % 5)::INT AS a, avg(p_retailprice) AS m FROM part GROUP BY 1, 2))"""
SY = "sy AS (SELECT (row_number() OVER () - 1)::INT AS z, s AS symbol FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in I.SYMBOLS) + "]) AS s))"
TX = """tx AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN symbol || '-' || n WHEN 1 THEN lower(symbol) || '-' || n WHEN 2 THEN ' ' || symbol || ' - ' || n WHEN 3 THEN symbol || '-' WHEN 4 THEN p_name WHEN 5 THEN symbol || '-' || n || 'x' WHEN 6 THEN 'n-1' ELSE '' END AS text
 FROM (SELECT *, (p_size * 6)::VARCHAR AS n FROM part) JOIN sy ON z = 1 + p_partkey % 92)"""
SP = "sp AS (SELECT vec_id AS iso, label::VARCHAR AS grp, i - 1 AS i, abs(embedding[i]::DOUBLE) * 100 AS sigma FROM embeddings, unnest(range(1, 65)) t(i))"
RS = """rs AS (SELECT hex(right(p_brand, 2)) AS za, 178.0::DOUBLE AS awr, 7.5::DOUBLE AS radius, (p_partkey % 3)::INT AS l, (0.5 + p_partkey % 2)::DOUBLE AS j, 0.5::DOUBLE + p_size * 0.8::DOUBLE + (p_partkey % 97) * 0.01::DOUBLE AS er,
 0.001::DOUBLE + (p_partkey % 5) * 0.0005::DOUBLE AS gn, 0.05::DOUBLE + (p_partkey % 7) * 0.004::DOUBLE AS gg, CASE WHEN p_partkey % 4 = 0 THEN 0.01 ELSE 0 END::DOUBLE AS gf FROM part),
eg AS (SELECT za, 0.7::DOUBLE + m * 1.03::DOUBLE AS e FROM (SELECT DISTINCT za FROM rs), unnest(range(0, 40)) t(m))"""
_HC = K.HBAR_EV_S * K.LIGHT_M_S * 1e15
_K2 = lambda e: f"({2.0 * K.NEUTRON_REST_MEV * 1e6!r}::DOUBLE * pow(awr / (1 + awr), 2) * {e} / {_HC * _HC!r}::DOUBLE)"
_P = lambda r: f"CASE l WHEN 0 THEN {r} WHEN 1 THEN pow({r}, 3) / (1 + pow({r}, 2)) WHEN 2 THEN pow({r}, 5) / (9 + 3 * pow({r}, 2) + pow({r}, 4)) WHEN 3 THEN pow({r}, 7) / (225 + 45 * pow({r}, 2) + 6 * pow({r}, 4) + pow({r}, 6)) WHEN 4 THEN pow({r}, 9) / (11025 + 1575 * pow({r}, 2) + 135 * pow({r}, 4) + 10 * pow({r}, 6) + pow({r}, 8)) END"
_S = lambda r: f"CASE l WHEN 0 THEN 0 WHEN 1 THEN -1 / (1 + pow({r}, 2)) WHEN 2 THEN -(18 + 3 * pow({r}, 2)) / (9 + 3 * pow({r}, 2) + pow({r}, 4)) WHEN 3 THEN -(675 + 90 * pow({r}, 2) + 6 * pow({r}, 4)) / (225 + 45 * pow({r}, 2) + 6 * pow({r}, 4) + pow({r}, 6)) WHEN 4 THEN -(44100 + 4725 * pow({r}, 2) + 270 * pow({r}, 4) + 10 * pow({r}, 6)) / (11025 + 1575 * pow({r}, 2) + 135 * pow({r}, 4) + 10 * pow({r}, 6) + pow({r}, 8)) END"
_F = lambda r: f"CASE l WHEN 0 THEN {r} WHEN 1 THEN {r} - atan({r}) WHEN 2 THEN {r} - atan(3 * {r} / (3 - pow({r}, 2))) WHEN 3 THEN {r} - atan({r} * (15 - pow({r}, 2)) / (15 - 6 * pow({r}, 2))) WHEN 4 THEN {r} - atan({r} * (105 - 10 * pow({r}, 2)) / (105 - 45 * pow({r}, 2) + pow({r}, 4))) END"
# l = 5 from its polynomial
_P5 = lambda r: f"(CASE WHEN l = 5 THEN pow({r}, 11) / (893025 + 99225 * pow({r}, 2) + 6300 * pow({r}, 4) + 315 * pow({r}, 6) + 15 * pow({r}, 8) + pow({r}, 10)) ELSE {_P(r)} END)"
KI = f"""{RS}, k0 AS (SELECT *, sqrt({_K2('e')}) * radius AS rho, sqrt({_K2('abs(er)')}) * radius AS rr0, pi() / {_K2('e')} / 100 * (2 * j + 1) / 2 AS u, e - er AS d FROM eg JOIN rs USING (za)),
k1 AS (SELECT *, {_F('rho')} AS phi, {_P('rho')} AS p, {_P('rr0')} AS pr FROM k0), k2 AS (SELECT *, gn * sqrt(e / er) * p / pr AS ge FROM k1), k3 AS (SELECT *, ge + gg + gf AS tot, d * d + pow(ge + gg + gf, 2) / 4 AS den FROM k2)"""
_OUT = "SELECT za, round(e, 6) AS e, round(sum(el), 6) AS elastic, round(sum(cap), 6) AS capture, round(sum(fis), 6) AS fission, round(sum(el) + sum(cap) + sum(fis), 6) AS total FROM g GROUP BY za, e"
_TURN = "SELECT za, e, u * (pow(1 - (ar * cos(2 * phi) + ai * sin(2 * phi)), 2) + pow(ai * cos(2 * phi) - ar * sin(2 * phi), 2)) AS el"
FC = f"""{P.EV}, fc AS (SELECT tof_bin, y, x, vw.value::DOUBLE AS s, ck.value::DOUBLE AS o, exp(-(0.1::DOUBLE + tof_bin * 0.02::DOUBLE)) AS t FROM vw JOIN ck USING (tof_bin, y, x)),
fd AS (SELECT *, CASE WHEN o > 0 THEN s / o ELSE 0 END AS data, CASE WHEN o <= 0 THEN 1e30 WHEN s <= 0 THEN 1e10 ELSE sqrt(greatest(s, 1)) / greatest(o, 1e-10) END AS sigma, tof_bin BETWEEN 5 AND 44 AS active FROM fc)"""
_XS = lambda f: lambda s, d: _r(f(energies(s, d), resonances(s, d)), "e", "elastic", "capture", "fission", "total").select("za", "e", "elastic", "capture", "fission", "total")


def tables(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolation tables (brand, x, y, law) from parts: mean price by size; the law is one for each brand."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("y")).select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("x"), "y", (F.substring("p_brand", -1, 1).cast("int") % 5 + 1).alias("law"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("brand")).distinct()
    return p.select("brand", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("m")).select("brand", (0.5 + F.col("m") * 0.93).alias("x"))


RANGES = [("a", 0.0, 10.0), ("a", 10.0, 20.0), ("a", 25.0, 30.0), ("b", 0.0, 30.0), ("b", 5.0, 30.0)]
PT = "pt AS (SELECT (p_partkey % 5)::INT AS l, 0.05::DOUBLE + p_size * 0.074::DOUBLE + (p_retailprice - 900) * 0.0007::DOUBLE AS rho FROM part)"


def waves(spark: SparkSession, sf: str) -> DataFrame:
    """l and rho of every part, from its size and price."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select((F.col("p_partkey") % 5).cast("int").alias("l"), (0.05 + F.col("p_size") * 0.074 + (F.col("p_retailprice") - 900.0) * 0.0007).alias("rho"))


def matrix(spark: SparkSession) -> DataFrame:
    """A banded kernel of 64 rows: weights 1 / (1 + |i - j|) over their sum."""
    i = F.col("id").cast("int")
    m = spark.range(64).select(i.alias("i"), F.explode(F.sequence(F.greatest(i - 3, F.lit(0)), F.least(i + 3, F.lit(63)))).alias("j"))
    m = m.withColumn("w", 1.0 / (1.0 + F.abs(F.col("i") - F.col("j"))))
    return m.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("i")))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.select(F.col("l_returnflag").alias("case"), F.col("l_extendedprice").alias("reference"), (F.col("l_extendedprice") * (1 + F.col("l_discount") * 0.1)).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("energy"))


def candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sp = spectra(spark, sf)
    base = sp.where("iso < 3").groupBy("i").agg(F.sum(F.col("sigma") * 0.02).alias("sigma_n")).select("i", (1.0 + F.col("i") * 0.5).alias("energy"), "sigma_n")
    return base, sp.where("iso >= 3").select("iso", F.col("iso").alias("ordinal"), "i", "sigma")


QUERIES = {
    "isotope_parse": lambda s, d: names(s, d).withColumn("iso", I.parse_isotope(F.col("text"))).select("k", F.col("iso.z").alias("z"), F.col("iso.a").alias("a")),
    "symbol_lookup": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 119).cast("int").alias("z")).withColumn("symbol", I.z_to_symbol(F.col("z"))).select("p_partkey", "z", "symbol", I.symbol_to_z(F.upper("symbol")).alias("back")),
    "za_codec": lambda s, d: abundances(s, d).select("z", "a", I.za(F.col("z"), F.col("a")).alias("za"), I.from_za(I.za(F.col("z"), F.col("a")))["a"].alias("back_a"), I.isotope_name(F.col("z"), F.col("a")).alias("name")),
    "natural_group": lambda s, d: _r(I.natural_group(abundances(s, d)), "ratio", digits=9),
    "group_subset": lambda s, d: _r(I.subset_group(abundances(s, d), 73, [147, 148]), "ratio", digits=9),
    "custom_group_check": lambda s, d: _r(I.check_custom(abundances(s, d).select(I.z_to_symbol(F.col("z")).alias("grp"), F.col("fraction").alias("ratio"))), "total"),
    "mat_lookup": lambda s, d: I.with_lookup(abundances(s, d).select("z", "a"), I.evaluations(abundances(s, d))),
    "group_effective_sigma": lambda s, d: _r(M.group_sigma(spectra(s, d).drop("grp"), members(s, d)), "sigma"),
    "beer_lambert_multi": lambda s, d: _r(M.transmit(M.group_sigma(spectra(s, d).drop("grp"), members(s, d)), members(s, d).select("grp").distinct().select("grp", (0.001 * (F.col("grp").cast("int") % 4)).alias("n"))), "transmission", digits=9),
    "background_model": lambda s, d: spectra(s, d).select("iso", "i", F.round(S.background(S.beer_lambert(F.col("sigma"), 0.01), 1.0 + F.col("i"), 0.98, 0.01, 0.02, -0.001, 0.03, 1.5), 9).alias("t")),
    "tab1_interpolate": lambda s, d: _r(M.interpolate(points(s, d), tables(s, d), ["brand"]), "x", "y"),
    "range_select_half_open": lambda s, d: M.in_ranges(s.range(128).select(F.when(F.col("id") < 64, "a").otherwise("b").alias("za"), (F.col("id") % 64 * 0.5).alias("e")), s.createDataFrame(RANGES, "za string, lo double, hi double")).select("e", "za", "lo"),
    "penetrability_table": lambda s, d: waves(s, d).select("l", F.round("rho", 6).alias("rho"), F.round(S.penetrability(F.col("l"), F.col("rho")), 9).alias("p"), F.round(S.shift_factor(F.col("l"), F.col("rho")), 9).alias("s")),
    "phase_shift_table": lambda s, d: waves(s, d).select("l", F.round("rho", 6).alias("rho"), F.round(S.phase_shift(F.col("l"), F.col("rho")), 9).alias("phi")),
    "slbw_sql": _XS(M.slbw),
    "mlbw_sql": _XS(M.mlbw),
    "reich_moore_sql": _XS(lambda e, r: M.reich_moore(e, r)),
    "urr_sql": lambda s, d: _r(M.unresolved(energies(s, d), averages(s, d)), "e", "elastic", "capture", "fission", "total"),
    "resolution_matvec": lambda s, d: _r(M.apply_matrix(matrix(s), spectra(s, d).select("iso", F.col("i").alias("j"), F.col("sigma").alias("value")), ["iso"]), "value", digits=9),
    "chi_square_per_pixel": lambda s, d: _r(M.chi_square(fit_cells(s, d), ["y", "x"]), "chi2", "chi2_r"),
    "pearson_chi_square": lambda s, d: _r(M.pearson(fit_cells(s, d), ["y", "x"]), "chi2", "chi2_r"),
    "counts_statistics": lambda s, d: _r(M.counts_statistics(fit_cells(s, d), ["y", "x"], 1.25), "deviance", "nll", "gradient", "fisher"),
    "profile_lambda": lambda s, d: fit_cells(s, d).select("tof_bin", "y", "x", F.round(S.profile_lambda(F.col("s"), F.col("o"), F.col("t"), 1.25), 9).alias("flux")),
    "residual_stats": lambda s, d: _r(M.residuals(fit_cells(s, d), ["y", "x"]), "rms", "max_abs"),
    "validation_errors": lambda s, d: _r(M.validation(pairs(s, d), ["case"], 0.005), "mean_error", "max_error", digits=9),
    "detectability_rank": lambda s, d: _r(M.detectability(*candidates(s, d), 0.001, 1e4), "peak_dt", "peak_snr", "opaque"),
    "calibrate_grid_argmin": lambda s, d: _r(calibrate.grid_search(calibrate.stand_in(s), 25.0), "chi2", "l_scale", "t0_us", "n", digits=6),
}

ORACLES = {
    "isotope_parse": f"WITH {SY}, {TX}, p AS (SELECT k, text, string_split(text, '-') AS p FROM tx) SELECT k, CASE WHEN ok THEN z END AS z, CASE WHEN ok THEN a END AS a FROM (SELECT p.k, sy.z, try_cast(trim(p.p[2]) AS INT) AS a, coalesce(len(p.p) = 2 AND sy.z IS NOT NULL AND regexp_matches(trim(p.p[2]), '^\\+?[0-9]+$') AND try_cast(trim(p.p[2]) AS INT) > 0 AND sy.z <= try_cast(trim(p.p[2]) AS INT), false) AS ok FROM p LEFT JOIN sy ON CASE WHEN trim(p.p[1]) = 'n' THEN sy.z = 0 ELSE sy.z > 0 AND lower(sy.symbol) = lower(trim(p.p[1])) END)",
    "symbol_lookup": f"WITH {SY} SELECT p_partkey, z, symbol, CASE WHEN z = 0 THEN 7 ELSE z END::INT AS back FROM part JOIN sy ON z = p_partkey % 119",
    "za_codec": f"WITH {AB}, {SY} SELECT z, a, z * 1000 + a AS za, a AS back_a, symbol || '-' || a AS name FROM ab JOIN sy USING (z)",
    "natural_group": f"WITH {AB}, {SY} SELECT symbol || ' (nat)' AS grp, z, a, round(fraction / sum(fraction) OVER (PARTITION BY z), 9) AS ratio FROM ab JOIN sy USING (z)",
    "group_subset": f"WITH {AB} SELECT 'Ta-147/148' AS grp, z, a, round(fraction / sum(fraction) OVER (), 9) AS ratio FROM ab WHERE z = 73 AND a IN (147, 148)",
    "custom_group_check": f"WITH {AB}, {SY}, t AS (SELECT symbol AS grp, sum(fraction) AS total FROM ab JOIN sy USING (z) GROUP BY symbol) SELECT grp, round(total, 6) AS total, CASE WHEN abs(total - 1) > 1e-3 THEN 'reject' WHEN abs(total - 1) > 1e-6 THEN 'renormalise' ELSE 'accept' END AS verdict FROM t",
    "mat_lookup": f"WITH {AB} SELECT z, a, (100 * z + 25 + 3 * (a - min(a) OVER (PARTITION BY z)))::INT AS mat FROM ab",
    "group_effective_sigma": f"WITH {SP} SELECT grp, i::INT AS i, round(sum(sigma / n), 6) AS sigma FROM sp JOIN (SELECT label::VARCHAR AS grp, count(*) AS n FROM embeddings GROUP BY 1) USING (grp) GROUP BY grp, i",
    "beer_lambert_multi": f"WITH {SP}, gs AS (SELECT grp, i, sum(sigma / n) AS sigma FROM sp JOIN (SELECT label::VARCHAR AS grp, count(*) AS n FROM embeddings GROUP BY 1) USING (grp) GROUP BY grp, i) SELECT i::INT AS i, round(exp(-sum(0.001::DOUBLE * (grp::INT % 4) * sigma)), 9) AS transmission FROM gs WHERE grp::INT % 4 > 0 GROUP BY i",
    "background_model": f"WITH {SP} SELECT iso, i::INT AS i, round(0.98::DOUBLE * exp(-0.01::DOUBLE * sigma) + 0.01::DOUBLE + 0.02::DOUBLE / sqrt(1 + i) - 0.001::DOUBLE * sqrt(1 + i) + 0.03::DOUBLE * exp(-1.5 / sqrt(1 + i)), 9) AS t FROM sp",
    "tab1_interpolate": """WITH tb AS (SELECT p_brand AS brand, p_size::DOUBLE AS x, avg(p_retailprice) AS y, right(p_brand, 1)::INT % 5 + 1 AS law FROM part GROUP BY 1, 2, 4),
iv AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS k FROM tb WINDOW w AS (PARTITION BY brand ORDER BY x)), pt AS (SELECT brand, 0.5::DOUBLE + m * 0.93::DOUBLE AS q FROM (SELECT DISTINCT p_brand AS brand FROM part), unnest(range(0, 61)) t(m))
SELECT brand, round(q, 6) AS x, round(CASE WHEN q <= x OR x1 IS NULL OR law = 1 THEN y WHEN law = 3 THEN y + (y1 - y) * ln(q / x) / ln(x1 / x) WHEN law = 4 THEN y * exp(ln(y1 / y) * (q - x) / (x1 - x)) WHEN law = 5 THEN y * exp(ln(y1 / y) * ln(q / x) / ln(x1 / x)) ELSE y + (y1 - y) * (q - x) / (x1 - x) END, 6) AS y
FROM pt JOIN iv USING (brand) WHERE (q >= x OR k = 1) AND (x1 IS NULL OR q < x1)""",
    "range_select_half_open": "WITH r AS (SELECT * FROM (VALUES ('a', 0.0, 10.0), ('a', 10.0, 20.0), ('a', 25.0, 30.0), ('b', 0.0, 30.0), ('b', 5.0, 30.0)) t(za, lo, hi)), o AS (SELECT *, coalesce(lead(lo) OVER (PARTITION BY za ORDER BY lo) = hi, false) AS op FROM r), e AS (SELECT za, i * 0.5::DOUBLE AS e FROM range(64) t(i), (VALUES ('a'), ('b')) z(za)) SELECT e, o.za, lo::DOUBLE AS lo FROM e JOIN o ON e.za = o.za AND e >= lo AND (e < hi OR (NOT op AND e = hi))",
    "penetrability_table": f"WITH {PT} SELECT l, round(rho, 6) AS rho, round({_P('rho')}, 9) AS p, round({_S('rho')}, 9) AS s FROM pt",
    "phase_shift_table": f"WITH {PT} SELECT l, round(rho, 6) AS rho, round({_F('rho')}, 9) AS phi FROM pt",
    "slbw_sql": f"WITH {KI}, g AS (SELECT za, e, first(4 * u * pow(sin(phi), 2)) + sum(u * ge * ge / den + u * 2 * ge * (2 * d * sin(phi) * cos(phi) - tot * pow(sin(phi), 2)) / den) AS el, sum(u * ge * gg / den) AS cap, sum(u * ge * gf / den) AS fis FROM k3 GROUP BY za, e, l, j) {_OUT}",
    "mlbw_sql": f"WITH {KI}, s AS (SELECT za, e, l, j, first(u) AS u, first(phi) AS phi, sum(-ge * d / den) AS ai, 1 - sum(ge * tot / 2 / den) AS ar, sum(u * ge * gg / den) AS cap, sum(u * ge * gf / den) AS fis FROM k3 GROUP BY za, e, l, j), g AS ({_TURN}, cap, fis FROM s) {_OUT}",
    # with one fission channel the two-by-two system has a closed solution: det = (-i/P - Rnn)(-i - Rff) - Rnf**2
    "reich_moore_sql": f"""WITH {KI}, b AS (SELECT *, gn / (2 * pr) AS nn, sqrt(gn / (2 * pr)) * sqrt(gf / 2) AS nf, gf / 2 AS ff, -d / (d * d + gg * gg / 4) AS wr, gg / 2 / (d * d + gg * gg / 4) AS wi FROM k3),
s AS (SELECT za, e, l, j, first(u) AS u, first(phi) AS phi, first(p) AS p, sum(nn * wr) AS nr, sum(nn * wi) AS ni, sum(nf * wr) AS mr, sum(nf * wi) AS mi, sum(ff * wr) AS fr, sum(ff * wi) AS fi FROM b GROUP BY za, e, l, j),
y AS (SELECT *, -nr AS ar, -1 / p - ni AS ai, -fr AS br, -1 - fi AS bi, mr * mr - mi * mi AS qr, 2 * mr * mi AS qi FROM s),
t AS (SELECT *, ar * br - ai * bi - qr AS dr, ar * bi + ai * br - qi AS di, br * nr - bi * ni + qr AS xr, br * ni + bi * nr + qi AS xi FROM y),
v AS (SELECT *, 1 + 2 * (xr * dr + xi * di) / (dr * dr + di * di) AS zr, 2 * (xi * dr - xr * di) / (dr * dr + di * di) AS zi, 4 * (mr * mr + mi * mi) / (dr * dr + di * di) / p AS uf FROM t),
w AS (SELECT *, zr * cos(2 * phi) + zi * sin(2 * phi) AS cr, zi * cos(2 * phi) - zr * sin(2 * phi) AS ci FROM v),
g AS (SELECT za, e, u * (pow(1 - cr, 2) + ci * ci) AS el, u * uf AS fis, 2 * u * (1 - cr) - u * (pow(1 - cr, 2) + ci * ci) - u * uf AS cap FROM w) {_OUT}""",
    "urr_sql": f"""WITH {RS}, av AS (SELECT hex(right(p_brand, 2)) AS za, 178.0::DOUBLE AS awr, p_partkey AS k, (p_partkey % 6)::INT AS l, 0.5 + p_partkey AS j, p_partkey % 5 + 1 AS law, m FROM part, unnest(CASE WHEN p_partkey % 2 = 0 THEN [0] ELSE [0, 1, 2] END) t(m)),
pt AS (SELECT *, 3 + 9::DOUBLE * m AS x, 2 + k % 9 + 0.5::DOUBLE * m AS sp, 0.001::DOUBLE * m AS gx, 0.002::DOUBLE + 0.001::DOUBLE * m AS gn, 0.06::DOUBLE - 0.004::DOUBLE * m AS gg, CASE WHEN k % 4 = 1 THEN 0.01::DOUBLE + 0.002::DOUBLE * m ELSE 0 END AS gf FROM av),
iv AS (SELECT *, {", ".join(f"lead({c}) OVER w AS {c}1" for c in ("x", "sp", "gx", "gn", "gg", "gf"))} FROM pt WINDOW w AS (PARTITION BY k ORDER BY m)),
ip AS (SELECT za, e, awr, l, j, k, {", ".join(f"CASE WHEN e <= x OR x1 IS NULL OR law = 1 THEN {c} WHEN law = 3 THEN {c} + ({c}1 - {c}) * ln(e / x) / ln(x1 / x) WHEN law = 4 AND {c} > 0 AND {c}1 > 0 THEN {c} * exp(ln({c}1 / {c}) * (e - x) / (x1 - x)) WHEN law = 5 AND {c} > 0 AND {c}1 > 0 THEN {c} * exp(ln({c}1 / {c}) * ln(e / x) / ln(x1 / x)) ELSE {c} + ({c}1 - {c}) * (e - x) / (x1 - x) END AS {c}" for c in ("sp", "gx", "gn", "gg", "gf"))} FROM eg JOIN iv USING (za) WHERE (e >= x OR m = 0) AND (x1 IS NULL OR e < x1) AND e BETWEEN 2 AND 35),
q0 AS (SELECT *, sqrt({_K2("e")}) * 7.5 AS rho FROM ip),
q AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN 2 * gn * {_P5("rho")} ELSE gn END AS gn) FROM q0),
c AS (SELECT *, pi() / {_K2("e")} / 100 * (2 * j + 1) / 16 * 2 * pi() * gn / sp / (gn + gg + gf + gx) AS pre FROM q),
o AS (SELECT za, e, sum(pre * gn) + 4 * pi() * 7.5 * 7.5 / 100 AS el, sum(pre * gg) AS cap, sum(pre * gf) AS fis, sum(pre * gx) AS oth FROM c GROUP BY za, e)
SELECT za, round(e, 6) AS e, round(el, 6) AS elastic, round(cap, 6) AS capture, round(fis, 6) AS fission, round(el + cap + fis + oth, 6) AS total FROM o""",
    "resolution_matvec": f"WITH {SP}, m AS (SELECT i::INT AS i, j::INT AS j, 1 / (1 + abs(i - j)::DOUBLE) AS w FROM range(64) a(i), range(64) b(j) WHERE abs(i - j) <= 3), n AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM m) SELECT iso, n.i, round(sum(w * sigma), 9) AS value FROM n JOIN sp ON sp.i = n.j GROUP BY iso, n.i",
    "chi_square_per_pixel": f"WITH {FC}, g AS (SELECT y, x, sum(pow(data - t, 2) / (sigma * sigma)) FILTER (WHERE active) AS chi2, count(*) FILTER (WHERE active) - 1 AS dof FROM fd GROUP BY y, x) SELECT y, x, round(chi2, 6) AS chi2, dof, round(chi2 / dof, 6) AS chi2_r FROM g",
    "pearson_chi_square": f"WITH {FC}, g AS (SELECT y, x, sum(pow(data - t, 2) / greatest(sigma * sigma, 1e-30)) AS chi2, greatest(count(*) - 1, 1) AS dof FROM fd GROUP BY y, x) SELECT y, x, round(chi2, 6) AS chi2, dof, round(chi2 / dof, 6) AS chi2_r FROM g",
    "counts_statistics": f"""WITH {FC}, v AS (SELECT y, x, s, o, t, s + o AS n, 1.25::DOUBLE * t AS ct, 1.25::DOUBLE * (o + s) / (1 + 1.25::DOUBLE * t) * t AS mu FROM fd)
SELECT y, x, round(sum(CASE WHEN n > 0 THEN 2 * (CASE WHEN s > 0 THEN s * ln(s * (1 + ct) / (n * ct)) ELSE 0 END + CASE WHEN o > 0 THEN o * ln(o * (1 + ct) / n) ELSE 0 END) ELSE 0 END), 6) AS deviance,
 round(sum(CASE WHEN mu > 1e-10 THEN mu - CASE WHEN s > 0 THEN s * ln(mu) ELSE 0 END ELSE 1e-10 - s * ln(1e-10) + (1 - s / 1e-10) * (mu - 1e-10) + 0.5 * greatest(s / 1e-20, 1e10) * pow(mu - 1e-10, 2) END), 6) AS nll,
 round(sum(-2 * (s - o * ct) / (t * (1 + ct)) * t), 6) AS gradient, round(sum(2 * n * 1.25::DOUBLE / (t * pow(1 + ct, 2)) * t * t), 6) AS fisher FROM v GROUP BY y, x""",
    "profile_lambda": f"WITH {FC} SELECT tof_bin, y, x, round(1.25::DOUBLE * (o + s) / (1 + 1.25::DOUBLE * t), 9) AS flux FROM fd",
    "residual_stats": f"WITH {FC} SELECT y, x, round(sqrt(avg(pow(data - t, 2))), 6) AS rms, round(max(abs(data - t)), 6) AS max_abs, count(*) AS n FROM fd GROUP BY y, x",
    "validation_errors": 'WITH p AS (SELECT l_returnflag AS "case", l_orderkey * 10 + l_linenumber AS energy, abs(l_extendedprice * (1 + l_discount * 0.1::DOUBLE) - l_extendedprice) / abs(l_extendedprice) AS err FROM lineitem) SELECT "case", round(avg(err), 9) AS mean_error, round(max(err), 9) AS max_error, count(*) FILTER (WHERE err > 0.005) AS n_above, (arg_max(energy, {\'e\': err, \'k\': -energy}))::DOUBLE AS worst_energy FROM p GROUP BY 1',
    "detectability_rank": f"""WITH {SP}, b AS (SELECT i, 1 + i * 0.5::DOUBLE AS energy, exp(-sum(sigma * 0.02::DOUBLE)) AS t FROM sp WHERE iso < 3 GROUP BY i), d AS (SELECT iso, b.i, energy, t, t * (1 - exp(-0.001::DOUBLE * sigma)) AS dt FROM sp JOIN b USING (i) WHERE iso >= 3),
g AS (SELECT iso, max(dt) AS peak_dt, arg_max(energy, {{'d': dt, 'i': i}}) AS peak_energy, greatest(max(dt / sqrt(greatest(t, 1e-15) / 1e4)), 0) AS peak_snr, avg((t < 1e-15)::INT) AS opaque FROM d GROUP BY iso)
SELECT iso, iso AS ordinal, round(peak_dt, 6) AS peak_dt, peak_energy, round(peak_snr, 6) AS peak_snr, round(opaque, 6) AS opaque, (row_number() OVER (ORDER BY peak_snr DESC, iso))::INT AS rank FROM g""",
    "calibrate_grid_argmin": calibrate.SQL,
}
