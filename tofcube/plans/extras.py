"""Smaller operators over generated axes and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.functions import scalars as S
from tofcube.operators import extras as X
from tofcube.operators import isotopes as I
from tofcube.operators import sparse
from tofcube.plans import axes as A
from tofcube.plans import cubes as C
from tofcube.plans import models as P
from tofcube.plans import scans
from tofcube.sources import project

LIBRARIES = ["ENDF-B-VIII.0", "ENDF-B-VIII.1", "JEFF-3.3", "JENDL-5", "TENDL-2023", "CENDL-3.2"]
L = 25.0


def spin_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as spin groups of cases (nations)."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_nationkey").alias("case"), F.col("c_custkey").alias("number"), (F.col("c_custkey") % 3).cast("int").alias("l"), (0.5 + F.col("c_custkey") % 4).cast("double").alias("j"), F.when(F.col("c_nationkey") % 2 == 0, 3.5).otherwise(0.0).alias("spin"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as resonances of spin groups; every seventh names a group that does not exist."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("case"), F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("number"), F.col("o_totalprice").alias("er"), (F.col("o_orderkey") % 11 * 0.001).alias("gn"))


def kernels(spark: SparkSession) -> DataFrame:
    rows = [(e, k, (k - 4) * 0.1 * e**0.2, 1.0 / (1 + abs(k - 4))) for e in (2.0, 20.0) for k in range(9)] + [(90.0, k, (k - 2) * 0.3, 0.2) for k in range(5)]
    return spark.createDataFrame(rows, "ref_energy double, k int, offset double, weight double")


def curve(spark: SparkSession, sf: str) -> DataFrame:
    return A.grid(spark, sf).select(F.col("value").alias("e"), F.exp(-1.0 / (1.0 + F.pow((F.col("value") - 15.0) / 0.8, F.lit(2.0)))).alias("value"))


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """A curve for each brand of part, its dip at a place of its own."""
    k = spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().withColumn("at", 10.0 + F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") * 0.3)
    return A.grid(spark, sf).select(F.col("value").alias("e")).join(F.broadcast(k)).select("p_brand", "e", F.exp(-1.0 / (1.0 + F.pow((F.col("e") - F.col("at")) / 0.8, F.lit(2.0)))).alias("value"))  # some brands


def externals(spark: SparkSession, sf: str) -> DataFrame:
    r = F.struct(F.lit(0.1).alias("con"), F.lit(0.01).alias("lin"), F.lit(0.001).alias("quad"), F.lit(0.2).alias("s_con"), F.lit(0.02).alias("s_lin"), F.lit(2.0).alias("e_low"), F.lit(60.0).alias("e_up"))
    return A.grid(spark, sf).select("i", F.round(X.external_r(F.col("value"), r), 9).alias("r"))


R = lambda c, n=9: F.round(c, n)
_REF = "kr AS (SELECT e AS ref_energy, k::INT AS k, (k - 4) * 0.1::DOUBLE * pow(e, 0.2) AS o, 1 / (1 + abs(k - 4))::DOUBLE AS w FROM (VALUES (2.0::DOUBLE), (20.0)) a(e), range(9) b(k) UNION ALL SELECT 90.0, k::INT, (k - 2) * 0.3::DOUBLE, 0.2 FROM range(5) b(k))"
_AT = f"""{A.GR}, {_REF}, en AS (SELECT value AS e, CASE WHEN value <= 2 THEN 2.0 WHEN value <= 20 THEN 2.0 WHEN value <= 90 THEN 20.0 ELSE 90.0 END AS lo, CASE WHEN value <= 2 OR value > 90 THEN NULL WHEN value <= 20 THEN 20.0 ELSE 90.0 END AS hi FROM gr),
fr AS (SELECT *, (ln(e) - ln(lo)) / (ln(hi) - ln(lo)) AS f FROM en),
ka AS (SELECT e, a.k, CASE WHEN hi = 20 THEN a.o + f * (b.o - a.o) ELSE a.o END AS o, CASE WHEN hi = 20 THEN a.w + f * (b.w - a.w) ELSE a.w END AS w FROM fr JOIN kr a ON a.ref_energy = CASE WHEN hi = 90 AND f >= 0.5 THEN 90 ELSE lo END LEFT JOIN kr b ON hi = 20 AND b.ref_energy = 20 AND b.k = a.k)"""
_FL = f"({K.TOF_FACTOR!r}::DOUBLE * {L})"
_SG = "sg AS (SELECT c_nationkey AS \"case\", c_custkey AS number, (c_custkey % 3)::INT AS l, (0.5 + c_custkey % 4)::DOUBLE AS j, CASE WHEN c_nationkey % 2 = 0 THEN 3.5 ELSE 0 END::DOUBLE AS spin FROM customer), rs AS (SELECT c_nationkey AS \"case\", CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS number, o_totalprice AS er, (o_orderkey % 11) * 0.001::DOUBLE AS gn FROM orders JOIN customer ON o_custkey = c_custkey)"

QUERIES = {
    "quadrature_weights": lambda s, d: X.quadrature_weights(A.grid(s, d)).select("i", R("weight").alias("weight")),
    "sparse_row_offsets": lambda s, d: X.row_offsets(sparse.entries(scans.plan(s, d))),
    "distinct_parameters": lambda s, d: X.distinct_parameters(P.spectra(s, d).select("grp", (F.col("iso") % 7).alias("p")), ["grp"], "p").select("grp", F.array_join(F.transform("parameters", lambda x: x.cast("string")), ",").alias("parameters")),
    "spin_group_offsets": lambda s, d: X.spin_offsets(spin_groups(s, d)).select("case", "number", "l", R("j").alias("j")),
    "spin_group_resonances": lambda s, d: X.attach_resonances(spin_groups(s, d), orders(s, d)).select("case", "number", "er", "gn"),
    "undefined_spin_groups": lambda s, d: X.undefined_groups(spin_groups(s, d), orders(s, d)),
    "group_expansion": lambda s, d: X.expand_groups(I.natural_group(P.abundances(s, d)).select("grp").distinct().withColumn("n", F.lit(0.002)), I.natural_group(P.abundances(s, d))).withColumn("n", R("n", 12)),
    "library_filenames": lambda s, d: I.with_lookup(P.abundances(s, d).select("z", "a"), I.evaluations(P.abundances(s, d))).select("z", "a", F.explode(F.array(*map(F.lit, LIBRARIES))).alias("library"), "mat").select("library", "z", "a", X.evaluation_file(F.col("library"), F.col("z"), F.col("a"), F.col("mat")).alias("file")),
    "resolution_conversion": lambda s, d: A.grid(s, d).select("i", X.kernel_parameters(F.col("value") % 2, F.col("value") % 3, F.lit(0.1), F.col("i") % 5 == 0).alias("p")).select("i", R("p.dt_us").alias("dt_us"), R("p.dl_m").alias("dl_m"), "p.de"),
    "external_r": lambda s, d: externals(s, d),
    "background_jacobian": lambda s, d: curve(s, d).select(R("e").alias("e"), *[R(c).alias(n) for n, c in X.background_jacobian(F.col("value"), F.col("e"), 0.03, 1.5).items()]),
    "kernel_at_energy": lambda s, d: X.kernels_at(A.grid(s, d).select(F.col("value").alias("e")), kernels(s)).select(R("e").alias("e"), "k", R("offset").alias("offset"), R("weight").alias("weight")),
    "tabulated_resolution": lambda s, d: X.tabulated_resolution(curve(s, d), kernels(s), L).select(R("e").alias("e"), R("value", 8).alias("value")),
    "tabulated_resolution_curves": lambda s, d: X.tabulated_resolution(curves(s, d), kernels(s), L, ["p_brand"]).select("p_brand", R("e").alias("e"), R("value", 8).alias("value")),
    "fisher_matrix": lambda s, d: X.fisher_matrix(P.M.group_sigma(P.spectra(s, d).drop("grp"), P.members(s, d)), P.members(s, d).select("grp").distinct().select("grp", (0.0005 * (1 + F.col("grp").cast("int") % 4)).alias("n")), 1e3).select("g1", "g2", R("fisher", 4).alias("fisher")),
    "noisy_cube": lambda s, d: X.add_poisson_noise(C.C.to_spectra(C.cells(s, d), "transmission"), 1e4, 7),
    "embedded_size": lambda s, d: project.embedded_size(C.full(s, d, "view")),
    "map_report_rows": lambda s, d: project.report_rows(C.cells(s, d).select(F.concat(F.lit("a|"), F.col("y").cast("string")).alias("label"), F.round("transmission", 2).alias("density"), (F.col("sigma") < float("inf")).alias("converged"))).select("label", "n_converged", "n_total"),
    "wave_numbers": lambda s, d: A.grid(s, d).select("i", R(S.wave_number_squared(F.col("value"), F.lit(236.006)), 15).alias("k2"), R(S.pi_over_k2_barns(F.col("value"), F.lit(236.006)), 6).alias("pi_k2"), R(S.channel_radius_fm(F.col("value")), 9).alias("radius"), R(S.statistical_weight(F.lit(0.5) + F.col("i") % 4, F.lit(3.5)), 9).alias("g")),
}
ORACLES = {
    "quadrature_weights": f"""WITH {A.GR}, v AS (SELECT i, value, lag(value, 2, 0) OVER w AS a, lag(value, 1, 0) OVER w AS b, lead(value, 1, 0) OVER w AS d, lead(value, 2, 0) OVER w AS f FROM gr WINDOW w AS (ORDER BY i)),
x AS (SELECT i, b - a AS v1, value - b AS v2, d - value AS v3, f - d AS v4 FROM v)
SELECT i, round(CASE WHEN i >= 2 THEN v1 ELSE 0 END + CASE WHEN i >= 1 THEN 5 * v2 ELSE 0 END + CASE WHEN i <> (SELECT max(i) FROM gr) THEN 5 * v3 ELSE 0 END + CASE WHEN i < (SELECT max(i) FROM gr) - 1 THEN v4 ELSE 0 END + CASE WHEN i >= 2 AND i <> (SELECT max(i) FROM gr) THEN (v3 * v3 - v1 * v1) / v2 ELSE 0 END - CASE WHEN i >= 1 AND i < (SELECT max(i) FROM gr) - 1 THEN (v4 * v4 - v2 * v2) / v3 ELSE 0 END, 9) AS weight FROM x""",
    "sparse_row_offsets": f"WITH {P.SP}, {scans._PLAN} SELECT i::INT AS i, (sum(c) OVER (ORDER BY i) - c)::BIGINT AS first, (sum(c) OVER (ORDER BY i))::BIGINT AS stop FROM (SELECT i, count(*) AS c FROM pl WHERE w <> 0 GROUP BY i)",
    "distinct_parameters": "SELECT grp, string_agg(p::VARCHAR, ',' ORDER BY p) AS parameters FROM (SELECT DISTINCT label::VARCHAR AS grp, vec_id % 7 AS p FROM embeddings) GROUP BY grp",
    "spin_group_offsets": f"WITH {_SG} SELECT \"case\", number, l, round(j + CASE WHEN spin > 0 THEN (row_number() OVER (PARTITION BY \"case\", l, j ORDER BY number) - 1) * 1e-6 ELSE 0 END, 9) AS j FROM sg",
    "spin_group_resonances": f"WITH {_SG} SELECT sg.\"case\", sg.number, coalesce(er, 0) AS er, coalesce(gn, 0) AS gn FROM sg LEFT JOIN rs ON sg.\"case\" = rs.\"case\" AND sg.number = rs.number",
    "undefined_spin_groups": f"WITH {_SG} SELECT \"case\", number, er, gn FROM rs WHERE number < 0",
    "group_expansion": f"WITH {P.AB}, {P.SY} SELECT symbol || ' (nat)' AS grp, z, a, round(0.002::DOUBLE * fraction / sum(fraction) OVER (PARTITION BY z), 12) AS n FROM ab JOIN sy USING (z)",
    "library_filenames": f"WITH {P.AB}, {P.SY}, m AS (SELECT z, a, symbol, 100 * z + 25 + 3 * (a - min(a) OVER (PARTITION BY z)) AS mat FROM ab JOIN sy USING (z)), l AS (SELECT unnest(['ENDF-B-VIII.0', 'ENDF-B-VIII.1', 'JEFF-3.3', 'JENDL-5', 'TENDL-2023', 'CENDL-3.2']) AS library) SELECT library, z, a, CASE WHEN library IN ('ENDF-B-VIII.0', 'JEFF-3.3') THEN printf('n_%04d_%d-%s-%d.zip', mat, z, symbol, a) ELSE printf('n_%03d-%s-%d_%04d.zip', z, symbol, a, mat) END AS file FROM m, l",
    "resolution_conversion": f"WITH {A.GR} SELECT i, CASE WHEN i % 5 <> 0 THEN round((value % 3) / (2 * sqrt(ln(2))), 9) END AS dt_us, CASE WHEN i % 5 <> 0 THEN round((value % 2) / sqrt(6), 9) END AS dl_m, CASE WHEN i % 5 <> 0 THEN 0.1::DOUBLE END AS de FROM gr",
    "external_r": f"WITH {A.GR} SELECT i, round(0.1::DOUBLE + 0.01::DOUBLE * value + 0.001::DOUBLE * value * value - CASE WHEN value > 2 AND value < 60 THEN (0.2::DOUBLE + 0.02::DOUBLE * value) * ln((60 - value) / (value - 2)) ELSE 0 END + 0.02::DOUBLE * 58, 9) AS r FROM gr",
    "background_jacobian": f"WITH {A.GR} SELECT round(value, 9) AS e, round(exp(-1 / (1 + pow((value - 15) / 0.8::DOUBLE, 2))), 9) AS d_a, 1::DOUBLE AS d_ba, round(1 / sqrt(value), 9) AS d_bb, round(sqrt(value), 9) AS d_bc, round(exp(-1.5 / sqrt(value)), 9) AS d_bd, round(-0.03::DOUBLE / sqrt(value) * exp(-1.5 / sqrt(value)), 9) AS d_bf FROM gr",
    "kernel_at_energy": f'WITH {_AT} SELECT round(e, 9) AS e, k, round(o, 9) AS "offset", round(w, 9) AS weight FROM ka',
    "tabulated_resolution": f"""WITH {_AT}, wd AS (SELECT *, lag(o) OVER x AS p, lead(o) OVER x AS q FROM ka WINDOW x AS (PARTITION BY e ORDER BY k)),
pt AS (SELECT e AS oe, w * abs(CASE WHEN p IS NULL AND q IS NULL THEN 1 WHEN p IS NULL THEN q - o WHEN q IS NULL THEN o - p ELSE (q - p) / 2 END) AS wt, pow({_FL} / ({_FL} / sqrt(e) + o), 2) AS x FROM wd WHERE w > 0 AND {_FL} / sqrt(e) + o > 0),
cv AS (SELECT value AS x0, exp(-1 / (1 + pow((value - 15) / 0.8::DOUBLE, 2))) AS y0, lead(value) OVER (ORDER BY i) AS x1, exp(-1 / (1 + pow((lead(value) OVER (ORDER BY i) - 15) / 0.8::DOUBLE, 2))) AS y1 FROM gr)
SELECT round(oe, 9) AS e, round(sum(wt * coalesce(y0 + (y1 - y0) * (x - x0) / (x1 - x0), y0)) / sum(wt), 8) AS value FROM pt JOIN cv ON x >= x0 AND (x < x1 OR (x1 IS NULL AND x = x0)) GROUP BY oe""",
    "tabulated_resolution_curves": f"""WITH {_AT}, wd AS (SELECT *, lag(o) OVER x AS p, lead(o) OVER x AS q FROM ka WINDOW x AS (PARTITION BY e ORDER BY k)),
pt AS (SELECT e AS oe, w * abs(CASE WHEN p IS NULL AND q IS NULL THEN 1 WHEN p IS NULL THEN q - o WHEN q IS NULL THEN o - p ELSE (q - p) / 2 END) AS wt, pow({_FL} / ({_FL} / sqrt(e) + o), 2) AS x FROM wd WHERE w > 0 AND {_FL} / sqrt(e) + o > 0),
br AS (SELECT DISTINCT p_brand, 10 + regexp_extract(p_brand, '([0-9]+)$', 1)::INT * 0.3::DOUBLE AS m FROM part),
cv AS (SELECT p_brand, value AS x0, exp(-1 / (1 + pow((value - m) / 0.8::DOUBLE, 2))) AS y0, lead(value) OVER z AS x1, exp(-1 / (1 + pow((lead(value) OVER z - m) / 0.8::DOUBLE, 2))) AS y1 FROM gr, br WINDOW z AS (PARTITION BY p_brand ORDER BY i))
SELECT p_brand, round(oe, 9) AS e, round(sum(wt * coalesce(y0 + (y1 - y0) * (x - x0) / (x1 - x0), y0)) / sum(wt), 8) AS value FROM pt JOIN cv ON x >= x0 AND (x < x1 OR (x1 IS NULL AND x = x0)) GROUP BY p_brand, oe""",
    "fisher_matrix": f"WITH {P.SP}, g AS (SELECT grp, i, sum(sigma / n) AS sigma FROM sp JOIN (SELECT label::VARCHAR AS grp, count(*) AS n FROM embeddings GROUP BY 1) USING (grp) GROUP BY grp, i), t AS (SELECT i, exp(-sum(0.0005::DOUBLE * (1 + grp::INT % 4) * sigma)) AS t FROM g GROUP BY i) SELECT a.grp AS g1, b.grp AS g2, round(sum(1e3 * a.sigma * b.sigma * t), 4) AS fisher FROM g a JOIN g b ON a.i = b.i AND a.grp <= b.grp JOIN t ON t.i = a.i GROUP BY ALL",
    "embedded_size": f"WITH {C.EV} SELECT count(*) * 8 AS raw_bytes, floor(count(*) * 8 / 3.0)::BIGINT AS compressed_bytes FROM vw",
    "map_report_rows": f"WITH {C.EV}, {C.NORM} SELECT 'a\\|' || y AS label, count(*) FILTER (WHERE isfinite(sigma)) AS n_converged, count(*) AS n_total FROM nm GROUP BY y",
    "wave_numbers": f"WITH {A.GR}, k AS (SELECT i, value, 236.006::DOUBLE AS awr FROM gr) SELECT i, round({P._K2('value')}, 15) AS k2, round(pi() / {P._K2('value')} / 100, 6) AS pi_k2, round((0.123::DOUBLE * cbrt(value) + 0.08::DOUBLE) * 10, 9) AS radius, round((2 * (0.5 + i % 4) + 1) / 16, 9) AS g FROM k",
}
