"""Record-level operators, surrogates and scalar functions over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.functions import scalars as S
from tofcube.operators import models as M
from tofcube.operators import records as R
from tofcube.operators import surrogate as C
from tofcube.plans import axes as A
from tofcube.plans import models as P

N = lambda c, n=9: F.round(c, n)


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A range for each supplier, of any kind."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 4).cast("int").alias("lru"), (F.col("s_suppkey") % 9).cast("int").alias("lrf"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as spin groups of cases (nations); every other case has labels, some missing."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(F.col("c_nationkey").alias("case"), k.alias("number"), F.when((F.col("c_nationkey") % 2 == 0) & (k % 5 > 0), F.concat(F.lit("Iso"), (k % 5).cast("string"))).alias("label"), (0.1 * (k % 5)).alias("abundance"), F.when((k % 5 == 3) & (k % 7 == 0), 2.5).otherwise(0.5 * (k % 5)).alias("spin"), (0.5 + k % 4 + F.when(k % 3 == 0, 1e-6).otherwise(0.0)).alias("j"))


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as layers; some can't be."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t.select(k.alias("layer"), F.when(k % 97 == 0, float("nan")).when(k % 89 == 0, -F.col("l_discount") - 1.0).otherwise(F.col("l_discount").cast("double")).alias("density"), F.when(k % 83 == 0, float("inf")).otherwise(F.col("l_quantity").cast("double")).alias("temperature"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Densities of one to four groups and their boxes, from parts."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    n = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 4), lambda j: (k + j * 7) % 19 * 0.001)
    return p.select(k.alias("k"), n.alias("n"), F.transform(n, lambda x: F.lit(0.012)).alias("box"))


def libraries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    iso = P.I.evaluations(P.abundances(spark, sf))
    own = iso.where("a % 2 = 0").select(F.lit("TENDL-2023").alias("library"), "z", "a", (F.col("mat") + 1).alias("mat"))
    rows = iso.select(F.explode(F.array(*map(F.lit, ("ENDF-B-VIII.0", "TENDL-2023", "CENDL-3.2")))).alias("library"), "z", "a").unionByName(spark.createDataFrame([("JEFF-3.3", 1, 1)], "library string, z int, a int"))
    return rows, iso, own


def surrogate(spark: SparkSession, sf: str) -> DataFrame:
    """iso, i, value: blurred transmission of every spectrum's own density by the polynomials of its group's mean cross section."""
    gs = M.group_sigma(P.spectra(spark, sf).drop("grp"), P.members(spark, sf)).select("grp", "i", "sigma")
    plan = C.chebyshev_plan(gs, P.matrix(spark), 0.05, by=("grp",))
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("iso"), F.col("label").cast("string").alias("grp"), (0.001 + F.col("vec_id") % 40 * 0.001).alias("n"))
    rows = d.join(plan, "grp")
    return rows.select("iso", "i", N(C.chebyshev_value(F.col("coefficients"), F.col("box"), F.col("n")), 7).alias("value"))


_GRID = lambda s, d: A.grid(s, d).select("i", F.col("value").alias("e"), F.exp(-0.01 * F.col("value")).alias("t"))
_WAVES = lambda s, d: P.waves(s, d).select((F.col("l") % 3).cast("int").alias("l"), "rho")
_HIGH = lambda s, d: P.waves(s, d).select((5 + F.col("l") % 2).cast("int").alias("l"), (0.5 + F.col("rho")).alias("rho"))


QUERIES = {
    "poisson_weights": lambda s, d: P.fit_cells(s, d).select("tof_bin", "y", "x", N(S.poisson_weight(F.col("s"), F.col("o") * F.col("t"))).alias("weight"), N(S.poisson_curvature(F.col("s"), F.col("o") * F.col("t"))).alias("curvature")),
    "counts_models": lambda s, d: _GRID(s, d).select("i", N(S.counts_model(F.col("e") * 100, F.col("t"), F.lit(3.0), 1.02, 0.9)).alias("counts"), N(S.likelihood_background(F.col("t"), F.col("e"), 0.01, 0.02)).alias("t")),
    "center_of_mass": lambda s, d: _GRID(s, d).select("i", N(S.lab_to_cm(F.col("e"), F.lit(55.454))).alias("e_cm"), N(S.scattering_radius(F.when(F.col("i") % 3 == 0, F.col("e") * 0.1), F.lit(5.4))).alias("radius")),
    "penetrability_slope": lambda s, d: _WAVES(s, d).select("l", N("rho", 6).alias("rho"), N(S.penetrability_slope(F.col("l"), F.col("rho"))).alias("slope")),
    "penetrability_high_l": lambda s, d: _HIGH(s, d).select("l", N("rho", 6).alias("rho"), N(S.penetrability(F.col("l"), F.col("rho"))).alias("p")),
    "resonance_counts": lambda s, d: R.resonance_counts(P.resonances(s, d), ["za", "l"]),
    "resonances_by_energy": lambda s, d: R.by_energy(P.resonances(s, d), ["za"]).select("za", "n", N("er").alias("er")),
    "evaluable_ranges": lambda s, d: R.evaluable(ranges(s, d)),
    "spin_groups_by_j": lambda s, d: R.spin_groups_by_j(groups(s, d), ["case"]),
    "isotope_parts": lambda s, d: R.isotope_parts(groups(s, d)).select("case", "number", "part", "conflict"),
    "library_lookup": lambda s, d: R.library_lookup(*libraries(s, d)),
    "layer_faults": lambda s, d: R.layer_faults(layers(s, d)).select("layer", "fault"),
    "density_box": lambda s, d: boxes(s, d).select("k", R.within_box(F.col("n"), F.col("box")).alias("inside")),
    "tof_axis_us": lambda s, d: R.tof_axis(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), (F.col("event_id") * 12345.0).alias("ns"))).select("i", N("value").alias("value")),
    "attribute_fallback": lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", R.attribute(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")), F.lit(25.0)).alias("flight_path")),
    "dead_mask": lambda s, d: R.dead_mask(s.read.parquet(f"{d}/part.parquet").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), (F.col("p_partkey") % 50).cast("int").alias("x"), (F.col("p_size") % 5).cast("int").alias("mask"))),
    "width_override": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", R.override((F.col("p_size") % 4).cast("double"), F.lit(0.25)).alias("width")),
    "region_law": lambda s, d: s.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 60).alias("id")).select(F.col("id").cast("int").alias("i"), R.region_law(F.col("id").cast("int"), F.when(F.col("id") % 4 < 3, F.array(*map(F.lit, (10, 25, 40)))).otherwise(F.array().cast("array<int>")), F.when(F.col("id") % 4 < 3, F.array(*map(F.lit, (5, 2, 3)))).otherwise(F.array().cast("array<int>"))).alias("law")),
    "chebyshev_surrogate": surrogate,
}

_MU = "(o * t)"
_SG = "sg AS (SELECT c_nationkey AS \"case\", c_custkey AS number, CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 5 > 0 THEN 'Iso' || c_custkey % 5 END AS label, 0.1::DOUBLE * (c_custkey % 5) AS abundance, CASE WHEN c_custkey % 5 = 3 AND c_custkey % 7 = 0 THEN 2.5 ELSE 0.5 * (c_custkey % 5) END AS spin, 0.5 + c_custkey % 4 AS j FROM customer)"
ORACLES = {
    "poisson_weights": f"WITH {P.FC} SELECT tof_bin, y, x, round(CASE WHEN {_MU} > 1e-10 THEN 1 - s / {_MU} ELSE 1 - s / 1e-10 + greatest(s / 1e-20, 1e10) * ({_MU} - 1e-10) END, 9) AS weight, round(CASE WHEN {_MU} > 1e-10 THEN s / pow({_MU}, 2) ELSE greatest(s / 1e-20, 1e10) END, 9) AS curvature FROM fc",
    "counts_models": f"WITH {A.GR} SELECT i, round(1.02::DOUBLE * value * 100 * exp(-0.01::DOUBLE * value) + 0.9::DOUBLE * 3, 9) AS counts, round(exp(-0.01::DOUBLE * value) + 0.01::DOUBLE + 0.02::DOUBLE / sqrt(value), 9) AS t FROM gr",
    "center_of_mass": f"WITH {A.GR} SELECT i, round(value * 55.454::DOUBLE / 56.454::DOUBLE, 9) AS e_cm, round(CASE WHEN i % 3 = 0 THEN value * 0.1::DOUBLE ELSE 5.4 END, 9) AS radius FROM gr",
    # by differentiation of the closed forms
    "penetrability_slope": f"WITH {P.PT}, p AS (SELECT (l % 3)::INT AS l, rho AS r FROM pt) SELECT l, round(r, 6) AS rho, round(CASE l WHEN 0 THEN 1 WHEN 1 THEN (3 * r * r + pow(r, 4)) / pow(1 + r * r, 2) ELSE (45 * pow(r, 4) + 9 * pow(r, 6) + pow(r, 8)) / pow(9 + 3 * r * r + pow(r, 4), 2) END, 9) AS slope FROM p",
    "penetrability_high_l": f"WITH {P.PT}, p AS (SELECT (5 + l % 2)::INT AS l, 0.5::DOUBLE + rho AS r FROM pt) SELECT l, round(r, 6) AS rho, round(CASE l WHEN 5 THEN pow(r, 11) / (893025 + 99225 * pow(r, 2) + 6300 * pow(r, 4) + 315 * pow(r, 6) + 15 * pow(r, 8) + pow(r, 10)) ELSE pow(r, 13) / (108056025 + 9823275 * pow(r, 2) + 496125 * pow(r, 4) + 18900 * pow(r, 6) + 630 * pow(r, 8) + 21 * pow(r, 10) + pow(r, 12)) END, 9) AS p FROM p",
    "resonance_counts": f"WITH {P.RS} SELECT za, l, count(*) AS resonances FROM rs GROUP BY za, l",
    "resonances_by_energy": f"WITH {P.RS} SELECT za, (row_number() OVER (PARTITION BY za ORDER BY er, gn) - 1)::INT AS n, round(er, 9) AS er FROM rs",
    "evaluable_ranges": "SELECT k, lru, lrf FROM (SELECT s_suppkey AS k, (s_suppkey % 4)::INT AS lru, (s_suppkey % 9)::INT AS lrf FROM supplier) WHERE (lru = 1 AND lrf IN (1, 2, 3, 7)) OR (lru = 2 AND lrf IN (1, 2))",
    "spin_groups_by_j": 'SELECT c_nationkey AS "case", round(0.5 + c_custkey % 4 + CASE WHEN c_custkey % 3 = 0 THEN 1e-6 ELSE 0 END, 8)::DOUBLE AS j, count(*) AS n FROM customer GROUP BY 1, 2',
    "isotope_parts": f"""WITH {_SG}, h AS (SELECT *, count(label) OVER (PARTITION BY "case") > 0 AS has FROM sg), p AS (SELECT *, CASE WHEN has THEN upper(coalesce(label, 'unknown')) ELSE printf('%.6f', abundance) || '_' || printf('%.1f', spin) END AS part FROM h)
SELECT "case", number, part, max(abundance) OVER w - min(abundance) OVER w >= 1e-12 OR max(spin) OVER w - min(spin) OVER w >= 1e-12 AS conflict FROM p WINDOW w AS (PARTITION BY "case", part)""",
    "library_lookup": f"WITH {P.AB}, m AS (SELECT z, a, (100 * z + 25 + 3 * (a - min(a) OVER (PARTITION BY z)))::INT AS mat FROM ab) SELECT 'ENDF-B-VIII.0' AS library, z, a, mat FROM m UNION ALL SELECT 'TENDL-2023', z, a, CASE WHEN a % 2 = 0 THEN mat + 1 END FROM m UNION ALL SELECT 'CENDL-3.2', z, a, NULL FROM m UNION ALL SELECT 'JEFF-3.3', 1, 1, NULL",
    "layer_faults": "SELECT layer, CASE WHEN layer % 97 = 0 OR layer % 89 = 0 THEN 'density' ELSE 'temperature' END AS fault FROM (SELECT l_orderkey * 10 + l_linenumber AS layer FROM lineitem) WHERE layer % 97 = 0 OR layer % 89 = 0 OR layer % 83 = 0",
    "density_box": "SELECT k, list_bool_and([x <= 0.012::DOUBLE * CASE WHEN k % 4 > 0 THEN 1.5 ELSE 1 END for x in n]) AS inside FROM (SELECT p_partkey AS k, [((p_partkey + j * 7) % 19) * 0.001::DOUBLE for j in range(0, p_partkey % 4 + 1)] AS n FROM part)",
    "tof_axis_us": "SELECT event_id AS i, round(event_id * 12345.0::DOUBLE / 1000, 9) AS value FROM events",
    "attribute_fallback": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE 25.0 END::DOUBLE AS flight_path FROM supplier",
    "dead_mask": "SELECT (p_partkey // 50)::INT AS y, (p_partkey % 50)::INT AS x FROM part WHERE p_size % 5 > 0",
    "width_override": "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.25 ELSE p_size % 4 END::DOUBLE AS width FROM part",
    "region_law": "SELECT i::INT AS i, CASE WHEN i % 4 = 3 THEN 2 WHEN i + 2 <= 10 THEN 5 WHEN i + 2 <= 25 THEN 2 ELSE 3 END::INT AS law FROM (SELECT p_partkey % 60 AS i FROM part)",
    # the value that the polynomials stand for
    "chebyshev_surrogate": f"WITH {P.SP}, g AS (SELECT grp, i, avg(sigma) AS sigma FROM sp GROUP BY grp, i), m AS (SELECT i::INT AS i, j::INT AS j, 1 / (1 + abs(i - j)::DOUBLE) AS w FROM range(64) a(i), range(64) b(j) WHERE abs(i - j) <= 3), n AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM m) SELECT vec_id AS iso, n.i, round(sum(w * exp(-(0.001::DOUBLE + vec_id % 40 * 0.001::DOUBLE) * sigma)), 7) AS value FROM embeddings JOIN g ON g.grp = label::VARCHAR JOIN n ON g.i = n.j GROUP BY vec_id, n.i",
}
