"""Ordered scans over the driver's tables: as-of and interval joins, band joins, compiled resolution, kept values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators import broaden, grids, sparse
from tofcube.operators import models as M
from tofcube.operators.asof import bracket, in_intervals
from tofcube.operators.ordering import kept_values
from tofcube.plans import models as P

FLIGHT, DT, DL = 25.0, 0.0005, 2e-4


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def price_steps(spark: SparkSession, sf: str) -> DataFrame:
    """key, x, part: price steps from parts, one for each key and price."""
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 4).alias("key"), (F.col("p_retailprice") * F.col("p_size")).alias("x"), "p_partkey")
    return p.groupBy("key", "x").agg(F.min("p_partkey").alias("part"))


def price_bracket(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item between the price steps around its price."""
    points = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 4).alias("key"), F.col("l_extendedprice").alias("x"))
    found = bracket(points, price_steps(spark, sf), ["key"], "x", ["part"])
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("x").alias("price"), F.col("before.part").alias("part_below"), F.col("after.part").alias("part_above"), F.round((F.col("x") - F.col("before.x")) / (F.col("after.x") - F.col("before.x")), 9).alias("share"))


def price_bands(spark: SparkSession, sf: str) -> DataFrame:
    """key, lo, hi: bands of prices from the sizes of parts; those of key 3 overlap, some of the others touch."""
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 4).alias("key"), F.col("p_size").cast("double").alias("s")).distinct()
    return p.select("key", (F.col("s") * 2000.0).alias("lo"), (F.col("s") * 2000.0 + F.when(F.col("key") == 3, 5000.0).when(F.col("s") % 3 == 0, 2000.0).otherwise(1100.0)).alias("hi"))


def bands_of_items(spark: SparkSession, sf: str) -> DataFrame:
    points = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 4).alias("key"), F.round(F.col("l_extendedprice"), -2).alias("x"))
    return in_intervals(points, price_bands(spark, sf), "key", "x", "lo", "hi").select("l_orderkey", "l_linenumber", "l_suppkey", "x", "lo", "hi")


def item_curve(spark: SparkSession, sf: str) -> DataFrame:
    """one, e, value: all line items as one curve, ordered by order and line."""
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_extendedprice").alias("p"))
    return rows.select(F.lit(1).alias("one"), (1.0 + F.col("l_orderkey") + F.col("l_linenumber") / 8.0).alias("e"), F.sqrt("p").alias("value"))


def blurred_items(spark: SparkSession, sf: str) -> DataFrame:
    return broaden.gaussian_resolution(item_curve(spark, sf), FLIGHT, DT, DL, ["one"]).select("e", F.round("value", 4).alias("value"))


def axis(spark: SparkSession, sf: str) -> DataFrame:
    """i, e: the columns of the embeddings as energies."""
    return P.spectra(spark, sf).select("i").distinct().select("i", (1.0 + 0.5 * F.col("i")).alias("e"))


def brand_kernels(spark: SparkSession, sf: str) -> DataFrame:
    """A kernel of twelve points for each brand of part, weighted by its mean price."""
    p = _t(spark, sf, "part").groupBy(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("b")).agg(F.avg("p_retailprice").alias("m"))
    k = p.select("b", "m", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    return k.select((1.0 + 1.3 * F.col("b")).alias("ref_energy"), "k", ((F.col("k") - 5.5) * 0.4 * (1.0 + F.col("b") / 50.0)).alias("offset"), (1.0 / (1.0 + F.abs(F.col("k") - 5.5)) * (1.0 + (F.col("m") - 900.0) / 500.0)).alias("weight"))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.compile_plan(axis(spark, sf), brand_kernels(spark, sf), FLIGHT)


def plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sparse.entries(plan(spark, sf)).groupBy("i").agg(F.min("j").alias("start"), F.count("*").alias("nnz"), F.round(F.sum("w"), 9).alias("total"), F.round(F.sum(F.col("w") * F.col("j")), 7).alias("center"))
    return rows.select("i", "start", "nnz", "total", "center")


def plan_applied(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("iso"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 100.0).alias("values"))
    return sparse.apply_plan(plan(spark, sf), e, ["iso"]).select("iso", F.posexplode("values").alias("i", "v")).select("iso", "i", F.round("v", 7).alias("value"))


def kept_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices, each at least two thousandths above the last kept one."""
    return kept_values(_t(spark, sf, "orders").select(F.col("o_totalprice").alias("value")), 2e-3)


def extended_axis(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct prices of parts as an axis, extended beyond its ends and between its points."""
    own = _t(spark, sf, "part").select((F.col("p_retailprice") / 100.0).alias("value")).distinct()
    return grids.extended_grid(own, FLIGHT, 0.02, 2e-5).select("i", F.round("value", 7).alias("value"), "own")


def radii(spark: SparkSession, sf: str) -> DataFrame:
    """za, e_low, x, y, law: for each brand of part a radius by energy, from sizes and mean prices."""
    p = _t(spark, sf, "part").groupBy(F.hex(F.substring("p_brand", -2, 2)).alias("za"), "p_size").agg(F.avg("p_retailprice").alias("m"))
    return p.select("za", F.lit(0.0).alias("e_low"), (F.col("p_size") * 0.9).alias("x"), (6.0 + (F.col("m") - 900.0) / 30.0).alias("y"), F.lit(2).alias("law"))


def radius_by_energy(spark: SparkSession, sf: str) -> DataFrame:
    points = P.energies(spark, sf).select("za", F.lit(0.0).alias("e_low"), F.col("e").alias("x"))
    return M.radius_at(points, radii(spark, sf)).select("za", F.round("x", 6).alias("e"), F.round("y", 9).alias("radius"))


def slbw_tabled(spark: SparkSession, sf: str) -> DataFrame:
    out = M.slbw(P.energies(spark, sf), P.resonances(spark, sf), radii=radii(spark, sf))
    return P._r(out, "e", "elastic", "capture", "fission", "total").select("za", "e", "elastic", "capture", "fission", "total")


def erfc_sql(x: str) -> str:
    """erfc of a column: its series below 2.5, a continued fraction above."""
    odd, series, frac = [1.0], "0", f"abs({x})"
    for k in range(1, 40):
        odd.append(odd[-1] * (2 * k + 1))
    for c in reversed(odd):
        series = f"({1.0 / c!r}::DOUBLE + 2 * {x} * {x} * {series})"
    for k in range(40, 0, -1):
        frac = f"(abs({x}) + {k / 2.0}::DOUBLE / {frac})"
    near = f"1 - {2.0 / math.sqrt(math.pi)!r}::DOUBLE * exp(-{x} * {x}) * abs({x}) * {series}"
    one = f"CASE WHEN abs({x}) < 2.5 THEN {near} ELSE exp(-{x} * {x}) / ({math.sqrt(math.pi)!r}::DOUBLE * {frac}) END"
    return f"CASE WHEN {x} >= 0 THEN {one} ELSE 2 - ({one}) END"


def width_sql(e: str, dt: float, dl: float) -> str:
    return f"sqrt(pow(pow({e}, 1.5) * {2.0 * dt / (K.TOF_FACTOR * FLIGHT)!r}::DOUBLE, 2) + pow({e} * {2.0 * dl / FLIGHT!r}::DOUBLE, 2))"


def blur_sql(curve: str, by: str, dt: float, dl: float) -> str:
    """The CTE `blurred` (by, e, value) of a CTE (by, e, value): exact integrals of the lines between neighbours, over five widths. by: one for a single curve."""
    on = "" if by == "one" else f"b.{by} = s.{by} AND "
    return f"""bw AS MATERIALIZED (SELECT *, {width_sql('e', dt, dl)} AS w FROM {curve}),
bs AS MATERIALIZED (SELECT {by}, e AS x0, value AS y0, lead(e) OVER q AS x1, lead(value) OVER q AS y1 FROM {curve} WINDOW q AS (PARTITION BY {by} ORDER BY e)),
bp AS (SELECT b.{by}, b.e, w, y0, (y1 - y0) / (x1 - x0) AS slope, (x0 - b.e) / w AS a, (x1 - b.e) / w AS c FROM bw b JOIN bs s ON {on}s.x0 >= b.e - 5 * w AND s.x1 <= b.e + 5 * w),
bf AS (SELECT *, {erfc_sql('a')} AS fa, {erfc_sql('c')} AS fc FROM bp),
bq AS (SELECT {by}, e, sum(fa - fc) AS norm, sum(y0 * (fa - fc) + slope * w * ({2.0 / math.sqrt(math.pi)!r}::DOUBLE * 0.5 * (exp(-a * a) - exp(-c * c)) - a * (fa - fc))) AS part FROM bf GROUP BY {by}, e),
blurred AS (SELECT b.{by}, b.e, CASE WHEN norm > 1e-30 THEN part / norm ELSE value END AS value FROM bw b LEFT JOIN bq q ON b.{by} = q.{by} AND b.e = q.e)"""


def doppler_sql(curve: str, by: str, temperature: float, awr: float) -> str:
    """The CTE `broad` (by, e, sigma, d_sigma) of a CTE (by, e, sigma): in v = sqrt(e), lines of v sigma, kept level six widths beyond the ends."""
    u = math.sqrt(K.BOLTZMANN_EV_K * temperature / awr)
    return f"""dv AS MATERIALIZED (SELECT {by}, e, sqrt(e) AS v, sqrt(e) * sigma AS y FROM {curve}),
dn AS (SELECT {by}, min(v) AS a, max(v) AS b FROM dv GROUP BY {by}),
dx AS (SELECT {by}, v, y FROM dv UNION ALL SELECT dn.{by}, greatest(a - 6 * {u!r}::DOUBLE, 1e-12), y FROM dn JOIN dv ON dn.{by} = dv.{by} AND v = a UNION ALL SELECT dn.{by}, b + 6 * {u!r}::DOUBLE, y FROM dn JOIN dv ON dn.{by} = dv.{by} AND v = b),
ds AS MATERIALIZED (SELECT * FROM (SELECT {by}, v AS x0, y AS y0, lead(v) OVER q AS x1, lead(y) OVER q AS y1 FROM dx WINDOW q AS (PARTITION BY {by} ORDER BY v)) WHERE x1 IS NOT NULL),
dp AS (SELECT d.{by}, e, v, y0, (y1 - y0) / (x1 - x0) AS slope, (x0 - v) / {u!r}::DOUBLE AS a, (x1 - v) / {u!r}::DOUBLE AS c FROM dv d JOIN ds s ON d.{by} = s.{by} AND x1 > v - 6 * {u!r}::DOUBLE AND x0 < v + 6 * {u!r}::DOUBLE),
df AS (SELECT *, {math.sqrt(math.pi) / 2!r}::DOUBLE * ({erfc_sql('a')} - ({erfc_sql('c')})) AS j0, 0.5 * (exp(-a * a) - exp(-c * c)) AS j1 FROM dp),
dq AS (SELECT {by}, e, v, sum(j0) AS norm, sum((y0 - slope * {u!r}::DOUBLE * a) * j0 + slope * {u!r}::DOUBLE * j1) AS part, sum(slope * j1) AS bent FROM df GROUP BY {by}, e, v),
broad AS (SELECT {by}, e, greatest(part / norm / v, 0) AS sigma, CASE WHEN part > 0 THEN bent / norm / v * {u / (2 * temperature)!r}::DOUBLE ELSE 0 END AS d_sigma FROM dq)"""


#: Cross sections (grp, e, sigma) on the fine grid of the broadening queries.
CURVES = P.KI.replace("0.7::DOUBLE + m * 1.03::DOUBLE AS e", "1.0::DOUBLE + m * 0.02::DOUBLE AS e").replace("range(0, 40)", "range(0, 800)") + """,
cw AS (SELECT za, e, first(4 * u * pow(sin(phi), 2)) + sum(u * ge * ge / den + u * 2 * ge * (2 * d * sin(phi) * cos(phi) - tot * pow(sin(phi), 2)) / den) AS el, sum(u * ge * gg / den) AS cap, sum(u * ge * gf / den) AS fis FROM k3 GROUP BY za, e, l, j),
cs AS MATERIALIZED (SELECT za AS grp, e, sum(el) + sum(cap) + sum(fis) AS sigma FROM cw GROUP BY za, e)"""

_STEPS = "st AS MATERIALIZED (SELECT p_partkey % 4 AS key, p_retailprice * p_size AS x, min(p_partkey) AS part FROM part GROUP BY 1, 2)"
_BANDS = "bn AS (SELECT *, coalesce(lead(lo) OVER (PARTITION BY key ORDER BY lo, hi) = hi, false) AS op FROM (SELECT key, s * 2000 AS lo, s * 2000 + CASE WHEN key = 3 THEN 5000 WHEN s % 3 = 0 THEN 2000 ELSE 1100 END AS hi FROM (SELECT DISTINCT p_partkey % 4 AS key, p_size::DOUBLE AS s FROM part)))"
_PLAN = f"""ax AS (SELECT i, 1 + 0.5::DOUBLE * i AS e FROM (SELECT DISTINCT i FROM sp)),
br AS (SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS b, avg(p_retailprice) AS m FROM part GROUP BY 1),
kr AS (SELECT 1 + 1.3::DOUBLE * b AS ref, k, (k - 5.5::DOUBLE) * 0.4 * (1 + b / 50.0::DOUBLE) AS o, 1 / (1 + abs(k - 5.5::DOUBLE)) * (1 + (m - 900) / 500) AS w FROM br, unnest(range(12)) t(k)),
rf AS (SELECT ref AS lo, lead(ref) OVER (ORDER BY ref) AS hi, row_number() OVER (ORDER BY ref) AS n FROM (SELECT DISTINCT ref FROM kr)),
fr AS (SELECT i, e, lo, CASE WHEN e > lo THEN hi END AS up, CASE WHEN e > lo AND hi IS NOT NULL THEN (ln(e) - ln(lo)) / (ln(hi) - ln(lo)) ELSE 0 END AS f FROM ax JOIN rf ON (e > lo OR n = 1) AND (hi IS NULL OR e <= hi)),
ka AS (SELECT i, e, a.k, CASE WHEN b.o IS NULL THEN a.o ELSE a.o + f * (b.o - a.o) END AS o, CASE WHEN b.w IS NULL THEN a.w ELSE a.w + f * (b.w - a.w) END AS w FROM fr JOIN kr a ON a.ref = lo LEFT JOIN kr b ON b.ref = up AND b.k = a.k),
wd AS (SELECT *, lag(o) OVER x AS p, lead(o) OVER x AS q, {K.TOF_FACTOR * FLIGHT!r}::DOUBLE / sqrt(e) + o AS tof FROM ka WINDOW x AS (PARTITION BY i ORDER BY k)),
pt AS (SELECT i, w * abs(CASE WHEN p IS NULL THEN q - o WHEN q IS NULL THEN o - p ELSE (q - p) / 2 END) AS wt, pow({K.TOF_FACTOR * FLIGHT!r}::DOUBLE / tof, 2) AS x FROM wd WHERE w > 0 AND tof > 0),
sg AS (SELECT i AS j, e AS x0, lead(e) OVER (ORDER BY i) AS x1, lead(i) OVER (ORDER BY i) AS j1 FROM ax),
cl AS (SELECT i, j, j1, wt, (x - x0) / (x1 - x0) AS f FROM pt JOIN sg ON x >= x0 AND x < x1),
en AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, wt * (1 - f) AS w FROM cl UNION ALL SELECT i, j1, wt * f FROM cl) GROUP BY i, j),
pl AS MATERIALIZED (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM en)"""

_RADII = """tb AS MATERIALIZED (SELECT hex(right(p_brand, 2)) AS za, p_size * 0.9::DOUBLE AS x, 6 + (avg(p_retailprice) - 900) / 30 AS y FROM part GROUP BY 1, 2),
iv AS MATERIALIZED (SELECT za, x, y, lead(x) OVER q AS x1, lead(y) OVER q AS y1, row_number() OVER q AS k FROM tb WINDOW q AS (PARTITION BY za ORDER BY x))"""
_AT = lambda x: f"iv.za = {x[0]} AND ({x[1]} >= iv.x OR k = 1) AND (x1 IS NULL OR {x[1]} < x1)"
_Y = lambda x: f"CASE WHEN {x} <= iv.x OR x1 IS NULL THEN y ELSE y + (y1 - y) * ({x} - iv.x) / (x1 - iv.x) END"
#: The resonance formulas' rows with a radius for each energy and each resonance.
_TABLED = f"""{P.RS}, {_RADII}, er AS (SELECT eg.za, e, {_Y('e')} AS radius_e FROM eg JOIN iv ON {_AT(('eg.za', 'e'))}), rr AS (SELECT rs.*, {_Y('abs(er)')} AS radius_r FROM rs JOIN iv ON {_AT(('rs.za', 'abs(er)'))}),
k0 AS (SELECT *, sqrt({P._K2('e')}) * radius_e AS rho, sqrt({P._K2('abs(er)')}) * radius_r AS rr0, pi() / {P._K2('e')} / 100 * (2 * j + 1) / 2 AS u, e - er AS d FROM er JOIN rr USING (za)),
{P.KI[P.KI.index('k1 AS'):]}"""


QUERIES = {
    "price_bracket": price_bracket,
    "bands_of_items": bands_of_items,
    "blurred_items": blurred_items,
    "resolution_plan_rows": plan_rows,
    "resolution_plan_applied": plan_applied,
    "kept_prices": kept_prices,
    "extended_axis": extended_axis,
    "radius_by_energy": radius_by_energy,
    "slbw_tabled_radius": slbw_tabled,
}
ORACLES = {
    "price_bracket": f"""WITH {_STEPS}, pt AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 4 AS key, l_extendedprice AS x FROM lineitem),
lo AS (SELECT pt.*, st.x AS x0, st.part AS p0 FROM pt ASOF LEFT JOIN st ON pt.key = st.key AND pt.x >= st.x)
SELECT l_orderkey, l_linenumber, l_suppkey, lo.x AS price, p0 AS part_below, st.part AS part_above, round((lo.x - x0) / (st.x - x0), 9) AS share FROM lo ASOF LEFT JOIN st ON lo.key = st.key AND lo.x < st.x""",
    "bands_of_items": f"""WITH {_BANDS}, pt AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 4 AS key, round(l_extendedprice, -2) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, x, lo, hi FROM pt JOIN bn ON pt.key = bn.key AND x >= lo AND (x < hi OR (NOT op AND x = hi))""",
    "blurred_items": f"""WITH cv AS MATERIALIZED (SELECT 1 AS one, 1 + l_orderkey + l_linenumber / 8.0::DOUBLE AS e, sqrt(avg(l_extendedprice)) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber),
{blur_sql('cv', 'one', DT, DL)} SELECT e, round(value, 4) AS value FROM blurred""",
    "resolution_plan_rows": f"WITH {P.SP}, {_PLAN} SELECT i::INT AS i, min(j)::INT AS start, count(*) AS nnz, round(sum(w), 9) AS total, round(sum(w * j), 7) AS center FROM pl WHERE w <> 0 GROUP BY i",
    "resolution_plan_applied": f"WITH {P.SP}, {_PLAN}, rk AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS n FROM (SELECT DISTINCT i FROM pl)) SELECT iso, n::INT AS i, round(sum(w * sigma), 7) AS value FROM pl JOIN rk USING (i) JOIN sp ON sp.i = pl.j GROUP BY iso, n",
    "kept_prices": """WITH RECURSIVE v AS (SELECT DISTINCT o_totalprice AS value FROM orders), k AS (
  SELECT 0 AS i, min(value) AS value FROM v
  UNION ALL
  SELECT i + 1, (SELECT min(v.value) FROM v WHERE v.value > k.value + greatest(abs(k.value), 1e-30) * 2e-3::DOUBLE) FROM k WHERE k.value IS NOT NULL)
SELECT i, value FROM k WHERE value IS NOT NULL""",
    "extended_axis": f"""WITH ax AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS n, count(*) OVER () AS m FROM (SELECT DISTINCT p_retailprice / 100 AS value FROM part)),
en AS (SELECT min(value) AS a, max(value) AS b, max(value) FILTER (WHERE n = 4) AS a5, min(value) FILTER (WHERE n = m - 5) AS b5 FROM ax),
es AS (SELECT *, (sqrt(a5) - sqrt(a)) / 4 AS sa, (sqrt(b) - sqrt(b5)) / 4 AS sb, {width_sql('a', 0.02, 2e-5)} AS wa, {width_sql('b', 0.02, 2e-5)} AS wb FROM en),
ep AS (SELECT pow(sqrt(a) - sa * k, 2) AS value FROM es, unnest(range(1, 1 + ceil((sqrt(a) - sqrt(greatest(a - 5 * wa, 0.001))) / sa)::INT)) t(k) UNION ALL SELECT pow(sqrt(b) + sb * k, 2) FROM es, unnest(range(1, 1 + ceil((sqrt(b + 5 * wb) - sqrt(b)) / sb)::INT)) t(k)),
g1 AS (SELECT value, lag(value) OVER (ORDER BY value) AS p FROM (SELECT value FROM ax UNION ALL SELECT value FROM ep)),
gp AS (SELECT p, value - p AS gap, ceil((value - p) / (0.25 * {width_sql('((value + p) * 0.5)', 0.02, 2e-5)}))::INT AS n FROM g1 WHERE p IS NOT NULL),
g2 AS (SELECT value FROM g1 UNION ALL SELECT p + gap / n * k FROM gp, unnest(range(1, n)) t(k) WHERE n > 1),
g3 AS (SELECT (row_number() OVER (ORDER BY value) - 1)::INT AS i, value FROM g2)
SELECT i, round(g3.value, 7) AS value, n::INT AS own FROM g3 LEFT JOIN ax ON g3.value = ax.value""",
    "radius_by_energy": f"WITH {P.RS}, {_RADII} SELECT eg.za, round(e, 6) AS e, round({_Y('e')}, 9) AS radius FROM eg JOIN iv ON {_AT(('eg.za', 'e'))}",
    "slbw_tabled_radius": f"WITH {_TABLED}, g AS (SELECT za, e, first(4 * u * pow(sin(phi), 2)) + sum(u * ge * ge / den + u * 2 * ge * (2 * d * sin(phi) * cos(phi) - tot * pow(sin(phi), 2)) / den) AS el, sum(u * ge * gg / den) AS cap, sum(u * ge * gf / den) AS fis FROM k3 GROUP BY za, e, l, j) {P._OUT}",
}
