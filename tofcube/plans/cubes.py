"""Event histograms, normalisation, rebinning, regions and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.operators import cube as C

BINS = C.Binning(50, 5.0, 105.0, 10, 10)
ROIS = [(1, 5, 2, 7), (3, 9, 0, 4)]
RATIO = 1.25  # open-beam charge over sample charge


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", "event_type", F.col("value").alias("tof"), (F.col("user_id") % 12 + 0.25 * (F.col("event_id") % 3)).alias("x"), (F.floor(F.col("user_id") / 12) % 12).cast("double").alias("y"))


def cube(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    """Sparse histogram of all events or of one type."""
    e = events(spark, sf)
    return C.histogram(e.where(F.col("event_type") == kind) if kind else e, BINS)


def full(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return C.dense(cube(spark, sf, kind), BINS)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalize(full(spark, sf, "view"), full(spark, sf, "click"), 1.0, RATIO)


def months(spark: SparkSession, sf: str) -> DataFrame:
    """A cube per run from lineitem: bin is the month from 1995 on, pixel the supplier, run the return flag."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    s = F.col("l_suppkey")
    rows = t.select("l_returnflag", month.cast("int").alias("tof_bin"), F.floor(s / 16).cast("int").alias("y"), (s % 16).cast("int").alias("x"), F.col("l_quantity").cast("bigint").alias("q"))
    return rows.groupBy(F.col("l_returnflag").alias("run"), *C.CELL).agg(F.sum("q").alias("value"))


R6 = lambda c: F.round(c, 6)

# -- the same in SQL ---------------------------------------------------------------------

EV = """ev AS (SELECT event_id, event_type, value AS tof, user_id % 12 + 0.25::DOUBLE * (event_id % 3) AS x, ((user_id // 12) % 12)::DOUBLE AS y FROM events),
st AS (SELECT *, CASE WHEN NOT isfinite(tof) THEN 'non_finite' WHEN tof < 5 OR tof >= 105 THEN 'tof_range' WHEN NOT isfinite(x) OR NOT isfinite(y) THEN 'non_finite'
  WHEN round(x) < 0 OR round(x) >= 10 OR round(y) < 0 OR round(y) >= 10 THEN 'spatial' ELSE 'kept' END AS status FROM ev),
h AS (SELECT event_type, least(floor((tof - 5) / 2), 49)::INT AS tof_bin, round(y)::INT AS y, round(x)::INT AS x FROM st WHERE status = 'kept'),
grid AS (SELECT (i // 100)::INT AS tof_bin, ((i % 100) // 10)::INT AS y, (i % 10)::INT AS x FROM range(5000) t(i)),
vw AS (SELECT tof_bin, y, x, count(h.event_type)::BIGINT AS value FROM grid LEFT JOIN (SELECT * FROM h WHERE event_type = 'view') h USING (tof_bin, y, x) GROUP BY ALL),
ck AS (SELECT tof_bin, y, x, count(h.event_type)::BIGINT AS value FROM grid LEFT JOIN (SELECT * FROM h WHERE event_type = 'click') h USING (tof_bin, y, x) GROUP BY ALL),
al AS (SELECT tof_bin, y, x, count(*)::BIGINT AS value FROM h GROUP BY ALL)"""
ROI_SQL = "((y >= 1 AND y < 5 AND x >= 2 AND x < 7) OR (y >= 3 AND y < 9 AND x >= 0 AND x < 4))"
NORM = """both_ AS (SELECT tof_bin, y, x, vw.value::DOUBLE AS s, ck.value::DOUBLE AS o FROM vw JOIN ck USING (tof_bin, y, x)),
nm AS (SELECT tof_bin, y, x, CASE WHEN o > 0 THEN s / o * 1.25::DOUBLE ELSE 0 END AS transmission,
  CASE WHEN o > 0 THEN sqrt((1.25::DOUBLE / o) * (1.25::DOUBLE / o) * (CASE WHEN s > 0 THEN s ELSE 0.5 END + s * s / o)) ELSE 'inf'::DOUBLE END AS sigma FROM both_)"""
MONTHS = """mo AS (SELECT l_returnflag AS run, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS tof_bin, (l_suppkey // 16)::INT AS y, (l_suppkey % 16)::INT AS x, sum(l_quantity::BIGINT)::BIGINT AS value FROM lineitem GROUP BY ALL)"""


def _finite(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN round({c}, 6) ELSE -1 END AS {c}"


def finite(c: str):
    """For results that are compared: -1 in place of infinity."""
    return F.when(F.abs(c) == float("inf"), -1.0).otherwise(R6(F.col(c))).alias(c)


def dark(spark: SparkSession) -> DataFrame:
    return spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 3 * 0.5).alias("value"))


def transmission_map(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: events to histograms, live pixels, normalisation, and a map of the mean transmission."""
    sample = full(spark, sf, "view")
    alive = C.live(sample, C.dead_pixels(sample))
    t = C.normalize(alive, full(spark, sf, "click"), 1.0, RATIO)
    valid = F.col("sigma") < float("inf")
    return t.groupBy("y", "x").agg(R6(F.avg(F.when(valid, F.col("transmission")))).alias("mean_transmission"), F.count_if(valid).alias("n_valid"))


QUERIES = {
    "transmission_map": transmission_map,
    "event_histogram": lambda s, d: cube(s, d),
    "event_histogram_dense": lambda s, d: full(s, d, "view"),
    "event_retention_stats": lambda s, d: C.retention(events(s, d), BINS),
    "preview_image": lambda s, d: C.preview(cube(s, d)),
    "cube_info": lambda s, d: C.cube_info(cube(s, d)),
    "normalize_cube": lambda s, d: cells(s, d).select(*C.CELL, R6(F.col("transmission")).alias("transmission"), finite("sigma")),
    "normalize_cube_dark": lambda s, d: C.normalize(full(s, d, "view"), full(s, d, "click"), 1.0, RATIO, dark(s)).select(*C.CELL, R6(F.col("transmission")).alias("transmission"), finite("sigma")),
    "counts_to_transmission": lambda s, d: C.counts_to_transmission(full(s, d, "view"), full(s, d, "click")).select(*C.CELL, R6(F.col("transmission")).alias("transmission"), R6(F.col("sigma")).alias("sigma")),
    "dead_pixels": lambda s, d: C.dead_pixels(full(s, d, "view")),
    "live_pixels": lambda s, d: C.live(full(s, d, "view"), C.dead_pixels(full(s, d, "view")), ROIS).select("y", "x").distinct(),
    "rebin_counts": lambda s, d: C.rebin(months(s, d), 7, by=("run",)),
    "rebin_transmission": lambda s, d: C.rebin(cells(s, d), 4, "avg", "transmission").withColumn("transmission", R6(F.col("transmission"))),
    "sum_over_angle": lambda s, d: C.sum_over_angle(months(s, d)),
    "select_angle": lambda s, d: months(s, d).where("run = 'R'").drop("run"),
    "average_roi": lambda s, d: C.roi_mean(full(s, d, "view"), ROIS[0]).withColumn("mean", R6(F.col("mean"))),
    "full_image_average": lambda s, d: C.roi_mean(full(s, d, "click")).withColumn("mean", R6(F.col("mean"))),
    "roi_finite_mean": lambda s, d: C.roi_mean(cells(s, d).withColumn("sigma", F.when(F.col("sigma") < float("inf"), F.col("sigma")).otherwise(float("nan"))), ROIS[1], "sigma", finite=True).select("tof_bin", F.when(F.isnan("mean"), -1.0).otherwise(R6(F.col("mean"))).alias("mean")),
    "roi_union_weighted": lambda s, d: C.roi_weighted(cells(s, d), ROIS).select("tof_bin", R6(F.col("mean")).alias("mean"), R6(F.col("sigma")).alias("sigma")),
    "mean_open_beam_flux": lambda s, d: C.roi_mean(C.live(full(s, d, "click"), C.dead_pixels(full(s, d, "view")))).withColumn("mean", R6(F.col("mean"))),
    "bounding_roi": lambda s, d: s.createDataFrame(ROIS, "y0 int, y1 int, x0 int, x1 int").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")),
    "extract_spectrum": lambda s, d: full(s, d, "view").where("y = 3 AND x = 4").select("tof_bin", "value"),
    "pixel_spectra": lambda s, d: C.to_spectra(full(s, d, "view")).select("y", "x", F.size("spectrum").alias("n_bins"), F.aggregate("spectrum", F.lit(0).cast("bigint"), lambda a, v: a * 31 % 1000003 + v).alias("digest")),
    "map_range": lambda s, d: C.data_range(cells(s, d), "sigma").select(R6(F.col("lo")).alias("lo"), R6(F.col("hi")).alias("hi")),
}

_ROUND2 = "round(transmission, 6) AS transmission"
ORACLES = {
    "transmission_map": f"WITH {EV}, {NORM}, dead AS (SELECT y, x FROM vw GROUP BY y, x HAVING bool_and(value = 0)) SELECT y, x, round(avg(transmission) FILTER (WHERE isfinite(sigma)), 6) AS mean_transmission, count(*) FILTER (WHERE isfinite(sigma)) AS n_valid FROM nm WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.y = nm.y AND dead.x = nm.x) GROUP BY y, x",
    "event_histogram": f"WITH {EV} SELECT tof_bin, y, x, value FROM al",
    "event_histogram_dense": f"WITH {EV} SELECT tof_bin, y, x, value FROM vw",
    "event_retention_stats": f"WITH {EV} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status = 'non_finite') AS dropped_non_finite, count(*) FILTER (WHERE status = 'tof_range') AS dropped_tof_range, count(*) FILTER (WHERE status = 'spatial') AS dropped_spatial FROM st",
    "preview_image": f"WITH {EV} SELECT y, x, sum(value)::BIGINT AS value FROM al GROUP BY y, x",
    "cube_info": f"WITH {EV} SELECT max(tof_bin) + 1 AS n_frames, max(y) + 1 AS height, max(x) + 1 AS width FROM al",
    "normalize_cube": f"WITH {EV}, {NORM} SELECT tof_bin, y, x, {_ROUND2}, {_finite('sigma')} FROM nm",
    "normalize_cube_dark": f"""WITH {EV}, dk AS (SELECT (i // 10)::INT AS y, (i % 10)::INT AS x, (i % 3) * 0.5::DOUBLE AS d FROM range(100) t(i)),
b AS (SELECT tof_bin, y, x, greatest(vw.value - d, 0)::DOUBLE AS s, greatest(ck.value - d, 0)::DOUBLE AS o FROM vw JOIN ck USING (tof_bin, y, x) JOIN dk USING (y, x)),
n2 AS (SELECT tof_bin, y, x, CASE WHEN o > 0 THEN s / o * 1.25::DOUBLE ELSE 0 END AS transmission, CASE WHEN o > 0 THEN sqrt((1.25::DOUBLE / o) * (1.25::DOUBLE / o) * (CASE WHEN s > 0 THEN s ELSE 0.5 END + s * s / o)) ELSE 'inf'::DOUBLE END AS sigma FROM b)
SELECT tof_bin, y, x, {_ROUND2}, {_finite('sigma')} FROM n2""",
    "counts_to_transmission": f"WITH {EV}, {NORM} SELECT tof_bin, y, x, round(CASE WHEN o > 0 THEN s / o ELSE 0 END, 6) AS transmission, round(CASE WHEN o <= 0 THEN 1e30 WHEN s <= 0 THEN 1e10 ELSE sqrt(greatest(s, 1)) / greatest(o, 1e-10) END, 6) AS sigma FROM both_",
    "dead_pixels": f"WITH {EV} SELECT y, x FROM vw GROUP BY y, x HAVING bool_and(value = 0)",
    "live_pixels": f"WITH {EV} SELECT y, x FROM vw WHERE {ROI_SQL} GROUP BY y, x HAVING NOT bool_and(value = 0)",
    "rebin_counts": f"WITH {MONTHS} SELECT run, (tof_bin // 7)::INT AS tof_bin, y, x, sum(value)::BIGINT AS value FROM mo GROUP BY ALL",
    "rebin_transmission": f"WITH {EV}, {NORM} SELECT (tof_bin // 4)::INT AS tof_bin, y, x, round(avg(transmission), 6) AS transmission FROM nm GROUP BY ALL",
    "sum_over_angle": f"WITH {MONTHS} SELECT tof_bin, y, x, sum(value)::BIGINT AS value FROM mo GROUP BY ALL",
    "select_angle": f"WITH {MONTHS} SELECT tof_bin, y, x, value FROM mo WHERE run = 'R'",
    "average_roi": f"WITH {EV} SELECT tof_bin, round(avg(value), 6) AS mean FROM vw WHERE y >= 1 AND y < 5 AND x >= 2 AND x < 7 GROUP BY tof_bin",
    "full_image_average": f"WITH {EV} SELECT tof_bin, round(avg(value), 6) AS mean FROM ck GROUP BY tof_bin",
    "roi_finite_mean": f"WITH {EV}, {NORM} SELECT tof_bin, coalesce(round(avg(sigma) FILTER (WHERE isfinite(sigma)), 6), -1) AS mean FROM nm WHERE y >= 3 AND y < 9 AND x >= 0 AND x < 4 GROUP BY tof_bin",
    "roi_union_weighted": f"WITH {EV}, {NORM}, w AS (SELECT tof_bin, transmission AS t, CASE WHEN isfinite(sigma) AND sigma > 0 THEN 1 / (sigma * sigma) ELSE 0 END AS w FROM nm WHERE {ROI_SQL}) SELECT tof_bin, round(CASE WHEN sum(w) > 0 THEN sum(w * t) / sum(w) ELSE 0 END, 6) AS mean, round(CASE WHEN sum(w) > 0 THEN 1 / sqrt(sum(w)) ELSE 1e30 END, 6) AS sigma FROM w GROUP BY tof_bin",
    "mean_open_beam_flux": f"WITH {EV}, dead AS (SELECT y, x FROM vw GROUP BY y, x HAVING bool_and(value = 0)) SELECT tof_bin, round(avg(value), 6) AS mean FROM ck WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.y = ck.y AND dead.x = ck.x) GROUP BY tof_bin",
    "bounding_roi": "SELECT 1::INT AS y0, 9::INT AS y1, 0::INT AS x0, 7::INT AS x1",
    "extract_spectrum": f"WITH {EV} SELECT tof_bin, value FROM vw WHERE y = 3 AND x = 4",
    "pixel_spectra": f"WITH {EV} SELECT y, x, len(l)::INT AS n_bins, list_reduce(list_prepend(0::BIGINT, l), lambda a, v: a * 31 % 1000003 + v)::BIGINT AS digest FROM (SELECT y, x, list(value ORDER BY tof_bin) AS l FROM vw GROUP BY y, x)",
    "map_range": f"WITH {EV}, {NORM} SELECT round(min(sigma), 6) AS lo, round(max(sigma), 6) AS hi FROM nm WHERE isfinite(sigma)",
}
