"""Spectral axes: edges and centres, checks between neighbours, energy windows.

Axes are dimension tables (i, value): one row per bin, whatever the number of pixels. Windows
over an axis are ordered in one partition, which its length bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.functions import scalars as S
from tofcube.operators.ordering import kept_values


#: Rows of a dimension that may be broadcast.
MOST_ROWS = 1_000_000


def bounded(rows: DataFrame, by: str, most: int = MOST_ROWS) -> DataFrame:
    """A dimension for broadcasting: with more than `most` rows of the column, the query ends with an error."""
    n = rows.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} rows in a dimension to be broadcast")).cast("boolean")).alias("_fits"))
    return F.broadcast(rows.join(F.broadcast(n)).where("_fits").drop("_fits"))  # one row, a count


def linspace_edges(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """n + 1 edges."""
    return spark.range(n + 1).select(F.col("id").cast("int").alias("i"), (F.lit(lo) + F.col("id") * (hi - lo) / n).alias("value"))


def edges_to_energy(edges: DataFrame, flight_m: float, delay_us: float = 0.0) -> DataFrame:
    """Energies of TOF edges, ascending. Corrected times that are not positive are an error."""
    t = F.col("value") - delay_us
    e = F.when(t > 0, S.tof_to_energy(t, flight_m)).otherwise(F.raise_error(F.lit("corrected time of flight must be positive")).cast("double"))
    return edges.select(e.alias("value")).select((F.row_number().over(W.orderBy("value")) - 1).cast("int").alias("i"), "value")


def centers(edges: DataFrame, geometric: bool = True) -> DataFrame:
    """Means of neighbouring edges: geometric for energies, arithmetic for times."""
    nxt = F.lead("value").over(W.orderBy("i"))
    mean = F.sqrt(F.col("value") * nxt) if geometric else (F.col("value") + nxt) / 2
    return edges.select("i", mean.alias("value")).where("value IS NOT NULL")


def axis_energies(axis: DataFrame, unit: str, kind: str, flight_m: float) -> DataFrame:
    """Bin energies from an axis in 'tof' or 'energy' units, given as 'edges' or 'centers'."""
    if unit == "tof" and kind == "centers":
        e = axis.select(S.tof_to_energy(F.col("value"), flight_m).alias("value"))
        return e.select((F.row_number().over(W.orderBy("value")) - 1).cast("int").alias("i"), "value")
    energy = edges_to_energy(axis, flight_m) if unit == "tof" else axis
    return centers(energy) if kind == "edges" else energy


def violations(axis: DataFrame) -> DataFrame:
    """Entries that are NaN or not greater than the one before."""
    prev = F.lag("value").over(W.orderBy("i"))
    return axis.withColumn("before", prev).where(F.isnan("value") | (F.col("value") <= F.col("before"))).select("i", "value", "before")


def frame_check(axis: DataFrame, n_frames: int) -> DataFrame:
    """kind: 'edges' (n + 1 values), 'centers' (n) or 'mismatch'."""
    n = axis.agg(F.count("*").alias("n_values"))
    return n.withColumn("kind", F.when(F.col("n_values") == n_frames, "centers").when(F.col("n_values") == n_frames + 1, "edges").otherwise("mismatch"))


def active(axis: DataFrame, window: tuple[float, float] | None) -> DataFrame:
    """A flag, both ends inclusive; the model still needs the inactive bins."""
    return axis.withColumn("active", F.col("value").between(*window) if window else F.lit(True))


def widened(axis: DataFrame, window: tuple[float, float], flight_m: float, dt_us: float, dl_m: float) -> DataFrame:
    """The bins a fit of a window needs: 5 full widths of the Gaussian kernel more at each end, and the flag."""
    fwhm = lambda e: 2.0 * (0.6931471805599453**0.5) * S.gaussian_width(F.lit(e), flight_m, dt_us, dl_m)
    lo, hi = window
    return active(axis, window).where(F.col("value").between(F.lit(lo) - 5.0 * fwhm(lo), F.lit(hi) + 5.0 * fwhm(hi)))


def corrected(axis: DataFrame, flight_m: float, t0_us: float, l_scale: float) -> DataFrame:
    """Energies under a time offset and a path scale, with their derivatives."""
    tof = K.TOF_FACTOR * flight_m / F.sqrt("value")
    rows = axis.withColumn("tof", tof)
    first = rows.agg(F.min("tof").alias("least"))
    rows = rows.join(F.broadcast(first))  # one row
    limit = F.col("least") * (1.0 - 1e-12)
    t0 = F.when(F.lit(t0_us) < limit, F.lit(t0_us)).otherwise(limit)
    c = F.col("tof") - t0
    e = F.pow(K.TOF_FACTOR * flight_m * l_scale / c, F.lit(2.0))
    return rows.select("i", e.alias("value"), F.when(F.lit(t0_us) < limit, 2.0 * e / c).otherwise(0.0).alias("d_t0"), (2.0 * e / l_scale).alias("d_l_scale"))


def kernel_widths(axis: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid widths of (by, i, value): half the distance of the neighbours, one-sided at the ends, 1 for a single point."""
    w = W.partitionBy(*by).orderBy("i")
    lo, hi = F.lag("value").over(w), F.lead("value").over(w)
    width = F.when(lo.isNull() & hi.isNull(), 1.0).when(lo.isNull(), hi - F.col("value")).when(hi.isNull(), F.col("value") - lo).otherwise((hi - lo) / 2)
    return axis.withColumn("width", width)


def densify(axis: DataFrame, widths: DataFrame) -> DataFrame:
    """Extra points between neighbours that are further apart than a quarter of the local width: ceil(h / (w / 4)) - 1 of them, evenly. widths: (i, width)."""
    nxt = F.lead("value").over(W.orderBy("i"))
    gaps = axis.withColumn("next", nxt).join(widths, "i").where((F.col("next") - F.col("value")) > F.col("width") / 4)
    n = (F.ceil((F.col("next") - F.col("value")) / (F.col("width") / 4)) - 1).cast("int")
    rows = gaps.withColumn("n", n).where("n > 0").select("value", "next", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return rows.select((F.col("value") + (F.col("next") - F.col("value")) * F.col("k") / (F.col("n") + 1)).alias("value"))


def dedup_sorted(values: DataFrame, rel: float = 1e-10, floor: float = 1e-30) -> DataFrame:
    """i, value: sorted values; one within rel * max(|last kept|, floor) of the last kept is left out."""
    return kept_values(values, rel, floor)
