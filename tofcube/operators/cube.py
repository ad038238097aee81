"""Cube algebra over long tables (tof_bin, y, x, value): one row per bin and pixel.

Element-wise steps are projections, zips are equi-joins on the cell, reductions are grouped sums
with map-side partials. Dense completion expands one sequence; axes and masks are dimension
tables whose size is the detector's, not the data's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube.functions import scalars as S

CELL = ["tof_bin", "y", "x"]


@dataclass(frozen=True)
class Binning:
    """Equal TOF bins on [tof_min, tof_max) and the detector's size."""

    n_bins: int
    tof_min: float
    tof_max: float
    height: int
    width: int


def event_status(tof: Column, x: Column, y: Column, b: Binning) -> Column:
    """One class per event: kept, or the first test that it fails (finite TOF, TOF range, finite place, inside)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    px, py = F.round(x), F.round(y)
    return (
        F.when(~finite(tof), "non_finite")
        .when((tof < b.tof_min) | (tof >= b.tof_max), "tof_range")
        .when(~finite(x) | ~finite(y), "non_finite")
        .when((px < 0) | (px >= b.width) | (py < 0) | (py >= b.height), "spatial")
        .otherwise("kept")
    )


def histogram(events: DataFrame, b: Binning, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts per cell of events (tof, x, y), cells without events absent. extra: further grouping columns."""
    step = (b.tof_max - b.tof_min) / b.n_bins
    kept = events.where(event_status(F.col("tof"), F.col("x"), F.col("y"), b) == "kept")
    t = F.least(F.floor((F.col("tof") - b.tof_min) / step), F.lit(b.n_bins - 1)).cast("int")
    return kept.groupBy(*extra, t.alias("tof_bin"), F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x")).agg(F.count("*").alias("value"))


def retention(events: DataFrame, b: Binning) -> DataFrame:
    """One row: total, kept and what was dropped by class."""
    status = events.select(event_status(F.col("tof"), F.col("x"), F.col("y"), b).alias("status"))
    count = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count("*").alias("total"), count("kept").alias("kept"), count("non_finite").alias("dropped_non_finite"), count("tof_range").alias("dropped_tof_range"), count("spatial").alias("dropped_spatial"))


def grid(spark: SparkSession, b: Binning) -> DataFrame:
    """All cells."""
    n = b.height * b.width
    i = F.col("id")
    return spark.range(b.n_bins * n).select((i / n).cast("int").alias("tof_bin"), ((i % n) / b.width).cast("int").alias("y"), (i % b.width).cast("int").alias("x"))


def dense(cube: DataFrame, b: Binning, value: str = "value") -> DataFrame:
    return grid(cube.sparkSession, b).join(cube.select(*CELL, value), CELL, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def normalize(sample: DataFrame, beam: DataFrame, charge_sample: float = 1.0, charge_beam: float = 1.0, dark: DataFrame | None = None) -> DataFrame:
    """Cells with transmission and sigma. dark: (y, x, value), taken from both counts and floored at 0."""
    if not all(0 < c < float("inf") for c in (charge_sample, charge_beam)):
        raise ValueError("charges must be finite and positive")
    both = sample.select(*CELL, F.col("value").cast("double").alias("s")).join(beam.select(*CELL, F.col("value").cast("double").alias("o")), CELL)
    if dark is not None:
        both = both.join(dark.select("y", "x", F.col("value").cast("double").alias("d")), ["y", "x"], "left")
        both = both.withColumns({c: F.greatest(F.col(c) - F.coalesce("d", F.lit(0.0)), F.lit(0.0)) for c in ("s", "o")})
    r = charge_beam / charge_sample
    return both.select(*CELL, S.transmission(F.col("s"), F.col("o"), r).alias("transmission"), S.transmission_sigma(F.col("s"), F.col("o"), r).alias("sigma"))


def counts_to_transmission(sample: DataFrame, beam: DataFrame) -> DataFrame:
    both = sample.select(*CELL, F.col("value").cast("double").alias("s")).join(beam.select(*CELL, F.col("value").cast("double").alias("o")), CELL)
    return both.select(*CELL, S.transmission(F.col("s"), F.col("o")).alias("transmission"), S.counts_transmission_sigma(F.col("s"), F.col("o")).alias("sigma"))


def rebin(cube: DataFrame, factor: int, how: str = "sum", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Groups of `factor` bins, the last one short: counts are summed, transmission averaged. Below 2 nothing changes. by: columns that tell several cubes apart."""
    if factor < 2:
        return cube.select(*by, *CELL, value)
    f = F.sum if how == "sum" else F.avg
    return cube.groupBy(*by, F.floor(F.col("tof_bin") / factor).cast("int").alias("tof_bin"), "y", "x").agg(f(value).alias(value))


def rebin_edges(axis: DataFrame, factor: int) -> DataFrame:
    """Every factor-th edge of (i, value) and always the last."""
    last = axis.agg(F.max("i").alias("last"))
    kept = axis.join(F.broadcast(last)).where((F.col("i") % factor == 0) | (F.col("i") == F.col("last")))
    return kept.select(F.ceil(F.col("i") / factor).cast("int").alias("i"), "value")


def rebin_centers(axis: DataFrame, factor: int) -> DataFrame:
    return axis.groupBy(F.floor(F.col("i") / factor).cast("int").alias("i")).agg(F.avg("value").alias("value"))


def dead_pixels(cube: DataFrame) -> DataFrame:
    """Pixels that are 0 in all bins."""
    return cube.groupBy("y", "x").agg(F.bool_and(F.col("value") == 0).alias("dead")).where("dead").select("y", "x")


def live(cube: DataFrame, dead: DataFrame, rois: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    """Cells of pixels that are not dead and lie in any of the ROIs (y0, y1, x0, x1), half open."""
    out = cube.join(dead, ["y", "x"], "left_anti")
    return out.where(in_any(rois)) if rois else out


def in_any(rois: list[tuple[int, int, int, int]]) -> Column:
    """Whether the pixel lies in one ROI at least; pixels count once."""
    out = F.lit(False)
    for y0, y1, x0, x1 in rois:
        out = out | ((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return out


def roi_mean(cube: DataFrame, roi: tuple[int, int, int, int] | None = None, value: str = "value", finite: bool = False) -> DataFrame:
    """Mean per bin over a ROI or the full image; finite: over finite values alone, NaN without any."""
    rows = cube.where(in_any([roi])) if roi else cube
    v = F.col(value).cast("double")
    if finite:
        v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        return rows.groupBy("tof_bin").agg(F.coalesce(F.avg(v), F.lit(float("nan"))).alias("mean"))
    return rows.groupBy("tof_bin").agg(F.avg(v).alias("mean"))


def roi_weighted(cells: DataFrame, rois: list[tuple[int, int, int, int]]) -> DataFrame:
    """Inverse-variance mean per bin over a union of ROIs: 0 and 1e30 where no cell has a finite value and a finite positive sigma."""
    t, s = F.col("transmission"), F.col("sigma")
    good = ~F.isnan(t) & (F.abs(t) != float("inf")) & ~F.isnan(s) & (s > 0) & (s != float("inf"))
    w = F.when(good, 1.0 / (s * s)).otherwise(0.0)
    sums = cells.where(in_any(rois)).groupBy("tof_bin").agg(F.sum(w).alias("w"), F.sum(F.when(good, w * t).otherwise(0.0)).alias("wt"))
    return sums.select("tof_bin", F.when(F.col("w") > 0, F.col("wt") / F.col("w")).otherwise(0.0).alias("mean"), F.when(F.col("w") > 0, 1.0 / F.sqrt("w")).otherwise(1e30).alias("sigma"))


def sum_over_angle(cube: DataFrame) -> DataFrame:
    return cube.groupBy(*CELL).agg(F.sum("value").alias("value"))


def preview(cube: DataFrame) -> DataFrame:
    return cube.groupBy("y", "x").agg(F.sum("value").alias("value"))


def to_spectra(cube: DataFrame, value: str = "value") -> DataFrame:
    """One row per pixel with its values in bin order; a pixel's bins bound the array."""
    held = F.array_sort(F.collect_list(F.struct("tof_bin", value)))
    return cube.groupBy("y", "x").agg(held.alias("held")).select("y", "x", F.col(f"held.{value}").alias("spectrum"))


def cube_info(cube: DataFrame) -> DataFrame:
    return cube.agg((F.max("tof_bin") + 1).alias("n_frames"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def data_range(values: DataFrame, value: str) -> DataFrame:
    """Least and greatest finite value; 0 and 0 without any."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return values.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("lo"), F.coalesce(F.max(v), F.lit(0.0)).alias("hi"))
