"""A streaming form of the event histogram: an addition of ours, the batch operator on unbounded input.

Events arrive with a timestamp; counts per window and cell are emitted once the watermark has
passed the window. Events outside the TOF range or the detector are classed and counted by a
second query, as in the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.operators.cube import CELL, Binning, event_status


def windowed_histogram(events: DataFrame, b: Binning, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, tof_bin, y, x, value. State: one count per open window and cell."""
    step = (b.tof_max - b.tof_min) / b.n_bins
    kept = events.where(event_status(F.col("tof"), F.col("x"), F.col("y"), b) == "kept").withWatermark(ts, late)
    t = F.least(F.floor((F.col("tof") - b.tof_min) / step), F.lit(b.n_bins - 1)).cast("int")
    cells = kept.select(ts, t.alias("tof_bin"), F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"))
    return cells.groupBy(F.window(ts, window).alias("w"), *CELL).agg(F.count("*").alias("value")).select(F.col("w.start").alias("window_start"), *CELL, "value")


def windowed_retention(events: DataFrame, b: Binning, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, status, n."""
    rows = events.select(ts, event_status(F.col("tof"), F.col("x"), F.col("y"), b).alias("status")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")
