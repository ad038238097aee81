"""Resolution compiled once into a sparse row table, and applied to any number of spectra in place.

Tabulated kernels are interpolated at each energy of an axis, each kernel point meets the two
axis points around it by a bracket join, and a row of the plan is the run of columns that it
reaches: the first column and the weights from there on, which sum to one. Rows are grouped on
their own number, so a plan of any size is built in parallel.

A plan is a dimension of the detector (its bins times the width of a kernel). Up to MOST_WEIGHTS
it is brought to the tasks once, and a spectrum is an array that meets it row by row in its own
Arrow batch: spectra are not shuffled. A larger plan meets exploded spectra by the column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators.asof import bracket
from tofcube.operators.extras import kernels_at
from tofcube.operators.models import apply_matrix

#: Weights of a plan that is brought to the tasks: 8 bytes each.
MOST_WEIGHTS = 4_000_000


def compile_plan(axis: DataFrame, kernels: DataFrame, flight_m: float) -> DataFrame:
    """i, start, weights: for each point of an axis (i, e) the columns from `start` on that its kernel reaches, weights summing to one.

    kernels: (ref_energy, k, offset, weight). A kernel point counts by its weight times its
    trapezoid width, and is split between the two axis points around its energy; points without
    weight, without positive time or beyond the axis are left out."""
    w = W.partitionBy("e").orderBy("k")
    pts = kernels_at(axis.select("e").distinct(), kernels).withColumns({"p": F.lag("offset").over(w), "q": F.lead("offset").over(w)})
    width = F.when(F.col("p").isNull() & F.col("q").isNull(), 1.0).when(F.col("p").isNull(), F.col("q") - F.col("offset")).when(F.col("q").isNull(), F.col("offset") - F.col("p")).otherwise((F.col("q") - F.col("p")) / 2)
    tof = K.TOF_FACTOR * flight_m / F.sqrt("e") + F.col("offset")
    pts = pts.select("e", (F.col("weight") * F.abs(width)).alias("wt"), "weight", tof.alias("tof")).where("weight > 0 AND tof > 0")
    pts = pts.select(F.col("e").alias("o_e"), "wt", F.pow(K.TOF_FACTOR * flight_m / F.col("tof"), F.lit(2.0)).alias("x"))
    found = bracket(pts, axis.select("i", F.col("e").alias("x")), [], "x", ["i"])
    low, high, x = F.col("before"), F.col("after"), F.col("x")
    inside = found.where(low.isNotNull() & (high.isNotNull() | (low["x"] == x)))
    share = F.when(high.isNull(), 0.0).otherwise((x - low["x"]) / F.when(high.isNotNull(), high["x"] - low["x"]))
    two = F.array(F.struct(low["i"].alias("j"), (F.col("wt") * (1.0 - share)).alias("w")), F.struct(high["i"].alias("j"), (F.col("wt") * share).alias("w")))
    cells = inside.select("o_e", F.inline(two)).where("j IS NOT NULL").groupBy("o_e", "j").agg(F.sum("w").alias("w"))
    rows = cells.groupBy("o_e").agg(F.min("j").alias("start"), F.max("j").alias("stop"), F.sum("w").alias("total"), F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
    full = F.transform(F.sequence("start", "stop"), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)) / F.col("total"))
    rows = rows.select("o_e", "start", full.alias("weights"))
    return axis.join(rows, F.col("e") == F.col("o_e")).select("i", "start", "weights")


def entries(plan: DataFrame) -> DataFrame:
    """i, j, w: a plan's weights one by one."""
    return plan.select("i", "start", F.posexplode("weights").alias("k", "w")).where("w <> 0").select("i", (F.col("start") + F.col("k")).alias("j"), "w")


def plan_facts(plan: DataFrame) -> DataFrame:
    """i, start, nnz, total of each row."""
    return plan.select("i", "start", F.size(F.filter("weights", lambda w: w != 0)).alias("nnz"), F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("total"))


class Compiled:
    """A plan's rows as flat arrays, for array products in tasks."""

    def __init__(self, rows: list[tuple[int, int, list[float]]]):
        rows = sorted(rows)
        self.rows = np.array([r[0] for r in rows], np.int64)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.columns = np.concatenate([np.arange(r[1], r[1] + len(r[2])) for r in rows]) if rows else np.zeros(0, np.int64)
        self.weights = np.array([w for r in rows for w in r[2]])

    def apply(self, values: np.ndarray) -> np.ndarray:
        """values (spectra, columns) to (spectra, rows), some spectra at a time."""
        out = np.zeros((len(values), len(self.rows)))
        step = max(1, (1 << 22) // max(1, len(self.columns)))
        for at in range(0, len(values), step):
            out[at : at + step] = np.add.reduceat(values[at : at + step][:, self.columns] * self.weights, self.first, axis=1)
        return out


def apply_plan(plan: DataFrame, spectra: DataFrame, by: list[str], values: str = "values", most: int = MOST_WEIGHTS) -> DataFrame:
    """by, values: spectra (by, array of one number per column) seen through the plan, one number per row of the plan in order."""
    kinds = {c: spectra.schema[c].dataType.simpleString() for c in by}
    weights = plan.agg(F.sum(F.size("weights"))).first()[0] or 0
    if not weights:
        raise ValueError("a plan with a row or more is needed")
    if weights > most:
        cells = spectra.select(*by, F.posexplode(values).alias("j", "value"))
        out = apply_matrix(entries(plan), cells, by)
        return out.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda r: r["value"]).alias(values))
    held = Compiled([tuple(r) for r in plan.select("i", "start", "weights").collect()])  # a dimension: its size was checked above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(len(by)).flatten().to_numpy(zero_copy_only=False)
            out = held.apply(flat.reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, len(held.rows)))
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(held.rows))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*by, values])

    return spectra.select(*by, F.col(values).cast("array<double>")).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), f"`{values}` array<double>"]))
