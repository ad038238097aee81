"""The extended grid of an axis as relations: unions of sets of points, each thinned by the rule of kept values.

The sets: the axis; points beyond its ends, evenly spaced in the root of the energy; points
between neighbours too far apart; and points within and around narrow resonances. Every set is
rows made from rows: a sequence for each end, for each gap and for each resonance. What a gap or a
resonance needs to know of the grid (its neighbours, and how many points are in its width) comes
from windows over the order and from bracket joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators.asof import bracket
from tofcube.operators.ordering import kept_values, numbered, placed, with_previous
from tofcube.work import written

#: Points at an end that set its spacing, parts of a width, points that a width needs, the tolerance of equal points, and rounds of doubling. Fixed values.
END_POINTS, WIDTH_PART, WIDTH_POINTS, EQUAL, DOUBLINGS = 5, 2.0 / 14.0, 10, 1e-10, 20


def gaussian_width(e: Column, flight_m: float, dt_us: float, dl_m: float) -> Column:
    return F.hypot(F.pow(e, F.lit(1.5)) * (2.0 * dt_us / (K.TOF_FACTOR * flight_m)), e * (2.0 * dl_m / flight_m))


def end_points(axis: DataFrame, width, de_us: float, flight_m: float) -> DataFrame:
    """value: points below and above an axis (value), to five widths beyond it, further with an exponential tail."""
    up, down = axis.orderBy("value").limit(END_POINTS), axis.orderBy(F.desc("value")).limit(END_POINTS)
    span = lambda d: d.agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).where("n > 1")
    # both spans are one row of at most five points; the step is the mean one between their roots
    step = (F.sqrt("b") - F.sqrt("a")) / (F.col("n") - 1)
    w = width(F.col("a"))
    floor = F.sqrt(F.greatest(F.col("a") - 5.0 * w, F.lit(0.001)))
    low = span(up).select(F.sqrt("a").alias("r"), step.alias("s"), w.alias("w"), floor.alias("to")).where("w > 0 AND s > 1e-30 AND r > to")
    low = low.select("r", "s", F.explode(F.sequence(F.lit(1), F.ceil((F.col("r") - F.col("to")) / F.col("s")).cast("int"))).alias("k"))
    low = low.select((F.col("r") - F.col("s") * F.col("k")).alias("x")).where("x > 0")
    w, tail = width(F.col("b")), F.pow(F.col("b"), F.lit(1.5)) * (2.0 * de_us / (K.TOF_FACTOR * flight_m))
    far = F.when(F.col("t") <= 1e-30, 5.0 * F.col("w")).when(F.col("w") <= F.col("t"), 6.25 * F.col("t")).when(F.col("w") <= 2.0 * F.col("t"), 5.0 * (3.0 - F.col("w") / F.when(F.col("t") > 1e-30, F.col("t"))) * F.col("w")).otherwise(5.0 * F.col("w"))
    high = span(down).select("b", step.alias("s"), w.alias("w"), tail.alias("t")).select("b", F.sqrt("b").alias("r"), "s", far.alias("far")).where("far > 0 AND s > 1e-30")
    high = high.select("r", "s", F.explode(F.sequence(F.lit(1), F.ceil((F.sqrt(F.col("b") + F.col("far")) - F.col("r")) / F.col("s")).cast("int"))).alias("k"))
    return low.unionByName(high.select((F.col("r") + F.col("s") * F.col("k")).alias("x"))).select((F.col("x") * F.col("x")).alias("value"))


def gap_points(grid: DataFrame, width) -> DataFrame:
    """value: points between neighbours of a grid further apart than a quarter of the width at their middle, evenly."""
    pairs = with_previous(placed(grid.select("value"), [F.col("value")]), "value").where("previous IS NOT NULL").select("value", "previous")
    most = 0.25 * width(0.5 * (F.col("value") + F.col("previous")))
    parts = pairs.select("previous", (F.col("value") - F.col("previous")).alias("gap"), most.alias("most")).where("most > 1e-60 AND gap > most")
    parts = parts.withColumn("n", F.ceil(F.col("gap") / F.col("most")).cast("int")).where("n > 1")
    parts = parts.select("previous", "gap", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    return parts.select((F.col("previous") + F.col("gap") / F.col("n") * F.col("k")).alias("value"))


def resonance_points(grid: DataFrame, resonances: DataFrame) -> DataFrame:
    """value: points in the width of each resonance (energy, width) where the grid (i, value) has too few, and on both sides at doubling distances to its next point."""
    ends = grid.agg(F.min("value").alias("g_least"), F.max("value").alias("g_most"))
    at = resonances.where("width >= 1e-30 AND energy > 0").join(F.broadcast(ends), F.col("energy").between(F.col("g_least"), F.col("g_most")))  # one row of ends
    e, w = F.col("energy"), F.col("width")
    at = at.select(F.greatest(e - w, F.lit(1e-6)).alias("lo"), (e + w).alias("hi"), (WIDTH_PART * w).alias("step")).where("hi > lo").distinct()
    below = with_previous(placed(grid.select("i", "value"), [F.col("value")]), "value").select(F.col("value").alias("x"), "i", "previous")
    sides = at.select("lo", "hi", "step", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("x", F.when(F.col("side") == 0, F.col("lo")).otherwise(F.col("hi")))
    found = bracket(sides, below, [], "x", ["i", "previous"])
    on = F.col("before.x") == F.col("x")
    # the number of grid points before each side, its own left out below and counted above; and the next point outside
    n = F.coalesce(F.col("before.i") + F.when(on & (F.col("side") == 0), 0).otherwise(1), F.lit(0))
    near = F.when(F.col("side") == 1, F.col("after.x")).when(on, F.col("before.previous")).otherwise(F.col("before.x"))
    found = found.select("lo", "hi", "step", "side", n.alias("n"), near.alias("near"))
    few = found.groupBy("lo", "hi", "step").agg((F.max("n") - F.min("n")).alias("held"), F.max(F.when(F.col("side") == 0, F.col("near"))).alias("near_lo"), F.max(F.when(F.col("side") == 1, F.col("near"))).alias("near_hi")).where(F.col("held") < WIDTH_POINTS)
    few = written(few, "narrow")
    own = few.select("hi", "step", "lo", F.explode(F.sequence(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / F.col("step")).cast("int"))).alias("k"))
    own = own.select((F.col("lo") + F.col("step") * F.col("k")).alias("value"), "hi", "step").where("value > 0 AND value <= hi + 0.01 * step").select("value")
    # 2 + 4 + ... + 2**m steps beyond a side
    far = F.explode(F.sequence(F.lit(1), F.lit(DOUBLINGS)))
    tol = lambda c: F.greatest(F.abs(c), F.lit(1e-30)) * EQUAL
    steps = F.col("step") * (F.pow(F.lit(2.0), F.col("m") + 1) - 2.0)
    down = few.where("near_lo IS NOT NULL AND lo - near_lo > 2 * step").select("lo", "step", "near_lo", far.alias("m")).select((F.col("lo") - steps).alias("value"), "near_lo").where(F.col("value") - F.col("near_lo") > tol("near_lo"))
    rise = few.where("near_hi IS NOT NULL AND near_hi - hi > 2 * step").select("hi", "step", "near_hi", far.alias("m")).select((F.col("hi") + steps).alias("value"), "near_hi").where(F.col("near_hi") - F.col("value") > tol("near_hi"))
    return own.unionByName(down.select("value")).unionByName(rise.select("value"))


def extended_grid(axis: DataFrame, flight_m: float, dt_us: float, dl_m: float, de_us: float = 0.0, resonances: DataFrame | None = None, between: bool = True) -> DataFrame:
    """i, value, own: an axis (value) with its auxiliary points; own is the number of the axis's point that a row is, or null.

    resonances: (energy, width). between: points between neighbours that are further apart than a
    quarter of the Gaussian width at their middle. An axis of one point stays as it is."""
    width = lambda e: gaussian_width(e, flight_m, dt_us, dl_m)
    axis = numbered(axis.select("value"), [F.col("value")], "n", 0)
    axis = written(axis, "axis")
    grid = kept_values(axis.select("value").unionByName(end_points(axis, width, de_us, flight_m)), EQUAL)
    if between:
        grid = kept_values(grid.select("value").unionByName(gap_points(grid, width)), EQUAL)
    if resonances is not None:
        grid = written(grid, "grid")
        grid = kept_values(grid.select("value").unionByName(resonance_points(grid, resonances)), EQUAL)
    grid = written(numbered(grid.where("value > 0").select("value"), [F.col("value")], "i", 0), "grid")
    near = bracket(axis.select("n", F.col("value").alias("x")), grid.select("i", F.col("value").alias("x")), [], "x", ["i"])
    # the nearer of the two around; the lower of two equally near
    low, high = F.col("x") - F.col("before.x"), F.col("after.x") - F.col("x")
    mine = near.select("n", F.when(F.col("before").isNull() | (high < low), F.col("after.i")).otherwise(F.col("before.i")).alias("o_i"))
    mine = mine.groupBy("o_i").agg(F.min("n").alias("own"))
    return grid.join(mine, F.col("i") == F.col("o_i"), "left").select(F.col("i").cast("int").alias("i"), "value", F.col("own").cast("int").alias("own"))
