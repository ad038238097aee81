"""Doppler and resolution broadening: band joins of a curve with itself.

A point's value is a sum over its neighbours within a window. Curves of at most BLOCK_ROWS points
are dealt over the cluster, one group each. A longer curve is cut into blocks of so many points
in the order of energy; each point is copied to the blocks whose windows reach it, with a margin
of three points, and the blocks are summed apart from each other. As a point's sum runs over the
same neighbours in the same order wherever the cuts are, the result is the same to the bit.
A task sums its (point, segment) pairs in pieces with numpy, so its memory is bounded by a block
and its halo, and not by the width of the kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators.pieces import PIECE_ROWS
from tofcube.work import written

#: (point, segment) pairs of a block.
_PAIRS = 1 << 19


def _odd_double_factorials(n: int) -> list[float]:
    out = [1.0]
    for k in range(1, n):
        out.append(out[-1] * (2 * k + 1))
    return out


def erfc(x: Column) -> Column:
    """Complementary error function: below 2.5 by erf(x) = 2/sqrt(pi) exp(-x*x) sum 2**k x**(2k+1) / (2k+1)!!, above by a continued fraction."""
    a = F.abs(x)
    z = 2.0 * a * a
    # both as folds over literal arrays: the expression stays small
    series = F.aggregate(F.array(*[F.lit(1.0 / c) for c in reversed(_odd_double_factorials(40))]), F.lit(0.0), lambda acc, c: acc * z + c)
    near = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-a * a) * a * series
    frac = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), a, lambda acc, k: a + (k / 2.0) / acc)
    tail = F.when(a < 2.5, near).otherwise(F.exp(-a * a) / (math.sqrt(math.pi) * frac))
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def _erfc(x: np.ndarray) -> np.ndarray:
    """erfc of an array, by the series and the continued fraction of the column expression."""
    a = np.abs(x)
    out = _scaled(a) * np.exp(-a * a)
    return np.where(x >= 0, out, 2.0 - out)


def _scaled(a: np.ndarray) -> np.ndarray:
    """exp(a*a) erfc(a) of numbers that aren't negative."""
    near = a < 2.5
    out = np.empty_like(a)
    z = a[near]
    series = np.zeros_like(z)
    for c in reversed(_odd_double_factorials(40)):
        series = series * (2.0 * z * z) + 1.0 / c
    out[near] = np.exp(z * z) - 2.0 / math.sqrt(math.pi) * z * series
    z = frac = a[~near]
    for k in range(40, 0, -1):
        frac = z + (k / 2.0) / frac
    out[~near] = 1.0 / (math.sqrt(math.pi) * frac)
    return out


def _blocks(first: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of points, with the point (within the block) and the number of each member of its range [first, stop)."""
    n = np.maximum(stop - first, 0)
    at = 0
    ends = np.cumsum(n)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        own = np.repeat(np.arange(to - at), n[at:to])
        yield np.arange(at, to), own, np.arange(len(own)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to]) + np.repeat(first[at:to], n[at:to])
        at = to


#: Points of a block of a long curve.
BLOCK_ROWS = 1 << 14
#: Points beyond a window that its sums look at: the ends of segments, and two more for the weights of points.
MARGIN = 3


def _by_curve(curves: DataFrame, by: list[str], f: Callable[[pa.Table], dict[str, np.ndarray]], names: list[str], window: tuple[Column, Column], long_way: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """by, e and the columns of f for each curve, its points in the order of e.

    window: the energies that a point's sums reach, at least, down and up. long_way: what is done with long curves, if not blocks with halos."""
    out = ", ".join([*(f"`{c}` {curves.schema[c].dataType.simpleString()}" for c in by), "e double", *(f"{c} double" for c in names)])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("e")
        found = t.select([*by, "e"])
        for name, values in f(t).items():
            found = found.append_column(name, pa.array(values, pa.float64()))
        found = found.select([*by, "e", *names])
        return found.filter(t.column("_own")) if "_own" in t.column_names else found

    sizes = curves.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    long = sizes.select(*[F.col(c).alias(f"_l_{c}") for c in by])
    if long.isEmpty():
        return curves.groupBy(*by).applyInArrow(run, out)
    same = _all(F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in by)
    short = curves.join(long, same, "left_anti").groupBy(*by).applyInArrow(run, out)
    if long_way:
        return short.unionByName(long_way(curves.join(long, same, "left_semi")))
    return short.unionByName(halo_blocks(curves.join(long, same, "left_semi"), by, window).groupBy(*by, "_block").applyInArrow(run, out))


def _all(conditions: Iterator[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def halo_blocks(curves: DataFrame, by: list[str], window: tuple[Column, Column], rows: int | None = None) -> DataFrame:
    """The rows with _block and _own: each in its block of `rows` points, and copied (not _own) to each block whose window it is in, or next to."""
    rows = max(rows or BLOCK_ROWS, MARGIN)
    placed = curves.withColumns({"_lo": window[0], "_hi": window[1]}).repartitionByRange(*by, "e").sortWithinPartitions(*by, "e")
    placed = written(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "curve-points")
    # numbers within a curve: those of its partition, moved by the counts of the partitions before
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moves = counts.select(F.col("_part").alias("_m_part"), *[F.col(c).alias(f"_m_{c}") for c in by], (before - F.col("first")).alias("_shift"))
    at = W.partitionBy("_part", *by).orderBy("_at")
    near = placed.withColumns({"_down": F.lag("e", MARGIN).over(at), "_up": F.lead("e", MARGIN).over(at)})
    near = near.join(moves, (F.col("_part") == F.col("_m_part")) & _all(F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in by))
    # where the neighbours are in another partition, the point is taken to reach anywhere
    near = near.withColumns({"_block": F.floor((F.col("_at") + F.col("_shift")) / rows), "_down": F.coalesce("_down", F.lit(float("-inf"))), "_up": F.coalesce("_up", F.lit(float("inf")))})
    keep = [*curves.columns, "_block", "_down", "_up"]
    blocks = near.groupBy(*by, "_block").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.min("e").alias("least"), F.max("e").alias("most"))
    targets = blocks.groupBy(*by).applyInArrow(_reached(by), ", ".join([*(f"`{c}` {curves.schema[c].dataType.simpleString()}" for c in by), "_of bigint, targets array<struct<block:bigint,lo:double,hi:double>>"]))
    targets = targets.select(*[F.col(c).alias(f"_t_{c}") for c in by], "_of", "targets")
    held = near.select(keep).join(targets, (F.col("_block") == F.col("_of")) & _all(F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by))
    mine = F.filter("targets", lambda t: (t["block"] == F.col("_block")) | ((F.col("_up") >= t["lo"]) & (F.col("_down") <= t["hi"])))
    each = held.withColumn("_t", F.explode(mine))
    return each.select(*curves.columns, F.col("_t.block").alias("_block"), (F.col("_t.block") == F.col("_block")).alias("_own"))


def _reached(by: list[str]) -> Callable[[pa.Table], pa.Table]:
    """For each block of a curve (one small row each) the blocks that want points of it, with their windows."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_block")
        lo, hi, least, most = (t.column(c).to_numpy() for c in ("lo", "hi", "least", "most"))
        n = len(lo)
        # windows widened so that both ends rise from block to block; points within the margin of one may stand in the block next to it
        low, high = np.minimum.accumulate(lo[::-1])[::-1], np.maximum.accumulate(hi)
        first = np.searchsorted(high, np.append(least[:1], least[:-1]), "left")
        stop = np.searchsorted(low, np.append(most[1:], most[-1:]), "right")
        block = t.column("_block").to_pylist()
        wanted = [[{"block": block[k], "lo": low[k], "hi": high[k]} for k in range(a, b)] for a, b in zip(first, stop, strict=True)]
        kind = pa.list_(pa.struct([("block", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())]))
        return t.select(by).append_column("_of", t.column("_block")).append_column("targets", pa.array(wanted, kind))

    return run


def free_gas(e: np.ndarray, sigma: np.ndarray, temperature: float, awr: float) -> tuple[np.ndarray, np.ndarray]:
    """Broadened sigma and its derivative by temperature.

    In v = sqrt(E), with u = sqrt(kT / A), Y = v sigma piecewise linear and extended 6u beyond the
    ends by sigma ~ 1/v (Y stays at the edge's value); sums of the exact integrals of each segment,
    floored at 0. With t = (w - v) / u the kernel's own weight doesn't depend on u, so only
    Y(v + u t) does, and its derivative is the slope times t."""
    u = math.sqrt(K.BOLTZMANN_EV_K * temperature / awr)
    v = np.sqrt(e)
    y = v * sigma
    pv = np.concatenate(([max(v[0] - 6 * u, 1e-12)], v, [v[-1] + 6 * u]))
    py = np.concatenate((y[:1], y, y[-1:]))
    slope = np.diff(py) / np.where(np.diff(pv) > 0, np.diff(pv), 1.0)
    first = np.maximum(np.searchsorted(pv, v - 6 * u, "right") - 1, 0)
    last = np.minimum(np.searchsorted(pv, v + 6 * u, "left"), len(pv) - 1)
    out, der = np.empty_like(v), np.empty_like(v)
    for rows, own, edge in _blocks(first, last + 1):
        b = (pv[edge] - v[rows][own]) / u
        c, g = _erfc(b), np.exp(-b * b)
        seg = np.flatnonzero(own[1:] == own[:-1])
        j0 = math.sqrt(math.pi) / 2 * (c[seg] - c[seg + 1])
        j1 = 0.5 * (g[seg] - g[seg + 1])
        k = edge[seg]
        sums = lambda x: np.bincount(own[seg], x, len(rows))  # noqa: B023, E731
        norm = sums(j0)
        out[rows] = sums((py[k] - slope[k] * u * b[seg]) * j0 + slope[k] * u * j1) / norm / v[rows]
        der[rows] = sums(slope[k] * j1) / norm / v[rows] * u / (2 * temperature)
    return np.maximum(out, 0.0), np.where(out > 0, der, 0.0)


def _one(t: pa.Table, awr: float | str) -> float:
    return float(t.column(awr)[0].as_py()) if isinstance(awr, str) else awr


def _doppler_window(temperature: float, awr: float | str) -> tuple[Column, Column]:
    six = 6.0 * F.sqrt(F.lit(K.BOLTZMANN_EV_K * temperature) / (F.col(awr) if isinstance(awr, str) else F.lit(float(awr))))
    low = F.greatest(F.sqrt("e") - six, F.lit(0.0))
    return low * low * (1.0 - 1e-12), F.pow(F.sqrt("e") + six, F.lit(2.0)) * (1.0 + 1e-12)


def doppler(curves: DataFrame, temperature: float, awr: float | str, by: list[str]) -> DataFrame:
    """Free-gas broadening of (by, e, sigma): by, e, sigma. awr: a number, or the column that holds each curve's."""

    def f(t: pa.Table) -> dict[str, np.ndarray]:
        return {"sigma": free_gas(t.column("e").to_numpy(), t.column("sigma").to_numpy(), temperature, _one(t, awr))[0]}

    return _by_curve(curves, by, f, ["sigma"], _doppler_window(temperature, awr))


def doppler_with_derivative(curves: DataFrame, temperature: float, awr: float | str, by: list[str]) -> DataFrame:
    """As doppler, with d_sigma, the derivative by temperature."""

    def f(t: pa.Table) -> dict[str, np.ndarray]:
        return dict(zip(("sigma", "d_sigma"), free_gas(t.column("e").to_numpy(), t.column("sigma").to_numpy(), temperature, _one(t, awr)), strict=True))

    return _by_curve(curves, by, f, ["sigma", "d_sigma"], _doppler_window(temperature, awr))


#: Above this ratio of half the Gaussian to the exponential width the tail is left out. Fixed value.
TAIL_RATIO = 2.5
#: Where the combined kernel's argument is below this, it is cut as the original formula cuts it. Fixed value.
TAIL_CUT = -5.01


def _peak(c: np.ndarray) -> np.ndarray:
    """The argument x at which c sqrt(pi) exp(x*x) erfc(x) is 1: there the combined kernel has its peak. By bisection."""
    def over(x: np.ndarray) -> np.ndarray:
        a = np.abs(x)
        s = np.where(x >= 0, _scaled(a), 2.0 * np.exp(np.minimum(a * a, 600.0)) - _scaled(a))
        return c * math.sqrt(math.pi) * s > 1.0

    lo, hi = np.full_like(c, -20.0), np.maximum(c, 1.0) + 1.0
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        up = over(mid)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return 0.5 * (lo + hi)


def point_weights(e: np.ndarray) -> np.ndarray:
    """Five-point weights of a grid, as operators.extras.quadrature_weights gives them for a table."""
    if len(e) == 1:
        return np.ones(1)
    x = np.concatenate(([0.0, 0.0], e, [0.0, 0.0]))
    d = np.diff(x)
    v1, v2, v3, v4 = (d[k : k + len(e)] for k in range(4))
    k, last = np.arange(len(e)), len(e) - 1
    ratio = lambda num, den: np.where(np.abs(den) > K.DIVISION_FLOOR, num / np.where(np.abs(den) > K.DIVISION_FLOOR, den, 1.0), 0.0)
    out = np.where(k >= 2, v1, 0.0) + np.where(k >= 1, 5 * v2, 0.0) + np.where(k != last, 5 * v3, 0.0) + np.where(k < last - 1, v4, 0.0)
    out += np.where((k >= 2) & (k != last), ratio(v3 * v3 - v1 * v1, v2), 0.0)
    return out - np.where((k >= 1) & (k < last - 1), ratio(v4 * v4 - v2 * v2, v3), 0.0)


def width(e: np.ndarray, flight_m: float, dt_us: float, dl_m: float) -> np.ndarray:
    """The Gaussian width at energies."""
    return np.sqrt((2.0 * dt_us * e**1.5 / (K.TOF_FACTOR * flight_m)) ** 2 + (2.0 * dl_m * e / flight_m) ** 2)


def segment_sums(x: np.ndarray, y: np.ndarray, slope: np.ndarray, e: np.ndarray, w: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points e of widths w the Gaussian's integral, and that of the curve (x, y) under it, over the segments between x[first] and x[stop - 1]."""
    norm, part = np.zeros(len(e)), np.zeros(len(e))
    for rows, own, edge in _blocks(first, stop):
        a = (x[edge] - e[rows][own]) / w[rows][own]
        f, g = _erfc(a), np.exp(-a * a)
        seg = np.flatnonzero(own[1:] == own[:-1])
        k = edge[seg]
        i0, i1 = f[seg] - f[seg + 1], 0.5 * (g[seg] - g[seg + 1])
        norm[rows] = np.bincount(own[seg], i0, len(rows))
        part[rows] = np.bincount(own[seg], y[k] * i0 + slope[k] * w[rows][own[seg]] * (2.0 / math.sqrt(math.pi) * i1 - a[seg] * i0), len(rows))
    return norm, part


def blur(e: np.ndarray, value: np.ndarray, flight_m: float, dt_us: float, dl_m: float, de_us: float = 0.0) -> np.ndarray:
    """The curve seen with a Gaussian of energy-dependent width W over 5W, with an exponential tail where it matters, normalised by the window's own weight.

    Pure Gaussian: exact integrals of the piecewise-linear curve between the grid's points in the
    window. With the tail: point weights times the combined kernel, its peak at the energy. One
    point in the window passes through."""
    w = width(e, flight_m, dt_us, dl_m)
    we = 2.0 * de_us * e**1.5 / (K.TOF_FACTOR * flight_m)
    c = w / np.where(we > 1e-60, 2.0 * we, 1.0)
    tail = (we > 1e-60) & (c <= TAIL_RATIO) & (w > 0)
    up = np.where(tail, np.where(2 * c <= 1, 6.25 * we, np.where(2 * c <= 2, 5.0 * (3.0 - 2 * c) * w, 5.0 * w)), 5.0 * w)
    first, stop = np.searchsorted(e, e - 5.0 * w, "left"), np.searchsorted(e, e + up, "right")
    out = value.astype(float).copy()
    some = (stop - first > 1) & (w > 1e-60)
    slope = np.diff(value) / np.where(np.diff(e) > 0, np.diff(e), 1.0) if len(e) > 1 else np.zeros(0)
    plain = np.flatnonzero(some & ~tail)
    norm, part = segment_sums(e, value, slope, e[plain], w[plain], first[plain], stop[plain])
    out[plain] = np.where(norm > K.DIVISION_FLOOR, part / np.where(norm > K.DIVISION_FLOOR, norm, 1.0), out[plain])
    if tail.any():
        weight, shift = point_weights(e), np.zeros_like(e)
        shift[tail] = (c[tail] - _peak(c[tail])) * w[tail]
        long = np.flatnonzero(some & tail)
        for rows, own, k in _blocks(first[long], stop[long]):
            at = long[rows][own]
            a = (e[at] - shift[at] - e[k]) / w[at]
            b = a + c[at]
            s = _scaled(np.abs(b))
            z = np.where(b >= 0, np.exp(-a * a) * s, np.where(b >= TAIL_CUT, 2.0 * np.exp(np.minimum(b * b - a * a, 600.0)) - np.exp(-a * a) * s, np.exp(-a * a) * s))
            norm, part = np.bincount(own, weight[k] * z, len(rows)), np.bincount(own, weight[k] * z * value[k], len(rows))
            out[long[rows]] = np.where(norm > K.DIVISION_FLOOR, part / np.where(norm > K.DIVISION_FLOOR, norm, 1.0), out[long[rows]])
    return out


def gaussian_resolution(curves: DataFrame, flight_m: float, dt_us: float, dl_m: float, by: list[str], de_us: float = 0.0) -> DataFrame:
    """Resolution of (by, e, value): by, e, value; de_us adds the exponential tail."""
    from tofcube.operators import moments

    def f(t: pa.Table) -> dict[str, np.ndarray]:
        return {"value": blur(t.column("e").to_numpy(), t.column("value").to_numpy(), flight_m, dt_us, dl_m, de_us)}

    e = F.col("e")
    w = F.hypot(F.pow(e, F.lit(1.5)) * (2.0 * dt_us / (K.TOF_FACTOR * flight_m)), e * (2.0 * dl_m / flight_m))
    # with the tail the window reaches at most so far above
    up = F.greatest(15.0 * w, F.pow(e, F.lit(1.5)) * (12.5 * de_us / (K.TOF_FACTOR * flight_m))) if de_us > 0 else 5.0 * w
    # without the tail, pieces of long curves stand in the windows of others by their moments
    far = None if de_us > 0 else lambda long: moments.blurred(long, by, lambda x: width(x, flight_m, dt_us, dl_m), min(BLOCK_ROWS, PIECE_ROWS))
    return _by_curve(curves, by, f, ["value"], (e - 5.0 * w * (1.0 + 1e-12), e + up * (1.0 + 1e-12)), far)


def forward(sigma: DataFrame, densities: DataFrame, temperature: float, awr: float | str, flight_m: float, dt_us: float, dl_m: float, de_us: float = 0.0) -> DataFrame:
    """e, value: cross sections (grp, e, sigma) are broadened by temperature, summed with densities (grp, n), turned into transmission, and only then blurred by the resolution. awr: a number, or the column of sigma that holds each group's."""
    broad = doppler(sigma, temperature, awr, ["grp"])
    t = broad.join(densities.where("n > 0"), "grp").groupBy("e").agg(F.exp(-F.sum(F.col("n") * F.col("sigma"))).alias("value"))
    return gaussian_resolution(t.withColumn("one", F.lit(1)), flight_m, dt_us, dl_m, ["one"], de_us).drop("one")


def effective_sigma(sigma: DataFrame, density: float, temperature: float, awr: float | str, flight_m: float, dt_us: float, dl_m: float, de_us: float = 0.0) -> DataFrame:
    """grp, e, sigma: of each group alone at a density, the cross section that gives its blurred transmission: -ln(R exp(-n sigma)) / n, the transmission kept within 1e-30 and 1."""
    t = doppler(sigma, temperature, awr, ["grp"]).select("grp", "e", F.exp(-density * F.col("sigma")).alias("value"))
    out = gaussian_resolution(t, flight_m, dt_us, dl_m, ["grp"], de_us)
    return out.select("grp", "e", (-F.ln(F.greatest(F.least("value", F.lit(1.0)), F.lit(1e-30))) / density).alias("sigma"))
