"""Smaller operators: quadrature weights, sparse layouts, spin groups, file names, model derivatives, tabulated kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.functions import scalars as S
from tofcube.operators import pieces
from tofcube.operators.axes import bounded
from tofcube.operators.isotopes import z_to_symbol


def quadrature_weights(axis: DataFrame) -> DataFrame:
    """Five-point weights of (i, value): sums of neighbouring spacings with a curvature correction, ends cut; energies beyond the axis count as 0."""
    w = W.orderBy("i")
    rows = axis.select("i", "value", F.lag("value", 2, 0.0).over(w).alias("a"), F.lag("value", 1, 0.0).over(w).alias("b"), F.lead("value", 1, 0.0).over(w).alias("d"), F.lead("value", 2, 0.0).over(w).alias("f"), (F.row_number().over(w) - 1).alias("k"), F.count("*").over(W.partitionBy()).alias("n"))
    v1, v2, v3, v4 = F.col("b") - F.col("a"), F.col("value") - F.col("b"), F.col("d") - F.col("value"), F.col("f") - F.col("d")
    k, last = F.col("k"), F.col("n") - 1
    ratio = lambda num, den: F.when(F.abs(den) > K.DIVISION_FLOOR, num / F.when(F.abs(den) > K.DIVISION_FLOOR, den).otherwise(1.0)).otherwise(0.0)
    weight = (
        F.when(k >= 2, v1).otherwise(0.0)
        + F.when(k >= 1, 5.0 * v2).otherwise(0.0)
        + F.when(k != last, 5.0 * v3).otherwise(0.0)
        + F.when(k < last - 1, v4).otherwise(0.0)
        + F.when((k >= 2) & (k != last), ratio(v3 * v3 - v1 * v1, v2)).otherwise(0.0)
        + F.when((k >= 1) & (k < last - 1), -ratio(v4 * v4 - v2 * v2, v3)).otherwise(0.0)
    )
    return rows.select("i", F.when(F.col("n") == 1, 1.0).otherwise(weight).alias("weight"))


def row_offsets(matrix: DataFrame) -> DataFrame:
    """i, first, stop: where each row of a sparse matrix (i, j, w) begins and ends among its entries ordered by row."""
    n = matrix.groupBy("i").agg(F.count("*").alias("c"))
    stop = F.sum("c").over(W.orderBy("i"))
    return n.select("i", (stop - F.col("c")).alias("first"), stop.alias("stop"))


def distinct_parameters(rows: DataFrame, by: list[str], col: str) -> DataFrame:
    """Sorted distinct parameter numbers."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(col)).alias("parameters"))


def spin_offsets(groups: DataFrame) -> DataFrame:
    """Spin groups (case, number, l, j, spin) with j moved by 1e-6 for each earlier one of the same l and |j|, for targets with spin."""
    w = W.partitionBy("case", "l", F.round(F.abs("j") * 1e6)).orderBy("number")
    return groups.withColumn("j", F.col("j") + F.when(F.abs("spin") > 1e-10, (F.row_number().over(w) - 1) * 1e-6).otherwise(0.0))


def attach_resonances(groups: DataFrame, res: DataFrame) -> DataFrame:
    """Every spin group with its resonances (case, number, er, gn); one without has a row of zero width."""
    r = res.select(F.col("case").alias("r_case"), F.col("number").alias("r_number"), "er", "gn")
    out = groups.join(r, (F.col("case") == F.col("r_case")) & (F.col("number") == F.col("r_number")), "left")
    return out.select(*groups.columns, F.coalesce("er", F.lit(0.0)).alias("er"), F.coalesce("gn", F.lit(0.0)).alias("gn"))


def undefined_groups(groups: DataFrame, res: DataFrame) -> DataFrame:
    """Resonances whose spin group does not exist."""
    return res.join(groups.select("case", "number"), ["case", "number"], "left_anti")


def expand_groups(densities: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, n) over members (grp, z, a, ratio): z, a and the density of each."""
    return densities.join(members, "grp").select("grp", "z", "a", (F.col("n") * F.col("ratio")).alias("n"))


#: Libraries that name files by material first; the others lead with the atomic number. Fixed values.
MATERIAL_FIRST = ("ENDF-B-VIII.0", "JEFF-3.3")


def evaluation_file(library: Column, z: Column, a: Column, mat: Column) -> Column:
    sym = F.coalesce(z_to_symbol(z), F.lit("X"))
    lead = F.when((z == 0) & (a == 1), "nn").otherwise(sym)
    return F.when(library.isin(*MATERIAL_FIRST), F.format_string("n_%04d_%d-%s-%d.zip", mat, z, sym, a)).otherwise(F.format_string("n_%03d-%s-%d_%04d.zip", z, lead, a, mat))


def kernel_parameters(dl: Column, dg: Column, de: Column, off: Column) -> Column:
    """struct(dt_us, dl_m, de) from card widths: dg / (2 sqrt(ln 2)), dl / sqrt(6), de; null if switched off or all zero."""
    some = ~off & ((dl != 0) | (dg != 0) | (de != 0))
    return F.when(some, F.struct((dg / (2.0 * 0.6931471805599453**0.5)).alias("dt_us"), (dl / 6.0**0.5).alias("dl_m"), de.alias("de")))


external_r = S.external_r


def background_jacobian(t: Column, e: Column, b_d: float, b_f: float) -> dict[str, Column]:
    """Derivatives of the background model by its parameters."""
    inv = S.inverse_root(e)
    tail = F.exp(-b_f * inv)
    return {"d_a": t, "d_ba": F.lit(1.0), "d_bb": inv, "d_bc": F.sqrt(e), "d_bd": tail, "d_bf": -b_d * inv * tail}


def kernels_at(energies: DataFrame, kernels: DataFrame) -> DataFrame:
    """e, k, offset, weight: kernels (ref_energy, k, offset, weight) at energies (e), blended element by element by the
    fraction of ln E between the two references around; clamped beyond them; the nearer of two of unequal length."""
    size = kernels.groupBy("ref_energy").agg(F.count("*").alias("m"))
    refs = size.select(F.col("ref_energy").alias("lo"), F.col("m").alias("m_lo"), F.lead("ref_energy").over(W.orderBy("ref_energy")).alias("hi"), F.lead("m").over(W.orderBy("ref_energy")).alias("m_hi"), (F.row_number().over(W.orderBy("ref_energy")) == 1).alias("lowest"))
    e = F.col("e")
    at = energies.join(bounded(refs, "lo", 10_000), ((e > F.col("lo")) | F.col("lowest")) & (F.col("hi").isNull() | (e <= F.col("hi"))))  # one row per reference kernel
    inside = (e > F.col("lo")) & F.col("hi").isNotNull()
    frac = F.when(inside, (F.ln("e") - F.ln("lo")) / (F.ln("hi") - F.ln("lo"))).otherwise(0.0)
    at = at.withColumn("frac", frac)
    same = F.col("m_lo") == F.col("m_hi")
    blend = inside & same
    own = F.when(inside & ~same & (F.col("frac") >= 0.5), F.col("hi")).otherwise(F.col("lo"))
    at = at.select("e", "frac", own.alias("own"), F.when(blend, F.col("hi")).alias("other"))
    a = kernels.select(F.col("ref_energy").alias("own"), F.col("k"), F.col("offset").alias("o1"), F.col("weight").alias("w1"))
    b = kernels.select(F.col("ref_energy").alias("other"), F.col("k").alias("k2"), F.col("offset").alias("o2"), F.col("weight").alias("w2"))
    rows = at.join(a, "own").join(b, (at["other"] == b["other"]) & (F.col("k") == F.col("k2")), "left")
    mix = lambda x, y: F.when(F.col(y).isNotNull(), F.col(x) + F.col("frac") * (F.col(y) - F.col(x))).otherwise(F.col(x))
    return rows.select("e", "k", mix("o1", "o2").alias("offset"), mix("w1", "w2").alias("weight"))


#: Kernel points that are brought to the tasks.
MOST_KERNEL_POINTS = 1_000_000


class Kernels:
    """Tabulated kernels as arrays, interpolated as kernels_at does it."""

    def __init__(self, rows: list[tuple[float, int, float, float]]):
        by_ref: dict[float, list] = {}
        for ref, k, offset, weight in sorted(rows):
            by_ref.setdefault(ref, []).append((k, offset, weight))
        self.refs = np.array(list(by_ref))
        each = list(by_ref.values())
        self.size = np.array([len(x) for x in each])
        self.most = int(self.size.max())
        self.own, self.other = np.full((2, len(each), 2, self.most), np.nan)
        for i, x in enumerate(each):
            self.own[i, :, : len(x)] = np.array([p[1:] for p in x]).T
            if i + 1 < len(each):
                held = {p[0]: p[1:] for p in each[i + 1]}
                self.other[i, :, : len(x)] = np.array([held.get(p[0], (np.nan, np.nan)) for p in x]).T

    def shifted(self, e: np.ndarray, flight_m: float) -> tuple[np.ndarray, np.ndarray]:
        """For energies the weights and the shifted energies of kernel points, a row for each energy: nan where there is none, without weight, or without positive time."""
        at = np.maximum(np.searchsorted(self.refs, e, "left") - 1, 0)
        up = np.minimum(at + 1, len(self.refs) - 1)
        inside = (e > self.refs[at]) & (up > at)
        with np.errstate(all="ignore"):
            frac = np.where(inside, (np.log(e) - np.log(self.refs[at])) / (np.log(self.refs[up]) - np.log(self.refs[at])), 0.0)
            same = self.size[at] == self.size[up]
            own = self.own[np.where(inside & ~same & (frac >= 0.5), up, at)]
            mixed = own + frac[:, None, None] * (self.other[at] - own)
            offset, weight = np.moveaxis(np.where((inside & same)[:, None, None] & ~np.isnan(self.other[at]), mixed, own), 1, 0)
            before, after = np.full_like(offset, np.nan), np.full_like(offset, np.nan)
            before[:, 1:], after[:, :-1] = offset[:, :-1], offset[:, 1:]
            width = np.where(np.isnan(before), np.where(np.isnan(after), 1.0, after - offset), np.where(np.isnan(after), offset - before, (after - before) / 2))
            tof = (K.TOF_FACTOR * flight_m / np.sqrt(e))[:, None] + offset
            good = (weight > 0) & (tof > 0)
            return np.where(good, weight * np.abs(width), np.nan), np.where(good, (K.TOF_FACTOR * flight_m / tof) ** 2, np.nan)


def tabulated_resolution(curve: DataFrame, kernels: DataFrame, flight_m: float, by: list[str] | None = None) -> DataFrame:
    """by, e, value: curves (by, e, value) seen through tabulated kernels: sums over kernel points of weight times trapezoid
    width times the curve at the shifted energy, over the sums of those weights. Points without weight, without positive
    time or off the grid are left out. Kernels are a dimension, whose size is checked, and are brought to the tasks; a curve
    is cut into pieces, and a piece meets those alone on which one of its kernel points falls."""
    given, by = by or [], by or ["_one"]
    curve = curve.where("e IS NOT NULL").select(*given, *([] if given else [F.lit(1).alias("_one")]), "e", "value")
    rows = kernels.select("ref_energy", "k", "offset", "weight").limit(MOST_KERNEL_POINTS + 1).collect()
    if len(rows) > MOST_KERNEL_POINTS:
        raise ValueError(f"kernels of at most {MOST_KERNEL_POINTS} points are brought to the tasks")
    if not rows:
        return curve.where("false").select(*given, "e", "value")
    held = Kernels([tuple(r) for r in rows])
    step = max(1, (1 << 19) // held.most)

    def facts(e: np.ndarray, _: np.ndarray) -> np.ndarray:
        lo, hi = np.full(held.most, np.inf), np.full(held.most, -np.inf)
        for at in range(0, len(e), step):
            x = held.shifted(e[at : at + step], flight_m)[1]
            lo, hi = np.fmin(lo, np.fmin.reduce(x)), np.fmax(hi, np.fmax.reduce(x))
        return np.concatenate((lo, hi))

    def plan(ends: pieces.Ends):
        """The pieces that each kernel point of a piece sweeps."""
        for k, f in enumerate(ends.facts):
            first, stop = np.searchsorted(ends.end, f[: held.most], "left"), np.searchsorted(ends.lo, f[held.most :], "right")
            swept = [np.arange(a, z) for a, z in zip(first, stop, strict=True) if z > a]
            yield k, np.unique(np.concatenate([[k], *swept])).astype(int), []

    def run(own: pieces.Held):
        x, y = (np.concatenate(c) for c in zip(*own.runs, strict=True))
        e = own.e[np.append(own.e[1:], own.next_e) != own.e]  # one row for an energy
        value = np.full(len(e), np.nan)
        some = np.zeros(len(e), bool)
        for at in range(0, len(e), step):
            wt, to = held.shifted(e[at : at + step], flight_m)
            k = np.searchsorted(x, to, "right") - 1
            inside = ~np.isnan(to) & (k >= 0) & ((k < len(x) - 1) | (to == x[-1]))
            k, up = np.maximum(k, 0), np.minimum(k + 1, len(x) - 1)
            share = np.where(inside & (up > k), (to - x[k]) / np.where(x[up] > x[k], x[up] - x[k], 1.0), 0.0)
            here = np.where(up > k, y[k] + (y[up] - y[k]) * share, y[k])
            total = np.where(inside, wt, 0.0).sum(1)
            some[at : at + step] = inside.any(1)
            value[at : at + step] = np.where(inside, wt * here, 0.0).sum(1) / np.where(total > 0, total, 1.0)
        return {"e": e[some], "value": value[some]}

    cut = pieces.cut(curve, by, lambda e: np.floor(np.log2(np.maximum(e, 1e-300))), facts, pieces.PIECE_ROWS)
    return pieces.meet(cut, by, plan, run, ["value"]).select(*given, "e", "value")


def fisher_matrix(sigma: DataFrame, densities: DataFrame, counts: float) -> DataFrame:
    """g1, g2, fisher: information on the densities (grp, n) in `counts` open-beam counts a bin, J = -sigma T and weight counts / T.

    sigma: (grp, i, sigma), a dimension: groups times bins; pairs are those of the few groups."""
    t = sigma.join(densities, "grp").groupBy("i").agg(F.exp(-F.sum(F.col("n") * F.col("sigma"))).alias("t"))
    rows = sigma.join(t, "i").select("i", "grp", "sigma", "t")
    other = rows.select(F.col("i").alias("i2"), F.col("grp").alias("g2"), F.col("sigma").alias("s2"))
    pairs = rows.join(other, (F.col("i") == F.col("i2")) & (F.col("grp") <= F.col("g2")))
    return pairs.groupBy(F.col("grp").alias("g1"), "g2").agg(F.sum(counts * F.col("sigma") * F.col("s2") * F.col("t")).alias("fisher"))


def add_poisson_noise(pixels: DataFrame, counts: float, seed: int) -> DataFrame:
    """y, x, transmission, sigma arrays of pixels (y, x, spectrum): N ~ Poisson(counts max(T, 0)), T' = N / counts, sigma = sqrt(max(N, 1)) / counts.

    Each pixel has a generator of its own from (seed, y, x), so the result does not depend on partitions."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ys, xs = b.column(0).to_pylist(), b.column(1).to_pylist()
            n = [np.random.default_rng([seed, y, x]).poisson(counts * np.maximum(np.asarray(s, float), 0)) for y, x, s in zip(ys, xs, b.column(2).to_pylist(), strict=True)]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v / counts for v in n], kind), pa.array([np.sqrt(np.maximum(v, 1)) / counts for v in n], kind)], names=["y", "x", "transmission", "sigma"])

    return pixels.select("y", "x", "spectrum").mapInArrow(run, "y int, x int, transmission array<double>, sigma array<double>")
