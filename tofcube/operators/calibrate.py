"""Energy calibration by a grid search over path length, time offset and density.

calibrate_energy searches each of many spectra in three stages, finer around the best point so
far, against tabulated cross sections: spectra are the long side, one group-by deals them, and a
task evaluates a spectrum's grid with numpy. grid_search is one stage of a fixed grid over one
spectrum and a built-in dip, as DataFrames. The least is the first strict minimum in the order
path, offset, density.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.operators.axes import bounded

SCALES, OFFSETS, DENSITIES = 11, 9, 5

#: The stages: relative steps of the path, steps of the offset (us), densities (first stage) or relative steps. Fixed values.
PATHS = ([k * 0.001 for k in range(-15, 16)], [k * 0.0001 for k in range(-5, 6)], [k * 0.00001 for k in range(-5, 6)])
TIMES = ([float(k) for k in range(-5, 11)], [k * 0.25 for k in range(-8, 9)], [k * 0.05 for k in range(-10, 11)])
COARSE = [5e-5, 1e-4, 1.5e-4, 2e-4, 3e-4]
FINE = ([k * 0.05 for k in range(-10, 11)], [k * 0.01 for k in range(-10, 11)])
#: Points of the cross-section table that may be broadcast.
MOST_POINTS = 4_000_000


def _least(e: np.ndarray, t: np.ndarray, sigma: np.ndarray, grid: np.ndarray, table: np.ndarray, flight_m: float, densities: list[float], resolution: tuple[float, float] | None) -> tuple[float, float, float, float, int]:
    """path, offset, density, chi-square and bins of the best point."""
    from tofcube.operators.broaden import blur

    good = np.isfinite(t) & np.isfinite(sigma) & (sigma > 0)
    tof = K.TOF_FACTOR * flight_m / np.sqrt(e)
    w = np.where(good, 1.0 / np.where(good, sigma, 1.0) ** 2, 0.0)
    data = np.where(good, t, 0.0)
    best = (flight_m, 0.0, 1e-4, np.inf)
    for stage in range(3):
        path0, time0, n0, _ = best
        trial = densities if stage == 0 else [n for n in (n0 * (1 + d) for d in FINE[stage - 1]) if n > 0]
        n = np.array(trial)[:, None]
        for dp in PATHS[stage]:
            path = (flight_m if stage == 0 else path0) * (1 + dp)
            for dt in TIMES[stage]:
                left = tof - (time0 + dt if stage else dt)
                if not (left > 0).all():
                    continue
                at = (K.TOF_FACTOR * path / left) ** 2
                model = np.exp(-n * np.interp(at, grid, table))
                if resolution:
                    model = np.array([blur(at, m, path, *resolution) for m in model])
                chi2 = (w * (data - model) ** 2).sum(1)
                k = int(np.argmin(chi2))
                if chi2[k] < best[3]:
                    best = (path, time0 + dt if stage else dt, trial[k], float(chi2[k]))
    return (*best, int(good.sum()))


def calibrate_energy(spectra: DataFrame, by: list[str], sigma: DataFrame, flight_m: float, densities: list[float] = COARSE, resolution: tuple[float, float] | None = None) -> DataFrame:
    """by, flight_path_m, t0_us, total_density, chi2_r, n_bins of each spectrum (by, e nominal, t, sigma).

    sigma: (e, sigma), the sample's cross section (sum of abundance times isotope, broadened by
    temperature) on a grid that covers the energies at all trial paths and offsets. Bins whose t or
    sigma isn't finite, or sigma not positive, don't count; grid points at which a bin's time is not
    positive are skipped. resolution: (dt_us, dl_m). A spectrum without a usable point keeps the
    assumed path and has an infinite chi2_r."""
    table = sigma.groupBy("e").agg(F.sum("sigma").alias("sigma")).orderBy("e").limit(MOST_POINTS + 1).toPandas()
    if not 2 <= len(table) <= MOST_POINTS:
        raise ValueError(f"the cross-section table has {len(table)} points; 2 to {MOST_POINTS} are expected")
    shared = spectra.sparkSession.sparkContext.broadcast((table.e.to_numpy(), table.sigma.to_numpy()))
    kinds = ", ".join(f"`{c}` {spectra.schema[c].dataType.simpleString()}" for c in by)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("e")
        path, t0, n, chi2, bins = _least(*(t.column(c).to_numpy() for c in ("e", "t", "sigma")), *shared.value, flight_m, densities, resolution)
        out = t.slice(0, 1).select(by)
        for name, v in (("flight_path_m", path), ("t0_us", t0), ("total_density", n), ("chi2_r", chi2 / max(bins - 3, 1))):
            out = out.append_column(name, pa.array([v], pa.float64()))
        return out.append_column("n_bins", pa.array([bins], pa.int64()))

    return spectra.groupBy(*by).applyInArrow(run, f"{kinds}, flight_path_m double, t0_us double, total_density double, chi2_r double, n_bins bigint")


def nelder_mead(f, x: np.ndarray, low: np.ndarray, high: np.ndarray, step: float = 0.05, iterations: int = 400, xatol: float = 1e-8, fatol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """Bounded simplex minimiser: reflection 1, expansion 2, contraction and shrinking by half.

    Points beyond a bound are mirrored at it and then cut; values that aren't finite count as
    infinite. Ends when the simplex spans at most xatol in each coordinate and fatol in value."""

    def inside(p: np.ndarray) -> np.ndarray:
        p = np.where(p < low, 2 * low - p, np.where(p > high, 2 * high - p, p))
        return np.clip(p, low, high)

    def value(p: np.ndarray) -> float:
        v = f(p)
        return float(v) if np.isfinite(v) else np.inf

    points = [np.clip(np.asarray(x, float), low, high)]
    for k in range(len(x)):
        h = step * points[0][k] if abs(points[0][k]) > 1e-8 else step
        p = points[0].copy()
        p[k] += h if low[k] <= p[k] + h <= high[k] else -h
        points.append(inside(p))
    held = [(value(p), k, p) for k, p in enumerate(points)]
    for _ in range(iterations):
        held.sort(key=lambda v: (v[0], v[1]))
        simplex = np.array([p for _, _, p in held])
        if np.abs(simplex[1:] - simplex[0]).max() <= xatol and held[-1][0] - held[0][0] <= fatol:
            return held[0][2], held[0][0], True
        centre, (worst, name, last) = simplex[:-1].mean(0), held[-1]
        p = inside(2 * centre - last)
        v = value(p)
        if v < held[0][0]:
            q = inside(centre + 2 * (centre - last))
            w = value(q)
            held[-1] = (w, name, q) if w < v else (v, name, p)
        elif v < held[-2][0]:
            held[-1] = (v, name, p)
        else:
            base, floor = (p, v) if v < worst else (last, worst)
            q = inside(centre + 0.5 * (base - centre))
            w = value(q)
            if w < floor:
                held[-1] = (w, name, q)
            else:
                held = [held[0], *((value(y), k, y) for _, k, p in held[1:] for y in [inside(simplex[0] + 0.5 * (p - simplex[0]))])]
    held.sort(key=lambda v: (v[0], v[1]))
    return held[0][2], held[0][0], False


def stand_in(spark: SparkSession) -> DataFrame:
    """bin, e (nominal), t, sigma: one Lorentz dip whose energies are a little off."""
    e = 1.0 + F.col("id") * 0.05
    true = F.pow(F.sqrt(e) / 1.002, F.lit(2.0))
    return spark.range(200).select(F.col("id").cast("int").alias("bin"), e.alias("e"), F.exp(-0.7 * 1.0 / (1.0 + F.pow((true - 6.0) / 0.2, F.lit(2.0)))).alias("t"), F.lit(0.01).alias("sigma"))


def grid(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(SCALES * OFFSETS * DENSITIES).select(
        i.alias("ordinal"),
        (0.995 + F.floor(i / (OFFSETS * DENSITIES)) * 0.001).alias("l_scale"),
        (-2.0 + F.floor(i / DENSITIES) % OFFSETS * 0.5).alias("t0_us"),
        (0.5 + i % DENSITIES * 0.1).alias("n"),
    )


def grid_search(spectrum: DataFrame, flight_m: float) -> DataFrame:
    """The best point with its chi2 and the number of bins: bins whose t and sigma are finite and sigma positive count."""
    good = spectrum.where("NOT isnan(t) AND abs(t) < double('inf') AND sigma > 0 AND sigma < double('inf')")
    points = grid(spectrum.sparkSession)
    tof = K.TOF_FACTOR * flight_m / F.sqrt("e")
    cells = points.join(bounded(good, "e", 100_000), F.lit(True))  # one spectrum
    e = F.pow(K.TOF_FACTOR * flight_m * F.col("l_scale") / (tof - F.col("t0_us")), F.lit(2.0))
    model = F.exp(-F.col("n") / (1.0 + F.pow((e - 6.0) / 0.2, F.lit(2.0))))
    r = (F.col("t") - model) / F.col("sigma")
    sums = cells.groupBy("ordinal", "l_scale", "t0_us", "n").agg(F.sum(r * r).alias("chi2"), F.count("*").alias("bins"))
    best = sums.agg(F.min(F.struct("chi2", "ordinal", "l_scale", "t0_us", "n", "bins")).alias("b"))
    return best.select("b.ordinal", "b.l_scale", "b.t0_us", "b.n", "b.chi2", "b.bins")


_F = f"({K.TOF_FACTOR!r}::DOUBLE * 25)"
SQL = f"""WITH s AS (SELECT 1 + i * 0.05::DOUBLE AS e FROM range(200) t(i)), d AS (SELECT e, exp(-0.7::DOUBLE / (1 + pow((pow(sqrt(e) / 1.002::DOUBLE, 2) - 6) / 0.2::DOUBLE, 2))) AS t FROM s),
g AS (SELECT i AS ordinal, 0.995::DOUBLE + (i // 45) * 0.001::DOUBLE AS l_scale, -2 + ((i // 5) % 9) * 0.5::DOUBLE AS t0_us, 0.5::DOUBLE + (i % 5) * 0.1::DOUBLE AS n FROM range(495) t(i)),
c AS (SELECT ordinal, l_scale, t0_us, n, sum(pow((t - exp(-n / (1 + pow((pow({_F} * l_scale / ({_F} / sqrt(e) - t0_us), 2) - 6) / 0.2::DOUBLE, 2)))) / 0.01::DOUBLE, 2)) AS chi2, count(*) AS bins FROM g, d GROUP BY ALL)
SELECT ordinal, round(l_scale, 6) AS l_scale, round(t0_us, 6) AS t0_us, round(n, 6) AS n, round(chi2, 6) AS chi2, bins FROM c ORDER BY chi2, ordinal LIMIT 1"""
