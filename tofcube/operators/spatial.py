"""The map query: input cubes, masks and one group's cross sections to a map of fitted densities.

The configuration decides, before any job runs, which plan is built; the plan is DataFrames alone:
dead pixels and regions go first by an anti-join and a range predicate, the flux of raw counts is
averaged over live pixels where the solver wants it, inactive bins are left out of the objective,
and one grouping by pixel turns cells into the arrays that are fitted in place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube.functions import scalars as S
from tofcube.operators import axes as A
from tofcube.operators import cube as C
from tofcube.operators import fit, multifit

#: Solver names and what they stand for. Fixed values.
SOLVERS = {"auto": "auto", "lm": "lm", "kl": "kl", "poisson": "kl", "joint_poisson": "kl"}


@dataclass(frozen=True)
class InputData:
    """kind: 'transmission' (a: T, b: sigma), 'counts' (a: sample, b: open beam) or 'nuisance' (a: sample, b: flux, c: detector background).
    Each table is (tof_bin, y, x, value)."""

    kind: str
    a: DataFrame
    b: DataFrame
    c: DataFrame | None = None


def from_transmission(t: DataFrame, sigma: DataFrame) -> InputData:
    return InputData("transmission", t, sigma)


def from_counts(sample: DataFrame, beam: DataFrame) -> InputData:
    return InputData("counts", sample, beam)


def from_counts_with_nuisance(sample: DataFrame, flux: DataFrame, background: DataFrame | None = None) -> InputData:
    return InputData("nuisance", sample, flux, background)


@dataclass(frozen=True)
class FitConfig:
    """window: energies fitted, both ends inclusive; charge: sample charge over open-beam charge; rois: (y0, y1, x0, x1), half open."""

    solver: str = "auto"
    start: float = 0.001
    charge: float = 1.0
    window: tuple[float, float] | None = None
    iterations: int = 60
    rois: list[tuple[int, int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.solver not in SOLVERS:
            raise ValueError(f"unknown solver {self.solver!r}; known: {sorted(SOLVERS)}")
        if not (0 <= self.start < float("inf")) or not (0 < self.charge < float("inf")):
            raise ValueError("start must be finite and not negative, charge finite and positive")
        if self.window and not self.window[0] < self.window[1]:
            raise ValueError("the window's ends must ascend")

    def resolved(self, kind: str) -> str:
        """The solver for a kind of input: counts are fitted by likelihood, transmission by least squares, unless told."""
        name = SOLVERS[self.solver]
        return name if name != "auto" else "lm" if kind == "transmission" else "kl"


def check(data: InputData, config: FitConfig) -> str:
    """The solver, or an error for what can't be fitted together."""
    solver = config.resolved(data.kind)
    if data.kind == "nuisance" and solver == "lm":
        raise ValueError("counts with a given flux are fitted by likelihood alone")
    if data.kind == "nuisance" and data.c is not None and not data.c.where("value <> 0").isEmpty():
        raise ValueError("a detector background other than zero is not fitted")
    if data.kind == "transmission" and solver == "kl" and config.window:
        raise ValueError("an energy window is not taken with transmission and likelihood")
    return solver


def _cells(data: InputData, config: FitConfig, solver: str, dead: DataFrame | None) -> DataFrame:
    """tof_bin, y, x, a, b of the live pixels in the regions: what the solver fits."""
    a = data.a if dead is None else data.a.join(dead, ["y", "x"], "left_anti")
    a = a.where(C.in_any(config.rois)) if config.rois else a
    value = lambda df, name: df.select(*C.CELL, F.col("value").cast("double").alias(name))
    if data.kind == "counts" and solver == "kl":
        # the likelihood takes the open beam's mean over live pixels, least squares takes each pixel's own
        live = data.b.join(a.select("y", "x").distinct(), ["y", "x"], "left_semi")
        flux = live.groupBy("tof_bin").agg(F.avg(F.col("value").cast("double")).alias("b"))
        return value(a, "a").join(flux, "tof_bin")
    return value(a, "a").join(value(data.b, "b"), C.CELL)


def fit_cube(data: InputData, sigma: DataFrame, config: FitConfig = FitConfig(), dead: DataFrame | None = None) -> DataFrame:
    """y, x, density, uncertainty, objective_r, iterations, converged of each live pixel. sigma: (tof_bin, energy, sigma), one row per bin."""
    solver = check(data, config)
    bins = sigma.where(F.col("energy").between(*config.window)) if config.window else sigma
    bins = A.bounded(bins.select("tof_bin", F.col("sigma").alias("s")), "tof_bin")
    cells = _cells(data, config, solver, dead).join(bins, "tof_bin")
    if solver == "kl" and data.kind == "transmission":
        objective, one = "poisson", F.struct("tof_bin", F.col("a").alias("t"), "s")
    elif solver == "kl":
        objective, one = "kl", F.struct("tof_bin", F.col("a").alias("k"), F.col("b").alias("o"), "s")
    else:
        t, u = (F.col("a"), F.col("b")) if data.kind == "transmission" else (S.transmission(F.col("a"), F.col("b")), S.counts_transmission_sigma(F.col("a"), F.col("b")))
        w = F.when(~F.isnan(u) & (u > 0) & (u < float("inf")), 1.0 / (u * u)).otherwise(1e-30)
        objective, one = "lm", F.struct("tof_bin", t.alias("t"), w.alias("w"), "s")
    pixels = cells.groupBy("y", "x").agg(F.array_sort(F.collect_list(one)).alias("held"))
    return fit.fit_map(pixels, F.col("held"), objective, config.start, config.charge, config.iterations)


def fit_groups(data: InputData, model: multifit.Model, config: FitConfig = FitConfig(), free: tuple[str, ...] = (), dead: DataFrame | None = None, **more) -> DataFrame:
    """The map of several densities and the parameters in free: y, x, the columns of multifit.fit_pixels.

    tof_bin numbers the model's bins, in the order of energy. Counts fitted by least squares take no
    energy scale, and energy scale and temperature are not fitted together."""
    solver = check(data, config)
    scale = {"t0_us", "l_scale"} & set(free)
    if scale and solver == "lm" and data.kind != "transmission":
        raise ValueError("an energy scale is not fitted to counts by least squares")
    if scale and "temperature" in free:
        raise ValueError("energy scale and temperature are not fitted together")
    cells = _cells(data, config, solver, dead)
    if solver == "lm" and data.kind != "transmission":
        t, u = S.transmission(F.col("a"), F.col("b")), S.counts_transmission_sigma(F.col("a"), F.col("b"))
        cells = cells.select(*C.CELL, t.alias("a"), u.alias("b"))
    kind = "poisson" if solver == "kl" and data.kind == "transmission" else solver
    how = multifit.Fit(kind, free, density=config.start, charge=config.charge, iterations=config.iterations, window=config.window, **more)
    return multifit.fit_pixels(cells.withColumnRenamed("tof_bin", "i"), ["y", "x"], model, how)


def with_all_pixels(fits: DataFrame, pixels: DataFrame) -> DataFrame:
    """The map over all pixels (y, x): NaN and not converged where nothing was fitted."""
    nan = F.lit(float("nan"))
    out = pixels.select("y", "x").join(fits, ["y", "x"], "left")
    return out.select("y", "x", F.coalesce("density", nan).alias("density"), F.coalesce("uncertainty", nan).alias("uncertainty"), F.coalesce("objective_r", nan).alias("objective_r"), F.coalesce("iterations", F.lit(0)).alias("iterations"), F.coalesce("converged", F.lit(False)).alias("converged"))
