"""Fits of several densities, temperature, energy scale, normalisation and background, pixel by pixel.

Pixels are the long side: one row each, its spectrum an array. A batch of pixels is fitted at once:
model and derivatives are arrays (pixel, bin, parameter) and every step solves the batch's small
normal equations together, so no Python runs per pixel. The axis, the cross sections on it, at
several temperatures or on a finer grid, and the resolution matrix are dimensions of the detector;
they are broadcast after a check of their size, and a pixel's result depends on its own row alone.

Model of a bin: T = exp(-sum n_g sigma_g(E', temperature)), seen through the resolution matrix R, then
A T + B_A + B_B / sqrt(E) + B_C sqrt(E) + B_D exp(-B_F / sqrt(E)), with E' = (F L s / (t - t0))**2.

A step solves (H + d max(diag H, 1e-10)) x = g, is cut to the bounds, and is taken if the objective
falls strictly: d shrinks tenfold, else it grows tenfold. A parameter held at a bound by its
gradient is left out of the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube import constants as K

#: Start and bounds of the parameters besides densities. Fixed values.
BOUNDS = {"temperature": (293.6, 1.0, 5000.0), "t0_us": (0.0, -10.0, 10.0), "l_scale": (1.0, 0.99, 1.01), "a": (1.0, 0.5, 2.0), "b_a": (0.0, -0.5, 0.5), "b_b": (0.0, -0.5, 0.5), "b_c": (0.0, -0.5, 0.5), "b_d": (0.01, 0.0, 1.0), "b_f": (1.0, 0.0, 100.0)}
#: Bytes of dimensions that may be broadcast.
MOST_BYTES = 256 << 20
#: Rows of a table of dimensions that may be read to the driver.
MOST_ROWS = 4_000_000


@dataclass
class Model:
    """energies: of the bins. sigma: (group, temperature node, point) on `grid` (the bins' energies if None).
    nodes: the temperatures of the nodes, ascending; between them sigma is linear. resolution: (bin, bin) or None."""

    groups: list[str]
    energies: np.ndarray
    sigma: np.ndarray
    grid: np.ndarray | None = None
    nodes: np.ndarray = field(default_factory=lambda: np.array([293.6]))
    resolution: np.ndarray | None = None
    flight_m: float = 25.0

    def __post_init__(self) -> None:
        self.energies, self.sigma, self.nodes = np.asarray(self.energies, float), np.asarray(self.sigma, float), np.asarray(self.nodes, float)
        points = len(self.energies if self.grid is None else self.grid)
        if self.sigma.shape != (len(self.groups), len(self.nodes), points):
            raise ValueError(f"sigma has shape {self.sigma.shape}, expected {(len(self.groups), len(self.nodes), points)}")
        if len(self.energies) == 0 or not (self.energies > 0).all() or (np.diff(self.energies) <= 0).any():
            raise ValueError("energies must be positive and ascend")
        if self.resolution is not None and self.resolution.shape != (len(self.energies),) * 2:
            raise ValueError("the resolution matrix must be square on the bins")
        if self.sigma.nbytes + (0 if self.resolution is None else self.resolution.nbytes) > MOST_BYTES:
            raise ValueError("the dimensions of the model are too large to broadcast")


@dataclass(frozen=True)
class Fit:
    """solver: 'lm' (bins are transmission and its sigma), 'kl' (sample and open-beam counts) or 'poisson' (transmission).
    free: what is fitted besides the densities; start: of any parameter; fixed: densities that keep their start; charge: sample over open beam."""

    solver: str = "lm"
    free: tuple[str, ...] = ()
    start: dict[str, float] = field(default_factory=dict)
    fixed: tuple[str, ...] = ()
    density: float = 1e-3
    charge: float = 1.0
    iterations: int = 200
    tol: float = 1e-8
    window: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.solver not in ("lm", "kl", "poisson"):
            raise ValueError("solver is 'lm', 'kl' or 'poisson'")
        unknown = set(self.free) - set(BOUNDS)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}; known: {sorted(BOUNDS)}")
        if ("b_d" in self.free) != ("b_f" in self.free):
            raise ValueError("b_d and b_f are fitted together")
        if self.solver == "kl" and {"b_d", "b_f"} & set(self.free):
            raise ValueError("the exponential background is not fitted to counts")
        if self.solver == "kl" and {"b_b", "b_c"} & set(self.free) and "b_a" not in self.free:
            raise ValueError("b_b and b_c need b_a when counts are fitted")
        if not 0 < self.charge < float("inf"):
            raise ValueError("charge must be finite and positive")

    def names(self, m: Model) -> list[str]:
        return [*(f"n_{g}" for g in m.groups), *self.free]


def _cross_sections(m: Model, v: dict[str, np.ndarray], n: int, slopes: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """sigma (pixel or 1, group, bin), and its slopes by temperature and energy; E' (pixel, bin)."""
    sig, by_t = m.sigma[None], None
    moved = "t0_us" in v or "l_scale" in v
    if len(m.nodes) > 1:
        t = np.clip(v.get("temperature", np.full(1, 293.6)), m.nodes[0], m.nodes[-1])
        k = np.clip(np.searchsorted(m.nodes, t, "right") - 1, 0, len(m.nodes) - 2)
        per = 1.0 / (m.nodes[k + 1] - m.nodes[k])
        low, high = m.sigma[:, k].swapaxes(0, 1), m.sigma[:, k + 1].swapaxes(0, 1)
        by_t = (high - low) * per[:, None, None]
        sig = low + by_t * (t - m.nodes[k])[:, None, None]
    else:
        sig = sig[:, :, 0]
    grid = m.energies if m.grid is None else m.grid
    if not moved and m.grid is None:
        return sig, by_t, None, None
    if moved:
        tof = K.TOF_FACTOR * m.flight_m / np.sqrt(m.energies)
        t0 = np.minimum(v.get("t0_us", np.zeros(1)), tof.min() * (1 - 1e-9))
        e = (K.TOF_FACTOR * m.flight_m * v.get("l_scale", np.ones(1))[:, None] / (tof - t0[:, None])) ** 2
        e = np.broadcast_to(e, (n, len(tof)))
    else:
        e = m.energies[None]
    k = np.clip(np.searchsorted(grid, e, "right") - 1, 0, len(grid) - 2)
    frac = np.clip((e - grid[k]) / (grid[k + 1] - grid[k]), 0.0, 1.0)[:, None]
    at = lambda x, j: np.take_along_axis(np.broadcast_to(x, (len(e), *x.shape[1:])), np.broadcast_to(j[:, None], (len(e), x.shape[1], j.shape[1])), 2)
    lo, hi = at(sig, k), at(sig, k + 1)
    by_e = (hi - lo) / (grid[k + 1] - grid[k])[:, None] if slopes and moved else None
    if by_t is not None:
        by_t = at(by_t, k) * (1 - frac) + at(by_t, k + 1) * frac
    return lo * (1 - frac) + hi * frac, by_t, by_e, e


def evaluate(m: Model, names: list[str], x: np.ndarray, slopes: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The model (pixel, bin) at parameters x (pixel, parameter), and its derivatives (pixel, bin, parameter)."""
    v = {c: x[:, k] for k, c in enumerate(names)}
    dens = x[:, : len(m.groups)]
    sig, by_t, by_e, e = _cross_sections(m, v, len(x), slopes)
    t0 = np.exp(-np.einsum("pg,pgb->pb", dens, np.broadcast_to(sig, (len(x), *sig.shape[1:]))))
    seen = (lambda y: y @ m.resolution.T) if m.resolution is not None else (lambda y: y)
    t = seen(t0)
    inv, root = 1.0 / np.sqrt(m.energies), np.sqrt(m.energies)
    one = lambda c, other: v[c][:, None] if c in v else other
    a = one("a", 1.0)
    out = a * t + one("b_a", 0.0) + one("b_b", 0.0) * inv + one("b_c", 0.0) * root
    tail = np.exp(-v["b_f"][:, None] * inv) if "b_f" in v else None
    if tail is not None:
        out = out + v["b_d"][:, None] * tail
    if not slopes:
        return out, None
    full = lambda y: np.broadcast_to(y, out.shape)
    cols = [full(a * seen(-sig[:, g] * t0)) for g in range(len(m.groups))]
    each = None if e is None or by_e is None else np.einsum("pg,pgb->pb", dens, by_e) * t0
    for c in names[len(m.groups) :]:
        if c == "temperature":
            d = a * seen(-np.einsum("pg,pgb->pb", dens, np.broadcast_to(by_t, (len(x), *by_t.shape[1:]))) * t0) if by_t is not None else np.zeros_like(t)
        elif c == "t0_us":
            tof = K.TOF_FACTOR * m.flight_m / np.sqrt(m.energies)
            d = a * seen(-each * 2.0 * e / (tof - v["t0_us"][:, None]))
        elif c == "l_scale":
            d = a * seen(-each * 2.0 * e / v["l_scale"][:, None])
        else:
            d = {"a": lambda: t, "b_a": lambda: np.ones_like(t), "b_b": lambda: inv, "b_c": lambda: root, "b_d": lambda: tail, "b_f": lambda: -v["b_d"][:, None] * inv * tail}[c]()
        cols.append(full(d))
    return out, np.stack(cols, 2)


def _objective(fit: Fit, a: np.ndarray, b: np.ndarray, use: np.ndarray, t: np.ndarray, j: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Objective of each pixel and, with derivatives j, half its descent and half its curvature."""
    if fit.solver == "lm":
        w = np.where(use & np.isfinite(b) & (b > 0), 1.0 / np.where(b > 0, b, 1.0) ** 2, np.where(use, 1e-30, 0.0))
        r = np.where(use, a - t, 0.0)
        value, down, curve = w * r * r, w * r, w
    elif fit.solver == "poisson":
        t = np.maximum(t, K.POISSON_FLOOR)
        value, down, curve = 2.0 * (t - np.where(a > 0, a * np.log(t), 0.0)), -(1.0 - a / t), np.maximum(a, 0.0) / (t * t)
    else:
        t, c = np.maximum(t, K.POISSON_FLOOR), fit.charge
        n, ct = a + b, c * t
        log = lambda x, y: np.where(x > 0, x * np.log(np.where(x > 0, y, 1.0)), 0.0)
        some = np.where(n > 0, n, 1.0)
        value = np.where(n > 0, 2.0 * (log(a, a * (1 + ct) / (some * ct)) + log(b, b * (1 + ct) / some)), 0.0)
        down, curve = (a - b * ct) / (t * (1 + ct)), n * c / (t * (1 + ct) ** 2)
    value, down, curve = (np.where(use, x, 0.0) for x in (value, down, curve))
    total = value.sum(1)
    if j is None:
        return total, None, None
    return total, np.einsum("pb,pbk->pk", down, j), np.einsum("pbk,pb,pbl->pkl", j, curve, j, optimize=True)


def _solve(h: np.ndarray, g: np.ndarray, damping: np.ndarray) -> np.ndarray:
    h = h.copy()
    d = np.arange(h.shape[1])
    h[:, d, d] += damping[:, None] * np.maximum(h[:, d, d], K.DIAGONAL_FLOOR)
    try:
        return np.linalg.solve(h, g[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.einsum("pkl,pl->pk", np.linalg.pinv(h), g)


def fit_batch(m: Model, fit: Fit, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """values and errors (pixel, parameter), objective_r, iterations, converged of spectra a, b (pixel, bin); NaN in a is a missing bin."""
    names = fit.names(m)
    start = np.array([fit.start.get(c, BOUNDS[c][0] if c in BOUNDS else fit.density) for c in names])
    low = np.array([BOUNDS[c][1] if c in BOUNDS else 0.0 for c in names])
    high = np.array([BOUNDS[c][2] if c in BOUNDS else np.inf for c in names])
    free = np.array([c not in {f"n_{g}" for g in fit.fixed} for c in names])
    use = np.isfinite(a)
    if fit.window:
        use &= (m.energies >= fit.window[0]) & (m.energies <= fit.window[1])
    a = np.where(np.isfinite(a), a, 0.0)
    n = len(a)
    x = np.repeat(np.clip(start, low, high)[None], n, 0)
    damping, done, count = np.full(n, 1e-3), np.zeros(n, bool), np.zeros(n, int)
    t, j = evaluate(m, names, x)
    f, g, h = _objective(fit, a, b, use, t, j)
    enough = use.sum(1) >= max(1, free.sum())
    live = np.flatnonzero(enough & np.isfinite(f)) if free.any() else np.zeros(0, int)
    done[~free.any() & enough] = True
    for k in range(1, fit.iterations + 1):
        if not len(live):
            break
        gk, hk = g[live].copy(), h[live].copy()
        # a parameter that its gradient holds at a bound, or that is fixed, takes no part
        out = ~free | ((x[live] <= low) & (gk < 0)) | ((x[live] >= high) & (gk > 0))
        gk[out] = 0.0
        hk[np.repeat(out[:, :, None], out.shape[1], 2) | np.repeat(out[:, None, :], out.shape[1], 1)] = 0.0
        d = np.arange(out.shape[1])
        hk[:, d, d] = np.where(out, 1.0, hk[:, d, d])
        new = np.clip(x[live] + _solve(hk, gk, damping[live]), low, high)
        new = np.where(np.isfinite(new), new, x[live])
        t, _ = evaluate(m, names, new, False)
        fk, _, _ = _objective(fit, a[live], b[live], use[live], t, None)
        better = fk < f[live]
        still = (np.abs(new - x[live]) <= fit.tol * np.maximum(np.abs(x[live]), 1e-12)).all(1)
        close = np.abs(f[live] - fk) <= fit.tol * np.maximum(np.abs(f[live]), 1e-300)
        count[live] = np.where(better, k, count[live])
        won = live[better]
        x[won], f[won] = new[better], fk[better]
        done[live] = np.where(better, close | still, still | (close & ~better))
        damping[live] = np.where(better, np.maximum(damping[live] * 0.1, 1e-16), damping[live] * 10.0)
        if len(won):
            t, j = evaluate(m, names, x[won])
            _, g[won], h[won] = _objective(fit, a[won], b[won], use[won], t, j)
        live = live[~done[live] & (damping[live] <= 1e16)]
    dof = use.sum(1) - free.sum()
    with np.errstate(invalid="ignore", divide="ignore"):
        per = np.where(dof > 0, f / np.where(dof > 0, dof, 1), np.nan)
    ok = done & enough
    kept = np.where(free, h.transpose(1, 0, 2), 0.0).transpose(1, 0, 2)
    kept = np.where(free[:, None], kept, np.eye(len(names)))
    cov = np.full((n, len(names)), np.nan)
    for p in np.flatnonzero(ok):
        try:
            cov[p] = np.diag(np.linalg.inv(kept[p]))
        except np.linalg.LinAlgError:
            pass
    with np.errstate(invalid="ignore"):
        err = np.sqrt(np.where(cov > 0, cov, np.nan) * (per[:, None] if fit.solver == "lm" else 1.0))
    err[:, ~free] = 0.0
    return {"values": np.where(ok[:, None], x, np.nan), "errors": np.where(ok[:, None], err, np.nan), "objective_r": per, "iterations": count, "converged": ok}


def _spectra(col: pa.Array, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays (pixel, bin) of a column of lists of (i, a, b); what is missing is NaN."""
    a, b = (np.full((len(col), bins), np.nan) for _ in "ab")
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten()
    i = flat.field("i").to_numpy(zero_copy_only=False).astype(int)
    row = np.repeat(np.arange(len(col)), sizes)
    a[row, i], b[row, i] = flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False)
    return a, b


def fit_pixels(cells: DataFrame, by: list[str], model: Model, fit: Fit = Fit(), block: int = 64) -> DataFrame:
    """by, a column and an err_ column for each parameter, objective_r (per degree of freedom), iterations, converged.

    cells: by, i (bin number), a, b: transmission and sigma, or sample and open-beam counts, by solver. One
    shuffle groups a pixel's cells. Parameters of pixels that don't converge are NaN."""
    spark = cells.sparkSession
    names = fit.names(model)
    shared = spark.sparkContext.broadcast(model)
    bins = len(model.energies)
    kinds = {c: cells.schema[c].dataType.simpleString() for c in by}
    one = F.struct(F.col("i").cast("int").alias("i"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    pixels = cells.where(F.col("i").between(0, bins - 1)).groupBy(*by).agg(F.collect_list(one).alias("bins"))
    cols = [x for c in names for x in (c, f"err_{c}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                t = whole.slice(at, block)
                a, b = _spectra(pa.concat_arrays([t.column("bins")]), bins)
                got = fit_batch(shared.value, fit, a, b)
                out = [t.column(c) for c in by]
                for k in range(len(names)):
                    out += [pa.array(got["values"][:, k]), pa.array(got["errors"][:, k])]
                yield pa.RecordBatch.from_arrays([*out, pa.array(got["objective_r"]), pa.array(got["iterations"], pa.int32()), pa.array(got["converged"])], names=[*by, *cols, "objective_r", "iterations", "converged"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"`{c}` double" for c in cols), "objective_r double, iterations int, converged boolean"])
    return pixels.select(*by, "bins").mapInArrow(run, schema)


def model_of(sigma: DataFrame, axis: DataFrame, **more) -> Model:
    """A model from tables sigma (grp, i, sigma; optionally temperature, else 293.6) and axis (i, energy), numbered by energy.

    Both are dimensions: more than MOST_ROWS rows of either are refused before they reach the driver.
    A row on no bin of the axis or a repeated row is refused; a bin without a row, or a null one, has no cross section."""
    if "temperature" not in sigma.columns:
        sigma = sigma.withColumn("temperature", F.lit(293.6))
    sigma = sigma.select(F.col("grp").cast("string"), F.col("temperature").cast("double"), F.col("i").cast("bigint"), F.col("sigma").cast("double"))
    axis = axis.select(F.col("i").cast("bigint"), F.col("energy").cast("double"))
    t, e = (d.limit(MOST_ROWS + 1).toArrow() for d in (sigma, axis))
    if max(t.num_rows, e.num_rows) > MOST_ROWS:
        raise ValueError(f"a dimension has more than {MOST_ROWS} rows")
    e = e.sort_by("i")
    groups, g = np.unique(t.column("grp").to_numpy().astype(str), return_inverse=True)
    nodes, k = np.unique(t.column("temperature").to_numpy(), return_inverse=True)
    bins, i = e.column("i").to_numpy(), t.column("i").to_numpy()
    if not np.isin(i, bins).all():
        raise ValueError("a cross section lies on no bin of the axis")
    at = g, k, np.searchsorted(bins, i)
    out = np.full((len(groups), len(nodes), len(bins)), np.nan)
    out[at] = t.column("sigma").to_numpy()
    if len(np.unique(np.ravel_multi_index(at, out.shape))) < len(i):
        raise ValueError("a group has two cross sections on one bin and temperature")
    return Model(groups.tolist(), e.column("energy").to_numpy(), np.where(np.isnan(out), 0.0, out), nodes=nodes, **more)


def differences(m: Model, names: list[str], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Derivatives (pixel, bin, parameter) at x (pixel, parameter) by forward steps of step * (1 + |p|), backward where the upper bound is in the way."""
    t, _ = evaluate(m, names, x, False)
    top = np.array([BOUNDS[c][2] if c in BOUNDS else np.inf for c in names])
    h = step * (1.0 + np.abs(x))
    h = np.where(x + h > top, -h, h)
    moved = [evaluate(m, names, x + h * one, False)[0] for one in np.eye(len(names))]
    return np.stack([(v - t) / h[:, k, None] for k, v in enumerate(moved)], 2)


def jacobian_and_fisher(cells: DataFrame, model: Model, names: list[str], values: list[float], step: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without a fit: the derivatives (bin, parameter), the information J' diag(1 / mu) J and mu = O T summed over all cells (i, b: open-beam counts).

    With a step the derivatives are differences."""
    x = np.array([values], float)
    t, j = evaluate(model, names, x, step is None)
    j = j if step is None else differences(model, names, x, step)
    o = np.zeros(len(model.energies))
    for i, b in cells.groupBy("i").agg(F.sum("b").alias("b")).collect():  # one row for each bin
        o[i] = b
    mu = o * t[0]
    jac = j[0] * o[:, None]
    w = np.where(mu > 0, 1.0 / np.where(mu > 0, mu, 1.0), 0.0)
    return jac, np.einsum("bk,b,bl->kl", jac, w, jac), mu
