"""Per-pixel fits of one areal density, inside generated and interpreted expressions of one row.

A pixel's spectrum is one array (bounded by the number of bins); the whole optimiser is a fold over
the iteration numbers whose state is a struct, and each evaluation a fold over the zipped arrays.
So a map of millions of pixels is a projection after the one shuffle that groups cells by pixel,
with no Python and no state between rows. The cross sections are a literal array or a column of a
broadcast row.

State: density n, objective, gradient g and curvature h of half the objective, damping, iterations,
converged. A step d = g / (h + damping * max(h, 1e-10)) is taken if the objective falls strictly:
damping shrinks tenfold, else it grows tenfold; the density stays in [0, inf).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tofcube import constants as K


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sum3(bins: Column, f: Callable[[Column], tuple[Column, Column, Column]]) -> Column:
    """struct(f, g, h): sums over the bins of three expressions."""
    zero = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))

    def add(acc: Column, b: Column) -> Column:
        x, y, z = f(b)
        return F.struct((acc["f"] + x).alias("f"), (acc["g"] + y).alias("g"), (acc["h"] + z).alias("h"))

    return F.aggregate(bins, zero, add)


def least_squares(bins: Column) -> Callable[[Column], Column]:
    """Objective of bins (t, w, s): sum w (t - exp(-n s))**2 and the slope and curvature of the step in n."""

    def at(n: Column) -> Column:
        def one(b: Column) -> tuple[Column, Column, Column]:
            m = F.exp(-n * b["s"])
            r, j = b["t"] - m, -b["s"] * m
            return b["w"] * r * r, b["w"] * r * j, b["w"] * j * j

        return _sum3(bins, one)

    return at


def joint_poisson(bins: Column, c: float) -> Callable[[Column], Column]:
    """Objective of bins (k, o, s): the deviance after profiling the flux out, with t = exp(-n s)."""

    def at(n: Column) -> Column:
        def one(b: Column) -> tuple[Column, Column, Column]:
            t = F.greatest(F.exp(-n * b["s"]), F.lit(K.POISSON_FLOOR))
            both, ct = b["k"] + b["o"], c * t
            log = lambda x, y: F.when(x > 0, x * F.ln(y)).otherwise(0.0)
            dev = F.when(both > 0, 2.0 * (log(b["k"], b["k"] * (1.0 + ct) / (both * ct)) + log(b["o"], b["o"] * (1.0 + ct) / both))).otherwise(0.0)
            slope = -2.0 * (b["k"] - b["o"] * ct) / (t * (1.0 + ct))
            j = -b["s"] * t
            return dev, -0.5 * slope * j, both * c / (t * (1.0 + ct) * (1.0 + ct)) * j * j

        return _sum3(bins, one)

    return at


def single_poisson(bins: Column) -> Callable[[Column], Column]:
    """Objective of bins (t, s): twice the Poisson likelihood of t under exp(-n s)."""

    def at(n: Column) -> Column:
        def one(b: Column) -> tuple[Column, Column, Column]:
            m = F.greatest(F.exp(-n * b["s"]), F.lit(K.POISSON_FLOOR))
            j = -b["s"] * m
            return 2.0 * (m - F.when(b["t"] > 0, b["t"] * F.ln(m)).otherwise(0.0)), -(1.0 - b["t"] / m) * j, j * j / m

        return _sum3(bins, one)

    return at


def minimise(at: Callable[[Column], Column], start: float, iterations: int = 60, tol: float = 1e-8) -> Column:
    """struct(n, f, g, h, damping, iterations, converged) after damped steps from `start`."""

    def state(n: Column, e: Column, damping: Column, k: Column, done: Column) -> Column:
        return F.struct(n.alias("n"), e["f"].alias("f"), e["g"].alias("g"), e["h"].alias("h"), damping.alias("damping"), k.alias("iterations"), done.alias("converged"))

    def step(s: Column, k: Column) -> Column:
        d = s["g"] / (s["h"] + s["damping"] * F.greatest(s["h"], F.lit(K.DIAGONAL_FLOOR)))

        def tried(n: Column) -> Column:
            def judged(e: Column) -> Column:
                better = e["f"] < s["f"]
                close = (F.abs(s["f"] - e["f"]) <= tol * F.greatest(F.abs(s["f"]), F.lit(1e-300))) | (F.abs(n - s["n"]) <= tol * F.greatest(F.abs(s["n"]), F.lit(1e-12)))
                # at a bound or at the bottom no step can lower the objective any more
                stuck = ~better & (F.abs(n - s["n"]) <= tol * F.greatest(F.abs(s["n"]), F.lit(1e-12)))
                return F.when(better, state(n, e, F.greatest(s["damping"] * 0.1, F.lit(1e-16)), k, close)).otherwise(state(s["n"], s, s["damping"] * 10.0, k, stuck))

            return let(at(n), judged)

        move = let(F.greatest(s["n"] + d, F.lit(0.0)), tried)
        return F.when(s["converged"] | (s["damping"] > 1e16) | ~(s["h"] > 0), s).otherwise(move)

    first = let(at(F.lit(start)), lambda e: state(F.lit(start), e, F.lit(1e-3), F.lit(0), F.lit(False)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), first, step)


def fit_map(pixels: DataFrame, bins: Column, objective: str, start: float = 0.01, c: float = 1.0, iterations: int = 60) -> DataFrame:
    """y, x, density, uncertainty, objective_r (per degree of freedom), iterations, converged.

    bins: array of structs, (t, w, s) for 'lm', (k, o, s) for 'kl' or (t, s) for 'poisson'. Values that are not
    converged are NaN in density and uncertainty; fewer than two bins never converge."""
    held = pixels.select("y", "x", bins.alias("bins"))
    b = F.col("bins")
    at = {"lm": lambda: least_squares(b), "kl": lambda: joint_poisson(b, c), "poisson": lambda: single_poisson(b)}[objective]()
    out = held.select("y", "x", F.size("bins").alias("m"), minimise(at, start, iterations).alias("s"))
    dof = F.col("m") - 1
    per = F.when(dof > 0, F.col("s.f") / dof).otherwise(float("nan"))
    ok = F.col("s.converged") & (F.col("m") >= 2)
    scale = per if objective == "lm" else F.lit(1.0)
    nan = F.lit(float("nan"))
    return out.select("y", "x", F.when(ok, F.col("s.n")).otherwise(nan).alias("density"), F.when(ok & (F.col("s.h") > 0), F.sqrt(scale / F.when(F.col("s.h") > 0, F.col("s.h")).otherwise(1.0))).otherwise(nan).alias("uncertainty"), per.alias("objective_r"), F.col("s.iterations").alias("iterations"), ok.alias("converged"))


def map_summary(fits: DataFrame) -> DataFrame:
    """Converged and total pixels, mean and population deviation over converged finite densities."""
    v = F.when(F.col("converged") & ~F.isnan("density"), F.col("density"))
    return fits.agg(F.count("*").alias("n_total"), F.count_if("converged").alias("n_converged"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
