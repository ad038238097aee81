"""Forward models and goodness of fit as joins and grouped sums.

Resonance, group and kernel tables are dimensions; energies and pixels are the long side. Every
contribution is a row of an equi-join or of a range join with a dimension, and each sum is a
grouped aggregation with map-side partials, so nothing is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tofcube import constants as K
from tofcube.functions import scalars as S
from tofcube.operators.asof import bracket, in_intervals
from tofcube.operators.ordering import numbered


def group_sigma(sigma: DataFrame, members: DataFrame) -> DataFrame:
    """grp, i, sigma: sums over members (grp, iso, ratio) of ratio * sigma (iso, i, sigma)."""
    return sigma.join(members, "iso").groupBy("grp", "i").agg(F.sum(F.col("ratio") * F.col("sigma")).alias("sigma"))


def transmit(sigma: DataFrame, densities: DataFrame) -> DataFrame:
    """i, transmission: exp(-sum n sigma) over (grp, i, sigma) and (grp, n); densities that are not positive are left out."""
    return sigma.join(densities.where("n > 0"), "grp").groupBy("i").agg(F.exp(-F.sum(F.col("n") * F.col("sigma"))).alias("transmission"))


def interpolate(x: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """The rows of x (by, x) with y from the tables (by, x, y, law), clamped at the ends; rows without a table are left out.

    Laws by interval: 1 histogram, 2 lin-lin, 3 linear in ln x, 4 ln y linear in x, 5 log-log; lin-lin
    where a logarithm has no argument. Each row meets the two table rows around it in one ordered scan."""
    found = bracket(x, table, by, "x", ["y", "law"]).where("before IS NOT NULL OR after IS NOT NULL")
    low = F.coalesce("before", "after")
    high = lambda c: F.when(F.col("before").isNotNull(), F.col("after")[c])
    return found.select(*x.columns, law_value(F.col("x"), low["x"], low["y"], high("x"), high("y"), low["law"]).alias("y"))


def law_value(x: Column, x0: Column, y0: Column, x1: Column, y1: Column, law: Column) -> Column:
    lin = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    logx = (x > 0) & (x0 > 0) & (x1 > 0)
    logy = (y0 > 0) & (y1 > 0)
    fx = F.ln(x / x0) / F.ln(x1 / x0)
    fl = (x - x0) / (x1 - x0)
    return (
        F.when((x <= x0) | x1.isNull(), y0)
        .when(law == 1, y0)
        .when((law == 3) & logx, y0 + (y1 - y0) * fx)
        .when((law == 4) & logy, y0 * F.exp(F.ln(y1 / y0) * fl))
        .when((law == 5) & logx & logy, y0 * F.exp(F.ln(y1 / y0) * fx))
        .otherwise(lin)
    )


def in_ranges(energies: DataFrame, ranges: DataFrame) -> DataFrame:
    """Energies (za, e) with the ranges (za, lo, hi) of their isotope that hold them: half open where
    the next range starts where this one ends, else closed. An as-of join on the start."""
    return in_intervals(energies, ranges, "za", "e", "lo", "hi")


#: Copies of a range's energies, so that its many (l, j) spread over as many tasks.
SALTS = 16
#: Energies and resonances of a block, and pairs that are held at once.
BLOCK_E, BLOCK_R, BLOCK_PAIRS = 1 << 11, 1 << 14, 1 << 19


def _kinematics(energies: DataFrame, res: DataFrame, spin: float, radii: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Energies (e) and resonances (za, awr, radius, l, j, er, gn, gg, gf, and gfa, gfb for gf) and what all formalisms need.

    Columns spin, e_low and e_high of the resonances tell each one's target spin (else `spin` holds
    for all) and range (else all energies): a shared end belongs to the range above. phase_radius
    is that of the phase shift (else radius). radii: tables (za, e_low, x, y, law) of a range's
    radius by energy; it takes the place of both radii, or of those that radius_tabled and
    phase_tabled name. What depends on the resonance alone, and what depends on energy and l alone,
    is computed before they meet, by gid."""
    has = set(res.columns)
    col = lambda c, other: (F.col(c) if c in has else other).alias(c)
    none = F.lit(None).cast("double")
    rows = res.select(
        "za", "awr", "radius", "l", F.abs("j").alias("j"), "er", "gn", "gg", (F.col("gfa") if "gfa" in has else F.col("gf")).alias("gfa"), col("gfb", F.lit(0.0)), col("spin", F.lit(float(spin))), col("e_low", none), col("e_high", none),
        col("phase_radius", F.col("radius")), col("radius_tabled", F.lit(True)), col("phase_tabled", F.lit(True)),
    )
    # one group for each isotope, l and range; equal j are those that agree to 1e-9
    own = ["za", "awr", "radius", "phase_radius", "radius_tabled", "phase_tabled", "l", "e_low", "e_high"]
    rows = rows.withColumn("gid", F.xxhash64(*own, "spin"))
    k = lambda e: F.sqrt(S.wave_number_squared(e, F.col("awr")))
    groups = rows.select("gid", *own).distinct()
    points = energies.select("za", "e").distinct()
    left = points.join(groups.where("e_low IS NULL"), "za")
    if "e_low" in has:
        ranges = groups.where("e_low IS NOT NULL").select("za", F.col("e_low").alias("lo"), F.col("e_high").alias("hi")).distinct()
        held = in_ranges(points, ranges).withColumnRenamed("za", "r_za").join(groups, (F.col("za") == F.col("r_za")) & (F.col("e_low") == F.col("lo")) & (F.col("e_high") == F.col("hi")))
        left = left.unionByName(held.select(left.columns))
    if radii is not None:
        left, rows = _with_radii(left, radii, "e"), _with_radii(rows, radii, "er")
    left = left.select("za", "e", "gid", "l", S.pi_over_k2_barns(F.col("e"), F.col("awr")).alias("pk"), S.phase_shift(F.col("l"), k(F.col("e")) * F.col("phase_radius")).alias("phi"), S.penetrability(F.col("l"), k(F.col("e")) * F.col("radius")).alias("p"))
    rho_r = k(F.abs("er")) * F.col("radius")
    right = rows.withColumn("pr", S.penetrability(F.col("l"), rho_r))
    right = right.select("gid", F.round("j", 9).alias("j"), S.statistical_weight(F.col("j"), F.col("spin")).alias("g"), "er", "gn", "gg", "gfa", "gfb", (F.abs("gfa") + F.abs("gfb")).alias("gf"), "pr", (F.abs("gn") / F.sqrt(F.abs("er")) / F.col("pr")).alias("gnr"))
    return left, right


_ENERGY, _RESONANCE = ["pk", "phi", "p"], ["g", "er", "gn", "gg", "gfa", "gfb", "gf", "pr", "gnr"]


def _pair_sums(sides: tuple[DataFrame, DataFrame], terms: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], list[np.ndarray]], names: list[str]) -> DataFrame:
    """gid, za, e, j, unit (pk g), phi, p, l and, for each energy and j, the sums of terms over resonances.

    terms gives matrices (energies, resonances) from columns of energies and rows of resonances. Each isotope's
    energies and resonances are dealt into blocks by a hash; each block of the ones meets each of the others in a
    group of its own, as array products. Equal resonances are one row with their number."""
    left, right = sides
    sums = ", ".join(f"{n} double" for n in names)

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(F.col("gid").alias(f"{name}_gid")).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    sizes = blocks(left, BLOCK_E, "n_e").join(blocks(right, BLOCK_R, "n_r"), F.col("n_e_gid") == F.col("n_r_gid"))
    left, right = (x.join(sizes, F.col("gid") == F.col("n_e_gid")) for x in (left, right.groupBy(right.columns).agg(F.count("*").cast("double").alias("times"))))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.select("gid", part("n_e", "e").alias("b_e"), each("n_r").alias("b_r"), "za", "e", "l", *_ENERGY)
    right = right.select(F.col("gid").alias("r_gid"), each("n_e").alias("r_e"), part("n_r", "j", *_RESONANCE).alias("r_r"), "j", "times", *_RESONANCE)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("j")
        own = {c: y.column(c).to_numpy() for c in ("j", "times", *_RESONANCE)}
        starts = np.flatnonzero(np.append(True, own["j"][1:] != own["j"][:-1])) if y.num_rows else np.zeros(0, int)
        js, m = own["j"][starts], len(x) * len(starts)
        found = np.zeros((len(x), len(starts), len(names)))
        # a resonance with a missing number adds nothing
        whole = ~np.any([np.isnan(own[c]) for c in _RESONANCE], axis=0)
        times = np.where(whole, own["times"], 0.0)
        res = {c: np.where(whole, own[c], 1.0) for c in _RESONANCE} | {"g": own["g"]}
        at = {c: x.column(c).to_numpy()[:, None] for c in ("e", *_ENERGY)}
        step = max(1, BLOCK_PAIRS // max(1, y.num_rows))
        for a in range(0, len(x) if m else 0, step):
            for k, t in enumerate(terms({c: v[a : a + step] for c, v in at.items()}, res)):
                found[a : a + step, :, k] = np.add.reduceat(t * times, starts, axis=1)
        rows = np.repeat(np.arange(len(x)), len(starts))
        out = x.select(["gid", "za", "e", *_ENERGY, "l"]).take(pa.array(rows))
        j, g = np.tile(js, len(x)), np.tile(own["g"][starts], len(x))
        out = pa.table({"gid": out.column("gid"), "za": out.column("za"), "e": out.column("e"), "j": pa.array(j, pa.float64()), "unit": pa.array(out.column("pk").to_numpy() * g), "phi": out.column("phi"), "p": out.column("p"), "l": out.column("l")})
        none = np.isnan(found)
        for k, n in enumerate(names):
            out = out.append_column(n, pa.array(found[:, :, k].ravel(), pa.float64(), mask=none[:, :, k].ravel()))
        return out

    kinds = f"gid long, za {left.schema['za'].dataType.simpleString()}, e double, j double, unit double, phi double, p double, l {left.schema['l'].dataType.simpleString()}, {sums}"
    parts = left.groupBy("gid", "b_e", "b_r").cogroup(right.groupBy("r_gid", "r_e", "r_r")).applyInArrow(run, kinds)
    return parts.groupBy("gid", "za", "e", "j").agg(*[F.first(c).alias(c) for c in ("unit", "phi", "p", "l")], *[F.sum(n).alias(n) for n in names])


def radius_at(points: DataFrame, radii: DataFrame) -> DataFrame:
    """za, e_low, x, y: the radius of points (za, e_low, x) whose range has a table (za, e_low, x, y, law)."""
    return interpolate(points, radii, ["za", "e_low"])


def _with_radii(rows: DataFrame, radii: DataFrame, e: str) -> DataFrame:
    """rows with radius and phase_radius taken from their range's table at |e|, where it has one and they follow it. Ranges without a start are those of tables at 0."""
    at = rows.withColumns({"a_low": F.coalesce("e_low", F.lit(0.0)), "a_x": F.abs(e)})
    found = radius_at(at.select("za", F.col("a_low").alias("e_low"), F.col("a_x").alias("x")).distinct(), radii)
    found = found.select(F.col("za").alias("t_za"), F.col("e_low").alias("t_low"), F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    out = at.join(found, (F.col("za") == F.col("t_za")) & (F.col("a_low") == F.col("t_low")) & (F.col("a_x") == F.col("t_x")), "left")
    follow = lambda c, flag: F.when(F.col(flag) & F.col("t_y").isNotNull(), F.col("t_y")).otherwise(F.col(c))
    return out.withColumns({"radius": follow("radius", "radius_tabled"), "phase_radius": follow("phase_radius", "phase_tabled")}).select(rows.columns)


def _level(at: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distance, neutron width at the energy, total width and denominator of each pair."""
    d, gne = at["e"] - r["er"], r["gnr"] * (np.sqrt(at["e"]) * at["p"])
    tot = gne + (r["gg"] + r["gf"])
    return d, gne, tot, d * d + tot * tot / 4.0


def slbw(energies: DataFrame, res: DataFrame, spin: float = 0.0, radii: DataFrame | None = None) -> DataFrame:
    """za, e and elastic, capture, fission, total of the single-level formulas."""

    def terms(at: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> list[np.ndarray]:
        d, gne, tot, den = _level(at, r)
        s, c = np.sin(at["phi"]), np.cos(at["phi"])
        over = at["pk"] * r["g"] * gne / den
        return [over * r["gg"], over * r["gf"], over * (gne + 2.0 * (2.0 * s * c * d - tot * (s * s)))]

    groups = _pair_sums(_kinematics(energies, res, spin, radii), terms, ["capture", "fission", "peak"])
    s = F.sin("phi")
    return _totals(groups.withColumn("elastic", 4.0 * F.col("unit") * s * s + F.col("peak")))


def mlbw(energies: DataFrame, res: DataFrame, spin: float = 0.0, radii: DataFrame | None = None) -> DataFrame:
    """As slbw, with the elastic part from the coherent sum X = sum gn / (er - e - i tot/2) of each (l, j)."""

    def terms(at: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> list[np.ndarray]:
        d, gne, tot, den = _level(at, r)
        over = gne / den
        return [-over * d, over * tot / 2.0, at["pk"] * r["g"] * over * r["gg"], at["pk"] * r["g"] * over * r["gf"]]

    sums = _pair_sums(_kinematics(energies, res, spin, radii), terms, ["xr", "xi", "capture", "fission"])
    # 1 + i X, turned by exp(-2 i phi)
    ar, ai = 1.0 - F.col("xi"), F.col("xr")
    c, s = F.cos(2.0 * F.col("phi")), F.sin(2.0 * F.col("phi"))
    ur, ui = ar * c + ai * s, ai * c - ar * s
    return _totals(sums.withColumn("elastic", F.col("unit") * ((1.0 - ur) * (1.0 - ur) + ui * ui)))


#: Pairs of channels: the neutron's (0) and two of fission.
_PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def reich_moore(energies: DataFrame, res: DataFrame, spin: float = 0.0, external: DataFrame | None = None, radii: DataFrame | None = None) -> DataFrame:
    """Reich-Moore with a neutron channel and up to two of fission.

    external: background terms (za, l, j, con, lin, quad, s_con, s_lin, e_low, e_up) of functions.scalars.external_r,
    a dimension, added to the neutron channel's R of their (l, j).

    R_ij = sum b_i b_j / (er - e - i gg/2) of each (l, j) are grouped sums; the 3 by 3 systems of
    the groups are then solved in batches. With L = iP for the neutron and i for fission,
    A = (1/L - R)**-1 R gives U_nn = exp(-2 i phi) (1 + 2 A_nn) and |U_nf|**2 = 4 |A_nf|**2 / P;
    capture is what is left of the total. A singular system gives zeros."""
    root = lambda w, per: np.sign(w) * np.sqrt(np.abs(w) / per)

    def terms(at: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> list[np.ndarray]:
        b = root(r["gn"], 2.0 * r["pr"]), root(r["gfa"], 2.0), root(r["gfb"], 2.0)
        d, half = at["e"] - r["er"], r["gg"] / 2.0
        den = d * d + half * half
        return [b[i] * b[j] * x for x in (-d / den, half / den) for i, j in _PAIRS]

    names = [f"{part}{i}{j}" for part in ("re", "im") for i, j in _PAIRS]
    sums = _pair_sums(_kinematics(energies, res, spin, radii), terms, names)
    sums = sums.withColumns({"re": F.array(*names[:6]), "im": F.array(*names[6:])})
    if external is not None:
        terms = ["con", "lin", "quad", "s_con", "s_lin", "e_low", "e_up"]
        x = external.select(F.col("za").alias("x_za"), F.col("l").alias("x_l"), F.round(F.abs("j"), 9).alias("x_j"), F.struct(*terms).alias("x"))
        sums = sums.join(x, (F.col("za") == F.col("x_za")) & (F.col("l") == F.col("x_l")) & (F.col("j") == F.col("x_j")), "left")
        more = F.when(F.col("x").isNotNull(), S.external_r(F.col("e"), F.col("x"))).otherwise(0.0)
        sums = sums.withColumn("re", F.transform("re", lambda v, k: F.when(k == 0, v + more).otherwise(v)))
    solved = sums.select("za", "e", "unit", "phi", "p", "re", "im").mapInArrow(_solve_channels, "za string, e double, elastic double, capture double, fission double")
    return _totals(solved)


def _solve_channels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        unit, phi, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "phi", "p"))
        r6 = b.column("re").flatten().to_numpy().reshape(-1, 6) + 1j * b.column("im").flatten().to_numpy().reshape(-1, 6)
        r = np.empty((len(unit), 3, 3), complex)
        for k, (i, j) in enumerate(_PAIRS):
            r[:, i, j] = r[:, j, i] = r6[:, k]
        open_ = p > 1e-300
        y = -r
        y[:, 0, 0] += np.where(open_, -1j / np.where(open_, p, 1.0), 1.0)
        y[:, 1, 1] -= 1j
        y[:, 2, 2] -= 1j
        fine = open_ & (np.abs(np.linalg.det(y)) > 1e-300)
        y[~fine] = np.eye(3)
        a = np.linalg.solve(y, r)
        u = np.exp(-2j * phi) * (1.0 + 2.0 * a[:, 0, 0])
        ok = np.where(fine, unit, 0.0)
        elastic, total = ok * np.abs(1.0 - u) ** 2, 2.0 * ok * (1.0 - u.real)
        fission = ok * 4.0 * (np.abs(a[:, 0, 1:]) ** 2).sum(1) / np.where(open_, p, 1.0)
        yield pa.RecordBatch.from_arrays([b.column("za"), b.column("e"), pa.array(elastic), pa.array(total - elastic - fission), pa.array(fission)], names=["za", "e", "elastic", "capture", "fission"])


def _totals(groups: DataFrame) -> DataFrame:
    out = groups.groupBy("za", "e").agg(F.sum("elastic").alias("elastic"), F.sum("capture").alias("capture"), F.sum("fission").alias("fission"))
    return out.withColumn("total", F.col("elastic") + F.col("capture") + F.col("fission"))


def unresolved(energies: DataFrame, table: DataFrame, radii: DataFrame | None = None) -> DataFrame:
    """za, e, elastic, capture, fission, total from tables of averages, within their ranges.

    table: za, awr, spin, radius (fm), e_low, e_high, l, j, law, reduced, and points x (energy) with
    spacing, gx, gn, gg, gf. Of each (za, range, l, j) the points are interpolated by the law, clamped
    at the ends; one point holds everywhere. reduced: gn is a reduced width, to be multiplied by 2 P.
    radii: tables (za, e_low, x, y, law) of the radius by energy, in place of radius.
    Each energy meets the one interval of each (l, j) that holds it, dealt by its range and a salt of (l, j), so no row
    holds more than a point, however many (l, j) a range has; gx is in the total alone."""
    key = ["za", "e_low", "e_high"]
    values = ["spacing", "gx", "gn", "gg", "gf"]
    e = F.col("e")
    held = in_intervals(energies.select("za", "e").distinct(), table.select(key).distinct(), "za", "e", "e_low", "e_high", both_ends=True)
    # a point of a (l, j) holds from its own energy to the next one's, the first from below it too
    own = W.partitionBy(*key, "l", "j").orderBy("x", "_row")
    points = table.where("x IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    points = points.withColumns({"up": F.lead(F.struct("x", *values)).over(own), "_first": F.row_number().over(own) == 1, "salt": F.pmod(F.xxhash64("l", "j"), F.lit(SALTS)).cast("int")})
    near = held.select(*[F.col(c).alias(f"h_{c}") for c in key], "e", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("h_salt"))
    same = F.col("salt") == F.col("h_salt")
    for c in key:
        same &= F.col(c) == F.col(f"h_{c}")
    found = points.join(near.hint("shuffle_hash"), same & ((e >= F.col("x")) | F.col("_first")) & (F.col("up").isNull() | (e < F.col("up.x"))))
    up = F.col("up")
    at = {v: law_value(e, F.col("x"), F.col(v), up["x"], up[v], F.col("law")) for v in values}
    rows = found.select("za", "e", "e_low", "radius", "awr", "spin", "l", "j", "reduced", *[c.alias(v) for v, c in at.items()])
    if radii is not None:
        here = radius_at(rows.select("za", "e_low", e.alias("x")).distinct(), radii).select(F.col("za").alias("t_za"), F.col("e_low").alias("t_low"), F.col("x").alias("t_x"), "y")
        rows = rows.join(here, (F.col("za") == F.col("t_za")) & (F.col("e_low") == F.col("t_low")) & (e == F.col("t_x")), "left").withColumn("radius", F.coalesce("y", "radius"))
    rho = F.sqrt(S.wave_number_squared(e, F.col("awr"))) * F.col("radius")
    rows = rows.withColumn("gn", F.when(F.col("reduced"), 2.0 * S.penetrability(F.col("l"), rho) * F.col("gn")).otherwise(F.col("gn")))
    tot = F.col("gn") + F.col("gg") + F.col("gf") + F.col("gx")
    good = (F.col("spacing") > 0) & (F.col("gn") > 0) & (tot > 0) & (F.col("awr") > 0)
    pre = S.pi_over_k2_barns(e, F.col("awr")) * S.statistical_weight(F.col("j"), F.col("spin")) * 2.0 * F.pi() * F.col("gn") / F.when(good, F.col("spacing")) / F.when(good, tot)
    part = lambda v: F.coalesce(F.sum(F.when(good, pre * F.col(v))), F.lit(0.0))
    ranges = rows.groupBy("za", "e", "e_low").agg(part("gn").alias("el"), part("gg").alias("capture"), part("gf").alias("fission"), part("gx").alias("other"), F.first(4.0 * F.pi() * F.col("radius") * F.col("radius") / 100.0).alias("pot"))
    out = ranges.groupBy("za", "e").agg(F.sum(F.col("el") + F.col("pot")).alias("elastic"), F.sum("capture").alias("capture"), F.sum("fission").alias("fission"), F.sum("other").alias("other"))
    return out.select("za", "e", "elastic", "capture", "fission", (F.col("elastic") + F.col("capture") + F.col("fission") + F.col("other")).alias("total"))


def apply_matrix(matrix: DataFrame, spectra: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, i, value: sums of w over (i, j, w) and (by, j, value); by names the spectrum if there are several."""
    return matrix.join(spectra, "j").groupBy(*(by or []), "i").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


# -- goodness of fit: long tables with the cell's data and model -------------------------------


def chi_square(cells: DataFrame, by: list[str], n_params: int = 1) -> DataFrame:
    """by, chi2, dof, chi2_r: cells (data, sigma, model, active); a sigma that is not finite and positive weighs 1e-30; inactive cells are left out."""
    s = F.col("sigma")
    w = F.when(~F.isnan(s) & (s > 0) & (s < float("inf")), 1.0 / (s * s)).otherwise(1e-30)
    r = F.col("data") - F.col("model")
    out = cells.groupBy(*by).agg(F.sum(F.when(F.col("active"), w * r * r)).alias("chi2"), (F.count_if("active") - n_params).alias("dof"))
    return out.withColumn("chi2_r", F.when(F.col("dof") > 0, F.col("chi2") / F.col("dof")).otherwise(float("nan")))


def pearson(cells: DataFrame, by: list[str], n_params: int = 1) -> DataFrame:
    r = F.col("data") - F.col("model")
    out = cells.groupBy(*by).agg(F.sum(r * r / F.greatest(F.col("sigma") * F.col("sigma"), F.lit(1e-30))).alias("chi2"), F.greatest(F.count("*") - n_params, F.lit(1)).alias("dof"))
    return out.withColumn("chi2_r", F.col("chi2") / F.col("dof"))


def counts_statistics(cells: DataFrame, by: list[str], c: float) -> DataFrame:
    """by and, for cells (s, o, t): the joint-Poisson deviance, the Poisson likelihood of s under the profiled flux, and gradient and Fisher sums for a scale of t."""
    s, o, t = F.col("s"), F.col("o"), F.col("t")
    lam = S.profile_lambda(s, o, t, c)
    return cells.groupBy(*by).agg(
        F.sum(S.binomial_deviance(s, o, t, c)).alias("deviance"),
        F.sum(S.poisson_nll(s, lam * t)).alias("nll"),
        F.sum(S.deviance_slope(s, o, t, c) * t).alias("gradient"),
        F.sum(S.deviance_curvature(s, o, t, c) * t * t).alias("fisher"),
    )


def residuals(cells: DataFrame, by: list[str]) -> DataFrame:
    r = F.col("data") - F.col("model")
    r = F.when(~F.isnan(r) & (F.abs(r) < float("inf")), r)
    return cells.groupBy(*by).agg(F.sqrt(F.avg(r * r)).alias("rms"), F.max(F.abs(r)).alias("max_abs"), F.count(r).alias("n"))


def validation(pairs: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Mean and greatest relative error (absolute where the reference is below 1e-6), how many exceed the tolerance, and the energy of the worst."""
    big = F.abs("reference") > 1e-6
    err = F.when(big, F.abs(F.col("value") - F.col("reference")) / F.when(big, F.abs("reference")).otherwise(1.0)).otherwise(F.abs(F.col("value") - F.col("reference")))
    rows = pairs.withColumn("err", err)
    return rows.groupBy(*by).agg(F.avg("err").alias("mean_error"), F.max("err").alias("max_error"), F.count_if(F.col("err") > tolerance).alias("n_above"), F.max(F.struct(F.col("err"), -F.col("energy"))).alias("w")).select(*by, "mean_error", "max_error", "n_above", (-F.col("w.col2")).alias("worst_energy"))


# -- detectability -----------------------------------------------------------------------------


def detectability(matrix: DataFrame, traces: DataFrame, density: float, i0: float) -> DataFrame:
    """Per candidate, ranked: matrix (i, energy, sigma_n: sum n sigma), traces (iso, ordinal, i, sigma).

    dT = T - T exp(-density sigma); the peak energy is where |dT| is greatest (the last of equals), peak_snr
    the greatest |dT| / sqrt(max(T, 1e-15) / i0); NaN is no maximum. opaque: share of bins with T < 1e-15."""
    base = matrix.withColumn("t", F.exp(-F.col("sigma_n")))
    rows = traces.join(base, "i")
    dt = F.abs(F.col("t") * (1.0 - F.exp(-density * F.col("sigma"))))
    snr = dt / F.sqrt(F.greatest(F.col("t"), F.lit(K.OPAQUE)) / i0)
    out = rows.select("iso", "ordinal", "i", "energy", "t", dt.alias("dt"), snr.alias("snr")).groupBy("iso", "ordinal").agg(
        F.max(F.struct("dt", "i", "energy")).alias("peak"), F.greatest(F.max(F.when(~F.isnan("snr"), F.col("snr"))), F.lit(0.0)).alias("peak_snr"), F.avg((F.col("t") < K.OPAQUE).cast("double")).alias("opaque")
    )
    ranked = out.select("iso", "ordinal", F.col("peak.dt").alias("peak_dt"), F.col("peak.energy").alias("peak_energy"), "peak_snr", "opaque")
    return numbered(ranked, [F.desc("peak_snr"), F.col("ordinal")]).withColumn("rank", F.col("rank").cast("int"))
