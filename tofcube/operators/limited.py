"""R-matrix limited cross sections: any channels, closed ones and charged ones too.

Spin groups are a dimension: channels and resonances of each are one row of nested arrays, as
large as an evaluation. Energies are the long side; each meets the spin groups of its isotope's
ranges, a salted co-group deals the pairs over the cluster, and a task solves the small complex
systems of its energies together. Contributions of groups are summed per energy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tofcube import constants as K

#: Fine-structure constant, and kinds of channels by reaction number. Fixed values.
ALPHA = 1.0 / 137.035999084
ENTRANCE, FISSION, CAPTURE = 2, 18, 102
SALTS = 16
CHANNEL = "array<struct<ma:double,mb:double,za:double,zb:double,q:double,shf:int,mt:int,l:int,bnd:double,ape:double,apt:double>>"
GROUPS = f"za string, e_low double, e_high double, grp int, awr double, spin double, j double, krm int, channels {CHANNEL}, resonances array<struct<er:double,gg:double,widths:array<double>>>"


def wave_number(e_cm: np.ndarray, reduced: float) -> np.ndarray:
    """1/fm, of the energy in the centre of mass (eV) and a reduced mass in neutron masses."""
    hbar_c = K.HBAR_EV_S * K.LIGHT_M_S * 1e15
    return np.sqrt(np.maximum(2.0 * K.NEUTRON_REST_MEV * 1e6 * reduced * e_cm, 0.0)) / hbar_c


def hard_sphere(l: int, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """Penetrability, shift and phase by the recurrence from l = 0."""
    p, s, phi = rho.astype(float), np.zeros_like(rho, float), rho.astype(float)
    for k in range(1, l + 1):
        u = k - s
        q = u * u + p * p
        phi = phi - np.arctan2(p, u)
        p, s = rho * rho * p / q, rho * rho * u / q - k
    return p, s, phi


def closed_shift(l: int, kappa: np.ndarray) -> np.ndarray:  # noqa: E741
    """The shift continued to imaginary rho: the recurrence in the squares, with rho**2 = -kappa**2."""
    r2 = -kappa * kappa
    p2, s = r2.astype(float), np.zeros_like(kappa, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, l + 1):
            u = k - s
            q = u * u + p2
            p2, s = r2 * r2 * p2 / (q * q), r2 * u / q - k
    return s


def sommerfeld(za: float, zb: float, reduced: float, e_cm: np.ndarray) -> np.ndarray:
    if not za or not zb:
        return np.zeros_like(e_cm)
    return za * zb * ALPHA * np.sqrt(K.NEUTRON_REST_MEV * 1e6 * reduced / (2.0 * np.where(e_cm > 0, e_cm, np.inf)))


def coulomb(l: int, eta: np.ndarray, rho: np.ndarray, steps: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """F, G and their derivatives by rho, elementwise.

    Far outside the turning point the continued fraction of H+ gives p + iq = (G' + iF') / (G + iF);
    from there G is carried inwards, the way in which it grows, by the differential equation
    w'' = (2 eta / rho + l (l + 1) / rho**2 - 1) w. F follows from its logarithmic slope, a
    continued fraction at rho itself, and the Wronskian F' G - F G' = 1."""
    eta, rho = np.broadcast_arrays(np.asarray(eta, float), np.asarray(rho, float))
    turn = eta + np.sqrt(eta * eta + l * (l + 1))
    far = np.maximum(rho, 2.0 * np.abs(turn) + 30.0)

    def outgoing(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = (1j * eta - l) * (1j * eta + l + 1.0)
        b = 2.0 * (x - eta + 1j)
        d = 1.0 / b
        h = step = a * d
        for k in range(1, 400):
            a = a + 2.0 * (k + 1j * eta)
            b = b + 2j
            d = 1.0 / (b + a * d)
            step = step * (b * d - 1.0)
            h = h + step
            if (np.abs(step) <= 1e-15 * np.abs(h)).all():
                break
        pq = 1j * (1.0 - eta / x) + 1j * h / x
        return pq.real, pq.imag

    def slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """F'/F and the sign of F, by the continued fraction in l."""
        tiny = 1e-30
        s = lambda k: k / x + eta / k
        f = s(l + 1.0)
        f = np.where(f == 0, tiny, f)
        c, d, sign = f.copy(), np.zeros_like(f), np.ones_like(f)
        for k in range(1, 20000):
            n = l + float(k)
            a = -(1.0 + (eta / n) ** 2)
            b = s(n) + s(n + 1.0)
            d = b + a * d
            d = 1.0 / np.where(d == 0, tiny, d)
            c = b + a / c
            c = np.where(c == 0, tiny, c)
            sign = np.where(d < 0, -sign, sign)
            f = f * c * d
            if (np.abs(c * d - 1.0) < 1e-15).all():
                break
        return f, sign

    p, q = outgoing(far)
    f, sign = slope(far)
    scale = sign * np.sqrt(q / ((f - p) ** 2 + q * q))
    g = (f - p) * scale / q
    dg = p * g - q * scale
    # fourth-order steps, equal in each element's own range
    h = (rho - far) / steps
    acc = lambda x, w: (2.0 * eta / x + l * (l + 1) / (x * x) - 1.0) * w
    x = far.copy()
    for _ in range(steps if (h != 0).any() else 0):
        k1, m1 = dg, acc(x, g)
        k2, m2 = dg + h / 2 * m1, acc(x + h / 2, g + h / 2 * k1)
        k3, m3 = dg + h / 2 * m2, acc(x + h / 2, g + h / 2 * k2)
        k4, m4 = dg + h * m3, acc(x + h, g + h * k3)
        g, dg = g + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), dg + h / 6 * (m1 + 2 * m2 + 2 * m3 + m4)
        x = x + h
    f, _ = slope(rho)
    w = 1.0 / (f * g - dg)
    return w, g, f * w, dg


def _channel(c: dict, e_cm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Penetrability, shift, phase of one channel at energies of the entrance pair, and where it is closed."""
    n = len(e_cm)
    if c["ma"] < 0.5:  # a photon
        return np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    reduced = c["ma"] * c["mb"] / (c["ma"] + c["mb"])
    e = e_cm + c["q"]
    shut = e <= 0
    charged = abs(c["za"]) > 0.5 and abs(c["zb"]) > 0.5
    own = np.full(n, float(c["bnd"]))
    p, s, phi = np.zeros(n), own.copy(), np.zeros(n)
    if (~shut).any():
        k = wave_number(e[~shut], reduced)
        if charged:
            eta = sommerfeld(c["za"], c["zb"], reduced, e[~shut])
            f, g, df, dg = coulomb(c["l"], eta, k * c["ape"])
            size = f * f + g * g
            p[~shut], shift = k * c["ape"] / size, k * c["ape"] * (f * df + g * dg) / size
            ft, gt, _, _ = coulomb(c["l"], eta, k * c["apt"])
            phi[~shut] = np.arctan2(ft, gt)
        else:
            p[~shut], shift, _ = hard_sphere(c["l"], k * c["ape"])
            phi[~shut] = hard_sphere(c["l"], k * c["apt"])[2]
        if c["shf"] == 1:
            s[~shut] = shift
    if shut.any() and c["shf"] == 1 and not charged:
        s[shut] = closed_shift(c["l"], wave_number(-e[shut], reduced) * c["ape"])
    return p, s, phi, shut


def spin_group(e: np.ndarray, g: dict) -> np.ndarray:
    """total, elastic, capture, fission (4, energy) of one spin group (a row of GROUPS) at laboratory energies.

    With L = S - B + iP and R = sum w w' / (pole - E), X = sqrt(P) / L (1/L - R)**-1 R sqrt(P) and
    U = exp(-i phi) (1 + 2i X) exp(-i phi). KRM 3 holds formal widths and a capture width in the
    pole, KRM 2 amplitudes. Capture is explicit if a capture channel is given, else (KRM 3) the rest."""
    chans, n = g["channels"], len(e)
    to_cm = g["awr"] / (1.0 + g["awr"])
    p, s, phi, shut = (np.array(x).T for x in zip(*(_channel(c, e * to_cm) for c in chans), strict=True))
    er = np.array([r["er"] for r in g["resonances"]], float)
    w = np.array([r["widths"][: len(chans)] for r in g["resonances"]], float).reshape(-1, len(chans))
    pole = er.astype(complex)
    if g["krm"] == 3:
        pole -= 0.5j * np.array([r["gg"] for r in g["resonances"]], float)
        at = np.array([_channel(c, er * to_cm)[0] for c in chans]).T.reshape(-1, len(chans)) if len(er) else w
        w = np.sign(w) * np.sqrt(np.abs(w) / np.where(at > 0, 2.0 * np.where(at > 0, at, 1.0), 1.0))
    gap = pole - e[:, None]
    gap = np.where(np.abs(gap) < K.QUANTUM_FLOOR, gap + 1j * K.QUANTUM_FLOOR, gap)
    r = np.einsum("er,rc,rd->ecd", 1.0 / gap, w, w, optimize=True)
    ell = s - np.array([c["bnd"] for c in chans]) + 1j * p
    weak = np.abs(ell) ** 2 < 1e-60
    inv = np.where(weak, 1e30, 1.0 / np.where(weak, 1.0, ell))
    y = -r
    d = np.arange(len(chans))
    y[:, d, d] += inv
    fine = np.abs(np.linalg.det(y / np.abs(y).max(axis=(1, 2), keepdims=True))) > 1e-280
    y[~fine] = np.eye(len(chans))
    front = np.where(shut | weak, 0.0, np.sqrt(p) * inv)
    x = front[:, :, None] * np.linalg.solve(y, r) * np.sqrt(p)[:, None, :]
    u = np.exp(-1j * (phi[:, :, None] + phi[:, None, :])) * (np.eye(len(chans)) + 2j * x)
    weight = (2.0 * abs(g["j"]) + 1.0) / (2.0 * (2.0 * g["spin"] + 1.0))
    unit = math.pi / wave_number(np.maximum(e, 1e-20) * to_cm, to_cm) ** 2 / 100.0 * weight * fine
    mts = [c["mt"] for c in chans]
    explicit = CAPTURE in mts
    out = np.zeros((4, n))
    other = np.zeros(n)
    for a, mt in enumerate(mts):
        if mt != ENTRANCE:
            continue
        out[0] += 2.0 * unit * (1.0 - u[:, a, a].real)
        out[1] += unit * np.abs(1.0 - u[:, a, a]) ** 2
        for b, kind in enumerate(mts):
            part = unit * np.abs(u[:, a, b]) ** 2
            if kind == FISSION:
                out[3] += part
            elif kind == CAPTURE:
                out[2] += part
            elif kind != ENTRANCE and chans[b]["ma"] >= 0.5:
                other += part
    if g["krm"] == 3 and not explicit:
        out[2] = np.maximum(out[0] - out[1] - out[3] - other, 0.0)
    return out


def limited(energies: DataFrame, groups: DataFrame) -> DataFrame:
    """za, e, elastic, capture, fission, total from spin groups (GROUPS); other reactions are in the total alone."""
    g = groups.withColumn("gid", F.xxhash64("za", "e_low", "e_high", "grp"))
    near = g.select("gid", "za", "e_low", "e_high")
    left = energies.select("za", "e").distinct().join(near, "za").where(F.col("e").between(F.col("e_low"), F.col("e_high")))
    left = left.select("za", "e", "gid", F.pmod(F.xxhash64("e"), F.lit(SALTS)).cast("int").alias("salt"))
    right = g.select(F.col("gid").alias("r_gid"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt"), "awr", "spin", "j", "krm", "channels", "resonances")

    def solve(e: pa.Table, dims: pa.Table) -> pa.Table:
        names = ["za", "e", "elastic", "capture", "fission", "total"]
        if not e.num_rows or not dims.num_rows:
            return pa.table([pa.array([], pa.string()), *[pa.array([], pa.float64())] * 5], names=names)
        total, elastic, capture, fission = spin_group(e.column("e").to_numpy(), dims.slice(0, 1).to_pylist()[0])
        return pa.table([e.column("za"), e.column("e"), *(pa.array(v) for v in (elastic, capture, fission, total))], names=names)

    parts = left.groupBy("gid", "salt").cogroup(right.groupBy("r_gid", "r_salt")).applyInArrow(solve, "za string, e double, elastic double, capture double, fission double, total double")
    return parts.groupBy("za", "e").agg(*[F.sum(c).alias(c) for c in ("elastic", "capture", "fission", "total")])
