"""Scalar functions of the data model as column expressions: they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tofcube import constants as K


def safe_div(num: Column, den: Column, other: float = 0.0) -> Column:
    """num / den, and `other` where den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(other))


# -- time of flight and energy ---------------------------------------------------------


def tof_to_energy(t_us: Column, flight_m: float) -> Column:
    speed = flight_m / (t_us * 1e-6)
    return 0.5 * K.NEUTRON_MASS_KG * speed * speed / K.CHARGE_C


def energy_to_tof(energy_ev: Column, flight_m: float) -> Column:
    return F.lit(flight_m) / F.sqrt(2.0 * energy_ev * K.CHARGE_C / K.NEUTRON_MASS_KG) * 1e6


def wavelength(energy_ev: Column) -> Column:
    return F.lit(K.WAVELENGTH_FACTOR) / F.sqrt(energy_ev)


# -- counts to transmission --------------------------------------------------------------


def transmission(sample: Column, beam: Column, ratio: float = 1.0) -> Column:
    return F.when(beam > 0, sample / beam * ratio).otherwise(0.0)


def transmission_sigma(sample: Column, beam: Column, ratio: float = 1.0) -> Column:
    """Absolute uncertainty with half a count for an empty sample; infinite without open beam."""
    eff = F.when(sample > 0, sample).otherwise(0.5)
    return F.when(beam > 0, F.sqrt((ratio / beam) * (ratio / beam) * (eff + sample * sample / beam))).otherwise(float("inf"))


def counts_transmission_sigma(sample: Column, beam: Column) -> Column:
    """The uncertainty that fits of raw counts use: sentinels instead of infinities."""
    return F.when(beam <= 0, 1e30).when(sample <= 0, 1e10).otherwise(F.sqrt(F.greatest(sample, F.lit(1.0))) / F.greatest(beam, F.lit(1e-10)))


# -- models --------------------------------------------------------------------------------


def beer_lambert(sigma: Column, density: Column | float) -> Column:
    return F.exp(-(density * sigma))


def inverse_root(energy: Column) -> Column:
    return F.when(F.sqrt(energy) > 0, 1.0 / F.sqrt(energy)).otherwise(0.0)


def background(t: Column, energy: Column, a: float = 1.0, b_a: float = 0.0, b_b: float = 0.0, b_c: float = 0.0, b_d: float | None = None, b_f: float = 0.0) -> Column:
    """a T + b_a + b_b / sqrt(E) + b_c sqrt(E), and b_d exp(-b_f / sqrt(E)) if b_d is given."""
    out = a * t + b_a + b_b * inverse_root(energy) + b_c * F.sqrt(energy)
    return out if b_d is None else out + b_d * F.exp(-b_f * inverse_root(energy))


def poisson_nll(y: Column, mu: Column, eps: float = K.POISSON_FLOOR) -> Column:
    """mu - y ln(mu); below eps its quadratic continuation."""
    d = mu - eps
    curve = F.greatest(y / (eps * eps), F.lit(1.0 / eps))
    low = eps - y * F.ln(F.lit(eps)) + (1.0 - y / eps) * d + 0.5 * curve * d * d
    return F.when(mu > eps, mu - F.when(y > 0, y * F.ln(mu)).otherwise(0.0)).otherwise(low)


def poisson_weight(y: Column, mu: Column, eps: float = K.POISSON_FLOOR) -> Column:
    """Derivative of poisson_nll by mu: 1 - y / mu, and that of the continuation below eps."""
    curve = F.greatest(y / (eps * eps), F.lit(1.0 / eps))
    return F.when(mu > eps, 1.0 - y / F.when(mu > eps, mu).otherwise(1.0)).otherwise(1.0 - y / eps + curve * (mu - eps))


def poisson_curvature(y: Column, mu: Column, eps: float = K.POISSON_FLOOR) -> Column:
    """Second derivative of poisson_nll by mu."""
    safe = F.when(mu > eps, mu).otherwise(1.0)
    return F.when(mu > eps, y / (safe * safe)).otherwise(F.greatest(y / (eps * eps), F.lit(1.0 / eps)))


def counts_model(flux: Column, t: Column, background: Column, alpha_flux: float = 1.0, alpha_background: float = 1.0) -> Column:
    """Expected counts: alpha_flux flux T + alpha_background B."""
    return alpha_flux * flux * t + alpha_background * background


def likelihood_background(t: Column, energy: Column, b0: float, b1: float) -> Column:
    """T + b0 + b1 / sqrt(E)."""
    return t + b0 + b1 * inverse_root(energy)


def profile_lambda(s: Column, o: Column, t: Column, c: float) -> Column:
    den = 1.0 + c * t
    return F.when(den > 1e-10, c * (o + s) / den).otherwise(0.0)


def _xlogy(x: Column, ratio: Column) -> Column:
    return F.when(x > 0, x * F.ln(ratio)).otherwise(0.0)


def binomial_deviance(s: Column, o: Column, t: Column, c: float) -> Column:
    """Joint-Poisson deviance of one bin after profiling the flux out."""
    t = F.greatest(t, F.lit(1e-10))
    n, ct = s + o, c * t
    return F.when(n > 0, 2.0 * (_xlogy(s, s * (1.0 + ct) / (n * ct)) + _xlogy(o, o * (1.0 + ct) / n))).otherwise(0.0)


def deviance_slope(s: Column, o: Column, t: Column, c: float) -> Column:
    t = F.greatest(t, F.lit(1e-10))
    return -2.0 * (s - o * c * t) / (t * (1.0 + c * t))


def deviance_curvature(s: Column, o: Column, t: Column, c: float) -> Column:
    t = F.greatest(t, F.lit(1e-10))
    return 2.0 * (s + o) * c / (t * (1.0 + c * t) * (1.0 + c * t))


# -- nuclear kinematics ----------------------------------------------------------------------


def wave_number_squared(energy: Column, awr: Column) -> Column:
    """k**2 in 1/fm**2: 2 m (A / (1 + A))**2 E / (hbar c)**2; 0 for no energy."""
    hbar_c = K.HBAR_EV_S * K.LIGHT_M_S * 1e15  # eV fm
    a = awr / (1.0 + awr)
    return F.when(energy > 0, 2.0 * K.NEUTRON_REST_MEV * 1e6 * a * a * energy / (hbar_c * hbar_c)).otherwise(0.0)


def pi_over_k2_barns(energy: Column, awr: Column) -> Column:
    return F.pi() / wave_number_squared(F.greatest(energy, F.lit(1e-20)), awr) / 100.0


def statistical_weight(j: Column, spin: Column) -> Column:
    return (2.0 * F.abs(j) + 1.0) / ((2.0 * spin + 1.0) * 2.0)


def lab_to_cm(energy: Column, awr: Column) -> Column:
    return energy * awr / (1.0 + awr)


def scattering_radius(tabulated: Column, constant: Column) -> Column:
    """The radius at an energy: interpolated from the range's table if it has one, else the constant."""
    return F.coalesce(tabulated, constant)


def channel_radius_fm(awr: Column) -> Column:
    return (0.123 * F.cbrt(awr) + 0.08) * 10.0


def _higher(l: Column, rho: Column) -> Column:  # noqa: E741
    """struct(p, s, phi) by the recurrence from l = 0: with q = (l - s)**2 + p**2 of the step before, p r**2 / q,
    r**2 (l - s) / q - l, and phi less the angle of (l - s, p)."""
    first = F.struct(rho.alias("p"), F.lit(0.0).alias("s"), rho.alias("phi"))

    def step(a: Column, k: Column) -> Column:
        u = k - a["s"]
        q = rho * rho / (u * u + a["p"] * a["p"])
        return F.struct((a["p"] * q).alias("p"), (u * q - k).alias("s"), (a["phi"] - F.atan2(a["p"], u)).alias("phi"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), l.cast("int")), lambda k: k.cast("double")), first, step)


def penetrability(l: Column, rho: Column) -> Column:  # noqa: E741
    """Closed forms for l from 0 to 4, the recurrence beyond."""
    r2 = rho * rho
    r4, r6, r8 = r2 * r2, r2 * r2 * r2, r2 * r2 * r2 * r2
    return (
        F.when(l == 0, rho)
        .when(l == 1, rho * r2 / (1.0 + r2))
        .when(l == 2, rho * r4 / (9.0 + 3.0 * r2 + r4))
        .when(l == 3, rho * r6 / (225.0 + 45.0 * r2 + 6.0 * r4 + r6))
        .when(l == 4, rho * r8 / (11025.0 + 1575.0 * r2 + 135.0 * r4 + 10.0 * r6 + r8))
        .when(l > 4, _higher(l, rho)["p"])
    )


def shift_factor(l: Column, rho: Column) -> Column:  # noqa: E741
    r2 = rho * rho
    r4, r6, r8 = r2 * r2, r2 * r2 * r2, r2 * r2 * r2 * r2
    return (
        F.when(l == 0, 0.0)
        .when(l == 1, -1.0 / (1.0 + r2))
        .when(l == 2, -(18.0 + 3.0 * r2) / (9.0 + 3.0 * r2 + r4))
        .when(l == 3, -(675.0 + 90.0 * r2 + 6.0 * r4) / (225.0 + 45.0 * r2 + 6.0 * r4 + r6))
        .when(l == 4, -(44100.0 + 4725.0 * r2 + 270.0 * r4 + 10.0 * r6) / (11025.0 + 1575.0 * r2 + 135.0 * r4 + 10.0 * r6 + r8))
        .when(l > 4, _higher(l, rho)["s"])
    )


def penetrability_slope(l: Column, rho: Column) -> Column:  # noqa: E741
    """Derivative of the penetrability by rho. P = rho / (F**2 + G**2) and S = rho / 2 times the logarithmic slope of F**2 + G**2, so it is P (1 - 2 S) / rho."""
    p, s = penetrability(l, rho), shift_factor(l, rho)
    return F.when(rho > 0, p * (1.0 - 2.0 * s) / rho).otherwise(0.0)


def phase_shift(l: Column, rho: Column) -> Column:  # noqa: E741
    r2 = rho * rho
    return (
        F.when(l == 0, rho)
        .when(l == 1, rho - F.atan(rho))
        .when(l == 2, rho - F.atan(3.0 * rho / (3.0 - r2)))
        .when(l == 3, rho - F.atan(rho * (15.0 - r2) / (15.0 - 6.0 * r2)))
        .when(l == 4, rho - F.atan(rho * (105.0 - 10.0 * r2) / (105.0 - 45.0 * r2 + r2 * r2)))
        .when(l > 4, _higher(l, rho)["phi"])
    )


def external_r(e: Column, r: Column) -> Column:
    """Background R at e from a struct (con, lin, quad, s_con, s_lin, e_low, e_up): the logarithm only where both of its distances are positive."""
    up, low = r["e_up"] - e, e - r["e_low"]
    base = r["con"] + r["lin"] * e + r["quad"] * e * e
    both = (up > 0) & (low > 0)
    log = F.ln(F.when(both, up).otherwise(1.0) / F.when(both, low).otherwise(1.0))
    return base + F.when(both, -(r["s_con"] + r["s_lin"] * e) * log).otherwise(0.0) + r["s_lin"] * (r["e_up"] - r["e_low"])


# -- widths ------------------------------------------------------------------------------------


def doppler_width(energy: Column, temperature: float, awr: float) -> Column:
    return F.sqrt(F.lit(4.0 * K.BOLTZMANN_EV_K * temperature / awr) * energy)


def gaussian_width(energy: Column, flight_m: float, dt_us: float, dl_m: float) -> Column:
    time = 2.0 * dt_us * F.pow(energy, F.lit(1.5)) / (K.TOF_FACTOR * flight_m)
    path = 2.0 * dl_m * energy / flight_m
    return F.sqrt(time * time + path * path)


def exp_width(energy: Column, flight_m: float, de_us: float) -> Column:
    return 2.0 * de_us * F.pow(energy, F.lit(1.5)) / (K.TOF_FACTOR * flight_m)


# -- text numbers ----------------------------------------------------------------------------------


def endf_float(field: Column) -> Column:
    """A fixed-width float whose exponent may lack its letter: 1.234567+2. Blank is 0."""
    f = F.regexp_replace(F.regexp_replace(field, " ", ""), r"(?i)d", "E")
    f = F.regexp_replace(f, r"([0-9.])([+-][0-9]+)$", "$1E$2")
    return F.when(f == "", 0.0).when(f.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), f.cast("double"))


def glob_regex(pattern: str) -> str:
    """* and ?, whole name, any case, as a regular expression."""
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
