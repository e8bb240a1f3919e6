"""Ocean and atmosphere formulas as Column expressions: Coriolis, winds, waves and the 1980 equation of state of sea water."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

# Turn of the Earth in a sidereal day (1/s), mean radius (m), gravity (m/s2).
OMEGA, EARTH_M, GRAVITY = 2 * math.pi / 86164.0905, 6371008.8, 9.81


def coriolis(lat) -> Column:
    """2 Omega sin(lat), lat in degrees."""
    return F.lit(2 * OMEGA) * F.sin(F.radians(_c(lat)))


def coriolis_beta(lat) -> Column:
    """2 Omega cos(lat) / R."""
    return F.lit(2 * OMEGA / EARTH_M) * F.cos(F.radians(_c(lat)))


def wind_stress(vx, vy, density: float = 1.225, drag: float = 0.0013) -> tuple[Column, Column]:
    """Stress components of a wind: density * drag * v * |v|."""
    vx, vy = _c(vx), _c(vy)
    k = F.lit(density * drag) * F.sqrt(vx * vx + vy * vy)
    return k * vx, k * vy


def gyre_wind(y, length: float, kind: str = "jans", stress: float = 1.0, mix: float = 0.0) -> Column:
    """Zonal stress over a basin of ``length``: "single" -cos(pi y') / pi, "jans" cos(2 pi (y'-1/2)) + 2 sin(pi (y'-1/2)),
    "dijkstra" -(mix cos(pi y') + (1 - mix) cos(2 pi y')), y' = y / length."""
    z = _c(y) / length
    pi = math.pi
    if kind == "single":
        return -stress / pi * F.cos(pi * z)
    if kind == "jans":
        return stress * (F.cos(2 * pi * (z - 0.5)) + 2 * F.sin(pi * (z - 0.5)))
    if kind == "dijkstra":
        return -stress * (mix * F.cos(pi * z) + (1 - mix) * F.cos(2 * pi * z))
    raise ValueError(f"no wind of kind {kind!r}")


def gaussian_bubble(r, sigma: float, amplitude: float = 0.5) -> Column:
    """amplitude * exp(-r2 / 2 sigma2)."""
    r = _c(r)
    return F.lit(amplitude) * F.exp(-r * r / (2 * sigma * sigma))


# ---- waves


class Waves:
    """Dispersion relation of surface waves: omega2(k) and its derivative; depth None is deep water."""

    def __init__(self, depth: float | None = None, shallow: bool = False, tension: float = 0.0, density: float = 1000.0, gravity: float = GRAVITY):
        if shallow and depth is None:
            raise ValueError("shallow water needs a depth")
        self.h, self.shallow, self.g, self.surface = depth, shallow, gravity, tension / density

    def omega2(self, k) -> Column:
        k = _c(k)
        base = self.g * k + (self.surface * F.pow(k, 3) if self.surface else 0.0)
        if self.shallow:
            return base * k * self.h
        return base if self.h is None else base * F.tanh(k * self.h)

    def domega2_dk(self, k) -> Column:
        k = _c(k)
        base = self.g * k + (self.surface * F.pow(k, 3) if self.surface else 0.0)
        slope = F.lit(self.g) + (3 * self.surface * k * k if self.surface else 0.0)
        if self.shallow:
            return (slope * k + base) * self.h
        if self.h is None:
            return slope
        t = F.tanh(k * self.h)
        return slope * t + base * self.h * (1 - t * t)

    def omega(self, k) -> Column:
        return F.sqrt(self.omega2(k))

    def group_velocity(self, k) -> Column:
        return self.domega2_dk(k) / (2 * self.omega(k))

    def phase_velocity(self, k) -> Column:
        return self.omega(k) / _c(k)

    def k_from_omega(self, omega, steps: int = 30) -> Column:
        """Inverse of omega: closed form in deep and shallow water of no tension, else a fixed number of Newton steps
        by SQL's ``aggregate``, which does not copy the expression at each step."""
        omega = _c(omega)
        w2 = omega * omega
        if not self.surface and self.shallow:
            return omega / math.sqrt(self.g * self.h)
        deep = w2 / self.g
        if not self.surface and self.h is None:
            return deep
        # from above the root the relation is monotone; the start is the smaller bound's sum
        start = deep if self.h is None else deep + omega / math.sqrt(self.g * self.h)
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda k, _: F.greatest(k - (self.omega2(k) - w2) / self.domega2_dk(k), k * 0.1))

    @staticmethod
    def k_from_lambda(wave_length) -> Column:
        return F.lit(2 * math.pi) / _c(wave_length)

    def omega_from_phase_velocity(self, speed) -> Column:
        """Deep water without tension: g / c."""
        if self.h is not None or self.surface:
            raise ValueError("only deep water without tension has a single frequency for a phase speed")
        return F.lit(self.g) / _c(speed)


# ---- sea water. Coefficients of Fofonoff & Millard (1983), by power of salinity, then of temperature.
_RHO = {
    0.0: [999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9],
    1.0: [8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9],
    1.5: [-5.72466e-3, 1.0227e-4, -1.6546e-6],
    2.0: [4.8314e-4],
}
_BULK = {
    0.0: [19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5],
    1.0: [54.6746, -0.603459, 1.09987e-2, -6.1670e-5],
    1.5: [7.944e-2, 1.6483e-2, -5.3009e-4],
}
_BULK_A = {0.0: [3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7], 1.0: [2.2838e-3, -1.0981e-5, -1.6078e-6], 1.5: [1.91075e-4]}
_BULK_B = {0.0: [8.50935e-5, -6.12293e-6, 5.2787e-8], 1.0: [-9.9348e-7, 2.0816e-8, 9.1697e-10]}
_HEAT = [
    {
        0.0: [4217.4, -3.720283, 0.1412855, -2.654387e-3, 2.093236e-5],
        1.0: [-7.643575, 0.1072763, -1.38385e-3],
        1.5: [0.1770383, -4.07718e-3, 5.148e-5],
    },
    {
        0.0: [-4.9592e-1, 1.45747e-2, -3.13885e-4, 2.0357e-6, 1.7168e-8],
        1.0: [4.9247e-3, -1.28315e-4, 9.802e-7, 2.5941e-8, -2.9179e-10],
        1.5: [-1.2331e-4, -1.517e-6, 3.122e-8],
    },
    {
        0.0: [2.4931e-4, -1.08645e-5, 2.87533e-7, -4.0027e-9, 2.2956e-11],
        1.0: [-2.9558e-6, 1.17054e-7, -2.3905e-9, 1.8448e-11],
        1.5: [9.971e-8],
    },
    {
        0.0: [-5.422e-8, 2.6380e-9, -6.5637e-11, 6.136e-13],
        1.0: [5.540e-10, -1.7682e-11, 3.513e-13],
        1.5: [0.0, -1.4300e-12],
    },
]
_SOUND = [
    {
        0.0: [1402.388, 5.03711, -5.80852e-2, 3.3420e-4, -1.47800e-6, 3.1464e-9],
        1.0: [1.389, -1.262e-2, 7.164e-5, 2.006e-6, -3.21e-8],
        1.5: [-1.922e-2, -4.42e-5],
        2.0: [1.727e-3],
    },
    {
        0.0: [0.153563, 6.8982e-4, -8.1788e-6, 1.3621e-7, -6.1185e-10],
        1.0: [9.4742e-5, -1.2580e-5, -6.4885e-8, 1.0507e-8, -2.0122e-10],
        1.5: [7.3637e-5, 1.7945e-7],
        2.0: [-7.9836e-6],
    },
    {
        0.0: [3.1260e-5, -1.7107e-6, 2.5974e-8, -2.5335e-10, 1.0405e-12],
        1.0: [-3.9064e-7, 9.1041e-9, -1.6002e-10, 7.988e-12],
    },
    {0.0: [-9.7729e-9, 3.8504e-10, -2.3643e-12], 1.0: [1.100e-10, 6.649e-12, -3.389e-13]},
]
_LAPSE = [
    {0: [3.5803e-5, 8.5258e-6, -6.836e-8, 6.6228e-10], 1: [1.8932e-6, -4.2393e-8]},
    {0: [1.8741e-8, -6.7795e-10, 8.733e-12, -5.4481e-14], 1: [-1.1351e-10, 2.7759e-12]},
    {0: [-4.6206e-13, 1.8676e-14, -2.1687e-16]},
]
_SALT = [0.0080, -0.1692, 25.3851, 14.0941, -7.0261, 2.7081]
_SALT_T = [0.0005, -0.0056, -0.0066, -0.0375, 0.0636, -0.0144]
_RT35 = [0.6766097, 2.00564e-2, 1.104259e-4, -6.9698e-7, 1.0031e-9]


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def _series(table: dict[float, list[float]], s: Column, t: Column) -> Column:
    """Sum over powers p of s of s ** p times a polynomial in t."""
    return sum((_poly(c, t) * F.pow(s, F.lit(float(p))) for p, c in table.items() if p), _poly(table[0], t))


def _by_t(table: dict[float, list[float]]) -> dict[float, list[float]]:
    """The table of the derivative by temperature."""
    return {0: [0.0]} | {p: [k * c for k, c in enumerate(cs)][1:] or [0.0] for p, cs in table.items()}


def _by_s(table: dict[float, list[float]]) -> dict[float, list[float]]:
    """The table of the derivative by salinity."""
    return {0: [0.0]} | {p - 1: [p * c for c in cs] for p, cs in table.items() if p}


def _in_pressure(tables: list[dict], s: Column, t: Column, p: Column) -> Column:
    out = _series(tables[-1], s, t)
    for table in tables[-2::-1]:
        out = out * p + _series(table, s, t)
    return out


def density(s, t, p=0.0) -> Column:
    """kg/m3 from practical salinity, degrees Celsius and dbar."""
    s, t, p = _c(s), _c(t), _c(p) / 10
    return _series(_RHO, s, t) / (1 - p / _in_pressure([_BULK, _BULK_A, _BULK_B], s, t, p))


def _slope(s, t, p, by: Callable[[dict], dict]) -> Column:
    s, t, p = _c(s), _c(t), _c(p) / 10
    rho, bulk = _series(_RHO, s, t), _in_pressure([_BULK, _BULK_A, _BULK_B], s, t, p)
    d_rho, d_bulk = _series(by(_RHO), s, t), _in_pressure([by(x) for x in (_BULK, _BULK_A, _BULK_B)], s, t, p)
    left = 1 - p / bulk
    return d_rho / left - rho * p * d_bulk / (bulk * bulk * left * left)


def density_by_t(s, t, p=0.0) -> Column:
    return _slope(s, t, p, _by_t)


def density_by_s(s, t, p=0.0) -> Column:
    return _slope(s, t, p, _by_s)


def thermal_expansion(s, t, p=0.0) -> Column:
    return -density_by_t(s, t, p) / density(s, t, p)


def haline_contraction(s, t, p=0.0) -> Column:
    return density_by_s(s, t, p) / density(s, t, p)


def sigma(s, t, p=0.0) -> Column:
    return density(s, t, p) - 1000.0


def volume_anomaly(s, t, p=0.0) -> Column:
    """Specific volume less that of salinity 35 and 0 degrees at the same pressure (m3/kg)."""
    return 1 / density(s, t, p) - 1 / density(F.lit(35.0), F.lit(0.0), p)


def heat_capacity(s, t, p=0.0) -> Column:
    """J/(kg K)."""
    return _in_pressure(_HEAT, _c(s), _c(t), _c(p) / 10)


def sound_speed(s, t, p=0.0) -> Column:
    """m/s."""
    return _in_pressure(_SOUND, _c(s), _c(t), _c(p) / 10)


def lapse_rate(s, t, p) -> Column:
    """Adiabatic temperature gradient (K/dbar)."""
    return _in_pressure(_LAPSE, _c(s) - 35.0, _c(t), _c(p))


def potential_temperature(s, t, p, reference=0.0) -> Column:
    """Temperature after an adiabatic move to the reference pressure: four Runge-Kutta stages, each a row of a small
    array that ``aggregate`` walks, so that the expression does not grow with the stages."""
    s, t, p, h = _c(s), _c(t), _c(p), _c(reference) - _c(p)
    # Per stage the share of the pressure step, and the factors of the increment and of the held term.
    stages = [(0.0, 0.5, 0.0, 1.0, 0.0), (0.5, 0.29289322, -0.29289322, 0.58578644, 0.121320344), (0.5, 1.707106781, -1.707106781, 3.414213562, -4.121320344), (1.0, 1 / 6, -1 / 3, 0.0, 0.0)]
    table = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(row, ("at", "k", "q", "qk", "qq"), strict=True)]) for row in stages])

    def step(state: Column, row: Column) -> Column:
        x = h * lapse_rate(s, state["t"], p + row["at"] * h)
        return F.struct((state["t"] + row["k"] * x + row["q"] * state["q"]).alias("t"), (row["qk"] * x + row["qq"] * state["q"]).alias("q"))

    return F.aggregate(table, F.struct(t.cast("double").alias("t"), F.lit(0.0).alias("q")), step)["t"]


def freezing_point(s, p=0.0) -> Column:
    s = _c(s)
    return (-0.0575 + 1.710523e-3 * F.sqrt(s) - 2.154996e-4 * s) * s - 7.53e-4 * _c(p)


def depth(p, lat) -> Column:
    """Metres from dbar and latitude."""
    p, x = _c(p), F.pow(F.sin(F.radians(_c(lat))), 2)
    g = 9.780318 * (1 + (5.2788e-3 + 2.36e-5 * x) * x) + 1.092e-6 * p
    return _poly([9.72659, -2.2512e-5, 2.279e-10, -1.82e-15], p) * p / g


def _salt_of_root(r: Column, t: Column) -> Column:
    d = t - 15.0
    return _poly(_SALT, r) + d / (1 + 0.0162 * d) * _poly(_SALT_T, r)


def salinity(ratio, t, p=0.0) -> Column:
    """Practical salinity from the conductivity ratio to that of salinity 35 at 15 degrees."""
    r, t, p = _c(ratio), _c(t), _c(p)
    pressure = _poly([2.070e-5, -6.370e-10, 3.989e-15], p) * p
    rt = r / (_poly(_RT35, t) * (1 + pressure / (_poly([1.0, 3.426e-2, 4.464e-4], t) + _poly([0.4215, -3.107e-3], t) * r)))
    return _salt_of_root(F.sqrt(F.abs(rt)), t)


def conductivity_ratio(s, t, p=0.0, steps: int = 12) -> Column:
    """Inverse of :func:`salinity`: Newton steps for the root of the ratio, then a quadratic in the ratio itself."""
    s, t, p = _c(s), _c(t), _c(p)
    slope = [k * c for k, c in enumerate(_SALT)][1:]
    slope_t = [k * c for k, c in enumerate(_SALT_T)][1:]
    d = t - 15.0

    def step(r: Column, _: Column) -> Column:
        return r + (s - _salt_of_root(r, t)) / (_poly(slope, r) + d / (1 + 0.0162 * d) * _poly(slope_t, r))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.sqrt(s / 35.0), step)
    rt = _poly(_RT35, t) * root * root
    a, b = _poly([0.4215, -3.107e-3], t), _poly([1.0, 3.426e-2, 4.464e-4], t)
    c = rt * (_poly([2.070e-5, -6.370e-10, 3.989e-15], p) * p + b)
    half = b - a * rt
    return (F.sqrt(F.abs(half * half + 4 * a * c)) - half) / (2 * a)


def linear_density(s, t, rho0=1000.0, t0=10.0, s0=35.0, alpha=2e-4, beta=7.6e-4) -> Column:
    """rho0 (1 - alpha (t - t0) + beta (s - s0))."""
    return F.lit(float(rho0)) * (1 - alpha * (_c(t) - t0) + beta * (_c(s) - s0))


# ---- tropical cyclones

# Factors of the Holland (1980) profile.
BOUNDARY_LAYER, TEN_MINUTES, AMBIENT_PA, AIR_DENSITY = 0.7, 0.88, 101300.0, 1.15


def holland(lat, lon, centre_lat, centre_lon, mslp, vmax, mrd, vx, vy) -> dict[str, Column]:
    """Pressure and wind of a cyclone at a point: Pa, m/s, m; angles in degrees. Keys: pressure, wind_x, wind_y, b, v."""
    from .geo import haversine

    lat, lon, clat, clon, mslp, vmax, mrd, vx, vy = (_c(x) for x in (lat, lon, centre_lat, centre_lon, mslp, vmax, mrd, vx, vy))
    deficit = F.greatest(F.lit(AMBIENT_PA) - mslp, F.lit(100.0))
    v0 = (vmax - F.sqrt(vx * vx + vy * vy)) / BOUNDARY_LAYER
    b = F.least(F.lit(2.5), F.greatest(F.lit(1.0), AIR_DENSITY * math.e * v0 * v0 / deficit))
    r = haversine(clat, clon, lat, lon, EARTH_M)
    r = F.when(r == 0, mrd * 2.220446049250313e-16).otherwise(r)
    x = F.pow(mrd / r, b)
    f = coriolis(clat)
    v = F.sqrt(x * F.exp(1 - x) * v0 * v0 + r * r * f * f / 4) - r * f / 2
    theta = F.atan2(F.radians(lat - clat), F.radians(lon - clon))
    k = F.lit(BOUNDARY_LAYER * TEN_MINUTES)
    moved = v / F.nullif(v0, F.lit(0.0))
    return {
        "pressure": mslp + deficit * F.exp(-x), "b": b, "v": v,
        "wind_x": -v * F.sin(theta) * k + moved * vx, "wind_y": v * F.cos(theta) * k + moved * vy,
    }
