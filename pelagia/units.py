"""Units of columns: algebra while a plan is built, kept as field metadata, conversions as constant factors."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("m", "kg", "s", "K", "rad", "salt")


class UnitError(ValueError):
    """Units that cannot be combined or converted."""


@dataclass(frozen=True)
class Unit:
    """A factor times powers of the base units; a unit of no dimension converts to a plain number."""

    factor: float
    powers: tuple[Fraction, ...]

    def __mul__(self, other: Unit | float) -> Unit:
        if not isinstance(other, Unit):
            return Unit(self.factor * other, self.powers)
        return Unit(self.factor * other.factor, tuple(a + b for a, b in zip(self.powers, other.powers, strict=True)))

    __rmul__ = __mul__

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, n: float) -> Unit:
        return Unit(self.factor**n, tuple(a * Fraction(n) for a in self.powers))

    @property
    def plain(self) -> bool:
        return not any(self.powers)

    def factor_to(self, other: Unit) -> float:
        if self.powers != other.powers:
            raise UnitError(f"{self} and {other} have different dimensions")
        return self.factor / other.factor

    def __str__(self) -> str:
        parts = [b if p == 1 else f"{b}^{p}" for b, p in zip(BASE, self.powers, strict=True) if p]
        return " ".join([repr(self.factor), *parts])

    @staticmethod
    def read(text: str) -> Unit:
        """The unit that :func:`str` wrote."""
        factor, *parts = text.split(" ")
        powers = dict.fromkeys(BASE, Fraction(0))
        for p in parts:
            base, _, n = p.partition("^")
            powers[base] = Fraction(n or 1)
        return Unit(float(factor), tuple(powers.values()))


NONE = Unit(1.0, (Fraction(0),) * len(BASE))
m, kg, s, K, rad, salt = (Unit(1.0, tuple(Fraction(int(b == x)) for x in BASE)) for b in BASE)

# Units of the ocean and atmosphere formats.
km, cm, minute, hour, day = m * 1e3, m * 1e-2, s * 60, s * 3600, s * 86400
deg = rad * 0.017453292519943295
Pa, N = kg / m / s**2, kg * m / s**2
bar, dbar, mbar, hPa = Pa * 1e5, Pa * 1e4, Pa * 1e2, Pa * 1e2
dyne = N * 1e-5
gram = kg * 1e-3
Sverdrup = m**3 / s * 1e6
g_per_kg = salt * 1.0
psu = g_per_kg * (35.16504 / 35)
nautical_mile = m * 1852
knot = nautical_mile / hour
percent, ppb = NONE * 1e-2, NONE * 1e-9
#: Temperature differences and temperatures in these formats are both read without an offset.
Celsius = K
earth_radius = km * 6371.0088

NAMED = {
    "m": m, "cm": cm, "km": km, "s": s, "second": s, "minute": minute, "hour": hour, "day": day, "kg": kg, "g": gram,
    "K": K, "degC": Celsius, "Celsius": Celsius, "rad": rad, "radians": rad, "deg": deg, "degrees": deg, "Pa": Pa,
    "bar": bar, "dbar": dbar, "mbar": mbar, "hPa": hPa, "N": N, "dyne": dyne, "Sv": Sverdrup, "Sverdrup": Sverdrup,
    "g/kg": g_per_kg, "psu": psu, "nm": nautical_mile, "knot": knot, "m/s": m / s, "cm/s": cm / s, "m/s**2": m / s**2,
    "m**2": m**2, "m**2/s": m**2 / s, "m**2/s**2": m**2 / s**2, "kg/m**3": kg / m**3, "kg/m**2": kg / m**2, "kg/kg": NONE,
    "Pa/m": Pa / m, "dyne/cm**2": dyne / cm**2, "1/s": s**-1, "%": percent, "ppb": ppb, "1": NONE, "": NONE,
}


def named(name: str) -> Unit:
    """Unit of a source's unit string; unknown strings raise KeyError."""
    return NAMED[name.strip()]


class Scales:
    """Converter between unit systems: values in units of ``length``, ``mass`` and ``time`` and back."""

    def __init__(self, length: Unit, mass: Unit, time: Unit):
        self.scales = {"m": length.factor, "kg": mass.factor, "s": time.factor}

    def unit(self, like: Unit) -> Unit:
        """The unit of this system with the dimensions of ``like``."""
        factor = 1.0
        for base, p in zip(BASE, like.powers, strict=True):
            factor *= self.scales.get(base, 1.0) ** float(p)
        return Unit(factor, like.powers)


def with_unit(df: DataFrame, name: str, unit: Unit) -> DataFrame:
    return df.withMetadata(name, {**df.schema[name].metadata, "unit": str(unit)})


def unit_of(df: DataFrame, name: str) -> Unit:
    """Unit of a column; columns without one are plain numbers."""
    text = df.schema[name].metadata.get("unit")
    return Unit.read(text) if text else NONE


def value_in(df: DataFrame, name: str, unit: Unit) -> Column:
    """The column as plain numbers of ``unit``."""
    factor = unit_of(df, name).factor_to(unit)
    return F.col(name) if factor == 1 else F.col(name) * F.lit(factor)


def in_unit(df: DataFrame, name: str, unit: Unit) -> DataFrame:
    """``df`` with one column converted to ``unit``."""
    return with_unit(df.withColumn(name, value_in(df, name, unit)), name, unit)


def product(df: DataFrame, out: str, a: str, b: str, power: int = 1) -> DataFrame:
    """Adds ``out`` = a * b ** power with the unit that follows."""
    value = F.col(a) * (F.col(b) if power == 1 else F.pow(b, F.lit(power)))
    return with_unit(df.withColumn(out, value), out, unit_of(df, a) * unit_of(df, b) ** power)


def total(df: DataFrame, out: str, *names: str) -> DataFrame:
    """Adds ``out``, the sum of columns of one dimension, in the first one's unit; raises UnitError otherwise."""
    unit = unit_of(df, names[0])
    value = sum((value_in(df, n, unit) for n in names[1:]), F.col(names[0]))
    return with_unit(df.withColumn(out, value), out, unit)
