"""The displaced-pole grid of Roberts et al. (2006): circles about a moved pole north of a joining latitude."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geo import _c

#: Halvings of the interval of a circle's radius: beyond a double's precision.
_HALVINGS = 60


class DisplacedPole:
    """Transforms (degrees) between the grid's own latitude and longitude and those on the Earth.

    ``centre`` is how the circles' centres move from the joining latitude to the pole: "linear", "parabolic" or "cubic".
    """

    def __init__(self, join_lat: float = 10.0, pole_lat: float = 75.0, pole_lon: float = 320.0, centre: str = "parabolic"):
        if centre not in ("linear", "parabolic", "cubic"):
            raise ValueError(f"no centre function {centre!r}")
        self.join_lat, self.pole_lon, self.power = join_lat, pole_lon, ("linear", "parabolic", "cubic").index(centre) + 1
        # in the polar plane the joining latitude is the unit circle, and the circle of radius 0 is the moved pole
        self.unit = math.tan(math.radians(90 - join_lat))
        self.shift = math.tan(math.radians(90 - pole_lat)) / self.unit

    def _radius(self, lat: Column) -> Column:
        return F.tan(F.radians(90 - lat)) / self.unit

    def _latitude(self, radius: Column) -> Column:
        return 90 - F.degrees(F.atan(radius * self.unit))

    def _centre(self, r: Column) -> Column:
        """Where on the axis to the moved pole the circle of radius r has its centre: shift (1 - r)**power."""
        return self.shift * F.pow(1 - r, F.lit(float(self.power)))

    def _stretch(self, r: Column) -> Column:
        """exp of the integral of -centre'(s) / s from r to 1: a line across all circles keeps tan(angle / 2) / stretch.

        With n the power that is n shift (1 - s)**(n - 1) / s, a sum of powers of s, integrated term by term.
        """
        n, r = self.power, F.greatest(r, F.lit(1e-12))
        terms = [(math.comb(n - 1, k) * (-1) ** k, k) for k in range(n)]
        total = -F.log(r)
        for c, k in terms[1:]:
            total = total + c / k * (1 - F.pow(r, F.lit(float(k))))
        return F.exp(n * self.shift * total)

    @staticmethod
    def _turned(angle: Column, factor: Column) -> Column:
        """The angle whose half has ``factor`` times the tangent; it keeps its sign."""
        return 2 * F.atan(F.tan(angle / 2) * factor)

    def _from_axis(self, lon: Column) -> Column:
        """Angle from the axis, in (-pi, pi]."""
        turn = F.radians(lon - self.pole_lon)
        return F.atan2(F.sin(turn), F.cos(turn))

    def _longitude(self, angle: Column) -> Column:
        return F.pmod(F.degrees(angle) + self.pole_lon, F.lit(360.0))

    def forward(self, lat, lon) -> tuple[Column, Column]:
        """(lat, lon) on the Earth of a grid point; points up to the joining latitude stay."""
        lat, lon = _c(lat), _c(lon)
        r = self._radius(lat)
        angle = self._turned(self._from_axis(lon), self._stretch(r))
        x, y = self._centre(r) + r * F.cos(angle), r * F.sin(angle)
        moved = lat > self.join_lat
        return F.when(moved, self._latitude(F.hypot(x, y))).otherwise(lat), F.when(moved, self._longitude(F.atan2(y, x))).otherwise(lon)

    def backward(self, lat, lon) -> tuple[Column, Column]:
        """The grid's (lat, lon) of a point on the Earth. The radius of the circle through it has no closed form; the distance from a circle's
        centre less its radius falls with the radius, so halving the interval from 0 to 1 finds it.
        """
        lat, lon = _c(lat), _c(lon)

        @F.pandas_udf("double")
        def circle(x: pd.Series, y: pd.Series) -> pd.Series:
            """Halves the interval for all rows of a batch at once."""
            x, y = x.to_numpy(float), y.to_numpy(float)
            low, high = np.zeros(len(x)), np.ones(len(x))
            for _ in range(_HALVINGS):
                middle = (low + high) / 2
                beyond = np.hypot(x - self.shift * (1 - middle) ** self.power, y) > middle
                low, high = np.where(beyond, middle, low), np.where(beyond, high, middle)
            return pd.Series(high)

        far, angle = self._radius(lat), self._from_axis(lon)
        x, y = far * F.cos(angle), far * F.sin(angle)
        r = circle(x, y)
        angle = self._turned(F.atan2(y, x - self._centre(r)), 1 / self._stretch(r))
        moved = lat > self.join_lat
        return F.when(moved, self._latitude(r)).otherwise(lat), F.when(moved, self._longitude(angle)).otherwise(lon)

    def grid(self, spark: SparkSession, n: int = 10, m: int = 10, lat0: float = -80.0, lat1: float = 80.0, lon0: float = 0.0, lon1: float = 360.0) -> DataFrame:
        """Rows (i, j, grid_lat, grid_lon, lat, lon) of n x m points."""
        cells = spark.range(n * m).select(F.floor(F.col("id") / m).cast("int").alias("i"), (F.col("id") % m).cast("int").alias("j"))
        cells = cells.select("i", "j", (F.lit(lat0) + F.col("i") * ((lat1 - lat0) / n)).alias("grid_lat"), (F.lit(lon0) + F.col("j") * ((lon1 - lon0) / m)).alias("grid_lon"))
        lat, lon = self.forward("grid_lat", "grid_lon")
        return cells.select("*", lat.alias("lat"), lon.alias("lon"))
