"""Map projections of packed grids in closed form on a sphere; each formula serves columns and plain numbers alike.

Standard spherical forms (Snyder, USGS Professional Paper 1395). Grid indices are counted from 0.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS_KM = 6371.2


class _Numbers:
    """The functions the formulas need, for floats."""

    sin, cos, tan, log, exp, sqrt, atan, asin, atan2, floor = (staticmethod(getattr(math, n)) for n in "sin cos tan log exp sqrt atan asin atan2 floor".split())
    power = staticmethod(math.pow)

    @staticmethod
    def wrap(lon: float) -> float:
        return (lon + 180.0) % 360.0 - 180.0


class _Columns:
    sin, cos, tan, log, exp, sqrt, atan, asin, atan2, floor = (staticmethod(getattr(F, n)) for n in "sin cos tan log exp sqrt atan asin atan2 floor".split())

    @staticmethod
    def power(a, b):
        return F.pow(a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))

    @staticmethod
    def wrap(lon: Column) -> Column:
        return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def _functions(x):
    return _Columns if isinstance(x, Column) else _Numbers


@dataclass(frozen=True)
class Projection:
    """The eleven numbers of an index record. grid_size is in km; 0 means a lat-lon grid with the tangents as spacing."""

    pole_lat: float
    pole_lon: float
    tangent_lat: float
    tangent_lon: float
    grid_size: float
    orientation: float
    cone_angle: float
    sync_x: float
    sync_y: float
    sync_lat: float
    sync_lon: float

    def __post_init__(self):
        if self.orientation != 0:
            raise NotImplementedError("rotated grids are not supported")

    @property
    def kind(self) -> str:
        if self.grid_size == 0:
            return "latlong"
        if abs(self.cone_angle) == 90:
            return "stere" if abs(self.pole_lat) == 90 else "sterea"
        return "merc" if self.cone_angle == 0 else "lcc"

    @property
    def is_latlon(self) -> bool:
        return self.kind == "latlong"

    @cached_property
    def _cone(self) -> tuple[float, float, float]:
        """n, R F and rho0 of the Lambert cone, which touches at the cone angle."""
        phi = math.radians(self.cone_angle)
        n = math.sin(phi)
        rf = RADIUS_KM * math.cos(phi) * math.tan(math.pi / 4 + phi / 2) ** n / n
        return n, rf, rf / math.tan(math.pi / 4 + math.radians(self.tangent_lat) / 2) ** n

    def forward(self, lon, lat):
        """Kilometres east and north of the projection's own origin."""
        m = _functions(lon)
        lam, phi = m.wrap(lon - self.tangent_lon) * (math.pi / 180), lat * (math.pi / 180)
        if self.kind == "stere":
            sign = 1.0 if self.pole_lat > 0 else -1.0
            rho = RADIUS_KM * (1 + abs(math.sin(math.radians(self.tangent_lat)))) * m.tan(math.pi / 4 - phi * (sign / 2))
            return rho * m.sin(lam), rho * m.cos(lam) * -sign
        if self.kind == "sterea":
            s0, c0 = math.sin(math.radians(self.pole_lat)), math.cos(math.radians(self.pole_lat))
            k = 2 * RADIUS_KM / (m.sin(phi) * s0 + m.cos(phi) * m.cos(lam) * c0 + 1.0)
            return k * m.cos(phi) * m.sin(lam), k * (m.sin(phi) * c0 - m.cos(phi) * m.cos(lam) * s0)
        if self.kind == "merc":
            k = RADIUS_KM * math.cos(math.radians(self.tangent_lat))
            return lam * k, m.log(m.tan(phi / 2 + math.pi / 4)) * k
        n, rf, rho0 = self._cone
        rho = m.power(m.tan(phi / 2 + math.pi / 4), -n) * rf
        return rho * m.sin(lam * n), rho * m.cos(lam * n) * -1.0 + rho0

    def inverse(self, x, y):
        """Longitude and latitude in degrees of kilometres east and north."""
        m = _functions(x)
        deg = 180 / math.pi
        if self.kind == "stere":
            sign = 1.0 if self.pole_lat > 0 else -1.0
            rho = m.sqrt(x * x + y * y)
            phi = (m.atan(rho / (RADIUS_KM * (1 + abs(math.sin(math.radians(self.tangent_lat)))))) * -2.0 + math.pi / 2) * sign
            lam = m.atan2(x, y * -sign)
        elif self.kind == "sterea":
            s0, c0 = math.sin(math.radians(self.pole_lat)), math.cos(math.radians(self.pole_lat))
            rho = m.sqrt(x * x + y * y)
            c = m.atan(rho / (2 * RADIUS_KM)) * 2.0
            # sin c / rho has the limit 1 / 2R at the centre
            ratio = m.cos(c / 2) * m.cos(c / 2) * (1 / RADIUS_KM)
            phi = m.asin(m.cos(c) * s0 + y * ratio * c0)
            lam = m.atan2(x * ratio, m.cos(c) * c0 - y * ratio * s0)
        elif self.kind == "merc":
            k = RADIUS_KM * math.cos(math.radians(self.tangent_lat))
            lam, phi = x / k, m.atan(m.exp(y / k)) * 2.0 - math.pi / 2
        else:
            n, rf, rho0 = self._cone
            sign = 1.0 if n > 0 else -1.0
            rho = m.sqrt(x * x + (y * -1.0 + rho0) * (y * -1.0 + rho0)) * sign
            lam = m.atan2(x * sign, (y * -1.0 + rho0) * sign) / n
            phi = m.atan(m.power(rho / rf, -1 / n)) * 2.0 - math.pi / 2
        return m.wrap(lam * deg + self.tangent_lon), phi * deg


@dataclass(frozen=True)
class Window:
    """A half-open rectangle of cells."""

    x_start: int
    x_stop: int
    y_start: int
    y_stop: int

    def __post_init__(self):
        if min(self.x_start, self.y_start) < 0 or self.x_stop <= self.x_start or self.y_stop <= self.y_start:
            raise ValueError(f"{self} is empty or negative")

    @property
    def shape(self) -> tuple[int, int]:
        return self.y_stop - self.y_start, self.x_stop - self.x_start

    def predicate(self, x: Column | str = "x", y: Column | str = "y") -> Column:
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        return (x >= self.x_start) & (x < self.x_stop) & (y >= self.y_start) & (y < self.y_stop)


def _nint(v: float) -> int:
    return math.floor(v + 0.5) if v >= 0 else math.ceil(v - 0.5)


@dataclass(frozen=True)
class Grid:
    projection: Projection
    nx: int
    ny: int

    @property
    def dims(self) -> tuple[str, str]:
        return ("lat", "lon") if self.projection.is_latlon else ("y", "x")

    @property
    def record_length(self) -> int:
        return 50 + self.nx * self.ny

    @property
    def full_window(self) -> Window:
        return Window(0, self.nx, 0, self.ny)

    @cached_property
    def _sync(self) -> tuple[float, float]:
        return self.projection.forward(float(self.projection.sync_lon), float(self.projection.sync_lat))

    def fractional_indices(self, lon, lat):
        """Fractional (x, y) of longitudes and latitudes; both columns, or both numbers."""
        p = self.projection
        if p.is_latlon:
            if p.tangent_lon == 0 or p.tangent_lat == 0:
                raise ValueError("lat-lon grids need a spacing")
            # the first column stands at the sync point
            return _functions(lon).wrap(lon - p.sync_lon) / p.tangent_lon, (lat - p.sync_lat) / p.tangent_lat
        x, y = p.forward(lon, lat)
        return (x - self._sync[0]) / p.grid_size + (p.sync_x - 1), (y - self._sync[1]) / p.grid_size + (p.sync_y - 1)

    def lon_lat(self, x, y):
        """Longitude and latitude of (fractional) indices. Along a lat-lon row longitudes run on from the wrapped first."""
        p = self.projection
        if p.is_latlon:
            return x * p.tangent_lon + _Numbers.wrap(p.sync_lon), y * p.tangent_lat + p.sync_lat
        return p.inverse((x - (p.sync_x - 1)) * p.grid_size + self._sync[0], (y - (p.sync_y - 1)) * p.grid_size + self._sync[1])

    def coords(self, spark: SparkSession) -> DataFrame:
        """(y, x, lon, lat) of every cell, made on the executors."""
        at = spark.range(self.nx * self.ny).select(F.floor(F.col("id") / self.nx).cast("int").alias("y"), (F.col("id") % self.nx).cast("int").alias("x"))
        lon, lat = self.lon_lat(F.col("x").cast("double"), F.col("y").cast("double"))
        return at.select("y", "x", lon.alias("lon"), lat.alias("lat"))

    def window_from_bbox(self, bbox: tuple[float, float, float, float]) -> Window:
        """The window of a box (west, south, east, north).

        Lat-lon grids: from the first to the last cell inside the closed box, west > east meaning across the date line.
        Projected grids: the corners' nearest cells, halves away from zero, clipped.
        """
        west, south, east, north = map(float, bbox)
        if south > north:
            raise ValueError("bbox south must not be greater than north")
        none = ValueError("the box and the grid have no cell in common")
        if not self.projection.is_latlon:
            if west > east:
                raise ValueError("bbox must not cross the dateline on projected grids")
            corners = [self.fractional_indices(lon, lat) for lon, lat in ((west, south), (east, north))]
            spans = []
            for axis, n in ((0, self.nx), (1, self.ny)):
                a, b = sorted(_nint(c[axis] + 1) for c in corners)
                if b < 1 or a > n:
                    raise none
                spans += [max(0, a - 1), min(n, b)]
            return Window(*spans)
        inside = (lambda v: west <= v <= east) if west <= east else (lambda v: v >= west or v <= east)
        xs = [x for x in range(self.nx) if inside(_Numbers.wrap(self.lon_lat(float(x), 0.0)[0]))]
        ys = [y for y in range(self.ny) if south <= self.lon_lat(0.0, float(y))[1] <= north]
        if not xs or not ys:
            raise none
        return Window(xs[0], xs[-1] + 1, ys[0], ys[-1] + 1)

    def subset(self, w: Window) -> Grid:
        """The grid of a window: its lower left cell becomes the sync point."""
        lon, lat = self.lon_lat(float(w.x_start), float(w.y_start))
        return Grid(replace(self.projection, sync_x=1.0, sync_y=1.0, sync_lat=lat, sync_lon=_Numbers.wrap(lon)), w.x_stop - w.x_start, w.y_stop - w.y_start)

    def to_dict(self) -> dict:
        return {"projection": asdict(self.projection), "nx": self.nx, "ny": self.ny}

    @classmethod
    def from_dict(cls, d: dict) -> Grid:
        return cls(Projection(**d["projection"]), d["nx"], d["ny"])
