"""Distances and directions on the sphere as Column expressions (degrees unless said otherwise)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import OMEGA
from ..grid import ratio


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _clipped(x: Column) -> Column:
    """x within [-1, 1]; NULL stays (greatest and least alone would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def dist_sphere(lon1, lat1, lon2, lat2, r: float = 6.37e6) -> Column:
    """Great-circle distance by the spherical law of cosines, clipped to its domain."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    x = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(_c(lon2)) - F.radians(_c(lon1)))
    return r * F.acos(_clipped(x))


def haversine(lon1, lat1, lon2, lat2, r: float = 6371.0) -> Column:
    """Great-circle distance by haversines."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    s, t = F.sin((b - a) / 2), F.sin(F.radians(_c(lon2) - _c(lon1)) / 2)
    return 2 * r * F.asin(_clipped(F.sqrt(s * s + F.cos(a) * F.cos(b) * t * t)))


def great_circle_distance(r, lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance, accurate for near and opposite points; coordinates in radians."""
    d, a, b = _c(lon2) - _c(lon1), _c(lat1), _c(lat2)
    y = F.hypot(F.cos(b) * F.sin(d), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return r * F.atan2(y, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def approx_distance(r, lon1, lat1, lon2, lat2) -> Column:
    """Distance on a local plane; coordinates in radians."""
    x = (_c(lon2) - _c(lon1)) * F.cos((_c(lat1) + _c(lat2)) / 2)
    return r * F.sqrt(x * x + (_c(lat2) - _c(lat1)) * (_c(lat2) - _c(lat1)))


def direction_on_sphere(lon1, lat1, lon2, lat2) -> Column:
    """Bearing from the first to the second point, 0 to 2 pi."""
    d, a, b = F.radians(_c(lon2) - _c(lon1)), F.radians(_c(lat1)), F.radians(_c(lat2))
    x = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.when(x < 0, x + 2 * F.pi()).otherwise(x)


def go_on_sphere(lon0, lat0, x, y, r: float = 6366.2e3) -> tuple[Column, Column]:
    """(lon, lat) reached from a point by going x metres east and y metres north along a great circle."""
    d, lat = F.hypot(_c(x), _c(y)) / r, F.radians(_c(lat0))
    course = F.atan2(_c(x), _c(y))
    z = F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(course)
    lat1 = F.asin(_clipped(z))
    lon1 = F.radians(_c(lon0)) + F.atan2(F.sin(course) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(lat1))
    return F.degrees(lon1), F.degrees(lat1)


def coriolis(lat) -> Column:
    """Coriolis parameter."""
    return 2 * OMEGA * F.sin(F.radians(_c(lat)))


def rossby_radius(lat, n: float = 0.013, h: float = 10.0) -> Column:
    """Rossby radius in km, from stability and depth (km)."""
    return ratio(F.lit(n * h), 2 * 7.29e-5 * F.sin(F.radians(F.abs(_c(lat)))))


def _tile(lon: Column, band: Column, km: float, shift: int = 0) -> Column:
    """Key of the tile of a longitude in a latitude band, or of one beside it."""
    angle = km / 6371.0
    least = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(*[F.abs((band + k) * math.degrees(angle) - 90) for k in (-1, 2)]))))
    # No two points this near, one of them in the band, are further apart in longitude.
    reach = F.when(least <= math.sin(angle / 2), 360.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(angle / 2) / least))))
    n = F.greatest(F.lit(1), F.floor(360 / (reach * (1 + 1e-9))))
    at = F.floor(F.pmod(lon, F.lit(360.0)) / 360 * n) + shift
    return band.cast("long") * (1 << 32) + F.pmod(at, n)


def tile_of(lon, lat, km: float) -> Column:
    """Key of the tile of a point; tiles are so large that points up to ``km`` apart lie in neighbouring ones."""
    return _tile(_c(lon), F.floor((_c(lat) + 90) / math.degrees(km / 6371.0)), km)


def tiles_near(lon, lat, km: float) -> Column:
    """Keys of a point's tile and those beside it (nine at most, poles and date line included), to be exploded."""
    band = F.floor((_c(lat) + 90) / math.degrees(km / 6371.0))
    return F.array_distinct(F.array(*[_tile(_c(lon), band + b, km, k) for b in (-1, 0, 1) for k in (-1, 0, 1)]))


def geographic_position(rlon, rlat, pole_lon, pole_lat) -> tuple[Column, Column]:
    """(lon, lat) of a place given in coordinates about a rotated north pole, which lies at (pole_lon, pole_lat); lon is in [-180, 180)."""
    a, b, p = F.radians(_c(rlon)), F.radians(_c(rlat)), F.radians(_c(pole_lat))
    x = F.cos(p) * F.sin(b) - F.sin(p) * F.cos(a) * F.cos(b)
    z = F.sin(p) * F.sin(b) + F.cos(p) * F.cos(a) * F.cos(b)
    lon = _c(pole_lon) + F.degrees(F.atan2(-F.sin(a) * F.cos(b), x))
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(F.asin(_clipped(z)))


def rotated_position(lon, lat, pole_lon, pole_lat) -> tuple[Column, Column]:
    """(rlon, rlat) about a rotated north pole: the inverse of ``geographic_position``."""
    a, b, p = F.radians(_c(lon) - _c(pole_lon)), F.radians(_c(lat)), F.radians(_c(pole_lat))
    x = F.cos(p) * F.sin(b) - F.sin(p) * F.cos(a) * F.cos(b)
    z = F.sin(p) * F.sin(b) + F.cos(p) * F.cos(a) * F.cos(b)
    return F.degrees(F.atan2(-F.sin(a) * F.cos(b), x)), F.degrees(F.asin(_clipped(z)))


def north_of_rotated(rlon, rlat, pole_lat) -> tuple[Column, Column]:
    """True north at a place in coordinates about a rotated pole, as a unit vector along their axes; NULL at the true poles."""
    a, b, p = F.radians(_c(rlon)), F.radians(_c(rlat)), F.radians(_c(pole_lat))
    x, y = -F.cos(p) * F.sin(a), F.sin(p) * F.cos(b) - F.cos(p) * F.sin(b) * F.cos(a)
    r = F.hypot(x, y)
    return F.when(r > 1e-12, x / r), F.when(r > 1e-12, y / r)
