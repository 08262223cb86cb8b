"""Distances and what is made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
M_PER_DEGREE = 111_320.0
#: Distance bands: of 500 m up to 25 km, then of 5 km.
NEAR_BAND_M, NEAR_LIMIT_M, FAR_BAND_M = 500, 25_000, 5_000
NO_BAND = 2**31 - 1


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a sphere. Arguments are columns or numbers of degrees."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    x = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(x), F.sqrt(F.lit(1.0) - x))


#: The WGS 84 ellipsoid.
EQUATOR_M, FLATTENING = 6_378_137.0, 1 / 298.257223563


def ellipsoidal(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the ellipsoid by Lambert's formula: a few metres off over thousands of kilometres, millimetres in a city."""
    lat1, lon1, lat2, lon2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat1, lon1, lat2, lon2))
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    b1, b2 = reduced(lat1), reduced(lat2)
    half = F.pow(F.sin((b2 - b1) / 2), F.lit(2.0)) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    angle = 2 * F.atan2(F.sqrt(half), F.sqrt(F.lit(1.0) - half))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    square = lambda x: F.pow(x, F.lit(2.0))
    x = (angle - F.sin(angle)) * square(F.sin(p)) * square(F.cos(q)) / square(F.cos(angle / 2))
    y = (angle + F.sin(angle)) * square(F.cos(p)) * square(F.sin(q)) / square(F.sin(angle / 2))
    return F.when(half == 0, 0.0).otherwise(EQUATOR_M * (angle - FLATTENING / 2 * (x + y)))


def bounding_box(lat: float, lon: float, radius_m: float = 30_000.0) -> tuple[float, float, float, float]:
    """(least lat, most lat, least lon, most lon) around a point; finite at the poles."""
    d_lat = radius_m / M_PER_DEGREE
    d_lon = d_lat / max(0.01, math.cos(math.radians(lat)))
    return lat - d_lat, lat + d_lat, lon - d_lon, lon + d_lon


def within(lat: Column, lon: Column, centre: tuple[float, float], radius_m: float) -> Column:
    """In the radius: a box that a scan can prune by, and the distance."""
    a, b, c, d = bounding_box(*centre, radius_m * 1.01 + 1)
    return lat.between(a, b) & lon.between(c, d) & (haversine(lat, lon, *centre) <= radius_m)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def distance_band(metres: Column) -> Column:
    far = NEAR_LIMIT_M // NEAR_BAND_M + 1 + F.floor((metres - NEAR_LIMIT_M) / FAR_BAND_M)
    return F.when(metres.isNull(), NO_BAND).when(metres <= NEAR_LIMIT_M, F.floor(metres / NEAR_BAND_M)).otherwise(far).cast("int")


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the number as a machine multiplies it."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def whole_metres(metres: Column) -> Column:
    return rounded(metres, 0).cast("int")


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Grid cell of a point, the key of joins by radius."""
    return F.floor(lat / degrees), F.floor(lon / degrees)
