"""Distances on the earth, polygons, units."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SeekError

RADIUS = 6_371_000.0
UNITS = {"cm": 0.01, "m": 1.0, "km": 1000.0, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344}


def metres(value: float, unit: str = "m") -> float:
    if unit not in UNITS:
        raise SeekError("INVALID_DISTANCE_SUFFIX", unit)
    return value * UNITS[unit]


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    dlat, dlon = F.radians(F.lit(lat0) - lat), F.radians(F.lit(lon0) - lon)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def vincenty_metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Inverse problem on WGS-84; NaN where the iteration does not settle."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b = a * (1 - f)
    if lat1 == lat2 and lon1 == lon2:
        return 0.0
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    su1, cu1, su2, cu2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    span = math.radians(lon2 - lon1)
    lam = span
    for _ in range(1000):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        if ss == 0:
            return 0.0
        cs = su1 * su2 + cu1 * cu2 * cl
        sigma = math.atan2(ss, cs)
        sa = cu1 * cu2 * sl / ss
        c2a = 1 - sa * sa
        c2m = cs - 2 * su1 * su2 / c2a if c2a else 0.0
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        old, lam = lam, span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
        if abs(lam - old) < 1e-12:
            break
    else:
        return math.nan
    us = c2a * (a * a - b * b) / (b * b)
    big_a = 1 + us / 16384 * (4096 + us * (us * (320 - 175 * us) - 768))
    big_b = us / 1024 * (256 + us * (us * (74 - 47 * us) - 128))
    ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m * c2m - 1) - big_b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
    return b * big_a * (sigma - ds)


def vincenty(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([vincenty_metres(x, y, lat0, lon0) for x, y in zip(a, b, strict=True)], dtype=float)

    return distance(lat, lon)


def in_box(lat: Column, lon: Column, lat0: float, lon0: float, distance: float) -> Column:
    """A box that holds the circle: what a scan can push down. Near the poles and
    across the date line only latitudes bound."""
    dlat = math.degrees(distance / RADIUS) * 1.01
    box = lat.between(lat0 - dlat, lat0 + dlat)
    if abs(lat0) + dlat < 89:
        dlon = math.degrees(math.asin(min(1.0, math.sin(distance / RADIUS) / math.cos(math.radians(lat0))))) * 1.01 if distance / RADIUS < math.pi / 2 else 180.0
        if abs(lon0) + dlon < 180:
            box = box & lon.between(lon0 - dlon, lon0 + dlon)
    return box


def in_polygon(lat: Column, lon: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting over (lat, lon) corners."""
    inside = F.lit(False)
    n = len(points)
    for i in range(n):
        (ya, xa), (yb, xb) = points[i], points[i - 1]
        crosses = ((F.lit(ya) > lat) != (F.lit(yb) > lat)) & (lon < (xb - xa) * (lat - ya) / ((yb - ya) or math.inf) + xa)
        inside = inside != crosses
    return inside


def polygon_bounds(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    lats, lons = [p[0] for p in points], [p[1] for p in points]
    return min(lats), max(lats), min(lons), max(lons)


def polygon_centroid(points: list[tuple[float, float]]) -> tuple[float, float]:
    area = x = y = 0.0
    for (y1, x1), (y2, x2) in zip(points, points[1:] + points[:1], strict=True):
        cross = x1 * y2 - x2 * y1
        area += cross
        x += (x1 + x2) * cross
        y += (y1 + y2) * cross
    if not area:
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    return y / (3 * area), x / (3 * area)
