"""Distances on the earth's surface, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres along a great circle; null for coordinates out of range."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(in_range(lat1, lon1) & in_range(lat2, lon2), F.lit(2 * RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def near_box(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    """A box around the circle: plain ranges of both columns, which Parquet statistics can prune.

    A circle that reaches a pole has all longitudes; one that reaches the antimeridian has two ranges of them.
    """
    d = math.degrees(km / RADIUS_KM) + 1e-6
    box = lat.between(lat0 - d, lat0 + d)
    if abs(lat0) + d >= 90:
        return box
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat0))))) + 1e-6
    lo, hi = lon0 - wide, lon0 + wide
    if lo < -180:
        return box & (lon.between(-180, hi) | lon.between(lo + 360, 180))
    if hi > 180:
        return box & (lon.between(lo, 180) | lon.between(-180, hi - 360))
    return box & lon.between(lo, hi)
