"""Great-circle distance as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    """Metres from a point to a fixed one."""
    half_lat, half_lon = F.radians(F.lit(lat2) - lat1) / 2, F.radians(F.lit(lon2) - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * math.cos(math.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius: float) -> Column:
    """A cheap necessary condition for lying within radius: latitude, and longitude away from poles and date line."""
    d_lat = math.degrees(radius / EARTH_RADIUS_M) * 1.0001 + 1e-9
    out = lat.between(centre_lat - d_lat, centre_lat + d_lat)
    top = max(abs(centre_lat - d_lat), abs(centre_lat + d_lat))
    if top < 89:
        reach = math.sin(min(radius / EARTH_RADIUS_M, math.pi / 2)) / math.cos(math.radians(centre_lat))
        d_lon = math.degrees(math.asin(min(1.0, reach))) * 1.0001 + 1e-9
        if reach < 1 and -180 < centre_lon - d_lon and centre_lon + d_lon < 180:
            out &= lon.between(centre_lon - d_lon, centre_lon + d_lon) | ~lon.between(-180, 180)
    return out
