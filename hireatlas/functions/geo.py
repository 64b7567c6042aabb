"""Distances and the cell keys the spatial joins meet on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hireatlas.rules import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres; null when a coordinate is missing."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    # least() skips nulls, so the guard for rounding above 1 must not see a missing coordinate.
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point on the unit sphere. Straight-line distance grows with great-circle distance."""
    across = F.cos(F.radians(lat))
    return across * F.cos(F.radians(lon)), across * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def cell(lat: Column, lon: Column, size_km: float) -> Column:
    """Cube of edge ``size_km`` that holds the point on the sphere.

    A straight line is never longer than the great circle, so two points within ``size_km`` of
    each other always lie in the same or in touching cubes: at the poles and across the date line too.
    """
    def axis(value: Column) -> Column:
        return F.floor(value * F.lit(EARTH_RADIUS_KM / size_km)).cast("long")

    return F.struct(*[axis(v).alias(n) for n, v in zip("xyz", unit_vector(lat, lon))])
