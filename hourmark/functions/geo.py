"""Distances between coordinates in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourmark import schema as S


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * S.EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """For comparing which of several places is nearest; null when a coordinate is."""
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return dlat * dlat + dlon * dlon
