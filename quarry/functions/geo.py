"""Geographic distance and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in km.
EARTH_KM = 6371.0
_KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def within_radius(df: DataFrame, lat: str, lon: str, center: tuple[float, float], km: float) -> DataFrame:
    """Rows within km of center with distance_km, nearest first. A latitude band goes to the scan before the exact test."""
    band = km / _KM_PER_DEGREE * 1.01
    near = df.where(F.col(lat).between(center[0] - band, center[0] + band))
    d = haversine_km(F.lit(center[0]), F.lit(center[1]), F.col(lat), F.col(lon))
    return near.withColumn("distance_km", d).where(F.col("distance_km") <= km).orderBy("distance_km")


def nearest(df: DataFrame, lat: str, lon: str, center: tuple[float, float], k: int, tie: str) -> DataFrame:
    d = haversine_km(F.lit(center[0]), F.lit(center[1]), F.col(lat), F.col(lon))
    return df.withColumn("distance_km", d).orderBy("distance_km", tie).limit(k)


def grid_cell(lat: Column, lon: Column, degrees: float = 1.0) -> Column:
    """A cell id to partition or bucket by."""
    return F.concat_ws(":", F.floor((lat + 90) / degrees).cast("string"), F.floor((lon + 180) / degrees).cast("string"))
