"""Points: radius, box and nearest neighbours; distances by reference system."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EARTH

WGS84, WGS84_3D, CARTESIAN, CARTESIAN_3D = 4326, 4979, 7203, 9157


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def distance(p: Column, q: Column, srid: int) -> Column:
    """Between structs x, y, z: metres on the globe (with height), or Euclidean."""
    if srid in (WGS84, WGS84_3D):
        flat = haversine(p["y"], p["x"], q["y"], q["x"])
        return flat if srid == WGS84 else F.sqrt(flat * flat + F.pow(p["z"] - q["z"], 2))
    if srid not in (CARTESIAN, CARTESIAN_3D):
        raise ValueError(f"unknown reference system {srid}")
    square = F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)
    return F.sqrt(square + F.pow(p["z"] - q["z"], 2) if srid == CARTESIAN_3D else square)


def within_box(points: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows with latitude and longitude in the box, edges included; west > east crosses the antimeridian."""
    lon = F.col("longitude")
    fits = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return points.where(F.col("latitude").between(south, north) & fits)


def within_radius(points: DataFrame, latitude: float, longitude: float, metres: float) -> DataFrame:
    """Rows nearer than metres, with their distance; a latitude band prunes the scan first."""
    band = math.degrees(metres / EARTH) + 1e-9
    near = points.where(F.col("latitude").between(latitude - band, latitude + band))
    return near.withColumn("metres", haversine(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))).where(F.col("metres") < metres)


def nearest(points: DataFrame, latitude: float, longitude: float, k: int, id: str = "id") -> DataFrame:
    """The k nearest rows, ties by id: a top-k per task, merged."""
    return points.withColumn("metres", haversine(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))).orderBy("metres", id).limit(k)


def grid_cell(latitude: Column, longitude: Column, degrees: float = 1.0) -> Column:
    """A cell number to partition or bucket points by, so that boxes prune files."""
    rows = math.ceil(360 / degrees)
    return (F.floor((latitude + 90) / degrees) * rows + F.floor((longitude + 180) / degrees)).cast("long")
