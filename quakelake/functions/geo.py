"""Plane and sphere geometry on longitude/latitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0
EARTH_RADIUS_KM = 6371.0


def in_region(lon: Column, lat: Column, region: tuple[float, float, float, float]) -> Column:
    """Inside ``(lon_min, lon_max, lat_min, lat_max)``, borders included."""
    lo0, lo1, la0, la1 = region
    return lon.between(lo0, lo1) & lat.between(la0, la1)


def along_and_across(
    lon: Column, lat: Column, p1: tuple[float, float], p2: tuple[float, float]
) -> tuple[Column, Column]:
    """Kilometres along the line p1-p2 and signed kilometres off it, on a flat grid of 111 km/degree."""
    dx, dy = p2[0] - p1[0], p2[1] - p1[1]
    length = (dx * dx + dy * dy) ** 0.5
    if length == 0:
        raise ValueError("profile end points coincide")
    ux, uy = dx / length, dy / length
    along = ((lon - p1[0]) * ux + (lat - p1[1]) * uy) * KM_PER_DEGREE
    across = ((lon - p1[0]) * (-uy) + (lat - p1[1]) * ux) * KM_PER_DEGREE
    return along, across


def epicentral_km(lon: Column, lat: Column, ref_lon: float | Column, ref_lat: float | Column) -> Column:
    """Great-circle distance on a sphere (within 0.6 % of the ellipsoid)."""
    ref_lon = ref_lon if isinstance(ref_lon, Column) else F.lit(float(ref_lon))
    ref_lat = ref_lat if isinstance(ref_lat, Column) else F.lit(float(ref_lat))
    half_lat = F.sin(F.radians(lat - ref_lat) / 2)
    half_lon = F.sin(F.radians(lon - ref_lon) / 2)
    h = half_lat * half_lat + F.cos(F.radians(ref_lat)) * F.cos(F.radians(lat)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def nearest_segment(lon: Column, lat: Column, segments: Column) -> Column:
    """``struct(km, id)`` of the nearest of an array of ``struct(segment_id, lon1, lat1, lon2, lat2)``.

    Distances are point-to-segment on a local flat grid whose east-west degrees are scaled by the
    cosine of the point's latitude. Each step binds its results, so nothing is computed twice.
    """
    scale = F.cos(F.radians(lat))
    vectors = F.transform(
        segments,
        lambda s: F.struct(
            s["segment_id"].alias("id"),
            ((s["lon1"] - lon) * scale).alias("ax"),
            (s["lat1"] - lat).alias("ay"),
            ((s["lon2"] - s["lon1"]) * scale).alias("dx"),
            (s["lat2"] - s["lat1"]).alias("dy"),
        ),
    )
    placed = F.transform(
        vectors,
        lambda v: F.struct(
            v.alias("v"),
            F.coalesce(
                F.try_divide(-(v["ax"] * v["dx"] + v["ay"] * v["dy"]), v["dx"] * v["dx"] + v["dy"] * v["dy"]),
                F.lit(0.0),
            ).alias("t"),
        ),
    )
    clipped = F.transform(
        placed,
        lambda p: F.struct(p["v"].alias("v"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["t"])).alias("t")),
    )
    return F.array_min(
        F.transform(
            clipped,
            lambda p: F.struct(
                (
                    F.hypot(p["v"]["ax"] + p["t"] * p["v"]["dx"], p["v"]["ay"] + p["t"] * p["v"]["dy"])
                    * KM_PER_DEGREE
                ).alias("km"),
                p["v"]["id"].alias("id"),
            ),
        )
    )
