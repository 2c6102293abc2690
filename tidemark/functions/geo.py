"""WGS84 expressions on flat lon/lat DOUBLE columns and small rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import lit_f, rnd, wrap360

# They must equal the published formulas for right results.
EARTH_RADIUS_KM = 6371.0
KM_PER_DEG_LAT = 110.574
KM_PER_DEG_LON = 111.320
MIN_COS_LAT = 0.1


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s_lat = F.sin(F.radians(lat2 - lat1) / lit_f(2))
    s_lon = F.sin(F.radians(lon2 - lon1) / lit_f(2))
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return lit_f(EARTH_RADIUS_KM) * (lit_f(2) * F.atan2(F.sqrt(a), F.sqrt(lit_f(1) - a)))


def planar_bearing(from_lat: Column, from_lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Bearing in the lon/lat plane (no latitude scaling), 0..360."""
    return wrap360(F.degrees(F.atan2(to_lon - from_lon, to_lat - from_lat)))


def _cos_floor(lat: Column) -> Column:
    return F.greatest(F.abs(F.cos(F.radians(lat))), lit_f(MIN_COS_LAT))


def box_around(lat: Column, lon: Column, radius_km: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat), clamped to the globe, 5 decimals."""
    dlat = radius_km / lit_f(KM_PER_DEG_LAT)
    dlon = radius_km / (lit_f(KM_PER_DEG_LON) * _cos_floor(lat))
    return F.struct(
        rnd(F.greatest(lit_f(-180), lon - dlon), 5).alias("min_lon"),
        rnd(F.greatest(lit_f(-90), lat - dlat), 5).alias("min_lat"),
        rnd(F.least(lit_f(180), lon + dlon), 5).alias("max_lon"),
        rnd(F.least(lit_f(90), lat + dlat), 5).alias("max_lat"),
    )


def metres_to_dlat(dy_m: Column) -> Column:
    return dy_m / lit_f(KM_PER_DEG_LAT * 1000)


def metres_to_dlon(dx_m: Column, lat: Column) -> Column:
    return dx_m / (lit_f(KM_PER_DEG_LON * 1000) * _cos_floor(lat))


def pixel_lon(px: Column, width: Column, min_lon: Column, max_lon: Column) -> Column:
    return min_lon + (px / F.greatest(width, F.lit(1))) * (max_lon - min_lon)


def pixel_lat(py: Column, height: Column, min_lat: Column, max_lat: Column) -> Column:
    return max_lat - (py / F.greatest(height, F.lit(1))) * (max_lat - min_lat)


def scene_size_km(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> tuple[Column, Column]:
    """(width, height) in km, with the longitude scale of the middle latitude."""
    mid = (min_lat + max_lat) / lit_f(2)
    width = F.abs(max_lon - min_lon) * (lit_f(KM_PER_DEG_LON) * F.cos(F.radians(mid)))
    return width, F.abs(max_lat - min_lat) * lit_f(KM_PER_DEG_LAT)


def pixel_area_km2(min_lon, min_lat, max_lon, max_lat, width: Column, height: Column) -> Column:
    w_km, h_km = scene_size_km(min_lon, min_lat, max_lon, max_lat)
    return (w_km * h_km) / F.greatest(width * height, F.lit(1))


def box_ring(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(point(min_lon, min_lat), point(max_lon, min_lat), point(max_lon, max_lat),
                   point(min_lon, max_lat), point(min_lon, min_lat))


def box_wkt(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, digits: int = 5) -> Column:
    pattern = "POLYGON((" + ", ".join([f"%.{digits}f %.{digits}f"] * 5) + "))"
    a, b, c, d = min_lon, min_lat, max_lon, max_lat
    return F.format_string(pattern, a, b, c, b, c, d, a, d, a, b)


def ring_bounds(ring: Column) -> Column:
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"),
                    F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1),
                      lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"),
                                            b["lon"].alias("bx"), b["lat"].alias("by")))


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    return ((cross == 0)
            & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Strict interior of a closed ring: odd crossings, and not on the boundary.

    A null ring is outside.  The bounds test short-cuts almost all points before
    the per-edge lambda runs.
    """
    edges = _edges(ring)
    crossings = F.size(F.filter(edges, lambda e: (
        ((e["ay"] > lat) != (e["by"] > lat))
        & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], lit_f(0)) + e["ax"]))))
    box = ring_bounds(ring)
    hit = F.when(
        (lon > box["min_lon"]) & (lon < box["max_lon"]) & (lat > box["min_lat"]) & (lat < box["max_lat"]),
        (crossings % 2 == 1) & ~F.exists(edges, lambda e: _on_edge(e, lon, lat)))
    return F.coalesce(hit, F.lit(False))


def near_ring(lon: Column, lat: Column, ring: Column, buffer_deg: Column) -> Column:
    """Within ``buffer_deg`` (planar degrees) of any ring edge, or of a lone point."""
    def close(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        dx, dy = bx - ax, by - ay
        len2 = dx * dx + dy * dy
        t = F.when(len2 == 0, lit_f(0)).otherwise(
            F.greatest(lit_f(0), F.least(lit_f(1), ((lon - ax) * dx + (lat - ay) * dy) / len2)))
        ex, ey = lon - (ax + t * dx), lat - (ay + t * dy)
        return ex * ex + ey * ey < buffer_deg * buffer_deg
    by_edge = F.exists(_edges(ring), lambda e: close(e["ax"], e["ay"], e["bx"], e["by"]))
    first = F.get(ring, F.lit(0))
    lone = close(first["lon"], first["lat"], first["lon"], first["lat"])
    box = ring_bounds(ring)
    reachable = (lon.between(box["min_lon"] - buffer_deg, box["max_lon"] + buffer_deg)
                 & lat.between(box["min_lat"] - buffer_deg, box["max_lat"] + buffer_deg))
    hit = F.when(reachable, F.when(F.size(ring) == 1, lone).otherwise(by_edge))
    return F.coalesce(hit, F.lit(False))


def inside_region(lon: Column, lat: Column, ring: Column, buffer_deg: Column) -> Column:
    """Inside a hull ring grown by a buffer; a null or zero buffer is the ring alone."""
    grown = F.coalesce(buffer_deg, lit_f(0))
    return inside_ring(lon, lat, ring) | ((grown > 0) & near_ring(lon, lat, ring, grown))


def cap_half_width_deg(lat: Column, radius_km: Column) -> tuple[Column, Column]:
    """(dlat, dlon) half sizes of a box that surely holds the radius cap.

    Widened by 0.1 % over the exact cap; a cap that touches a pole spans all longitudes.
    """
    reach = radius_km / lit_f(EARTH_RADIUS_KM)
    dlat = F.degrees(reach) * lit_f(1.001)
    ratio = F.sin(reach) / F.cos(F.radians(lat))
    exact = F.degrees(F.asin(F.least(lit_f(1), ratio))) * lit_f(1.001)
    polar = (F.abs(lat) + dlat >= lit_f(90)) | (reach >= lit_f(math.pi / 2))
    return dlat, F.when(polar, lit_f(180)).otherwise(exact)
