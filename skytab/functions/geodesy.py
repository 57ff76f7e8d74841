"""Geodesy as Column expressions. Angles are degrees; yaw and course run clockwise from true north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
FULL_FRAME_MM = 36.0
# WGS-84 and UTM, fixed values
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_FALSE_EAST, UTM_FALSE_NORTH = 0.9996, 500000.0, 10000000.0


def wrap360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def meters_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of latitude and of longitude at a latitude (WGS-84 cosine series, fixed values)."""
    p = F.radians(lat)
    north = 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p)
    east = 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)
    return north, east


def bearing(east: Column, north: Column) -> Column:
    """Direction of a vector, 0 to 360."""
    return wrap360(F.degrees(F.atan2(east, north)))


def angle_difference(a: Column, b: Column) -> Column:
    """a - b, -180 to 180."""
    return F.pmod(a - b + 540.0, F.lit(360.0)) - 180.0


def haversine_3d(lat1: Column, lon1: Column, alt1: Column, lat2: Column, lon2: Column, alt2: Column) -> Column:
    """Great-circle distance on a sphere, combined with the difference in altitude."""
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    ground = 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.sqrt(ground * ground + (alt2 - alt1) * (alt2 - alt1))


def utm_zone(lon: Column) -> Column:
    """Zone by longitude alone: no exceptions for Norway and Svalbard; longitude 180 gives 61."""
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("string"))


def _third_flattening() -> tuple[float, float, list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, radius, forward, back


def utm_forward(lon: Column, lat: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing by Krüger's series of the third order (millimetres within a zone)."""
    n, radius, alpha, _ = _third_flattening()
    zone = utm_zone(lon) if zone is None else zone
    e = 2 * math.sqrt(n) / (1 + n)
    p, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(F.sin(p)) - e * atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, a in enumerate(alpha))
    y = xi + sum(a * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, a in enumerate(alpha))
    south = F.when(lat < 0, UTM_FALSE_NORTH).otherwise(0.0)
    return UTM_FALSE_EAST + UTM_SCALE * radius * x, south + UTM_SCALE * radius * y


def utm_inverse(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM point."""
    n, radius, _, beta = _third_flattening()
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi = (northing - F.when(south, UTM_FALSE_NORTH).otherwise(0.0)) / (UTM_SCALE * radius)
    eta = (easting - UTM_FALSE_EAST) / (UTM_SCALE * radius)
    x = xi - sum(b * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, b in enumerate(beta))
    y = eta - sum(b * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, b in enumerate(beta))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum(d * F.sin(2 * (k + 1) * chi) for k, d in enumerate(delta))
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def footprint(width: Column, height: Column, agl: Column, altitude: Column, focal_35mm: Column, focal_mm: Column, sensor_w: Column, sensor_h: Column) -> tuple[Column, Column, Column]:
    """Nadir footprint width and height and metres a pixel. Height above ground goes before altitude;
    a 35 mm equivalent focal length stands for a 36 mm wide sensor."""
    above = F.greatest(F.lit(5.0), F.when(agl > 0, agl).otherwise(altitude))
    full = F.coalesce(focal_35mm > 0, F.lit(False))
    sw = F.when(full, FULL_FRAME_MM).otherwise(sensor_w)
    sh = F.when(full, FULL_FRAME_MM * height / F.greatest(F.lit(1), width)).otherwise(sensor_h)
    focal = F.when(full, F.greatest(F.lit(1.0), focal_35mm)).otherwise(F.greatest(F.lit(5.0), focal_mm))
    ground_w = above * sw / focal
    return ground_w, above * sh / focal, ground_w / F.greatest(F.lit(1), width)


def rotated_half_extent(ground_w: Column, ground_h: Column, yaw: Column) -> tuple[Column, Column]:
    """Half width and half height of the upright box around a footprint turned by yaw."""
    c, s = F.abs(F.cos(F.radians(yaw))), F.abs(F.sin(F.radians(yaw)))
    return (ground_w * c + ground_h * s) / 2, (ground_w * s + ground_h * c) / 2
