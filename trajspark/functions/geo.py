"""Geometry as column expressions: distances, bearings, planes, segments, emissions.

"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii in metres, metres a degree, the side of the planar approximation.
EARTH_RADIUS = 6_371_000.0
EQUATOR_RADIUS = 6_378_137.0
DEGREE_METRES = 111_000.0
DEGREE_METRES_AUDIT = 111_111.0
PLANE_SCALE = 51_500.0
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by arc sine, clamped so that rounding never leaves its domain; null if a coordinate is [I1]."""
    chord = F.sqrt(_half_chord(lat1, lon1, lat2, lon2))
    return 2 * EARTH_RADIUS * F.asin(F.when(chord > 1, 1.0).otherwise(chord))


def haversine_atan(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by arc tangent, 0 for equal points [I2]."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    there = 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(F.when(a > 1, 0.0).otherwise(1 - a)))
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(there)


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres on the tangent plane at (lat0, lon0) [I9]."""
    return (
        F.radians(lon - lon0) * EQUATOR_RADIUS * F.cos(F.radians(lat0)),
        F.radians(lat - lat0) * EQUATOR_RADIUS,
    )


def local_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """The inverse of local_xy."""
    return (
        lat0 + F.degrees(y / EQUATOR_RADIUS),
        lon0 + F.degrees(F.try_divide(x, EQUATOR_RADIUS * F.cos(F.radians(lat0)))),
    )


def plane_xy(lat: Column, lon: Column, lat0: Column, lon0: Column, scale: float = PLANE_SCALE) -> tuple[Column, Column]:
    """One scale for both axes [I10]."""
    return (lon - lon0) * scale, (lat - lat0) * scale


def plane_latlon(x: Column, y: Column, lat0: Column, lon0: Column, scale: float = PLANE_SCALE) -> tuple[Column, Column]:
    return lat0 + y / scale, lon0 + x / scale


def degree_step(dlat: Column, dlon: Column, metres: float = DEGREE_METRES_AUDIT) -> Column:
    """Length of a difference in degrees, one scale for both axes [I11]."""
    return F.hypot(dlat, dlon) * metres


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series to the sixth power [I12]."""
    e2 = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
    ep2 = e2 / (1 - e2)
    p = F.radians(lat)
    lon0 = (utm_zone(lon) - 1) * 6 - 177
    n = EQUATOR_RADIUS / F.sqrt(1 - e2 * F.pow(F.sin(p), 2))
    t = F.pow(F.tan(p), 2)
    c = ep2 * F.pow(F.cos(p), 2)
    a = F.radians(lon - lon0) * F.cos(p)
    m = EQUATOR_RADIUS * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p)
        - (35 * e2**3 / 3072) * F.sin(6 * p)
    )
    x = UTM_SCALE * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + 500_000.0
    y = UTM_SCALE * (m + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return x, F.when(lat < 0, y + 10_000_000.0).otherwise(y)


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360 [I13]."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.least(F.pmod(a - b, F.lit(360.0)), F.pmod(b - a, F.lit(360.0)))


def slope_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction of a line, 0 to 180; 90 if it is vertical [I14]."""
    angle = F.degrees(F.atan(F.try_divide(y2 - y1, x2 - x1)))
    return F.when(x1 == x2, 90.0).otherwise(F.when(angle < 0, angle + 180).otherwise(angle))


def slope_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 90, 180 - d).otherwise(d)


def foot_of_perpendicular(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """(t, x, y): the foot on the line through two points and its place t; null for a segment of no length [I15]."""
    dx, dy = x2 - x1, y2 - y1
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    return t, x1 + t * dx, y1 + t * dy


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance to a segment; a segment of no length is a point [I17]."""
    t, _, _ = foot_of_perpendicular(px, py, x1, y1, x2, y2)
    t = F.when(t < 0, 0.0).when(t > 1, 1.0).otherwise(F.coalesce(t, F.lit(0.0)))
    return F.hypot(px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1)))


def beyond_view(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat0: Column, lon0: Column, reach: float = 0.0015) -> Column:
    """Whether both ends of a segment lie beyond the same side of the view box around a point [C18]."""
    sides = [(lat1 > lat0 + reach) & (lat2 > lat0 + reach), (lat1 < lat0 - reach) & (lat2 < lat0 - reach), (lon1 > lon0 + reach) & (lon2 > lon0 + reach), (lon1 < lon0 - reach) & (lon2 < lon0 - reach)]
    return sides[0] | sides[1] | sides[2] | sides[3]


def within_radius(lat: Column, lon: Column, lat0: Column, lon0: Column, metres: float = 1000.0) -> Column:
    """[C19]"""
    return haversine(lat, lon, lat0, lon0) <= metres


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays [I16]."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms; 0 if either is empty [I32]."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + x)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(total(a) * total(b))
    return F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(shared, norm))), F.lit(0.0))


def heading_factor(diff: Column) -> Column:
    """How well a heading fits an edge: wrong way, across, or the cosine [I18]."""
    return F.when(diff > 100, 1e-4).when(diff > 45, 0.1).otherwise(F.cos(F.radians(diff)))


def gaussian_emission(distance: Column, sigma: float = 15.0) -> Column:
    return F.exp(-0.5 * F.pow(distance / sigma, 2)) / (math.sqrt(2 * math.pi) * sigma)


def rms3(a: Column, b: Column, c: Column) -> Column:
    """Root of the summed squares of three deviations [I19]."""
    return F.sqrt(a * a + b * b + c * c)


def rotate(roll: Column, pitch: Column, yaw: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A vector under Rz(yaw) Ry(pitch) Rx(roll), angles in radians [I20]."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return (
        cy * cp * x + (cy * sp * sr - sy * cr) * y + (cy * sp * cr + sy * sr) * z,
        sy * cp * x + (sy * sp * sr + cy * cr) * y + (sy * sp * cr - cy * sr) * z,
        -sp * x + cp * sr * y + cp * cr * z,
    )


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """[I30]"""
    return a + alpha * (b - a)
