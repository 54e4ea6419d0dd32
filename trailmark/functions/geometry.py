"""Column expressions for angles and local coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def wrap_degrees(angle: Column) -> Column:
    """Into [-180, 180), by the floor."""
    return angle + 180 - 360 * F.floor((angle + 180) / 360) - 180


def enu(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north of an origin, in metres, on a sphere (equirectangular)."""
    return F.radians(lon - lon0) * math.cos(math.radians(lat0)) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M


def geodetic(east: Column, north: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of a place east and north of an origin: the inverse of enu()."""
    return lat0 + F.degrees(north / EARTH_RADIUS_M), lon0 + F.degrees(east / (EARTH_RADIUS_M * math.cos(math.radians(lat0))))


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)


def pixel_to_latlon(px: Column, py: Column, north: Column, south: Column, west: Column, east: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel, linear within the image's bounds; row 0 is the north edge."""
    return north - py / height * (north - south), west + px / width * (east - west)


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography, given by rows."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def yaw_degrees(qx: Column, qy: Column, qz: Column, qw: Column) -> Column:
    """The first extrinsic zyx angle of a unit quaternion."""
    return F.degrees(F.atan2(2 * (qw * qz - qx * qy), 1 - 2 * (qy * qy + qz * qz)))


def unit(q: list[Column]) -> list[Column]:
    """A quaternion of length one; the identity for one of no length."""
    norm = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    return [F.when(norm <= 1e-9, 1.0 if i == 3 else 0.0).otherwise(x / norm) for i, x in enumerate(q)]


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product of quaternions in the order x, y, z, w."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return [aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz]


def blend(a: list[Column], b: list[Column], weight: Column) -> list[Column]:
    """(1 - weight) a + weight b, with b's sign turned to a's side, to length one."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    return unit([(1 - weight) * x + weight * sign * y for x, y in zip(a, b, strict=True)])


def parabola(left: Column, peak: Column, right: Column) -> Column:
    """Offset of a parabola's top from the middle of three samples, within half a sample; 0 if they are flat."""
    bend = left - 2 * peak + right
    return F.when(F.abs(bend) < 1e-12, 0.0).otherwise(F.least(F.greatest(0.5 * (left - right) / bend, F.lit(-0.5)), F.lit(0.5)))


def signed_index(index: Column, size: Column) -> Column:
    """The index of a circular axis as a signed shift."""
    return F.when(index > F.floor(size / 2), index - size).otherwise(index)


def rotate(q: list[Column], v: list[Column]) -> list[Column]:
    """A vector turned by the unit quaternion q."""
    return rotate_back([-q[0], -q[1], -q[2], q[3]], v)


def rotate_back(q: list[Column], v: list[Column]) -> list[Column]:
    """A vector seen from the frame that the unit quaternion q turns: the inverse rotation."""
    inverse = [-q[0], -q[1], -q[2], q[3]]
    return multiply(multiply(inverse, [*v, F.lit(0.0)]), q)[:3]


def rotation_vector(q: list[Column]) -> list[Column]:
    """Axis times angle, at most half a turn, of a unit quaternion."""
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    size = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    scale = F.when(size < 1e-12, 2.0).otherwise(2 * F.atan2(size, F.abs(q[3])) / F.nullif(size, F.lit(0.0)))
    return [sign * scale * x for x in q[:3]]
