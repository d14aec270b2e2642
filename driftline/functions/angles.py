"""Angles and local tangent-plane coordinates as column expressions.

Heading ``psi`` is counter-clockwise from east in radians; a compass course is clockwise from north in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def wrap_pi(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(TAU)) - math.pi


def compass_to_psi(course: Column) -> Column:
    return wrap_pi(math.pi / 2 - F.radians(course))


def psi_to_compass(psi: Column) -> Column:
    return F.pmod(F.degrees(math.pi / 2 - psi), F.lit(360.0))


def kmh_to_mps(speed: Column) -> Column:
    return speed / 3.6


def seconds_of_day(stamp: Column, skip: int = 11) -> Column:
    """Seconds of day of texts like ``2021-05-01 08-15-30_250``: the date is skipped, the rest split at ``- : _``."""
    parts = F.split(F.substring(stamp, skip + 1, 64), "[-:_]")
    part = lambda i: parts[i].cast("double")
    return part(0) * 3600 + part(1) * 60 + part(2) + F.coalesce(part(3), F.lit(0.0)) / 1000


def whole_hours(difference: Column) -> Column:
    """A clock difference rounded to whole hours, halves to even."""
    return F.bround(difference / 3600) * 3600


def ecef(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of geodetic ones in degrees and metres."""
    height = height if isinstance(height, Column) else F.lit(height)
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(la) * F.sin(la))
    return (n + height) * F.cos(la) * F.cos(lo), (n + height) * F.cos(la) * F.sin(lo), (n * (1 - WGS84_E2) + height) * F.sin(la)


def to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column, height: Column | float = 0.0) -> tuple[Column, Column]:
    """East and north in metres in the tangent plane at the origin."""
    x, y, z = ecef(lat, lon, height)
    x0, y0, z0 = ecef(lat0, lon0)
    dx, dy, dz = x - x0, y - y0, z - z0
    la, lo = F.radians(lat0), F.radians(lon0)
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    return east, north


def to_geodetic(east: Column, north: Column, lat0: Column, lon0: Column, rounds: int = 3) -> tuple[Column, Column]:
    """Latitude and longitude of a point of the tangent plane, by a fixed number of latitude iterations."""
    la, lo = F.radians(lat0), F.radians(lon0)
    x0, y0, z0 = ecef(lat0, lon0)
    x = x0 - F.sin(lo) * east - F.sin(la) * F.cos(lo) * north
    y = y0 + F.cos(lo) * east - F.sin(la) * F.sin(lo) * north
    z = z0 + F.cos(la) * north
    p = F.hypot(x, y)

    def nearer(lat: Column, _: Column) -> Column:
        n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
        return F.atan2(z + WGS84_E2 * n * F.sin(lat), p)

    # as an aggregate, since written out each round would hold the one before it three times
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(z, p * (1 - WGS84_E2)), nearer)
    return F.degrees(lat), F.degrees(F.atan2(y, x))


def flat_earth(lat: Column, lon: Column, lat0: float, lon0: float, metres_per_degree: float = 111_320.0) -> tuple[Column, Column]:
    """East and north by the flat-earth rule of the older engine; for comparison only."""
    return (lon - lon0) * metres_per_degree * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * metres_per_degree
