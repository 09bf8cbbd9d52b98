"""Coordinates: geodetic degrees and earth-centred metres, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84 semi-major axis in metres and first eccentricity: fixed values.
AXIS, ECCENTRICITY = 6378137.0, 8.1819190842622e-2
_E2 = ECCENTRICITY**2
_B = (AXIS**2 * (1 - _E2)) ** 0.5
_EP2 = (AXIS**2 - _B**2) / _B**2


def _radius(lat: Column) -> Column:
    return AXIS / F.sqrt(1 - _E2 * F.sin(lat) * F.sin(lat))


def lla_to_ecef(lat: Column, lon: Column, alt: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """(x, y, z) in metres of degrees and metres above the ellipsoid."""
    phi, lam, alt = F.radians(lat), F.radians(lon), alt if isinstance(alt, Column) else F.lit(float(alt))
    n = _radius(phi)
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), ((1 - _E2) * n + alt) * F.sin(phi)


def ecef_to_lla(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(lat, lon, alt): closed form, one step."""
    p = F.sqrt(x * x + y * y)
    th = F.atan2(z * AXIS, p * _B)
    lat = F.atan2(z + _EP2 * _B * F.pow(F.sin(th), 3), p - _E2 * AXIS * F.pow(F.cos(th), 3))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - _radius(lat)


def surface_point(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The point at sea level under (or over) an earth-centred point."""
    lat, lon, _ = ecef_to_lla(x, y, z)
    return lla_to_ecef(lat, lon)


def square_dist(a, b) -> Column:
    """Sum of squared differences of two equally long lists of columns, or of two array columns.

    Arrays of unequal length raise when the row is read.
    """
    if isinstance(a, Column):
        total = F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)
        return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))
    if len(a) != len(b):
        raise ValueError("vectors differ in size")
    total = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        total = total + (p - q) * (p - q)
    return total
