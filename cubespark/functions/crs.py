"""Coordinate systems: geographic degrees (EPSG:4326), web Mercator (3857) and the UTM zones, as Column math."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnitMismatch

R = 6378137.0
_F = 1 / 298.257223563
_E = math.sqrt(_F * (2 - _F))
_N = _F / (2 - _F)
_A = R / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0 = 0.9996


def epsg(crs) -> int:
    """The EPSG code of a number, ``EPSG:n``, or a WKT text with an authority code."""
    if isinstance(crs, int):
        return crs
    text = str(crs)
    if m := re.fullmatch(r"(?i)\s*(?:epsg:)?(\d+)\s*", text):
        return int(m[1])
    if codes := re.findall(r'(?:ID|AUTHORITY)\["EPSG",\s*"?(\d+)"?\]', text):
        return int(codes[-1])
    raise ValueError(f"no EPSG code in {text[:80]!r}")


def supported(code: int) -> bool:
    return code in (4326, 3857) or 32601 <= code <= 32660 or 32701 <= code <= 32760


def normal(crs) -> str:
    code = epsg(crs)
    if not supported(code):
        raise ValueError(f"EPSG:{code} is not supported: there are 4326, 3857 and UTM zones 326xx, 327xx")
    return f"EPSG:{code}"


def assert_metres(crs: str | None) -> None:
    if crs is None:
        raise UnitMismatch("the geometries have no coordinate system, so their unit is not known")
    if epsg(crs) == 4326:
        raise UnitMismatch("the geometries are in degrees; a distance in metres needs a projected system")


def _zone(code: int) -> tuple[float, float]:
    """Central meridian in radians and false northing."""
    return math.radians((code % 100) * 6 - 183), 10_000_000.0 if code >= 32700 else 0.0


def to_degrees(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return x, y
    if code == 3857:
        return F.degrees(x / R), F.degrees(2 * F.atan(F.exp(y / R)) - math.pi / 2)
    lon0, north = _zone(code)
    xi, eta = (y - north) / (_K0 * _A), (x - 500_000.0) / (_K0 * _A)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.lit(lon0) + F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def from_degrees(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    if code == 4326:
        return lon, lat
    if code == 3857:
        return F.radians(lon) * R, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * R
    lon0, north = _zone(code)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    dl = F.radians(lon) - lon0
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000.0 + _K0 * _A * x, north + _K0 * _A * y


def transform(x: Column, y: Column, source, target) -> tuple[Column, Column]:
    """Coordinates, always x before y, from one system to another."""
    a, b = epsg(normal(source)), epsg(normal(target))
    if a == b:
        return x, y
    return from_degrees(*to_degrees(x, y, a), b)


def transform_point(x: float, y: float, source, target) -> tuple[float, float]:
    """The same for two numbers, without Spark."""
    a, b = epsg(normal(source)), epsg(normal(target))
    if a == b:
        return x, y
    if a == 3857:
        x, y = math.degrees(x / R), math.degrees(2 * math.atan(math.exp(y / R)) - math.pi / 2)
    elif a != 4326:
        lon0, north = _zone(a)
        xi, eta = (y - north) / (_K0 * _A), (x - 500_000.0) / (_K0 * _A)
        u = xi - sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(_BETA, 1))
        v = eta - sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(_BETA, 1))
        chi = math.asin(math.sin(u) / math.cosh(v))
        x = math.degrees(lon0 + math.atan2(math.sinh(v), math.cos(u)))
        y = math.degrees(chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(_DELTA, 1)))
    if b == 4326:
        return x, y
    if b == 3857:
        return math.radians(x) * R, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * R
    lon0, north = _zone(b)
    s = math.sin(math.radians(y))
    t = math.sinh(math.atanh(s) - _E * math.atanh(_E * s))
    dl = math.radians(x) - lon0
    xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
    u = eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(_ALPHA, 1))
    v = xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(_ALPHA, 1))
    return 500_000.0 + _K0 * _A * u, north + _K0 * _A * v


def transform_bbox(bbox, source, target) -> tuple[float, float, float, float]:
    """The envelope of a box's four corners."""
    w, s, e, n = bbox
    pts = [transform_point(x, y, source, target) for x in (w, e) for y in (s, n)]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


def common_epsg(items: list[dict], default: int = 4326) -> int:
    """The one code that all items with a code share, else ``default``."""
    codes = set()
    for i in items:
        p = i.get("properties", {})
        code = p.get("proj:code") or p.get("proj:epsg")
        if code:
            codes.add(epsg(code))
    return codes.pop() if len(codes) == 1 else default
