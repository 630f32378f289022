"""Geometries as structs: a type and parts of rings of points.

A point is one part with one ring of one point; a line one part with one ring; a polygon one part whose first ring is
the shell; multi-geometries have a part for each member.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
TYPE = f"struct<type:string,parts:array<array<array<{POINT}>>>>"

Ring = list[tuple[float, float]]


def from_geojson(g: dict | None):
    """A Python value of ``TYPE`` for a GeoJSON geometry; None for null."""
    if g is None:
        return None
    kind, c = g["type"], g.get("coordinates")
    pt = lambda p: (float(p[0]), float(p[1]))
    if kind == "Point":
        parts = [[[pt(c)]]] if c else []
    elif kind == "MultiPoint":
        parts = [[[pt(p)]] for p in c]
    elif kind == "LineString":
        parts = [[[pt(p) for p in c]]]
    elif kind == "MultiLineString":
        parts = [[[pt(p) for p in line]] for line in c]
    elif kind == "Polygon":
        parts = [[[pt(p) for p in r] for r in c]]
    elif kind == "MultiPolygon":
        parts = [[[pt(p) for p in r] for r in poly] for poly in c]
    else:
        raise TypeError(f"no geometry of type {kind!r}")
    return (kind, parts)


def to_geojson(g) -> dict:
    kind, parts = g[0], [[[[p[0], p[1]] for p in r] for r in part] for part in g[1]]
    one = {"Point": lambda p: p[0][0], "LineString": lambda p: p[0], "Polygon": lambda p: p}
    if kind in one:
        return {"type": kind, "coordinates": one[kind](parts[0]) if parts else []}
    return {"type": kind, "coordinates": [one[kind.removeprefix("Multi")](p) for p in parts]}


def polygons(mask) -> list[list[Ring]]:
    """The polygons (lists of rings) of a GeoJSON polygon, feature or collection, or of structs of ``TYPE``."""
    if isinstance(mask, str):
        mask = json.loads(mask)
    if isinstance(mask, dict):
        kind = mask.get("type")
        if kind == "FeatureCollection":
            return [p for f in mask["features"] if f.get("geometry") is not None for p in polygons(f)]
        if kind == "Feature":
            return polygons(mask["geometry"])
        if kind in ("Polygon", "MultiPolygon"):
            return from_geojson(mask)[1]
        raise TypeError(f"a polygon is needed, not {kind!r}")
    if isinstance(mask, tuple) and len(mask) == 2 and isinstance(mask[0], str):
        if mask[0] not in ("Polygon", "MultiPolygon"):
            raise TypeError(f"a polygon is needed, not {mask[0]!r}")
        return [list(p) for p in mask[1]]
    if isinstance(mask, Iterable):
        return [p for m in mask for p in polygons(m)]
    raise TypeError(f"no geometry: {type(mask).__name__}")


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def bbox(g: Column) -> dict[str, Column]:
    v = vertices(g)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def point(x: Column, y: Column) -> Column:
    p = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(p))).alias("parts"))


def contains(g: Column, x: Column, y: Column) -> Column:
    """Whether a polygon contains a point: by the parity of crossings over all rings, so holes count as outside."""

    def crossings(ring):
        n = F.size(ring)
        edges = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        cross = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
        return F.size(cross)

    return F.exists(g["parts"], lambda part: F.aggregate(part, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1)


def contains_fixed(shapes: list[list[Ring]], x: Column, y: Column) -> Column:
    """The same for a few polygons known while the plan is built: plain arithmetic, which is compiled."""
    out = F.lit(False)
    for rings in shapes:
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        parity = F.lit(0)
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
                if ay != by:
                    parity = parity + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
        out = out | (x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (parity % 2 == 1))
    return out


def hull(points: Iterable[tuple[float, float]]) -> Ring:
    """The convex hull, counter-clockwise, its first point again at the end."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return [*pts, *pts[:1]]

    def half(ps):
        out: Ring = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return [*ring, ring[0]]


def is_convex(ring: Ring) -> bool:
    pts = ring[:-1] if ring and ring[0] == ring[-1] else ring
    n, sign = len(pts), 0.0
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = pts[i], pts[(i + 1) % n], pts[(i + 2) % n]
        z = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        if z * sign < 0:
            return False
        sign = sign or z
    return True


def buffer_convex(points: Ring, distance: float, segments: int = 16) -> Ring:
    """The buffer of the convex hull of ``points``: offset edges joined by arcs; a negative distance clips inwards."""
    ring = hull(points)[:-1]
    if distance > 0:
        n = 4 * segments
        circle = [(distance * math.cos(2 * math.pi * i / n), distance * math.sin(2 * math.pi * i / n)) for i in range(n)]
        return hull((x + a, y + b) for x, y in ring for a, b in circle)
    out: Ring = ring
    n = len(ring)
    for i in range(n):
        (ax, ay), (bx, by) = ring[i], ring[(i + 1) % n]
        length = math.hypot(bx - ax, by - ay)
        nx, ny = -(by - ay) / length, (bx - ax) / length  # inwards of a counter-clockwise ring
        side = lambda p: (p[0] - ax) * nx + (p[1] - ay) * ny + distance  # noqa: B023, E731
        kept: Ring = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                kept.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        out = kept
        if not out:
            return []
    return [*out, out[0]] if len(out) > 2 else []
