"""Planar geometry on Columns, in generated code: points, lines, regions.

A point is struct(x, y), a segment struct(x1, y1, x2, y2), a line an array of segments, a region an array of rings, each an array
of points without the first one repeated at the end; a point is inside a region if it is inside an odd number of rings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segment(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def distance(p: Column, q: Column) -> Column:
    """Of two points."""
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def direction(p: Column, q: Column) -> Column:
    """Angle of the way from p to q in degrees from 0 to 360; undefined for equal points."""
    angle = F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))
    return F.when((p["x"] != q["x"]) | (p["y"] != q["y"]), F.when(angle < 0, angle + 360).otherwise(angle))


def polyline(points: Column) -> Column:
    """Segments between successive points."""
    n = F.size(points)
    return F.when(n >= 2, F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1),
        lambda p, q: segment(p["x"], p["y"], q["x"], q["y"]))).otherwise(F.array())


def edges(ring: Column) -> Column:
    """Segments of a closed ring."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: segment(p["x"], p["y"], q["x"], q["y"]))


def length(line: Column) -> Column:
    return F.aggregate(line, F.lit(0.0), lambda s, e: s + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def ring_area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2))


def area(region: Column) -> Column:
    """The first ring is the outside; the others are holes in it."""
    areas = F.transform(region, ring_area)
    return F.when(F.size(region) > 0, 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)).when(region.isNotNull(), 0.0)


def region_perimeter(region: Column) -> Column:
    return F.aggregate(F.transform(region, lambda r: length(edges(r))), F.lit(0.0), lambda s, a: s + a)


def bbox(line: Column) -> Column:
    """struct(lo, hi) of a line's segments."""
    xs = F.concat(F.transform(line, lambda e: e["x1"]), F.transform(line, lambda e: e["x2"]))
    ys = F.concat(F.transform(line, lambda e: e["y1"]), F.transform(line, lambda e: e["y2"]))
    return F.struct(F.array(F.array_min(xs), F.array_min(ys)).alias("lo"), F.array(F.array_max(xs), F.array_max(ys)).alias("hi"))


def region_bbox(region: Column) -> Column:
    return bbox(F.flatten(F.transform(region, edges)))


def inside(p: Column, region: Column) -> Column:
    """Point in region by the number of edges to its right; points on a border fall to the lower left side."""
    crosses = lambda e: ((e["y1"] > p["y"]) != (e["y2"] > p["y"])) & (p["x"] < (e["x2"] - e["x1"]) * (p["y"] - e["y1"]) / F.nullif(e["y2"] - e["y1"],
        F.lit(0.0)) + e["x1"])
    return F.size(F.filter(F.flatten(F.transform(region, edges)), crosses)) % 2 == 1


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segments have a common point."""
    t1, t2 = _turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"]), _turn(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    t3, t4 = _turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"]), _turn(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    over = lambda u, v: (F.least(a[u], a[v]) <= F.greatest(b[u], b[v])) & (F.least(b[u], b[v]) <= F.greatest(a[u], a[v]))
    return (t1 * t2 <= 0) & (t3 * t4 <= 0) & over("x1", "x2") & over("y1", "y2")


def lines_intersect(a: Column, b: Column) -> Column:
    return F.exists(a, lambda e: F.exists(b, lambda f: segments_meet(e, f)))


def regions_intersect(a: Column, b: Column) -> Column:
    """Borders meet, or one region holds a corner of the other."""
    ea, eb = (F.flatten(F.transform(r, edges)) for r in (a, b))
    return lines_intersect(ea, eb) | inside(a[0][0], b) | inside(b[0][0], a)


def point_segment_distance(p: Column, e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = F.coalesce(F.least(F.greatest(((p["x"] - e["x1"]) * dx + (p["y"] - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)),
        F.lit(1.0)), F.lit(0.0))
    return F.hypot(p["x"] - e["x1"] - along * dx, p["y"] - e["y1"] - along * dy)


def point_line_distance(p: Column, line: Column) -> Column:
    return F.array_min(F.transform(line, lambda e: point_segment_distance(p, e)))


def utm(lat: Column, lon: Column) -> Column:
    """Easting and northing in metres, zone by longitude (WGS84, Krueger's series to the third order)."""
    zone = F.floor((lon + 180) / 6) + 1
    return _mercator(lat, lon, zone * 6 - 183, 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, zone)


def gauss_krueger(lat: Column, lon: Column) -> Column:
    """Easting and northing in 3-degree zones on the Bessel ellipsoid, without a change of datum."""
    zone = F.floor((lon + 1.5) / 3)
    out = _mercator(lat, lon, zone * 3, 6_377_397.155, 1 / 299.1528128, 1.0, 500_000.0, zone)
    return F.struct((out["x"] + zone * 1_000_000).alias("x"), out["y"].alias("y"), zone.alias("zone"))


def _mercator(lat: Column, lon: Column, centre: Column, a: float, f: float, scale: float, east: float, zone: Column) -> Column:
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - centre)
    e = 2 * n**0.5 / (1 + n)
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((east + scale * radius * x).alias("x"), (scale * radius * y).alias("y"), zone.alias("zone"))


POINTS = "array<struct<x:double,y:double>>"


def _on_points(f: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf(POINTS)
    def udf(points: pd.Series) -> pd.Series:
        out = []
        for ps in points:
            if ps is None:
                out.append(None)
                continue
            xy = np.array([(p["x"], p["y"]) for p in ps], float).reshape(-1, 2)
            out.append([{"x": float(x), "y": float(y)} for x, y in f(xy)])
        return pd.Series(out)

    return udf


def _hull(xy: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, xy)))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)
    half = []
    for row in (pts, pts[::-1]):
        chain: list = []
        for p in row:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        half += chain[:-1]
    return np.array(half, float)


def convex_hull(points: Column) -> Column:
    """Corners of the convex hull against the clock, from the least one."""
    return _on_points(_hull)(points)


def simplify(points: Column, tolerance: float) -> Column:
    """Douglas-Peucker simplification of a polyline."""

    def run(xy: np.ndarray) -> np.ndarray:
        keep, stack = {0, max(0, len(xy) - 1)}, [(0, len(xy) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d = xy[b] - xy[a]
            rel = xy[a + 1 : b] - xy[a]
            size = float(d @ d)
            along = np.clip(rel @ d / size, 0, 1)[:, None] if size else np.zeros((len(rel), 1))
            away = np.linalg.norm(rel - along * d, axis=1)
            if away.max() > tolerance:
                m = a + 1 + int(away.argmax())
                keep.add(m)
                stack += [(a, m), (m, b)]
        return xy[sorted(keep)] if len(xy) else xy

    return _on_points(run)(points)


# Moving things about, and places along lines


def translate(line: Column, dx: object, dy: object) -> Column:
    return F.transform(line, lambda e: segment(e["x1"] + dx, e["y1"] + dy, e["x2"] + dx, e["y2"] + dy))


def scale(line: Column, factor: object) -> Column:
    return F.transform(line, lambda e: segment(e["x1"] * factor, e["y1"] * factor, e["x2"] * factor, e["y2"] * factor))


def rotate(line: Column, x: float, y: float, degrees: float) -> Column:
    """Against the clock around (x, y)."""
    a = np.radians(degrees)
    turn = lambda u, v: (x + (u - x) * float(np.cos(a)) - (v - y) * float(np.sin(a)), y + (u - x) * float(np.sin(a)) + (v - y) * float(np.cos(a)))
    return F.transform(line, lambda e: segment(*turn(e["x1"], e["y1"]), *turn(e["x2"], e["y2"])))


def crossings(a: Column, b: Column) -> Column:
    """Points at which segments of two lines cross or touch (parallel ones have none), as an array."""

    def cut(e: Column, f: Column) -> Column:
        dx, dy, fx, fy = e["x2"] - e["x1"], e["y2"] - e["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]
        cross = F.nullif(dx * fy - dy * fx, F.lit(0.0))
        t = ((f["x1"] - e["x1"]) * fy - (f["y1"] - e["y1"]) * fx) / cross
        s = ((f["x1"] - e["x1"]) * dy - (f["y1"] - e["y1"]) * dx) / cross
        return F.when((t >= 0) & (t <= 1) & (s >= 0) & (s <= 1), point(e["x1"] + t * dx, e["y1"] + t * dy))

    return F.array_distinct(F.filter(F.flatten(F.transform(a, lambda e: F.transform(b, lambda f: cut(e, f)))), lambda p: p.isNotNull()))


def line_at(line: Column, position: Column) -> Column:
    """The point at a distance along a line of joined segments; undefined beyond its ends."""
    seen = F.transform(line, lambda e, i: F.struct(length(F.slice(line, F.lit(1), i)).alias("from"),
        F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]).alias("size"), e.alias("e")))
    own = F.get(F.filter(seen, lambda s: (position >= s["from"]) & (position <= s["from"] + s["size"])), F.lit(0))
    f = (position - own["from"]) / F.nullif(own["size"], F.lit(0.0))
    return F.when(own.isNotNull(), point(own["e"]["x1"] + F.coalesce(f, F.lit(0.0)) * (own["e"]["x2"] - own["e"]["x1"]),
        own["e"]["y1"] + F.coalesce(f, F.lit(0.0)) * (own["e"]["y2"] - own["e"]["y1"])))


def line_locate(line: Column, p: Column) -> Column:
    """Distance along a line of its place nearest to a point."""

    def place(e: Column, i: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        size = F.hypot(dx, dy)
        along = F.coalesce(F.least(F.greatest(((p["x"] - e["x1"]) * dx + (p["y"] - e["y1"]) * dy) / F.nullif(size * size, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
            F.lit(0.0))
        return F.struct(point_segment_distance(p, e).alias("away"), (length(F.slice(line, F.lit(1), i)) + along * size).alias("at"))

    return F.array_min(F.transform(line, place))["at"]


def distance_within(p: Column, q: Column, most: float) -> Column:
    """Whether two points are at most so far apart."""
    return distance(p, q) <= most


def components(line: Column) -> Column:
    """The connected parts of a line, each a line, by common ends of segments."""

    @F.pandas_udf("array<array<struct<x1:double,y1:double,x2:double,y2:double>>>")
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for segments in lines:
            if segments is None:
                out.append(None)
                continue
            parent: dict = {}

            def root(x, parent=parent):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for e in segments:
                parent[root((e["x1"], e["y1"]))] = root((e["x2"], e["y2"]))
            parts: dict = {}
            for e in segments:
                parts.setdefault(root((e["x1"], e["y1"])), []).append(e)
            out.append(list(parts.values()))
        return pd.Series(out)

    return run(line)
