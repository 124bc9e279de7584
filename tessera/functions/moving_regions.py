"""Moving regions on Columns: arrays of units, each with the interval s, e, lc, rc and its corners.

A corner moves straight from (x1, y1) at s to (x2, y2) at e; a unit has one ring of corners, in order. At every instant the ring is that
of a region as in tessera.functions.geometry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.moving import interval, once, point_in_unit, unit_at, unit_point


def unit_region(s: Column, e: Column, first: Column, last: Column, lc: object = True, rc: object = False) -> Column:
    """A unit from a ring (array of points) at its start and one of as many corners at its end."""
    corners = F.zip_with(first, last, lambda p, q: g.segment(p["x"], p["y"], q["x"], q["y"]))
    return F.struct(*interval(s, e, lc, rc), corners.alias("corners"))


def _ring(u: Column, t: Column) -> Column:
    own = lambda c: point_in_unit(unit_point(u["s"], u["e"], c["x1"], c["y1"], c["x2"], c["y2"]), t)
    return F.transform(u["corners"], own)


def atinstant_region(units: Column, t: Column) -> Column:
    """The region at an instant, undefined outside the value's time."""
    return once(unit_at(units, t), lambda u: F.when(u.isNotNull(), F.array(_ring(u, t))))


def area_at(units: Column, t: Column) -> Column:
    return once(atinstant_region(units, t), g.area)


def inside_at(points: Column, regions: Column, t: Column) -> Column:
    """Whether a moving point is in a moving region at an instant."""
    place = once(unit_at(points, t), lambda u: point_in_unit(u, t))
    return once(F.struct(place.alias("p"), atinstant_region(regions, t).alias("r")), lambda both: g.inside(both["p"], both["r"]))


def region_trajectory_box(units: Column) -> Column:
    """The box (lo, hi) of all places that a moving region covers."""
    return g.bbox(F.flatten(F.transform(units, lambda u: u["corners"])))


def moved(region_ring: Column, s: Column, e: Column, dx: object, dy: object) -> Column:
    """A ring that moves by (dx, dy) from s to e, as a moving region of one unit."""
    return F.array(unit_region(s, e, region_ring, F.transform(region_ring, lambda p: g.point(p["x"] + dx, p["y"] + dy))))
