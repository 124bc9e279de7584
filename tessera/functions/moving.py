"""Moving values on Columns, in generated code.

A moving value is an array of units in the order of time; a unit is a struct with the interval s, e (timestamps; null: open end), lc, rc
(whether the ends belong to it) and its parameters: v for a constant, a, b, c, r for a real (a t^2 + b t + c with t in days since s,
and the square root of that if r), x1, y1, x2, y2 for a point that moves straight. Intervals of a value don't overlap. A period set
is an array of s, e, lc, rc.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

DAY = 86_400.0


def seconds(t: Column) -> Column:
    return t.cast("timestamp").cast("double")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def interval(s: Column, e: Column, lc: object = True, rc: object = False) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [s.cast("timestamp").alias("s"), e.cast("timestamp").alias("e"), lit(lc).alias("lc"), lit(rc).alias("rc")]


def unit_const(s: Column, e: Column, v: Column, lc: object = True, rc: object = False) -> Column:
    return F.struct(*interval(s, e, lc, rc), v.alias("v"))


def unit_point(s: Column, e: Column, x1: Column, y1: Column, x2: Column, y2: Column, lc: object = True, rc: object = False) -> Column:
    return F.struct(*interval(s, e, lc, rc), *(c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def unit_real(s: Column, e: Column, a: Column, b: Column, c: Column, r: object = False, lc: object = True, rc: object = False) -> Column:
    return F.struct(*interval(s, e, lc, rc), *(x.cast("double").alias(n) for x, n in zip((a, b, c), "abc", strict=True)),
        (r if isinstance(r, Column) else F.lit(r)).alias("r"))


def covers(u: Column, t: Column) -> Column:
    """Whether the unit's interval holds the instant."""
    after = u["s"].isNull() | (t > u["s"]) | (u["lc"] & (t == u["s"]))
    before = u["e"].isNull() | (t < u["e"]) | (u["rc"] & (t == u["e"]))
    return after & before


def unit_at(units: Column, t: Column) -> Column:
    """The unit at an instant, or null."""
    return F.get(F.filter(units, lambda u: covers(u, t)), F.lit(0))


def _share(u: Column, t: Column) -> Column:
    return F.coalesce((seconds(t) - seconds(u["s"])) / F.nullif(seconds(u["e"]) - seconds(u["s"]), F.lit(0.0)), F.lit(0.0))


def point_in_unit(u: Column, t: Column) -> Column:
    f = _share(u, t)
    return F.when(u.isNotNull(), F.struct((u["x1"] + (u["x2"] - u["x1"]) * f).alias("x"), (u["y1"] + (u["y2"] - u["y1"]) * f).alias("y")))


def real_in_unit(u: Column, t: Column) -> Column:
    d = (seconds(t) - seconds(u["s"])) / DAY
    v = u["a"] * d * d + u["b"] * d + u["c"]
    return F.when(u["r"], F.sqrt(F.greatest(v, F.lit(0.0)))).otherwise(v)


def atinstant_point(units: Column, t: Column) -> Column:
    return point_in_unit(unit_at(units, t), t)


def atinstant_real(units: Column, t: Column) -> Column:
    return real_in_unit(unit_at(units, t), t)


def atinstant(units: Column, t: Column) -> Column:
    """Of a value that is constant in its units."""
    return unit_at(units, t)["v"]


def present(units: Column, t: Column) -> Column:
    return F.exists(units, lambda u: covers(u, t))


def deftime(units: Column) -> Column:
    """Periods at which the value is defined; intervals that touch are joined."""
    start = F.array().cast("array<struct<s:timestamp,e:timestamp,lc:boolean,rc:boolean>>")

    def step(acc: Column, u: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.struct(u["s"].alias("s"), u["e"].alias("e"), u["lc"].alias("lc"), u["rc"].alias("rc"))
        joined = F.struct(last["s"].alias("s"), u["e"].alias("e"), last["lc"].alias("lc"), u["rc"].alias("rc"))
        touches = (F.size(acc) > 0) & (last["e"] == u["s"]) & (last["rc"] | u["lc"])
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(own)))

    safe = F.when(F.size(units) > 0, units)
    return F.coalesce(F.aggregate(safe, start,
        lambda acc, u: F.when(F.size(acc) == 0,
            F.array(F.struct(u["s"].alias("s"), u["e"].alias("e"), u["lc"].alias("lc"), u["rc"].alias("rc")))).otherwise(step(F.when(F.size(acc) > 0, acc),
                u))), start)


def duration(units: Column) -> Column:
    """Seconds over which the value is defined."""
    return F.aggregate(units, F.lit(0.0), lambda s, u: s + seconds(u["e"]) - seconds(u["s"]))


def initial_point(units: Column) -> Column:
    u = F.get(units, F.lit(0))
    return F.when(u.isNotNull(), F.struct(u["s"].alias("inst"), F.struct(u["x1"].alias("x"), u["y1"].alias("y")).alias("val")))


def final_point(units: Column) -> Column:
    u = F.get(units, F.size(units) - 1)
    return F.when(u.isNotNull(), F.struct(u["e"].alias("inst"), F.struct(u["x2"].alias("x"), u["y2"].alias("y")).alias("val")))


def initial(units: Column) -> Column:
    u = F.get(units, F.lit(0))
    return F.when(u.isNotNull(), F.struct(u["s"].alias("inst"), u["v"].alias("val")))


def final(units: Column) -> Column:
    u = F.get(units, F.size(units) - 1)
    return F.when(u.isNotNull(), F.struct(u["e"].alias("inst"), u["v"].alias("val")))


def _clip(u: Column, p: Column, rebuilt: Callable[[Column, Column, Column, Column, Column], Column]) -> Column:
    s = F.when(p["s"].isNull() | (u["s"] > p["s"]), u["s"]).otherwise(F.coalesce(p["s"], u["s"]))
    e = F.when(p["e"].isNull() | (u["e"] < p["e"]), u["e"]).otherwise(F.coalesce(p["e"], u["e"]))
    lc = F.when(u["s"] == p["s"], u["lc"] & p["lc"]).when(p["s"].isNull() | (u["s"] > p["s"]), u["lc"]).otherwise(p["lc"])
    rc = F.when(u["e"] == p["e"], u["rc"] & p["rc"]).when(p["e"].isNull() | (u["e"] < p["e"]), u["rc"]).otherwise(p["rc"])
    return F.when((s < e) | ((s == e) & lc & rc), rebuilt(u, s, e, lc, rc))


def _clipped(units: Column, periods: Column, rebuilt: Callable) -> Column:
    pieces = F.flatten(F.transform(units, lambda u: F.transform(periods, lambda p: _clip(u, p, rebuilt))))
    return F.filter(pieces, lambda u: u.isNotNull())


def atperiods(units: Column, periods: Column) -> Column:
    """Restrict a value of constant units."""
    return _clipped(units, periods, lambda u, s, e, lc, rc: unit_const(s, e, u["v"], lc, rc))


def atperiods_point(units: Column, periods: Column) -> Column:
    def rebuilt(u: Column, s: Column, e: Column, lc: Column, rc: Column) -> Column:
        p, q = point_in_unit(u, s), point_in_unit(u, e)
        return unit_point(s, e, p["x"], p["y"], q["x"], q["y"], lc, rc)

    return _clipped(units, periods, rebuilt)


def at(units: Column, value: object) -> Column:
    """Restrict a value of constant units to the times at which it has that value."""
    return F.filter(units, lambda u: u["v"] == value)


def passes(units: Column, value: object) -> Column:
    return F.exists(units, lambda u: u["v"] == value)


def when_true(flags: Column) -> Column:
    """Periods at which a moving bool is true."""
    return deftime(F.filter(flags, lambda u: u["v"]))


def sometimes(flags: Column) -> Column:
    return F.exists(flags, lambda u: u["v"])


def always(flags: Column) -> Column:
    return F.forall(flags, lambda u: u["v"])


def lifted(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of two values of constant units over their common times: both are refined to common intervals."""
    pieces = F.flatten(F.transform(a, lambda u: F.transform(b, lambda w: _clip(u, w, lambda x, s, e, lc, rc: unit_const(s, e, f(x["v"], w["v"]), lc, rc)))))
    return F.filter(pieces, lambda u: u.isNotNull())


def compact(units: Column) -> Column:
    """Join neighbouring units of the same constant value."""
    same = lambda x, y: (x["e"] == y["s"]) & (x["rc"] | y["lc"]) & x["v"].eqNullSafe(y["v"])
    joined = lambda x, y: unit_const(x["s"], y["e"], x["v"], x["lc"], y["rc"])
    rest = F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0)))
    first = F.transform(F.slice(units, 1, 1), lambda u: unit_const(u["s"], u["e"], u["v"], u["lc"], u["rc"]))

    def step(acc: Column, u: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(same(last, u), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined(last, u)))).otherwise(F.concat(acc,
            F.array(unit_const(u["s"], u["e"], u["v"], u["lc"], u["rc"]))))

    return F.when(F.size(units) > 0, F.aggregate(rest, first, step)).otherwise(units)


def trajectory(units: Column) -> Column:
    """Segments that a moving point covers."""
    moved = F.filter(units, lambda u: (u["x1"] != u["x2"]) | (u["y1"] != u["y2"]))
    return F.transform(moved, lambda u: F.struct(*(u[n].alias(n) for n in ("x1", "y1", "x2", "y2"))))


def travelled(units: Column) -> Column:
    """Length of the way of a moving point."""
    return F.aggregate(units, F.lit(0.0), lambda s, u: s + F.hypot(u["x2"] - u["x1"], u["y2"] - u["y1"]))


def speed(units: Column) -> Column:
    """Moving real: units of length a second."""
    span = lambda u: F.nullif(seconds(u["e"]) - seconds(u["s"]), F.lit(0.0))
    return F.transform(units, lambda u: unit_real(u["s"], u["e"], F.lit(0.0), F.lit(0.0), F.hypot(u["x2"] - u["x1"], u["y2"] - u["y1"]) / span(u), False,
        u["lc"], u["rc"]))


def velocity(units: Column) -> Column:
    """Moving point of the constant velocity in each unit."""
    span = lambda u: F.nullif(seconds(u["e"]) - seconds(u["s"]), F.lit(0.0))
    vx, vy = (lambda u: (u["x2"] - u["x1"]) / span(u)), (lambda u: (u["y2"] - u["y1"]) / span(u))
    return F.transform(units, lambda u: unit_point(u["s"], u["e"], vx(u), vy(u), vx(u), vy(u), u["lc"], u["rc"]))


def derivative(units: Column) -> Column:
    """Of a moving real, per day; units under a square root have none."""
    plain = F.filter(units, lambda u: ~u["r"])
    return F.transform(plain, lambda u: unit_real(u["s"], u["e"], F.lit(0.0), 2 * u["a"], u["b"], False, u["lc"], u["rc"]))


def distance_to(units: Column, x: Column, y: Column) -> Column:
    """Distance of a moving point from a fixed one, as moving real (the root of a quadratic)."""

    def one(u: Column) -> Column:
        days = F.nullif((seconds(u["e"]) - seconds(u["s"])) / DAY, F.lit(0.0))
        vx, vy = F.coalesce((u["x2"] - u["x1"]) / days, F.lit(0.0)), F.coalesce((u["y2"] - u["y1"]) / days, F.lit(0.0))
        dx, dy = u["x1"] - x, u["y1"] - y
        return unit_real(u["s"], u["e"], vx * vx + vy * vy, 2 * (vx * dx + vy * dy), dx * dx + dy * dy, True, u["lc"], u["rc"])

    return F.transform(units, one)


def _extreme(u: Column, low: bool) -> Column:
    days = (seconds(u["e"]) - seconds(u["s"])) / DAY
    value = lambda d: F.when(u["r"],
        F.sqrt(F.greatest(u["a"] * d * d + u["b"] * d + u["c"], F.lit(0.0)))).otherwise(u["a"] * d * d + u["b"] * d + u["c"])
    turn = F.least(F.greatest(F.coalesce(-u["b"] / (2 * F.nullif(u["a"], F.lit(0.0))), F.lit(0.0)), F.lit(0.0)), days)
    return (F.least if low else F.greatest)(value(F.lit(0.0)), value(days), value(turn))


def minimum(units: Column) -> Column:
    """Least value of a moving real."""
    return F.array_min(F.transform(units, lambda u: _extreme(u, True)))


def maximum(units: Column) -> Column:
    return F.array_max(F.transform(units, lambda u: _extreme(u, False)))


def _at_extreme(units: Column, low: bool) -> Column:
    """Units in which the value's extreme is reached: each unit's own is found once, and the least or greatest of them once."""
    own = F.transform(units, lambda u: F.struct(_extreme(u, low).alias("v"), u.alias("u")))
    ends = lambda ks: (F.array_min if low else F.array_max)(F.transform(ks, lambda k: k["v"]))
    both = once(own, lambda ks: F.struct(ks.alias("ks"), ends(ks).alias("end")))
    return once(both, lambda p: F.transform(F.filter(p["ks"], lambda k: k["v"] == p["end"]), lambda k: k["u"]))


def atmax(units: Column) -> Column:
    """Units in which the greatest value is reached."""
    return _at_extreme(units, False)


def atmin(units: Column) -> Column:
    return _at_extreme(units, True)


def ever_nearer_than(units: Column, x: Column, y: Column, d: float) -> Column:
    return minimum(distance_to(units, x, y)) < d


def trips(df: DataFrame, ident: list[str], t: str, x: str, y: str, gap_seconds: float | None = None) -> DataFrame:
    """Moving points from positions: ident, trip (0, 1, ...), units; a longer gap than gap_seconds ends a trip.

    Positions of an object at the same instant count once (the least). An object's positions are gathered in one row, as a moving value is.
    """
    places = df.groupBy(*ident, t).agg(F.min(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("p"))
    w = Window.partitionBy(*ident).orderBy(t)
    steps = places.withColumns({"_next": F.lead("p").over(w), "_until": F.lead(t).over(w), "_from": F.lag(t).over(w)})
    late = F.lit(False) if gap_seconds is None else seconds(F.col(t)) - seconds(F.col("_from")) > gap_seconds
    steps = steps.withColumn("trip", F.sum(F.when(late, 1).otherwise(0)).over(w))
    if gap_seconds is not None:
        steps = steps.filter(seconds(F.col("_until")) - seconds(F.col(t)) <= gap_seconds)
    steps = steps.filter(F.col("_until").isNotNull())
    unit = unit_point(F.col(t), F.col("_until"), F.col("p.x"), F.col("p.y"), F.col("_next.x"), F.col("_next.y"))
    return steps.groupBy(*ident, "trip").agg(F.array_sort(F.collect_list(unit)).alias("units"))


def labels(df: DataFrame, ident: list[str], t: str, label: str) -> DataFrame:
    """Symbolic trajectories: ident, units with each label until the next one begins; runs of one label are one unit, the last has no end."""
    w = Window.partitionBy(*ident).orderBy(t, label)
    marked = df.withColumn("_new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)).filter("_new = 1")
    unit = unit_const(F.col(t), F.lead(t).over(w), F.col(label))
    return marked.withColumn("_u", unit).groupBy(*ident).agg(F.array_sort(F.collect_list("_u")).alias("units"))


def matches(units: Column, pattern: str) -> Column:
    """Whether a whole symbolic trajectory matches: labels, `_` for any one, `*` for any number, `(a | b)` and `+` as in regular expressions."""
    words = re.findall(r"[()|+?]|\*|[^\s()|+?*]+", pattern)
    regex = "".join({"_": "[^;]*;", "*": "(?:[^;]*;)*", "(": "(?:", ")": ")", "|": "|", "+": "+", "?": "?"}.get(w) or f"(?:{re.escape(w)};)" for w in words)
    return F.concat(F.array_join(F.transform(units, lambda u: F.coalesce(u["v"].cast("string"), F.lit(""))), ";"), F.lit(";")).rlike(f"^(?:{regex})$")


def rewrite(units: Column, labels: list[str], replacement: str) -> Column:
    """The first place at which these labels follow one another becomes one unit with the replacement, over the same time; undefined if there is none."""
    n = len(labels)
    fits = lambda i: F.transform(F.slice(units, i + 1, n), lambda u: u["v"]) == F.array(*map(F.lit, labels))
    places = F.when(F.size(units) >= n, F.filter(F.sequence(F.lit(0), F.size(units) - n), fits))
    at = F.get(places, F.lit(0))
    first, last = F.get(units, at), F.get(units, at + n - 1)
    whole = lambda us: F.transform(us, lambda u: unit_const(u["s"], u["e"], u["v"], u["lc"], u["rc"]))
    joined = F.array(unit_const(first["s"], last["e"], F.lit(replacement), first["lc"], last["rc"]))
    return F.when(at.isNotNull(), F.concat(whole(F.slice(units, F.lit(1), at)), joined, whole(F.slice(units, at + n + 1, F.size(units)))))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Frechet distance of two arrays of points (x, y)."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            if p is None or q is None or not len(p) or not len(q):
                out.append(None)
                continue
            x, y = (np.array([(k["x"], k["y"]) for k in s]) for s in (p, q))
            d = np.linalg.norm(x[:, None] - y[None, :], axis=2)
            row = np.maximum.accumulate(d[0])
            for i in range(1, len(d)):
                new = np.empty_like(row)
                new[0] = max(row[0], d[i, 0])
                for j in range(1, len(row)):
                    new[j] = max(min(row[j], row[j - 1], new[j - 1]), d[i, j])
                row = new
            out.append(float(row[-1]))
        return pd.Series(out)

    return F.pandas_udf(run, DoubleType())(a, b)


def lcss(eps: float) -> Callable[[Column, Column], Column]:
    """Longest common subsequence of two arrays of points, as share of the shorter one; points are common within eps in both coordinates."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            if p is None or q is None or not len(p) or not len(q):
                out.append(None)
                continue
            x, y = (np.array([(k["x"], k["y"]) for k in s]) for s in (p, q))
            near = (np.abs(x[:, None] - y[None, :]) <= eps).all(2)
            row = np.zeros(len(y) + 1, int)
            for i in range(len(x)):
                new = np.maximum(row[1:], np.where(near[i], row[:-1] + 1, 0))
                row[1:] = np.maximum.accumulate(new)
            out.append(float(row[-1]) / min(len(x), len(y)))
        return pd.Series(out)

    return lambda a, b: F.pandas_udf(run, DoubleType())(a, b)


def repeated(units: Column, period_seconds: object, times: int) -> Column:
    """A periodic value: constant units, shifted by the period so many times (the first time by none)."""
    shift = lambda t, i: F.timestamp_micros((F.unix_micros(t) + i.cast("long") * F.lit(period_seconds) * F.lit(1_000_000).cast("long")).cast("long"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(times - 1)),
        lambda i: F.transform(units, lambda u: unit_const(shift(u["s"], i), shift(u["e"], i), u["v"], u["lc"], u["rc"]))))


def the_period(year: int, month: int | None = None, day: int | None = None, hour: int | None = None) -> Column:
    """The period set of one year, month, day or hour."""
    step = "hour" if hour is not None else "day" if day is not None else "month" if month is not None else "year"
    start = F.make_timestamp(*(F.lit(v) for v in (year, month or 1, day or 1, hour or 0, 0)), F.lit(0))
    return F.array(F.struct(*interval(start, start + F.expr(f"INTERVAL 1 {step.upper()}"))))


def knearest_moving(df: DataFrame, ident: str, units: str, query: Column, instants: list, k: int) -> DataFrame:
    """instant, ident, distance, rank: the k objects nearest to a moving query point at each of the given instants."""
    at = df.select(ident, F.col(units).alias("_u"), query.alias("_q"), F.explode(F.array(*(F.lit(t).cast("timestamp") for t in instants))).alias("instant"))
    p, q = atinstant_point(F.col("_u"), F.col("instant")), atinstant_point(F.col("_q"), F.col("instant"))
    placed = at.withColumn("distance", F.hypot(p["x"] - q["x"], p["y"] - q["y"])).filter("distance is not null")
    best = Window.partitionBy("instant").orderBy("distance", ident)
    return placed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("instant", ident, "distance", "rank")
