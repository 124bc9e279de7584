"""Forms over moving objects: `get m:pos from [m, q] where m:t = q:t`, `exists(get * from [m, q] where m:v = q:v)`.

m and q are columns. The where part restricts the moving value m to an instant or periods (t), to a place (pos) or to a value (v); the get
part takes its time (t), its places (pos), its values (v) or all of it (*). What is meant follows from the columns' types: moving
points and values of constant units are arrays of units, periods are arrays of intervals, points are struct(x, y).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, TimestampNTZType, TimestampType

from tessera.functions import moving as m

_FORM = re.compile(r"\s*(?P<exists>exists\s*\(\s*)?get\s+(?:(?P<all>\*)|(?P<of>\w+):(?P<part>t|pos|v))\s+from\s+\[?\s*(?P<x>\w+)\s*(?:,\s*(?P<y>\w+)\s*)?\]?(?:\s*where\s+(?P<a>\w+):(?P<by>t|pos|v)\s*=\s*(?P<b>\w+):(?P=by))?\s*(?P<close>\))?\s*$")


class FormError(ValueError):
    """The text isn't such a form, or the types don't fit."""


def kind_of(t: DataType) -> str:
    """mpoint, mconst, periods, instant, point or value."""
    if isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
        names = set(t.elementType.fieldNames())
        if {"s", "e"} <= names:
            return "mpoint" if "x1" in names else "mconst" if "v" in names else "periods"
    if isinstance(t, StructType) and set(t.fieldNames()) == {"x", "y"}:
        return "point"
    return "instant" if isinstance(t, TimestampType | TimestampNTZType) else "value"


def form(df: DataFrame, text: str) -> Column:
    """The column that a form means over the columns of df."""
    found = _FORM.match(text)
    if not found or bool(found["exists"]) != bool(found["close"]):
        raise FormError(f"not a form: {text!r}")
    x, by = F.col(found["x"]), found["by"]
    moving = kind_of(df.schema[found["x"]].dataType)
    if moving not in ("mpoint", "mconst") or (found["of"] or found["x"]) != found["x"] or (by and {found["a"], found["b"]} != {found["x"], found["y"]}):
        raise FormError(f"{found['x']} must be a moving value, and the only one that is asked for")
    if by is None:
        return F.size(x) > 0 if found["exists"] else _part(x, moving, found["part"])
    y, other = F.col(found["y"]), kind_of(df.schema[found["y"]].dataType)
    if (by, other) == ("t", "instant"):
        t = y.cast("timestamp")
        if found["exists"]:
            return m.present(x, t)
        value = m.atinstant_point(x, t) if moving == "mpoint" else m.atinstant(x, t)
        at = F.when(m.present(x, t), F.struct(t.alias("inst"), value.alias("val")))
        return at if found["part"] is None else at["inst"] if found["part"] == "t" else at["val"]
    if (by, other) == ("t", "periods"):
        cut = m.atperiods_point(x, y) if moving == "mpoint" else m.atperiods(x, y)
    elif (by, other, moving) == ("pos", "point", "mpoint"):
        cut = F.filter(x, lambda u: m.minimum(m.distance_to(F.array(u), y["x"], y["y"])) <= 1e-9)
    elif (by, other, moving) == ("v", "value", "mconst"):
        cut = m.at(x, y)
    else:
        raise FormError(f"{found['x']}:{by} can't be compared with a {other}")
    return F.size(cut) > 0 if found["exists"] else _part(cut, moving, found["part"])


def _part(x: Column, moving: str, part: str | None) -> Column:
    if part == "t":
        return m.deftime(x)
    if part == "pos" and moving == "mpoint":
        return m.trajectory(x)
    if part == "v" and moving == "mconst":
        return F.array_sort(F.array_distinct(F.transform(x, lambda u: u["v"])))
    if part is None:
        return x
    raise FormError(f"a moving value of this kind has no {part}")
