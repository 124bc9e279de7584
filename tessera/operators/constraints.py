"""Constraint tables: a symbolic tuple is a conjunction of linear constraints a x + b y + c <= 0, as an array of struct(a, b, c)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.operators.spatial import spatial_join

CONSTRAINTS = "array<struct<a:double,b:double,c:double>>"
_CORNERS = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def box_constraints(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The constraints of a rectangle."""
    one = lambda a, b, c: F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), c.cast("double").alias("c"))
    return F.array(one(-1, 0, x1), one(1, 0, -x2), one(0, -1, y1), one(0, 1, -y2))


def corners(constraints: Column, world: float = 1e9) -> Column:
    """Corners of the convex set that fulfils the constraints, within a large square; none if they contradict each other."""

    def run(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            ring = [(-world, -world), (world, -world), (world, world), (-world, world)]
            for k in s if s is not None else ():
                side = [k["a"] * x + k["b"] * y + k["c"] for x, y in ring]
                new = []
                for i, p in enumerate(ring):
                    q, u, v = ring[(i + 1) % len(ring)], side[i], side[(i + 1) % len(ring)]
                    if u <= 1e-12:
                        new.append(p)
                    if (u < -1e-12 and v > 1e-12) or (u > 1e-12 and v < -1e-12):
                        t = u / (u - v)
                        new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                ring = new
                if not ring:
                    break
            out.append([{"x": x, "y": y} for x, y in ring] if s is not None else None)
        return pd.Series(out)

    return F.pandas_udf(run, _CORNERS)(constraints)


def cjoin(a: DataFrame, b: DataFrame, left: str, right: str, name: str = "constraints") -> DataFrame:
    """Pairs of symbolic tuples whose constraints can hold together, with all columns and the conjunction as `name`.

    Pairs come from a join of the sets' boxes, so that sets far from each other never meet.
    """
    a, b = a.withColumn("_p", corners(F.col(left))), b.withColumn("_q", corners(F.col(right)))
    side = lambda c, n: F.transform(c, lambda p: p[n])
    box = lambda c: F.when(F.size(c) > 0,
        F.struct(*(f(side(c, n)).alias(k) for f, n,
            k in ((F.array_min, "x", "x1"), (F.array_min, "y", "y1"), (F.array_max, "x", "x2"), (F.array_max, "y", "y2")))))
    pairs = spatial_join(a.withColumn("_box", box("_p")), b.withColumn("_rbox", box("_q")), F.col("_box"), F.col("_rbox"))
    pairs = pairs.drop("_p", "_q", "_box", "_rbox").withColumn(name, F.concat(left, right))
    return pairs.filter(F.size(corners(F.col(name))) > 0)
