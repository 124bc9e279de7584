"""Rasters in long form: cell_x, cell_y, v (undefined cells have no row). Map algebra is joins and aggregates on cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["cell_x", "cell_y"]


def tile(df: DataFrame, x: Column, y: Column, size: float, value: Column) -> DataFrame:
    """A raster from points: an aggregate of the points of each cell."""
    return df.groupBy(F.floor(x / size).cast("int").alias("cell_x"), F.floor(y / size).cast("int").alias("cell_y")).agg(value.alias("v"))


def map1(r: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return r.select(*CELL, f(F.col("v")).alias("v")).filter("v is not null")


def map2(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of the cells that both rasters define."""
    return a.join(b.withColumnRenamed("v", "_w"), CELL).select(*CELL, f(F.col("v"), F.col("_w")).alias("v")).filter("v is not null")


def at(r: DataFrame, x: int, y: int) -> DataFrame:
    return r.filter((F.col("cell_x") == x) & (F.col("cell_y") == y)).select("v")


def clip(r: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    return r.filter(F.col("cell_x").between(x1, x2) & F.col("cell_y").between(y1, y2))


def neighbourhood(r: DataFrame, radius: int, aggregate: Callable[[str], Column]) -> DataFrame:
    """An aggregate over the defined cells of the square around each defined cell, itself included."""
    near = F.sequence(F.lit(-radius), F.lit(radius))
    spread = r.select("*", F.explode(near).alias("_dx")).select("*", F.explode(near).alias("_dy"))
    sent = spread.select((F.col("cell_x") + F.col("_dx")).alias("cell_x"), (F.col("cell_y") + F.col("_dy")).alias("cell_y"), "v")
    return sent.groupBy(*CELL).agg(aggregate("v").alias("v")).join(r.select(*CELL), CELL, "left_semi")


def upsample(r: DataFrame, factor: int) -> DataFrame:
    """Coarser cells with the mean of theirs."""
    return r.groupBy(F.floor(F.col("cell_x") / factor).cast("int").alias("cell_x"),
        F.floor(F.col("cell_y") / factor).cast("int").alias("cell_y")).agg(F.avg("v").alias("v"))


def slope(r: DataFrame, size: float) -> DataFrame:
    """Steepness from the differences of the four neighbours; cells without all four are undefined."""
    moved = lambda dx, dy, n: r.select((F.col("cell_x") - dx).alias("cell_x"), (F.col("cell_y") - dy).alias("cell_y"), F.col("v").alias(n))
    out = r.select(*CELL)
    for dx, dy, n in ((1, 0, "e"), (-1, 0, "w"), (0, 1, "n"), (0, -1, "s")):
        out = out.join(moved(dx, dy, n), CELL)
    return out.select(*CELL, F.hypot((F.col("e") - F.col("w")) / (2 * size), (F.col("n") - F.col("s")) / (2 * size)).alias("v"))


def contour_cells(r: DataFrame, level: float) -> DataFrame:
    """Cells at which the raster crosses a level: at least the level, with a neighbour to the right or above that is below it, or the other way round."""
    right = r.select((F.col("cell_x") - 1).alias("cell_x"), "cell_y", F.col("v").alias("_r"))
    above = r.select("cell_x", (F.col("cell_y") - 1).alias("cell_y"), F.col("v").alias("_a"))
    both = r.join(right, CELL, "left").join(above, CELL, "left")
    high = F.col("v") >= level
    return both.filter((high != (F.col("_r") >= level)) | (high != (F.col("_a") >= level))).select(*CELL, "v")
