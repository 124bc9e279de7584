"""Histograms as values: struct(bounds, counts) with one bound more than counts; a bin holds its lower bound, not its upper one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(bounds: list[float] | Column, counts: list[float] | Column) -> Column:
    as_array = lambda x: x if isinstance(x, Column) else F.array(*(F.lit(float(v)) for v in x))
    return F.struct(as_array(bounds).cast("array<double>").alias("bounds"), as_array(counts).cast("array<double>").alias("counts"))


def find_bin(h: Column, x: Column) -> Column:
    """Index from 0 of the bin that holds x; null outside."""
    below = F.size(F.filter(h["bounds"], lambda b: b <= x))
    return F.when((below > 0) & (below < F.size(h["bounds"])), below - 1)


def get_count(h: Column, i: Column) -> Column:
    return F.get(h["counts"], i)


def no_components(h: Column) -> Column:
    return F.size(h["counts"])


def bin_range(h: Column, i: Column) -> Column:
    return F.struct(F.get(h["bounds"], i).alias("lo"), F.get(h["bounds"], i + 1).alias("hi"))


def _middles(h: Column) -> Column:
    n = F.size(h["counts"])
    return F.zip_with(F.slice(h["bounds"], F.lit(1), n), F.slice(h["bounds"], F.lit(2), n), lambda a, b: (a + b) / 2)


def total(h: Column) -> Column:
    return F.aggregate(h["counts"], F.lit(0.0), lambda s, x: s + x)


def mean(h: Column) -> Column:
    return F.aggregate(F.zip_with(_middles(h), h["counts"], lambda m, c: m * c), F.lit(0.0), lambda s, x: s + x) / F.nullif(total(h), F.lit(0.0))


def variance(h: Column) -> Column:
    square = F.aggregate(F.zip_with(_middles(h), h["counts"], lambda m, c: m * m * c), F.lit(0.0), lambda s, x: s + x) / F.nullif(total(h), F.lit(0.0))
    return square - mean(h) * mean(h)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of the counts; null for different bins."""
    squares = F.zip_with(a["counts"], b["counts"], lambda x, y: (x - y) * (x - y))
    return F.when(a["bounds"] == b["bounds"], F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def is_refinement(a: Column, b: Column) -> Column:
    """Whether a has all bounds of b."""
    return F.size(F.array_except(b["bounds"], a["bounds"])) == 0


def insert(h: Column, x: Column, amount: object = 1.0) -> Column:
    """With x counted; unchanged outside the bins."""
    at = find_bin(h, x)
    return F.struct(h["bounds"].alias("bounds"), F.transform(h["counts"], lambda c, i: F.when(i == at, c + amount).otherwise(c)).alias("counts"))


def translate(h: Column, by: object) -> Column:
    return F.struct(F.transform(h["bounds"], lambda b: b + by).alias("bounds"), h["counts"].alias("counts"))


def use(h: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(h["bounds"].alias("bounds"), F.transform(h["counts"], f).alias("counts"))


def use2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.when(a["bounds"] == b["bounds"], F.struct(a["bounds"].alias("bounds"), F.zip_with(a["counts"], b["counts"], f).alias("counts")))


def fold(h: Column, f: Callable[[Column, Column], Column], start: float) -> Column:
    return F.aggregate(h["counts"], F.lit(float(start)), f)


def find_minbin(h: Column) -> Column:
    """Indexes of the bins with the least count."""
    low = F.array_min(h["counts"])
    return F.filter(F.transform(h["counts"], lambda c, i: F.when(c == low, i)), lambda i: i.isNotNull())


def find_maxbin(h: Column) -> Column:
    top = F.array_max(h["counts"])
    return F.filter(F.transform(h["counts"], lambda c, i: F.when(c == top, i)), lambda i: i.isNotNull())


def shrink(h: Column, lo: object, hi: object, eager: bool = True) -> Column:
    """Without bins that lie (eager: partly; else: wholly) outside lo to hi."""
    bins = F.transform(h["counts"], lambda c, i: F.struct(F.get(h["bounds"], i).alias("a"), F.get(h["bounds"], i + 1).alias("b"), c.alias("c")))
    kept = F.filter(bins, lambda s: (s["a"] >= lo) & (s["b"] <= hi) if eager else (s["b"] > lo) & (s["a"] < hi))
    bounds = F.when(F.size(kept) > 0,
        F.concat(F.transform(kept, lambda s: s["a"]), F.array(F.element_at(kept, -1)["b"]))).otherwise(F.array().cast("array<double>"))
    return F.struct(bounds.alias("bounds"), F.transform(kept, lambda s: s["c"]).alias("counts"))


def create(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """One row: the histogram of a column over given bounds, counted by bin with partial aggregates."""
    edges = F.array(*(F.lit(float(b)) for b in bounds))
    below = F.size(F.filter(edges, lambda b: b <= F.col(column)))
    counted = df.filter(F.col(column).isNotNull()).groupBy((below - 1).alias("i")).agg(F.count("*").alias("n"))
    found = counted.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(bounds) - 2)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double"))
    return found.select(F.struct(edges.alias("bounds"), counts.alias("counts")).alias("histogram"))
