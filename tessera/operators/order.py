"""Operators that depend on the order of a stream, without gathering the stream in one task.

A stream's order is given by sort columns. Rows are range-partitioned and sorted, numbered within partitions, and shifted by
the row counts of the partitions before; later steps cut the numbers into blocks, so windows run over blocks with a guest row or a
carried total from the neighbours rather than over the whole stream. Undefined values (nulls) sort first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

BLOCK = 65_536


def keys(order: list[str]) -> list[Column]:
    """Sort columns from 'name' or 'name desc'; nulls are the least."""
    out = []
    for o in order:
        name, _, way = o.partition(" ")
        out.append(F.col(name).desc_nulls_last() if way.strip() == "desc" else F.col(name).asc_nulls_first())
    return out


def place_among(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above x, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= x))
    literal = lambda xs: F.array(*map(F.lit, xs))
    group = upto(literal([g[0] for g in groups]))
    inner = upto(F.element_at(F.array(*map(literal, groups)), F.greatest(group, F.lit(1))))
    return F.when(group == 0, 0).otherwise((group - 1) * size + inner)


def numbered(df: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """df with its position in the order, counted from start. The sorted rows are written once, so numbers don't change."""
    spark = df.sparkSession
    low = (1 << 33) - 1
    placed = df.orderBy(*keys(order)).withColumn("_id", F.monotonically_increasing_id())
    rows = materialise(placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(low)}).drop("_id"))
    shift, offsets = start, []
    for r in rows.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r._part, shift))
        shift += r["count"]
    before = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))  # a row for each partition
    return rows.join(before, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def addcounter(df: DataFrame, name: str, start: int, order: list[str]) -> DataFrame:
    """Append a running number that begins at start."""
    return numbered(df, order, name, start)


def add_mod_counter(df: DataFrame, name: str, modulus: int, order: list[str]) -> DataFrame:
    """Append a running number modulo a number."""
    return numbered(df, order, "_n").withColumn(name, F.pmod("_n", F.lit(modulus))).drop("_n")


def _with_neighbour(df: DataFrame, order: list[str], step: int) -> tuple[DataFrame, Window]:
    """Rows in blocks, each block with the row before (step -1) or after (step 1) it as a guest."""
    rows = numbered(df, order, "_n")
    block = F.floor(F.col("_n") / BLOCK)
    near = F.floor((F.col("_n") - step) / BLOCK)
    seats = F.when((near != block) & (near >= 0),
        F.array(F.struct(block.alias("b"), F.lit(False).alias("guest")), F.struct(near.alias("b"), F.lit(True).alias("guest"))))
    rows = rows.withColumn("_seat", F.explode(F.coalesce(seats, F.array(F.struct(block.alias("b"), F.lit(False).alias("guest"))))))
    return rows, Window.partitionBy("_seat.b").orderBy("_n")


def extend_last(df: DataFrame, order: list[str], **made: Callable[[Callable[[str], Column]], Column] | tuple) -> DataFrame:
    """Append f(last), where last(name) is that column of the row before; (f, initial) gives the first row's value."""
    rows, window = _with_neighbour(df, order, -1)
    first = F.col("_n") == 0
    out = {}
    for name, f in made.items():
        f, initial = f if isinstance(f, tuple) else (f, None)
        out[name] = F.when(first, F.lit(initial)).otherwise(f(lambda c: F.lag(c).over(window)))
    return rows.withColumns(out).filter(~F.col("_seat.guest")).drop("_seat", "_n")


def extend_next(df: DataFrame, order: list[str], **made: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """Append f(next), where next(name) is that column of the row after; null in the last row."""
    rows, window = _with_neighbour(df, order, 1)
    return rows.withColumns({n: f(lambda c: F.lead(c).over(window)) for n, f in made.items()}).filter(~F.col("_seat.guest")).drop("_seat", "_n")


_MERGE = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def extend_aggr(df: DataFrame, order: list[str], **made: tuple[str, str]) -> DataFrame:
    """Append running aggregates, name=(sum | count | min | max, column), over all rows up to the current one."""
    rows = numbered(df, order, "_n").withColumn("_b", F.floor(F.col("_n") / BLOCK))
    agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    totals = rows.groupBy("_b").agg(*(agg[how](c).alias(f"_t_{n}") for n, (how, c) in made.items()))
    over = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block only
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carried = totals.select("_b", *(again[how](f"_t_{n}").over(over).alias(f"_c_{n}") for n, (how, _) in made.items()))
    inner = Window.partitionBy("_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, "_b")
    out = {}
    for n, (how, c) in made.items():
        here, before = agg[how](c).over(inner), F.col(f"_c_{n}")
        out[n] = F.when(before.isNull(), here).when(here.isNull(), before).otherwise(_MERGE[how](here, before))
    return rows.withColumns(out).drop("_b", "_n", *(f"_c_{n}" for n in made))


def sliding_window(df: DataFrame, size: int, step: int, order: list[str], **aggregates: Column) -> DataFrame:
    """Windows of size rows that begin at every step-th row, as far as they are full: window (0, 1, ...) and the aggregates."""
    rows = numbered(df, order, "_n")
    total = rows.count()
    last = (total - size) // step if total >= size else -1
    low = F.greatest(F.lit(0), F.ceil((F.col("_n") - size + 1) / step)).cast("long")
    high = F.least(F.lit(last), F.floor(F.col("_n") / step)).cast("long")
    placed = rows.filter(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    return placed.groupBy("window").agg(*(c.alias(n) for n, c in aggregates.items()))


def obojoin(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], defaults: dict | None = None) -> DataFrame:
    """Positional join: row i with row i; as long as the shorter side or, with defaults, as the longer one."""
    a, b = numbered(left, left_order, "_n"), numbered(right, right_order, "_n")
    joined = a.join(b, "_n", "inner" if defaults is None else "full_outer").drop("_n")
    return joined.fillna(defaults) if defaults else joined


def nth(df: DataFrame, n: int, order: list[str], offset: int = 0) -> DataFrame:
    """Every n-th row, the first of them at offset."""
    return numbered(df, order, "_n").filter((F.col("_n") % n == offset % n) & (F.col("_n") >= offset)).drop("_n")


def xth(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n-th row, counted from 1."""
    return numbered(df, order, "_n").filter(F.col("_n") == n - 1).drop("_n")


def head(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first n rows."""
    return (df.orderBy(*keys(order)) if order else df).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows, in the stream's order."""
    back = [f"{o.partition(' ')[0]}{'' if o.endswith(' desc') else ' desc'}" for o in order]
    return df.orderBy(*keys(back)).limit(n).orderBy(*keys(order))


def cancel(df: DataFrame, stop: Column, order: list[str]) -> DataFrame:
    """Rows before the first one for which stop holds."""
    rows = numbered(df, order, "_n")
    first = rows.filter(stop).agg(F.min("_n")).first()[0]
    return (rows if first is None else rows.filter(F.col("_n") < first)).drop("_n")


def reduce_runs(df: DataFrame, same: list[str], order: list[str], **aggregates: Column) -> DataFrame:
    """Collapse runs of neighbouring rows that agree in `same`: run (0, 1, ...), those columns and the aggregates."""
    rows = numbered(df, order, "_n")
    marked = extend_last(rows, ["_n"],
        _new=(lambda last: F.when(F.struct(*same).eqNullSafe(F.struct(*(last(c).alias(c) for c in same))), 0).otherwise(1), 0)).withColumn("_new",
            F.col("_new").cast("long"))
    runs = extend_aggr(marked, ["_n"], run=("sum", "_new"))
    return runs.groupBy("run", *same).agg(*(c.alias(n) for n, c in aggregates.items()))


def is_ordered(df: DataFrame, by: list[str], order: list[str]) -> bool:
    """Whether the stream in the given order is sorted by `by` as well."""
    columns = [b.partition(" ")[0] for b in by]
    rows = extend_last(df, order, _prev=lambda last: F.struct(*(last(c).alias(c) for c in columns)))
    worse = F.lit(False)
    for b in reversed(by):
        name, _, way = b.partition(" ")
        before, now = F.col(f"_prev.{name}"), F.col(name)
        bad = (before > now) if way != "desc" else (before < now)
        worse = F.coalesce(bad, F.lit(False)) | (before.eqNullSafe(now) & worse)
    return rows.filter(F.col("_prev").isNotNull() & worse).isEmpty()
