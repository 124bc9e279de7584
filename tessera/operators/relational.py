"""Relational operators over DataFrames: schema, filters, joins, grouping, sorting, duplicates, sets and changes to tables.

Undefined values are nulls: a filter drops rows whose predicate is null, keys that are null never join, nulls sort first.
Names follow the operators of the query language in tessera.plans.oplang.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.order import keys, place_among
from tessera.session import materialise, spread

#: Rows that a fold takes together; a power of two.
BLOCK = 1 << 14

# Schema and filters


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet table."""
    return spark.read.parquet(path)


def feedproject(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Scan only some columns."""
    return spark.read.parquet(path).select(*names)


def project(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def remove(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, suffix: str) -> DataFrame:
    """Append _suffix to every name."""
    return df.toDF(*(f"{c}_{suffix}" for c in df.columns))


def rename_attr(df: DataFrame, **new: str) -> DataFrame:
    """new_name='old_name'."""
    return df.withColumnsRenamed({old: n for n, old in new.items()})


def validate_attr(df: DataFrame) -> DataFrame:
    """Names of letters, digits and underscores that begin with a letter, without repeats."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = re.sub(r"\W", "_", c)
        name = name if re.match(r"[A-Za-z]", name) else f"a_{name}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)


def extend(df: DataFrame, **made: Column) -> DataFrame:
    return df.withColumns(made)


def project_extend(df: DataFrame, names: list[str], **made: Column) -> DataFrame:
    return df.select(*names, *(c.alias(n) for n, c in made.items()))


def extend_stream(df: DataFrame, **made: Column) -> DataFrame:
    """Append a column from an array-valued expression, one row for each element (none for an empty or null array)."""
    ((name, column),) = made.items()
    return df.withColumn(name, F.explode(column))


def project_extend_stream(df: DataFrame, names: list[str], **made: Column) -> DataFrame:
    ((name, column),) = made.items()
    return df.select(*names, F.explode(column).alias(name))


def extend_x(df: DataFrame, names: list[str], f: Callable[[Column], Column], suffix: str) -> DataFrame:
    """Append f of each named column as name_suffix."""
    return df.withColumns({f"{c}_{suffix}": f(F.col(c)) for c in names})


def apply_to_all(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.select(*(f(F.col(c)).alias(c) for c in df.columns))


def replace_attr(df: DataFrame, **made: Column) -> DataFrame:
    unknown = set(made) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.withColumns(made)


def swap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange the places of two columns."""
    names = [{a: b, b: a}.get(c, c) for c in df.columns]
    return df.select(*names)


def to_fields(df: DataFrame, *ids: str) -> DataFrame:
    """Unpivot: ids, Field, Type, Value (text); undefined values stay as rows with a null Value."""
    rest = [(c, t) for c, t in df.dtypes if c not in ids]
    cells = F.array(*(F.struct(F.lit(c).alias("Field"), F.lit(t).alias("Type"), F.col(c).cast("string").alias("Value")) for c, t in rest))
    return df.select(*ids, F.inline(cells))


def from_fields(df: DataFrame, ids: list[str], fields: dict[str, str]) -> DataFrame:
    """Pivot back to columns field: type; missing fields are null."""
    picked = (F.max(F.when(F.col("Field") == f, F.col("Value"))).try_cast(t).alias(f) for f, t in fields.items())
    return df.groupBy(*ids).agg(*picked)


def extract(df: DataFrame, name: str, default: object = None) -> object:
    """The first row's value of a column, or the default for an empty stream."""
    row = df.select(name).first()
    return default if row is None else row[0]


def exist(df: DataFrame) -> bool:
    return not df.isEmpty()


def ensure(df: DataFrame, n: int) -> bool:
    """Whether there are at least n rows."""
    return df.limit(n).count() == n


def some(df: DataFrame, predicate: Column) -> bool:
    return not df.filter(predicate).isEmpty()


# Joins


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.crossJoin(b)


def symmjoin(a: DataFrame, b: DataFrame, predicate: Column, slices: int | None = None) -> DataFrame:
    """Theta join; parts of the predicate that compare keys for equality become an equi-join.

    For few or frequent keys, or none, slices deals the rows of a to so many parts, each of which meets all of b (the smaller side): the pairs of
    one key are made by many tasks.
    """
    if slices is None:
        return a.join(b, predicate)
    left = spread(a).withColumn("_slice", (F.monotonically_increasing_id() % slices).cast("int"))
    right = b.withColumn("_part", F.explode(F.array(*map(F.lit, range(slices)))))
    return left.join(right.hint("merge"), predicate & (F.col("_slice") == F.col("_part"))).drop("_slice", "_part")


def symmouterjoin(a: DataFrame, b: DataFrame, predicate: Column) -> DataFrame:
    return a.join(b, predicate, "full_outer")


def _equi(a: DataFrame, b: DataFrame, left: str, right: str, how: str, hint: str | None) -> DataFrame:
    b = b.hint(hint) if hint else b
    return a.join(b, a[left] == b[right], how)


def hashjoin(a: DataFrame, b: DataFrame, left: str, right: str, buckets: int | None = None) -> DataFrame:
    """Equi-join with hash tables; the number of buckets is the planner's business here."""
    return _equi(a, b, left, right, "inner", "shuffle_hash")


def mergejoin(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    return _equi(a, b, left, right, "inner", "merge")


def equijoin(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Equi-join by whatever the optimiser picks: broadcast, hash or merge, re-planned at run time."""
    return _equi(a, b, left, right, "inner", None)


def smouterjoin(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    return _equi(a, b, left, right, "full_outer", "merge")


def loopjoin(a: DataFrame, inner: Callable[[Callable[[str], Column]], DataFrame], how: str = "inner") -> DataFrame:
    """For each row of a, the rows of inner(outer), where outer(name) is that row's column: a lateral join."""
    return a.lateralJoin(inner(lambda c: F.col(c).outer()), how=how)


def loopsel(a: DataFrame, inner: Callable[[Callable[[str], Column]], DataFrame]) -> DataFrame:
    """As loopjoin, with the inner columns only."""
    joined = loopjoin(a, inner)
    return joined.toDF(*(f"_{i}" for i in range(len(joined.columns)))).select(*(F.col(f"_{i}").alias(c) for i,
        c in enumerate(joined.columns) if i >= len(a.columns)))


def matchbelow(a: DataFrame, b: DataFrame, left: str, right: str, by: tuple[str, str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """As-of join: each row of a with the row of b whose key is the greatest not above its own; nulls where there is none.

    Rows of both sides go through one sort by key, in which the last row of b is carried on. `by` names a column of each side that must agree;
    it spreads the work. In any case keys are cut into ranges, as many as there are shuffle partitions, and each range (of each `by`) gets the
    last row of b before it as a guest, so neither a stream without `by` nor a frequent one lands in one task.
    Among rows of b with equal keys the greatest by its other kept columns counts.
    """
    kept = kept or [c for c in b.columns if c != right and not (by and c == by[1])]
    payload = F.struct(F.col(right).alias("_key"), *(F.col(c).alias(f"{c}") for c in kept))
    names = a.columns
    rows = a.select(F.col(left).alias("_at"), (F.col(by[0]) if by else F.lit(0)).alias("_by"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"))
    right_rows = b.filter(F.col(right).isNotNull()).select(F.col(right).alias("_at"), (F.col(by[1]) if by else F.lit(0)).alias("_by"), F.lit(0).alias("_side"),
        payload.alias("_match"))
    both = rows.withColumn("_match",
        F.lit(None).cast(right_rows.schema["_match"].dataType)).unionByName(right_rows.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = (F.col("_at").cast("timestamp") if right_rows.schema["_at"].dataType.simpleString() in ("timestamp_ntz", "date") else F.col("_at")).cast("double")
    cuts = sorted(set(right_rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    place = F.when(F.col("_at").isNull(), 0).otherwise(place_among(at, cuts))
    both = both.withColumn("_range", place)
    cells = both.groupBy("_by", "_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_match"))).alias("_top"))
    before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    guests = cells.select("_by", "_range", F.last("_top", ignorenulls=True).over(before).alias("_top")).filter("_top is not null")
    guests = guests.select(F.col("_top._at").alias("_at"), "_by", F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"),
        F.col("_top._match").alias("_match"), "_range")
    both = both.unionByName(guests)
    window = Window.partitionBy("_by", "_range").orderBy(F.col("_at").asc_nulls_first(), "_side", "_match")
    carried = F.last("_match", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_match", carried).filter("_side = 1").withColumn("_match", F.when(F.col("_at").isNotNull(), F.col("_match")))
    return out.select("_row.*", F.col("_match._key").alias(right), *(F.col("_match")[c].alias(c) for c in kept))


# Aggregates and grouping


def stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Joint statistics of two columns in one pass."""
    parts = [F.count(F.lit(1)).alias("Count")]
    for n, c in (("X", x), ("Y", y)):
        parts += [F.count(c).alias(f"Count{n}"), F.sum(c).alias(f"Sum{n}"), F.avg(c).alias(f"Avg{n}"), F.min(c).alias(f"Min{n}"), F.max(c).alias(f"Max{n}"),
            F.var_samp(c).alias(f"Var{n}")]
    return df.agg(*parts, F.covar_samp(x, y).alias("CovXY"), F.corr(x, y).alias("CorrXY"))


def groupby(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*(c.alias(n) for n, c in aggregates.items()))


def groupby2(df: DataFrame, by: list[str], **folds: tuple[str, Callable[[Column, Column], Column], object]) -> DataFrame:
    """Fold each group: name=(column, f(accumulator, value), initial). f must not depend on the order of values.

    Values of a group are gathered, so groups must fit into memory; use groupby with built-in aggregates where there is one.
    """
    gathered = df.groupBy(*by).agg(*(F.array_sort(F.collect_list(c)).alias(f"_v_{n}") for n, (c, _, _) in folds.items()))
    return gathered.select(*by, *(F.aggregate(f"_v_{n}", F.lit(start) if not isinstance(start, Column) else start, f).alias(n) for n,
        (_, f, start) in folds.items()))


def fold(df: DataFrame, column: str, f: Callable[[Column, Column], Column], initial: object) -> DataFrame:
    """aggregate / aggregateB: a fold with an associative and commutative function whose neutral element is `initial`.

    Rows are folded in blocks of at most BLOCK (as they lie, whatever their values), then the blocks' results again, until one block is left.
    """
    start = F.lit(initial)
    now = df.select(F.col(column).alias("v"))
    while True:
        blocks = now.withColumn("_b", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
        parts = blocks.groupBy("_b").agg(F.array_sort(F.collect_list("v")).alias("v")).select(F.aggregate("v", start, f).alias("v"))
        now = materialise(parts)
        if now.count() <= BLOCK:
            return now.agg(F.aggregate(F.array_sort(F.collect_list("v")), start, f).alias(column))


def nest(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Group by columns; the others become an array of structs, sorted."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def unnest(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != name), F.inline(name))


def histogram_equiwidth(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (1 to bins, 0 and bins + 1 outside) and its count."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(lo), F.lit(hi),
        F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def histogram_equicount(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equi-depth bins: bin, lo, hi, n; borders from approximate quantiles, so no global sort."""
    cuts = sorted(set(df.agg(F.percentile_approx(column, [i / bins for i in range(1, bins)], 10_000)).first()[0] or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) if cuts else F.lit(0)
    return df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n"))


def predcounts(df: DataFrame, *predicates: Column) -> DataFrame:
    """Atom (bit i: predicate i holds) and Count over all rows."""
    atom = F.lit(0)
    for i, p in enumerate(predicates):
        atom = atom + F.when(p, 1 << i).otherwise(0)
    return df.groupBy(atom.alias("Atom")).agg(F.count("*").alias("Count"))


# Sorting and duplicates


def sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*keys(df.columns))


def sortby(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*keys(list(order)))


def sortattr(df: DataFrame) -> DataFrame:
    """Columns in the order of their names."""
    return df.select(*sorted(df.columns))


def ksmallest(df: DataFrame, k: int, *by: str) -> DataFrame:
    return df.orderBy(*keys(list(by))).limit(k)


def kbiggest(df: DataFrame, k: int, *by: str) -> DataFrame:
    return df.orderBy(*keys([f"{b} desc" for b in by])).limit(k)


def rdup(df: DataFrame) -> DataFrame:
    return df.distinct()


def krdup(df: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the first in the order; without an order any."""
    if not order:
        return df.dropDuplicates(by)
    best = Window.partitionBy(*by).orderBy(*keys(order))
    return df.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


# Sets


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def mergesec(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def mergediff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def mergeunion(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def kmergediff(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of a whose key isn't in b."""
    return a.join(b.select(F.col(right).alias("_k")).distinct(), F.col(left) == F.col("_k"), "left_anti")


def pmerge(a: DataFrame, b: DataFrame, *order: str) -> DataFrame:
    return a.union(b).orderBy(*keys(list(order)))


# Access by key, and estimates of it


def exactmatch(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def range_(df: DataFrame, column: str, lo: object = None, hi: object = None) -> DataFrame:
    """range, leftrange (lo is None) and rightrange (hi is None); bounds are closed."""
    if lo is not None:
        df = df.filter(F.col(column) >= F.lit(lo))
    return df if hi is None else df.filter(F.col(column) <= F.lit(hi))


def keyrange(df: DataFrame, column: str, key: object) -> DataFrame:
    """Less, Equal, Greater (fractions) and NumOfKeys."""
    c, k = F.col(column), F.lit(key)
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    return df.filter(c.isNotNull()).agg(share(c < k).alias("Less"), share(c == k).alias("Equal"), share(c > k).alias("Greater"),
        F.count("*").alias("NumOfKeys"))


def search_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


# Changes: a table is rewritten; what is returned is its new content


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def delete(table: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Without the rows whose key is among rows; null keys match each other."""
    gone = rows.select(*(F.col(c).alias(f"_{c}") for c in by)).distinct()
    match = [table[c].eqNullSafe(gone[f"_{c}"]) for c in by]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return table.join(gone, condition, "left_anti")


def update(table: DataFrame, where: Column, **made: Column) -> DataFrame:
    return table.withColumns({n: F.when(where, c).otherwise(F.col(n)) for n, c in made.items()})


def addid(df: DataFrame, name: str = "TID") -> DataFrame:
    """Append a number that is unique in the table."""
    return df.withColumn(name, F.monotonically_increasing_id())


# Functions as values


def within(value: object, f: Callable) -> object:
    return f(value)


def whiledo(value: object, condition: Callable[[object], bool], step: Callable) -> list:
    """All values from the first on while the condition holds for the one before."""
    out = [value]
    while condition(out[-1]):
        out.append(step(out[-1]))
    return out
