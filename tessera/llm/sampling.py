"""Bounded, repeatable samples of labelled rows, and the exact place of the k-th largest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialise

SCALE = 1 << 30


def fold_of(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of a document's id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1))


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the documents that no model learns from."""
    return fold_of(doc_id) == 1


def place(*key: Column) -> Column:
    """A row's fixed place in 0 to SCALE, by hash."""
    return F.pmod(F.xxhash64(F.lit(20_011), *key), F.lit(SCALE))


def stratified(rows: DataFrame, label: str, key: str, quota: int, content: str | None = None, most: int | None = None) -> DataFrame:
    """At most `quota` rows of each label (all, if there are fewer), those whose hash of key and content comes first.

    However many labels there are, each has its rows; with `most`, the quota is so much smaller that all labels together have at most that
    many rows, or one each. A count by label and order of magnitude of the hash comes first, so that few rows beyond the quota
    are sorted. Rows that repeat key and content count each. Rows with a null label are left out.
    """
    at = place(F.col(key), *([F.col(content)] if content else []))
    known = rows.filter(F.col(label).isNotNull()).withColumn("_at", at)
    digits = F.length(F.bin("_at"))
    sizes = known.groupBy(F.col(label).alias("_of"), digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_of").orderBy("_digits"))
    cuts = sizes.withColumn("_upto", upto).groupBy("_of").agg(F.coalesce(F.min(F.when(F.col("_upto") >= quota, F.col("_digits"))), F.lit(SCALE.bit_length())).alias("_cut"))
    cuts = materialise(cuts)
    if most is not None:
        quota = min(quota, max(1, most // max(1, cuts.count())))
    near = known.join(cuts, F.col(label) == F.col("_of")).filter(digits <= F.col("_cut"))
    order = Window.partitionBy(label).orderBy("_at", key, *([F.xxhash64(content)] if content else []))
    return near.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= quota).select(rows.columns)


def kth_largest(rows: DataFrame, column: str, k: int, close: int = 5000) -> float | None:
    """The k-th largest value (nulls don't count), None if there are fewer than k.

    A histogram finds the bin that holds it, then one of that bin, and so on; at last at most `close` values come to the driver.
    """
    x = F.col(column)
    ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    if k < 1 or ends.n < k:
        return None
    lo, hi, left, n = ends.lo, ends.hi, k, ends.n
    for _ in range(40):
        inside = rows.filter((x >= lo) & (x <= hi))
        if n <= close:
            return sorted((r[0] for r in inside.select(x).collect()), reverse=True)[left - 1]
        width = (hi - lo) / 1024
        if width <= 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(1023))
        bins = inside.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
        for b in sorted(bins, key=lambda b: -b.bin):
            if left <= b.n:
                lo, hi, n = b.lo, b.hi, b.n
                break
            left -= b.n
        if lo == hi:
            return lo
    return lo
