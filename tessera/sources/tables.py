"""Stored tables and generated streams: materialisation, samples, number streams, and streams of single values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def consume(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Store as a table, partitioned by columns if given, and give it back."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def oconsume(df: DataFrame, name: str, order: list[str], buckets: int = 16) -> DataFrame:
    """Store as a table bucketed and sorted by its keys: later joins and aggregates on them need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *order).sortBy(*order).saveAsTable(name)
    return df.sparkSession.table(name)


def tconsume(df: DataFrame, name: str) -> DataFrame:
    """A temporary name for the stream."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def mconsume(df: DataFrame) -> DataFrame:
    """Keep in the executors' memory, spilling to their disks."""
    return df.persist()


def clear(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def dumpstream(df: DataFrame, path: str, separator: str = ", ") -> DataFrame:
    """Write the rows as lines of text and pass them on."""
    df.select(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("undefined")) for c in df.columns))).write.mode("overwrite").text(path)
    return df


HASH = 1 << 52


def key_hash(key: Column, seed: int) -> Column:
    """52 bits of the MD5 of seed:key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def sample(df: DataFrame, least: int, share: float, key: Column, seed: int = 0) -> DataFrame:
    """About share of the rows, or about `least` and some more (or all) if that is more, by the hash of a key: the same at every run."""
    n = df.count()
    rate = min(1.0, max(share, least / n * 1.05 + 5 / n if n else 1.0))
    return df.filter(key_hash(key, seed) < int(rate * HASH))


def intstream(spark: SparkSession, lo: int, hi: int, name: str = "Elem") -> DataFrame:
    """lo to hi, both included."""
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias(name))


def realstream(spark: SparkSession, lo: float, hi: float, step: float, name: str = "Elem") -> DataFrame:
    n = int((hi - lo) / step + 1e-9) + 1 if (hi - lo) * step >= 0 else 0
    return spark.range(n).select((F.lit(float(lo)) + F.col("id") * float(step)).alias(name))


def value_stream(spark: SparkSession, value: object, name: str = "Elem") -> DataFrame:
    """One value as a stream."""
    return spark.range(1).select((value if isinstance(value, Column) else F.lit(value)).alias(name))


def named_transform_stream(df: DataFrame, name: str) -> DataFrame:
    """A stream of values as one of tuples with that attribute."""
    return df.toDF(name)


def project_transform_stream(df: DataFrame, name: str) -> DataFrame:
    """A stream of tuples as one of that attribute's values."""
    return df.select(name)


def probability_filter(df: DataFrame, share: Column | float, key: Column, seed: int = 0) -> DataFrame:
    """Each row stays with the given probability, by the hash of a key."""
    return df.filter(key_hash(key, seed) / float(HASH) < share)


def collect_box(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """The box around all boxes."""
    return df.agg(F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2"))


def collect_line(df: DataFrame, by: list[str], segment: Column) -> DataFrame:
    """Segments of each group as one line, sorted."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(segment)).alias("line"))


def window_time_intersects(df: DataFrame, box: Column, window: tuple[float, float, float, float], start: Column, end: Column,
    span: tuple[object, object]) -> DataFrame:
    """Rows whose box meets a window and whose interval meets a time span."""
    x1, y1, x2, y2 = window
    return df.filter((box["x1"] <= x2) & (box["x2"] >= x1) & (box["y1"] <= y2) & (box["y2"] >= y1) & (start <= F.lit(span[1])) & (end >= F.lit(span[0])))
