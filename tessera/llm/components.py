"""Connected components of a graph in tables: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

SALTS = 16


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root for each node of edges (a, b; longs, no nulls): the least node of its component.

    Every round rewires each edge to the least neighbour, so the number of edges never grows and long chains halve. Edges and
    nodes stay in tables in the shared folder; only two sums a round come to the driver. Hot nodes are summed up before
    they are shuffled, and their edges are dealt to several tasks by a salt.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        down = now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt"))
        large = down.join(spread, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialise(small.filter("a <> b").distinct())
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
