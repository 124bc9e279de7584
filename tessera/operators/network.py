"""Networks of sections: positions on them, distances along them, neighbouring sections.

A section is a row with an id, two end nodes and a length; a position is a section and the way from its first end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import shortest_paths


def adjacent_sections(sections: DataFrame, sid: str, a: str, b: str) -> DataFrame:
    """sid, other: sections that share an end node; a section is not its own neighbour."""
    ends = sections.select(F.col(sid).alias("s"), F.explode(F.array(a, b)).alias("node")).distinct()
    pairs = ends.join(ends.select(F.col("s").alias("o"), "node"), "node").filter("s <> o")
    return pairs.select(F.col("s").alias(sid), F.col("o").alias("other")).distinct()


def network_distances(sections: DataFrame, sid: str, a: str, b: str, length: str, place: tuple[object, float], places: DataFrame, at: str) -> DataFrame:
    """places (columns sid and at) with distance along the network from one position; null where it isn't reached. Sections lead both ways."""
    on, way = place
    own = sections.filter(F.col(sid) == F.lit(on)).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"),
        F.col(length).cast("double").alias("len"))
    start = own.select(F.lit("start").alias("u"), F.concat(F.lit("n"), "a").alias("v"), F.lit(float(way)).alias("w"))
    start = start.union(own.select(F.lit("start"), F.concat(F.lit("n"), "b"), F.col("len") - float(way)))
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    there = sections.select(name(a).alias("u"), name(b).alias("v"), F.col(length).cast("double").alias("w"))
    found = shortest_paths(start.union(there).union(there.select("v", "u", "w")), "start", "u", "v", "w")
    ends = sections.select(F.col(sid).alias("_sid"), name(a).alias("_a"), name(b).alias("_b"), F.col(length).cast("double").alias("_len"))
    out = places.join(ends, F.col(sid) == F.col("_sid"), "left")
    for end in ("a", "b"):
        out = out.join(found.select(F.col("node").alias(f"_n{end}"), F.col("distance").alias(f"_d{end}")), F.col(f"_{end}") == F.col(f"_n{end}"), "left")
    direct = F.when(F.col(sid) == F.lit(on), F.abs(F.col(at) - float(way)))
    best = F.least(direct, F.col("_da") + F.col(at), F.col("_db") + F.col("_len") - F.col(at))
    return out.withColumn("distance", best).select(*places.columns, "distance")
