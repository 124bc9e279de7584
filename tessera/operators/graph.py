"""Graphs in tables: supersteps, components, paths, ranks, pattern matching and frequent itemsets.

Loops run on the driver, but every step is a plan over tables that are written in the shared folder; only counts come back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for each node of an edge table, loops left out: alternating large and small stars."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        centre = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(centre, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.filter("u <> v").distinct())
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    raise RuntimeError("components did not settle")


def pregel(vertices: DataFrame, messages: DataFrame, compute: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    supersteps: int | None = None) -> DataFrame:
    """Run supersteps until no message is left, or so many: compute(vertices, messages) gives the new vertices and messages."""
    step = 0
    messages = materialise(messages)
    while (supersteps is None or step < supersteps) and not messages.isEmpty():
        vertices, messages = compute(vertices, messages)
        vertices, messages = materialise(vertices), materialise(messages)
        step += 1
    return vertices


def shortest_paths(edges: DataFrame, source: object, a: str = "a", b: str = "b", cost: str | None = None) -> DataFrame:
    """node, distance from the source over directed edges with costs of at least 0 (1 each by default)."""
    weight = F.lit(1.0) if cost is None else F.col(cost).cast("double")
    links = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v"), weight.alias("w")).groupBy("u", "v").agg(F.min("w").alias("w")))
    spark = edges.sparkSession
    kind = links.schema["u"].dataType.simpleString()
    state = spark.createDataFrame([(source, 0.0, True)], f"node {kind}, distance double, moved boolean")
    while not state.filter("moved").isEmpty():
        moved = state.filter("moved")
        found = moved.join(links, moved["node"] == links["u"]).select(F.col("v").alias("node"), F.lit(None).cast("double").alias("old"),
            (F.col("distance") + F.col("w")).alias("new"))
        both = found.union(state.select("node", "distance", F.lit(None).cast("double"))).groupBy("node").agg(F.min("old").alias("old"),
            F.min("new").alias("new"))
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        state = materialise(both.select("node", F.least("old", "new").alias("distance"), better.alias("moved")))
    return state.select("node", "distance")


def page_rank(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank (they sum to 1): sources share their rank over their links; nodes without links share it with all.

    A round is one join of the ranks with the links, one aggregation, and one table written; a node's number of links is kept beside its rank.
    """
    links = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    degrees = links.select(F.col("u").alias("node"), F.lit(1).alias("one")).union(links.select("v", F.lit(0))).groupBy("node").agg(F.sum("one").alias("degree"))
    ranks = materialise(degrees)
    n = ranks.count()
    ranks = ranks.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        lost = ranks.filter("degree = 0").agg(F.sum("rank")).first()[0] or 0.0
        given = ranks.filter("degree > 0").join(links, F.col("node") == F.col("u")).select(F.col("v").alias("node"),
            (F.col("rank") / F.col("degree")).alias("got"), F.lit(None).cast("long").alias("degree"))
        both = given.union(ranks.select("node", F.lit(0.0), "degree")).groupBy("node").agg(F.sum("got").alias("got"), F.max("degree").alias("degree"))
        ranks = materialise(both.select("node", "degree", (F.lit((1 - damping) / n) + damping * (F.col("got") + F.lit(lost / n))).alias("rank")))
    return ranks.select("node", "rank")


def match_path(steps: list[tuple[DataFrame, str, str]], where: Column | None = None) -> DataFrame:
    """Chains of edges: each step is (edges, from, to), and its start is the end of the step before. Columns n0, n1, ... and the edges' other columns."""
    out = None
    for i, (edges, a, b) in enumerate(steps):
        e = edges.withColumnsRenamed({a: f"n{i}", b: f"n{i + 1}"})
        out = e if out is None else out.join(e, f"n{i}")
    return out if where is None else out.filter(where)


def frequent_itemsets(baskets: DataFrame, items: str, support: float) -> DataFrame:
    """apriori, eclat, fpGrowth: Itemset (sorted) and its Support, as fraction of the baskets."""
    from pyspark.ml.fpm import FPGrowth

    n = baskets.count()
    model = FPGrowth(itemsCol=items, minSupport=support, minConfidence=0.0).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("Itemset"), (F.col("freq") / n).alias("Support"))


def strong_rules(baskets: DataFrame, items: str, support: float, confidence: float) -> DataFrame:
    """Antecedent, Consequent, Confidence, with one item as consequent."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(baskets)
    return model.associationRules.select(F.array_sort("antecedent").alias("Antecedent"), F.array_sort("consequent").alias("Consequent"),
        F.col("confidence").alias("Confidence"))
