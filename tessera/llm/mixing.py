"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, and words flow from patterns to
sources: a pattern's first pass costs nothing, each repetition costs more than the one before (convex), and a source takes
its quota. A source whose documents belong to no other has one way only to its quota, so such sources are planned in tables, however many
there are. The others form a graph with a node for each pattern and source, which is solved on the driver; its size doesn't depend on
the number of documents, and more than `most_patterns` patterns in it are an error.

A pattern's flow is whole passes over its documents plus a rest, which goes to the documents whose seeded hashes come first: a cut in
the hash decides row by row. It is found by two histograms, one within a bin of the other, and a look into one bin of the second.

Size of a document: number of words between blanks; a null text has none. A null source is a source of its own, the last one.
Rows that repeat a doc_id are taken alike. An empty table gives an empty mix. Columns of the input may have any names.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.order import numbered
from tessera.session import materialise

WEIGHTS = (5, 2, 1)
HASH_BITS, BIN_BITS = 52, 12


def size_of(text: str = "text") -> Column:
    """Words of a text column."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_hash(seed: int, doc_id: str = "doc_id") -> Column:
    """52 bits of a document's hash; null ids hash as the text null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def order_of(sources: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def fill_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> dict[str | None, float]:
    """Shares of the total by repeating weights; none is above `most` times its source's size, the excess goes to the others by weight."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order_of(list(sizes)))}
    left, share, out = sum(sizes.values()), sum(weight.values()), {}
    for s in sorted(sizes, key=lambda s: (most * sizes[s] / weight[s], s is None, s or "")):
        if most * sizes[s] * share <= weight[s] * left:
            out[s] = float(most * sizes[s])
            left, share = left - most * sizes[s], share - weight[s]
        else:
            out[s] = weight[s] * left / share
    return out


class Flow:
    """Min-cost flow by successive shortest paths with potentials; capacities and costs are integers, costs at least 0."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Send as much as fits, at least cost; edge e has then carried left[e ^ 1]. All shortest paths of one length are filled together."""
        potential: dict[int, int] = defaultdict(int)
        sent = 0
        while True:
            reach, queue = {source: 0}, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > reach[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] and d + self.cost[e] + potential[a] - potential[b] < reach.get(b, 1 << 62):
                        reach[b] = d + self.cost[e] + potential[a] - potential[b]
                        heapq.heappush(queue, (reach[b], b))
            if sink not in reach:
                return sent
            far = max(reach.values())
            for a in self.out:
                potential[a] += reach.get(a, far)
            while more := self._fill(source, sink, potential):
                sent += more

    def _fill(self, source: int, sink: int, potential: dict[int, int]) -> int:
        """Send along arcs that cost nothing beside the potentials until each path with as few arcs as possible is full."""
        free = lambda e, a: self.left[e] and self.cost[e] + potential[a] == potential[self.to[e]]
        level, queue = {source: 0}, [source]
        for a in queue:
            for e in self.out[a]:
                if self.to[e] not in level and free(e, a):
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        if sink not in level:
            return 0
        untried, path, sent = {a: iter(self.out[a]) for a in level}, [], 0
        at = source
        while True:
            if at == sink:
                amount = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= amount
                    self.left[e ^ 1] += amount
                sent += amount
                full = next(i for i, e in enumerate(path) if not self.left[e])
                at = self.to[path[full] ^ 1]
                untried[at] = itertools.chain([path[full]], untried[at])
                del path[full:]
            e = next((e for e in untried[at] if level.get(self.to[e]) == level[at] + 1 and free(e, at)), None)
            if e is not None:
                path.append(e)
                at = self.to[e]
            elif path:
                at = self.to[path.pop() ^ 1]
            else:
                return sent


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], passes: int) -> dict[tuple, int]:
    """Words to take from each pattern so that the sources get their quotas with as little repetition as possible."""
    flow, node = Flow(), {}
    number = lambda x: node.setdefault(x, len(node) + 2)
    taken: dict[tuple, list[int]] = {}
    for p, size in sorted(patterns.items(), key=lambda x: json.dumps(x[0])):
        taken[p] = [flow.edge(0, number(("pattern", p)), size, n * (n + 1) // 2) for n in range(passes)]
        for s in order_of(list(dict.fromkeys(p))):
            flow.edge(number(("pattern", p)), number(("source", s)), passes * size, 0)
    for s in order_of(list(quotas)):
        flow.edge(number(("source", s)), 1, quotas[s], 0)
    flow.run(0, 1)
    return {p: sum(flow.left[e ^ 1] for e in edges) for p, edges in taken.items()}


def measured(docs: DataFrame, sources: Column | None = None, seed: int = 11) -> DataFrame:
    """doc (struct of all columns of docs), mix_pattern (JSON list of the document's sources), mix_size and mix_hash.

    sources: an array column of docs; by default column source alone. A document in no source has an empty pattern and isn't taken.
    """
    sources = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(sources.cast("array<string>")))
    return docs.select(F.struct("*").alias("doc"), F.to_json(sources).alias("mix_pattern"), size_of().alias("mix_size"), seeded_hash(seed).alias("mix_hash"))


def targets_of(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, size, target for each row of sources (source, size); the same rule as fill_targets(), in tables.

    Each round fixes the sources above the bound at it and shares what is left among the others; only sums come to the driver.
    """
    ranked = numbered(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], "at").drop("none")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("at", F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(ranked.select("source", "size", weight.alias("w")))
    exact = lambda x: F.lit(x).cast("decimal(38,0)")
    bound = F.col("size").cast("decimal(38,0)") * F.lit(most)
    left, share = rows.agg(F.sum("size"), F.sum("w")).first()
    total, full = left or 0, F.lit(False)
    while share:
        full = bound * F.lit(share) <= F.col("w") * exact(left)
        fixed, rest = rows.agg(F.sum(F.when(full, F.col("size"))), F.sum(F.when(~full, F.col("w")))).first()
        now = total - most * (fixed or 0), rest or 0
        if now == (left, share):
            break
        left, share = now
        full = full if share else F.lit(True)
    target = F.when(full, bound.cast("double")).otherwise((F.col("w") * exact(left or 0)).cast("double") / F.lit(float(share or 1)))
    return materialise(rows.select("source", "size", target.alias("target")))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = 3, most_patterns: int = 100_000) -> DataFrame:
    """For each mix_pattern: mix_passes (long), mix_cut (long: of the rest, hashes up to it are taken), mix_source_size, mix_target (of its first source).

    rows: mix_pattern, mix_size, mix_hash; read more than once, so best a written table. The plan is a written table too, so that
    joins know its size. Patterns of more than one source, and those of single sources that such patterns share, are solved together on the driver.
    """
    spark = rows.sparkSession
    patterns = materialise(rows.groupBy("mix_pattern").agg(F.sum("mix_size").alias("n")).withColumn("sources", F.from_json("mix_pattern", "array<string>")))
    member = patterns.select("mix_pattern", "n", F.size("sources").alias("k"), F.posexplode("sources").alias("place", "source"))
    targets = targets_of(member.groupBy("source").agg(F.sum("n").alias("size")), weights, passes).withColumn("quota", F.floor(F.col("target") + 0.5))
    member = member.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    several = member.groupBy("source").agg(F.max("k").alias("most")).filter("most > 1").select(F.col("source").alias("of"))
    tied = member.join(several, F.col("source").eqNullSafe(F.col("of"))).select("mix_pattern", "n", "source", "quota").limit(most_patterns + 1).collect()
    if len(tied) > most_patterns:
        raise ValueError(f"more than {most_patterns} memberships of sources that share documents")
    tied_sources = {r.source: int(r.quota) for r in tied}
    by_text = {tuple(json.loads(r.mix_pattern)): (r.mix_pattern, int(r.n)) for r in tied}
    routed = route({p: n for p, (_, n) in by_text.items()}, tied_sources, passes) if by_text else {}
    routed = spark.createDataFrame([(by_text[p][0], words) for p, words in routed.items()], "mix_pattern string, words long")
    first = member.filter("place = 0").select("mix_pattern", F.col("size").alias("mix_source_size"), F.col("target").alias("mix_target"), "quota")
    joined = patterns.join(routed, "mix_pattern", "left").join(first, "mix_pattern", "left")
    joined = joined.withColumns({"words": F.coalesce("words", "quota", F.lit(0)), "each": F.greatest("n", F.lit(1))})
    words = F.when(F.col("n") > 0, F.col("words")).otherwise(0)
    plan = materialise(joined.select("mix_pattern", words.alias("words"), "each", "mix_source_size", "mix_target"))
    plan = plan.selectExpr("mix_pattern", "words div each as mix_passes", "words % each as rest", "mix_source_size", "mix_target")
    cuts = find_cuts(rows, plan.select("mix_pattern", "rest"))
    return materialise(plan.join(cuts, "mix_pattern", "left").select("mix_pattern", "mix_passes", F.coalesce("mix_cut", F.lit(-1)).alias("mix_cut"), "mix_source_size", "mix_target"))


def find_cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """mix_pattern, mix_cut: the hash up to which a pattern's documents make up its rest (wanted: mix_pattern, rest), as near as whole documents allow.

    Patterns without a rest have no row.
    """
    edge = wanted.filter("rest > 0").select("mix_pattern", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"), "rest")
    for level in (1, 2):
        shift = HASH_BITS - level * BIN_BITS
        inside = rows.withColumn("bin", F.shiftright("mix_hash", shift + BIN_BITS)).join(edge, ["mix_pattern", "bin"])
        bins = inside.groupBy("mix_pattern", F.shiftright("mix_hash", shift).alias("bin"), "before", "rest").agg(F.sum("mix_size").alias("n"))
        ahead = Window.partitionBy("mix_pattern").orderBy("bin")
        bins = bins.withColumn("upto", F.col("before") + F.sum("n").over(ahead)).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        edge = materialise(bins.select("mix_pattern", "bin", (F.col("upto") - F.col("n")).alias("before"), "rest"))
    shift = HASH_BITS - 2 * BIN_BITS
    close = rows.withColumn("bin", F.shiftright("mix_hash", shift)).join(edge, ["mix_pattern", "bin"])
    close = close.groupBy("mix_pattern", "before", "rest", "mix_hash").agg(F.sum("mix_size").alias("n"))
    ahead = Window.partitionBy("mix_pattern").orderBy("mix_hash")
    close = close.withColumn("upto", F.col("before") + F.sum("n").over(ahead)).filter(F.col("upto") - F.col("n") / 2 <= F.col("rest"))
    last = close.groupBy("mix_pattern").agg(F.max("mix_hash").alias("last"))
    start = F.shiftleft("bin", shift)
    return edge.join(last, "mix_pattern", "left").select("mix_pattern", F.coalesce("last", start - 1).alias("mix_cut"))


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan's columns, mix_times and mix_taken: words taken of the document, repeats counted."""
    times = F.col("mix_passes") + (F.col("mix_hash") <= F.col("mix_cut")).cast("long")
    return rows.join(plan, "mix_pattern").withColumn("mix_times", times).withColumn("mix_taken", F.col("mix_times") * F.col("mix_size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = 3, seed: int = 11, sources: Column | None = None) -> DataFrame:
    """The documents that the mix takes with all their columns, and times (long): how often each is taken. An input column times is replaced."""
    rows = measured(docs, sources, seed)
    plan = plan_mix(materialise(rows.select("mix_pattern", "mix_size", "mix_hash")), weights, passes)
    names = [F.col("doc").getField(c).alias(c) for c in docs.columns if c != "times"]
    return take(rows, plan).filter("mix_times > 0").select(*names, F.col("mix_times").alias("times"))
