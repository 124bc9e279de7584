"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Signatures. Each text becomes its set of hashed `n`-word shingles (a text of fewer words is one shingle, a text without
   words has none and joins nothing), a MinHash signature and band hashes. Bands and rows are chosen for a target recall at the threshold.
2. Classes. Texts with equal sets are one class with one representative, its least row; all later work is on representatives.
3. Candidates. Band hashes are shuffled; each band bucket links its members to its least one, so a bucket of any size
   gives no more rows than it has members. Components of these links are regions that hold every candidate pair.
4. Verification. Regions are cut by set length (similar sets are in the same or in neighbouring length classes) and, where they are
   large, into cells of bounded size; a task takes a pair of cells and compares all their members by products of their
   incidence matrices. Each pair of representatives is compared once. Out come counts of links and a spanning forest, not pairs.
5. Components of the forests are the near-duplicate classes.

Links are counted between documents: a document has a link to each other one with a similarity of at least the threshold, copies
included. Pairs of distinct sets in a region are all compared, also those that share no band.

Rows without doc_id are given back with a null class and no links. Every other row is judged by its own text: rows that repeat a doc_id and
its text count as copies of one another, rows of one doc_id with different texts have the classes and links of these texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import kernels as k
from tessera.llm.components import components
from tessera.llm.repeats import keyed
from tessera.session import materialise

CELL, SALTS = 256, 64


def choose_bands(threshold: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the steepest curve whose recall at the threshold is reached with so many hashes."""
    best = None
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def shingles(block: k.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds by row, hashes): the sorted distinct shingles of each row of a block."""
    tokens = k.tokenise(block, k.SPACES)
    hashes, rows = k.token_hashes(block, tokens), len(block.offsets) - 1
    windows = k.window_hashes(hashes, n)
    whole = tokens.row[: len(windows)] == tokens.row[n - 1 :] if len(windows) else np.empty(0, bool)
    row, value = tokens.row[: len(windows)][whole], windows[whole]
    size = np.diff(tokens.bounds)
    short = np.flatnonzero((size > 0) & (size < n))
    single = [k.window_hashes(hashes[tokens.bounds[i] : tokens.bounds[i + 1]], int(size[i]))[0] for i in short]
    row, value = np.append(row, short), np.append(value, np.array(single, np.uint64))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return np.searchsorted(row, np.arange(rows + 1)), value


def sign(n: int, bands: int, rows: int):
    """Map doc_id, text, row_hash to doc_id, row_hash, size of the set, key (128 bits of the set), bands (longs)."""
    factors = (k.seeded(bands * rows, 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    terms = (k.seeded(bands * rows, 2) >> np.uint64(32)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in k.blocks(batch.column("text")):
                bounds, value = shingles(block, n)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                first = bounds[:-1][some]
                band = np.zeros((bands, len(some)), np.uint64)
                keys: list[bytes | None] = [None] * len(size)
                if len(some):
                    low = (value >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        h = np.full(len(some), b + 1, np.uint64)
                        for j in range(b * rows, (b + 1) * rows):
                            h = k.mix(h ^ np.minimum.reduceat(low * factors[j] + terms[j], first))
                        band[b] = h
                    total, spread = np.add.reduceat(value, first), np.add.reduceat(k.mix(value), first)
                    for i, a, c in zip(some.tolist(), k.mix(total ^ size[some].astype(np.uint64)), k.mix(spread), strict=True):
                        keys[i] = int(a).to_bytes(8, "big") + int(c).to_bytes(8, "big")
                spread_bands = pa.array(band.T.reshape(-1).view(np.int64))
                at = np.zeros(len(size) + 1, np.int32)
                at[1:] = np.cumsum((size > 0) * bands)
                own = [batch.column(c).slice(block.first, block.last - block.first) for c in ("doc_id", "row_hash")]
                yield pa.record_batch(
                    [*own, pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), spread_bands)],
                    ["doc_id", "row_hash", "size", "key", "bands"],
                )

    return run


def pack_sets(n: int):
    """Map node, text and cell columns to the same with the packed set instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            for block in k.blocks(batch.column("text")):
                bounds, value = shingles(block, n)
                sets = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(block.first, block.last - block.first)
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"])

    return run


def _matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and columns of the incidence matrix of sets; only elements that come more than once have a column."""
    value = np.concatenate(sets)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = count[column] > 1
    names = np.cumsum(count > 1) - 1
    return row[kept], names[column[kept]], int((count > 1).sum())


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, most_cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i in left, j in right) with a Jaccard similarity of at least the threshold; i < j in left, if right is None."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    row, column, columns = _matrix(sets)
    shared = np.zeros((len(left), len(right) if right is not None else len(left)), np.float32)
    step = max(1, most_cells // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, columns, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        x = np.zeros((len(sets), min(step, columns - a)), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        shared += x[: len(left)] @ (x[len(left) :] if right is not None else x).T
    other = size[len(left) :] if right is not None else size
    both = size[: len(left), None] + other[None, :] - shared
    hit = shared >= threshold * both - 1e-6
    if right is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def compare(threshold: float):
    """Map rows sorted by task to node, links (documents linked), root (least node linked within the task)."""

    def flush(rows: list[tuple]) -> tuple[list, list, list]:
        reps = np.array([r for r, _, _, _ in rows], np.int64)
        copies = np.array([c for _, _, c, _ in rows], np.int64)
        sides = np.array([s for _, s, _, _ in rows])
        sets = [np.frombuffer(b, np.uint64) for _, _, _, b in rows]
        if sides.any():  # two cells; else one with itself
            a, b = np.flatnonzero(sides == 1), np.flatnonzero(sides == 2)
            i, j = similar([sets[x] for x in a], [sets[x] for x in b], threshold)
            i, j = a[i], b[j]
        else:
            i, j = similar(sets, None, threshold)
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        parent = list(range(len(rows)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q, key=lambda z: reps[z])] = min(p, q, key=lambda z: reps[z])
        hit = np.flatnonzero(links)
        return reps[hit].tolist(), links[hit].astype(np.int64).tolist(), [int(reps[root(int(x))]) for x in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], ([], [], [])

        def batch_of(out: tuple) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in out], ["node", "links", "root"])

        for batch in batches:
            for task, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "side", "copies", "set")), strict=True):
                if task != now:
                    if len(rows) > 1:
                        for x, y in zip(out, flush(rows), strict=True):
                            x += y
                    now, rows = task, []
                rows.append(tuple(row))
            if len(out[0]) > 5000:
                yield batch_of(out)
                out = ([], [], [])
        if len(rows) > 1:
            for x, y in zip(out, flush(rows), strict=True):
                x += y
        yield batch_of(out)

    return run


def linked_rows(docs: DataFrame, n: int, threshold: float, recall: float, cell: int) -> DataFrame:
    """doc_id, row_hash, first (struct doc_id, row_hash: the least row of its near-duplicate class), n_links for each row of docs that has an id and text, else nulls."""
    bands, rows = choose_bands(threshold, recall)
    source = keyed(docs)
    signed = source.mapInArrow(k.trimmed(sign(n, bands, rows)), "doc_id long, row_hash long, size int, key binary, bands array<long>")
    signed = materialise(signed)
    known = signed.filter("doc_id is not null and key is not null")
    classes = known.groupBy("key").agg(F.min(F.struct("doc_id", "row_hash")).alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.min("bands").alias("bands"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))  # as written: a class keeps its number
    flat = classes.select("node", F.explode("bands").alias("band"))
    least = flat.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least")
    star = flat.join(least, "band").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    regions = materialise(components(star).withColumnRenamed("root", "region"))
    step = float(np.log(1 / threshold))
    members = classes.join(regions, "node").select("node", "rep", "copies", "region", F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).cast("int").alias("level"))
    members = materialise(members)
    # cells of bounded size; large groups get as many as spread their pairs evenly over all tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_cells = F.ceil(F.col("n") / cell)
    spread_out = F.least(F.ceil(F.col("n") * 8 / cell), F.lit(int(np.ceil(np.sqrt(4 * parts)))))
    cells = members.groupBy("region", "level").agg(F.count("*").alias("n")).select("region", "level", F.when(F.col("n") > 4 * cell, F.greatest(n_cells, spread_out)).otherwise(n_cells).cast("int").alias("cells"))
    near = cells.filter("cells > 1").select("region", F.explode(F.array(F.col("level") - 1, "level", F.col("level") + 1)).alias("level"), F.col("level").alias("near"), "cells")
    large = near.groupBy("region", "level").agg(F.map_from_entries(F.collect_list(F.struct("near", "cells"))).alias("sizes"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # members of one region come from many tasks
    placed = members.withColumn("salt", F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(SALTS)).cast("int")).join(large, ["region", "level", "salt"], "left")
    own_cells = F.coalesce(F.element_at("sizes", F.col("level")), F.lit(1))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("node"), own_cells).cast("int"))
    name = lambda lo_level, lo, hi_level, hi: F.struct("region", lo_level.alias("l"), lo.alias("c"), hi_level.alias("m"), hi.alias("d"))
    level, own = F.col("level"), F.col("cell")
    upto = lambda x: F.sequence(F.lit(0), F.coalesce(F.element_at("sizes", x), F.lit(1)) - 1)
    tasks = F.concat(
        F.transform(upto(level), lambda o: F.struct(name(level, F.least(own, o), level, F.greatest(own, o)).alias("task"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side"))),
        F.transform(upto(level + 1), lambda o: F.struct(name(level, own, level + 1, o).alias("task"), F.lit(1).alias("side"))),
        F.transform(upto(level - 1), lambda o: F.struct(name(level - 1, o, level, own).alias("task"), F.lit(2).alias("side"))),
    )
    placed = materialise(placed.select("node", "rep", "copies", F.explode(tasks).alias("t")).select("node", "rep", "copies", F.xxhash64("t.task").alias("task"), "t.side"))
    shared = placed.groupBy("task").agg(F.count("*").alias("n"), F.min("side").alias("a"), F.max("side").alias("b")).filter("n > 1 and (b = 0 or a < b)").select("task")
    placed = placed.join(shared, "task", "left_semi")
    wanted = placed.groupBy("node").agg(F.first("rep").alias("rep"), F.first("copies").alias("copies"), F.collect_list(F.struct("task", "side")).alias("tasks"))
    wanted = wanted.hint("merge")  # the same plan at every size
    texts = source.join(wanted, (source["doc_id"] == wanted["rep.doc_id"]) & (source["row_hash"] == wanted["rep.row_hash"]))
    texts = texts.groupBy("doc_id", "row_hash").agg(*(F.first(c).alias(c) for c in ("node", "copies", "tasks", "text"))).drop("doc_id", "row_hash")  # rows may be repeated
    sets = texts.mapInArrow(k.trimmed(pack_sets(n)), "node long, copies long, tasks array<struct<task:long,side:int>>, set binary")
    spread = sets.select("node", "copies", "set", F.explode("tasks").alias("t")).select("node", "copies", "set", "t.task", "t.side")
    found = materialise(spread.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(k.trimmed(compare(threshold)), "node long, links long, root long"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    firsts = joined.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("first"))
    linked = joined.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node").join(firsts, "root").select("node", "first", "links")
    result = classes.select("key", "node", "rep", "copies").join(linked, "node", "left")
    result = result.select(F.col("key").alias("of"), F.coalesce("first", "rep").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = signed.select("doc_id", "row_hash", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    return ids.join(result, ids["key"] == result["of"], "left").select("doc_id", "row_hash", "first", "n_links")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, cell: int = CELL) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicate class), n_links, for each row of docs (doc_id, text)."""
    rows = linked_rows(docs, n, threshold, recall, cell)
    return rows.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, cell: int = CELL) -> DataFrame:
    """One row of each near-duplicate class, that of the least doc_id (and then of the least hash of its text), with all columns of docs.

    Rows without doc_id all stay, and so do texts without words. Each row is judged by its own text, also where rows share a doc_id;
    rows that repeat both are one (null and empty texts are the same). Of such rows with different other columns, the least by those columns as text stays.
    """
    firsts = linked_rows(docs, n, threshold, recall, cell).filter("doc_id is not null")
    firsts = firsts.filter("first is null or (first.doc_id = doc_id and first.row_hash = row_hash)").select(F.col("doc_id").alias("_of"), F.col("row_hash").alias("_of_hash")).distinct()
    # columns of docs travel in a struct, so that they may have any names
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"), F.struct("*").alias("doc"))
    kept = rows.join(firsts, (F.col("id") == F.col("_of")) & (F.col("hash") == F.col("_of_hash")))
    rest = F.struct(*(F.col("doc").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"))
    order = Window.partitionBy("id", "hash").orderBy(F.col("doc").getField("text").isNull(), F.to_json(rest))
    kept = kept.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return kept.select("doc.*").union(docs.filter("doc_id is null"))
