"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens that a fixed mask keeps out of a few neighbouring ones; the positions that the mask ignores may
differ. Seeds of benchmark items are joined with those of the documents. Every hit names a diagonal (an item laid over a
document at an offset), and the diagonal is verified token by token: an item is found where some `window` consecutive tokens of
it agree in at least `share` of their places.

Tokens are runs of word characters, lower case. Items of fewer than `least` tokens are not looked for (least=1: all are). Where a
window is shorter than `SHORT` tokens, as in a shorter item, the three masks would miss some of the substitutions that `share` allows;
masks made for its length then leave out every such set of places. Null texts have no tokens.

The benchmark side is sent to the executors in parts of about `part_chars` characters of text, whatever its size: a
benchmark that is larger is searched part by part, each in a pass of its own. Documents are never shuffled. A seed that many items or
places share is looked at in blocks of hits, so memory stays bounded.

Each row of documents is judged by its own text, also where rows repeat a doc_id or have none; each row of the benchmark is an item
of its own, also where rows repeat an item_id or a text. item_id may have any type. Other columns aren't read, and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm import kernels as k

#: 1 keeps a token, 0 ignores it.
MASKS = ("111010011", "1100101011", "10110111")
#: From this length on, a window with two substitutions has a seed of MASKS that they leave whole, wherever they are.
SHORT, WEIGHT = 12, 4


def offsets_of(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


@cache
def short_masks(n: int, changed: int) -> tuple[tuple[str, int], ...]:
    """Masks of n places, each with where it begins, so that any `changed` places are ignored by one of them together.

    The places are dealt to groups, and each mask ignores some groups: as few groups as leave WEIGHT tokens in every mask.
    """
    for groups in range(changed + 1, n + 1):
        parts = np.array_split(np.arange(n), groups)
        if n - sum(map(len, parts[:changed])) >= min(WEIGHT, n - changed):  # the first ones are the largest
            break
    out = []
    for gone in combinations(parts, changed):
        mask = "".join("01"[all(i not in g for g in gone)] for i in range(n))
        out.append((mask.strip("0"), mask.index("1")))
    return tuple(out)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at every position at which the mask fits; seeds of different masks differ."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for factor, o in zip(k.seeded(len(mask), 4242), offsets_of(mask), strict=False):
        out += hashes[o : o + n] * (factor | np.uint64(1))
    return k.mix(out)


@dataclass(frozen=True)
class Index:
    """Seeds of benchmark items, sorted, with the item and position of each, a bit table in front, and the items' tokens."""

    ids: list
    tokens: np.ndarray
    bounds: np.ndarray
    masks: tuple[str, ...]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    window: int
    share: float


def build(items: list[tuple[object, str | None]], window: int = 13, share: float = 0.8, least: int = 5) -> Index:
    """The index of (id, text) items."""
    parts, bounds = [], [0]
    for block in k.blocks(pa.array([t for _, t in items], pa.string()), lower=True):
        tokens = k.tokenise(block, k.WORDS)
        parts.append(k.token_hashes(block, tokens))
        bounds += (bounds[-1] + tokens.bounds[1:]).tolist()
    all_tokens, edges = np.concatenate([np.empty(0, np.uint64), *parts]), np.array(bounds, np.int64)
    sizes = np.diff(edges)
    owner, found = np.repeat(np.arange(len(sizes)), sizes), []
    spot, width = np.arange(len(owner)) - edges[owner], np.minimum(window, sizes)[owner]
    wanted: dict[str, list[tuple[int, int]]] = {m: [] for m in MASKS}
    for w in np.unique(width[(sizes[owner] >= least) & (width < SHORT)]).tolist():
        for mask, begin in short_masks(w, w - int(np.ceil(share * w - 1e-9))):
            wanted.setdefault(mask, []).append((w, begin))
    for mask, short in wanted.items():
        at = seeds(all_tokens, mask)
        n = len(at)
        fits = (owner[:n] == owner[len(mask) - 1 :]) & (sizes[owner[:n]] >= least) if n else np.empty(0, bool)
        good = fits & (width[:n] >= SHORT) & (mask in MASKS)
        for w, begin in short:  # a window begins `begin` places before and ends in the item
            good |= fits & (width[:n] == w) & (spot[:n] >= begin) & (spot[:n] - begin + w <= sizes[owner[:n]])
        p = np.flatnonzero(good)
        found.append((at[p], owner[p], spot[p]))
    masks = list(wanted)
    keys, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, item, place = keys[order], item[order], place[order]
    bits = max(16, int(len(keys) * 16).bit_length())
    table = np.zeros(1 << bits, bool)
    table[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Index([i for i, _ in items], all_tokens, edges, tuple(masks), keys, item, place, table, window, share)


def overlaps(block: k.Block, index: Index, most_hits: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row in block, item, tokens that agree in the item's best window) of all verified overlaps; a pair may come again."""
    tokens = k.tokenise(block, k.WORDS)
    hashes, row = k.token_hashes(block, tokens), tokens.row
    shift = np.uint64(64 - (len(index.table).bit_length() - 1))
    out = [(np.empty(0, np.int64),) * 3]
    held, count = [np.empty((0, 2), np.int64)], 0

    def check() -> None:
        nonlocal held, count
        pairs = np.unique(np.concatenate(held), axis=0)
        for part in np.array_split(pairs, max(1, len(pairs) // 20_000)):
            out.append(_verified(part, hashes, tokens, index))
        held, count = [np.empty((0, 2), np.int64)], 0

    for mask in index.masks:
        at = seeds(hashes, mask)
        near = np.flatnonzero(index.table[(at >> shift).astype(np.int64)])
        near = near[row[near] == row[near + len(mask) - 1]]
        first, last = np.searchsorted(index.keys, at[near]), np.searchsorted(index.keys, at[near], side="right")
        upto = np.cumsum(last - first)
        total = int(upto[-1]) if len(upto) else 0
        for begin in range(0, total, most_hits):  # hits begin to begin + most_hits, counted over all places
            end = min(total, begin + most_hits)
            i = np.searchsorted(upto, np.arange(begin, end), side="right")
            entry = first[i] + np.arange(begin, end) - (upto[i] - (last - first)[i])
            here = near[i]
            held.append(np.unique(np.stack([row[here] * len(index.ids) + index.item[entry], here - index.place[entry]], 1), axis=0))
            count += len(held[-1])
            if count >= most_hits:
                check()
    check()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _verified(pairs: np.ndarray, hashes: np.ndarray, tokens: k.Tokens, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, item, start = pairs[:, 0] // len(index.ids), pairs[:, 0] % len(index.ids), pairs[:, 1]
    size = np.diff(index.bounds)[item]
    first = np.cumsum(size) - size
    inner = np.arange(size.sum()) - np.repeat(first, size)
    at = np.repeat(start, size) + inner
    inside = (at >= np.repeat(tokens.bounds[row], size)) & (at < np.repeat(tokens.bounds[row + 1], size))
    agree = np.zeros(len(at), np.int64)
    agree[inside] = hashes[at[inside]] == index.tokens[np.repeat(index.bounds[item], size)[inside] + inner[inside]]
    sums = np.append(0, np.cumsum(agree))
    width = np.minimum(index.window, size)
    starts = np.flatnonzero(inner <= np.repeat(size - width, size))
    best = np.zeros(len(item), np.int64)
    np.maximum.at(best, np.repeat(np.arange(len(item)), size)[starts], sums[starts + np.repeat(width, size)[starts]] - sums[starts])
    good = best >= np.ceil(index.share * width - 1e-9)
    return row[good], item[good], best[good]


def parts_of(benchmark: DataFrame, part_chars: int, **options: object) -> Iterator[Index]:
    """Indexes of the benchmark's parts."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // part_chars)
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield build(sorted(((r.item_id, r.text) for r in rows), key=str), **options)


def contaminated(docs: DataFrame, benchmark: DataFrame, part_chars: int = 4_000_000, **options: object) -> DataFrame:
    """doc_id, item_id, matched for each document and item that overlaps with it.

    docs: doc_id, text; benchmark: item_id, text. options: window, share, least; see build().
    """
    spark = docs.sparkSession
    schema = StructType([StructField("doc_id", LongType()), StructField("item_id", benchmark.schema["item_id"].dataType), StructField("matched", IntegerType())])
    kind = to_arrow_type(schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for index in parts_of(benchmark, part_chars, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for block in k.blocks(batch.column("text"), lower=True):
                    row, item, matched = overlaps(block, index)
                    best: dict = {}
                    for r, i, m in zip(row.tolist(), item.tolist(), matched.tolist(), strict=True):
                        best[r, i] = max(m, best.get((r, i), 0))
                    if best:
                        rows = pa.array([block.first + r for r, _ in best])
                        names = pa.array([index.ids[i] for _, i in best], kind)
                        yield pa.record_batch([ids.take(rows), names, pa.array(list(best.values()), pa.int32())], ["doc_id", "item_id", "matched"])

        out = out.union(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(k.trimmed(run), schema))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, part_chars: int = 4_000_000, **options: object) -> DataFrame:
    """The rows of docs that overlap with no item, with all their columns."""
    spark = docs.sparkSession
    for index in parts_of(benchmark, part_chars, **options):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for block in k.blocks(batch.column("text"), lower=True):
                    good[block.first + overlaps(block, shared.value)[0]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(k.trimmed(run), docs.schema)
    return docs
