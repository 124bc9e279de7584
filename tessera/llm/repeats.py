"""Substring dedup: word windows that already start in a document with a smaller id, by prefix-partitioned suffix trees.

A window of `width` words is the beginning of a suffix; it is to be removed if it lies below an internal node of depth `width` or more
in the generalised suffix tree of the corpus that also has a leaf of a smaller document. The tree is built in parts:

* Prefixes. Every window is filed under the gram of `gram` words in it whose hash is the smallest. The choice depends only on the
  window's words, so equal windows share it, and consecutive windows share it too, so a run of them travels as one stretch of text.
* Groups. A pass counts the windows under each range of prefixes. Where they don't fit into a group, their prefixes grow by a word (to
  the right up to the window's end, then to the left), the children are counted, and so on, until every group fits or the prefix is
  the whole window. So prefixes have the length that their frequency asks for, and groups of at most `group` windows go to one task each.
* Subtrees. The suffixes of a group are sorted by words and the common prefixes of neighbours measured; internal nodes are
  the intervals whose neighbours share enough words. Suffixes that a hash of their first `width` words shows to be alone are leaves
  of shallower nodes and are left out before the sort.
* Removal. A deep node's least document keeps its windows, those of all other leaves go. Touching runs together are the maximal repeats.

Before anything is shuffled each block of documents resolves its own repeats in the same way, so a passage in a third of all documents
reaches its group once per block and not once per document.

Words are compared one by one by 64-bit hashes. Runs are given back to the row they came from (doc_id and a hash of the text), so rows
that repeat a doc_id with other texts keep theirs. Such rows are one document to each other: they don't remove one another's
words. Rows without doc_id keep all their words and remove nothing elsewhere. Null text: no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k

#: Ranges of prefix hashes that are counted first, and bytes of text whose runs are packed together.
RANGES, PACK_BYTES = 1 << 14, 16 << 20


def runs_of(flags: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of maximal runs of set flags over which the given arrays don't change."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def subtree(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order of the suffixes that begin at starts, and how many tokens each shares with the one before it in that order.

    A suffix reaches to its end (exclusive); tokens beyond `deepest` aren't looked at. Ranks of prefixes double in length each round.
    starts ascend.
    """
    if not len(starts):
        return starts, starts
    reach = np.minimum(ends, starts + deepest)
    # the stretches that suffixes cover, one after the other with a token below all others behind each
    change = np.zeros(len(tokens) + 2, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, reach, -1)
    covered = np.cumsum(change[:-1]) > 0
    covered[1:] |= covered[:-1] & ~covered[1:]
    place = np.cumsum(covered) - 1
    inside = np.flatnonzero(covered)
    real = (np.cumsum(change[:-1]) > 0)[inside]
    rank = np.zeros(len(inside), np.int64)
    rank[real] = np.unique(tokens[inside[real]], return_inverse=True)[1] + 1
    codes, length = rank, 1
    while length < deepest:
        step = min(length, deepest - length)
        beyond = np.zeros(len(rank), np.int64)
        beyond[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + beyond, return_inverse=True)[1] + 1
        length += step
    at, most = place[starts], reach - starts
    order = np.argsort(rank[at], kind="stable")
    common = np.zeros(len(order), np.int64)
    left, right = order[:-1], order[1:]
    limit, alive = np.minimum(most[left], most[right]), np.arange(1, len(order))
    depth = 0
    while len(alive):
        alive = alive[limit[alive - 1] > depth]
        alive = alive[codes[at[order[alive - 1]] + depth] == codes[at[order[alive]] + depth]]
        depth += 1
        common[alive] = depth
    return order, common


def nodes(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last + 1) of the internal nodes of at least that depth, as intervals of the sorted suffixes."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            high, first = stack.pop()
            yield high, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(tokens: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[int, list[int]]]:
    """(length, starts) of every stretch of at least that length that occurs more than once and can't be extended to either side.

    bounds: where the texts begin, and the end of the last. One group's tree as a whole.
    """
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    heads = set(bounds[:-1].tolist())
    gap = np.insert(tokens, bounds[1:], 0)  # so that no suffix is read beyond its text
    order, common = subtree(gap, np.arange(len(tokens)) + text, (bounds[1:] + np.arange(len(size)))[text], int(size.max(initial=1)))
    for depth, lo, hi in nodes(common, least):
        at = sorted(order[lo:hi].tolist())
        before = {None if p in heads else int(tokens[p - 1]) for p in at}
        if len(before) > 1 or None in before:
            yield depth, at


def later(tokens: np.ndarray, paths: np.ndarray, starts: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """Whether the same `width` tokens also start in a smaller document. paths: hashes of these tokens; starts ascend."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    order = np.argsort(paths)
    first = np.flatnonzero(np.append(True, paths[order][1:] != paths[order][:-1]))
    own = docs[order]
    mixed = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    shared = np.sort(order[np.repeat(mixed, np.diff(np.append(first, len(order))))])
    if not len(shared):
        return out
    at = starts[shared]
    order, common = subtree(tokens, at, at + width, width)
    first = np.flatnonzero(common < width)  # the intervals between are the uppermost deep nodes
    own = docs[shared][order]
    least = np.minimum.reduceat(own, first)
    out[shared[order]] = own > np.repeat(least, np.diff(np.append(first, len(order))))
    return out


@dataclass
class Prefixes:
    """The tree of prefixes: ranges of their hashes, and for each level the nodes that grow by a word, with their first child and number of children."""

    ranges: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    size: int = 0

    def __post_init__(self) -> None:
        self.size = self.size or self.ranges

    def grow(self, heavy: dict[int, int], group: int) -> None:
        """Give each heavy node (and its number of windows) children, of which each gets half a group if they are alike."""
        ids = np.array(sorted(heavy), np.int64)
        fan = np.array([2 * -(-heavy[i] // group) for i in ids.tolist()], np.int64)
        self.levels.append((ids, self.size + np.cumsum(fan) - fan, fan))
        self.size += int(fan.sum())

    def leaf(self, hashes: np.ndarray, grams: np.ndarray, least: np.ndarray, width: int, gram: int) -> np.ndarray:
        """The leaf of every window: least is its smallest gram hash."""
        node = (least % np.uint64(self.ranges)).astype(np.int64)
        alive, state, spot = np.arange(len(node)), None, None
        for level, (heavy, base, fan) in enumerate(self.levels, 1):
            i = np.minimum(np.searchsorted(heavy, node[alive]), len(heavy) - 1)
            hit = heavy[i] == node[alive]
            alive, i = alive[hit], i[hit]
            if not len(alive):
                break
            if state is None:
                state, spot = least[alive], np.full(len(alive), -1)
                for o in range(width - gram, -1, -1):
                    spot[grams[alive + o] == state] = o
            else:
                state, spot = state[hit], spot[hit]
            word = spot + gram - 1 + level
            word = np.where(word < width, word, spot - (word - width + 1))
            state = k.mix(state * np.uint64(31) + hashes[alive + word])
            node[alive] = base[i] + (state % fan[i].astype(np.uint64)).astype(np.int64)
        return node


def windows(batch: pa.RecordBatch, width: int, gram: int, prefixes: Prefixes, size: int) -> Iterator[tuple]:
    """For each block: block, tokens, their hashes, which windows lie in one document that has an id, and each window's leaf."""
    ids = batch.column("doc_id")
    for block in k.blocks(batch.column("text"), size):
        tokens = k.tokenise(block, k.SPACES)
        if len(tokens.start) < width:
            continue
        valid = ids.slice(block.first, block.last - block.first).is_valid().to_numpy(zero_copy_only=False)
        whole = tokens.row[: len(tokens.row) - width + 1] == tokens.row[width - 1 :]
        whole &= valid[tokens.row[: len(whole)]]
        hashes = k.token_hashes(block, tokens)
        grams = k.window_hashes(hashes, gram)
        yield block, tokens, hashes, whole, prefixes.leaf(hashes, grams, k.sliding_min(grams, width - gram + 1), width, gram)


def count_leaves(width: int, gram: int, prefixes: Prefixes, since: int):
    """Map documents to counts of windows by leaf, of leaves from `since` on."""
    size = prefixes.size - since

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64) if size <= 1 << 20 else None
        for batch in batches:
            for _, _, _, whole, leaf in windows(batch, width, gram, prefixes, k.BLOCK_BYTES):
                new = leaf[whole & (leaf >= since)] - since
                if total is not None:
                    total += np.bincount(new, minlength=size)
                else:
                    at, n = np.unique(new, return_counts=True)
                    yield pa.record_batch([pa.array(at + since), pa.array(n)], ["leaf", "n"])
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at + since), pa.array(total[at])], ["leaf", "n"])

    return run


def plan(source: DataFrame, width: int, gram: int, group: int, ranges: int = RANGES) -> tuple[Prefixes, int]:
    """The prefixes that keep every group below that many windows, and the number of windows.

    The driver gets a row for each range, then one for each node that has to grow: at most one for each `group` windows.
    """
    prefixes, since, total = Prefixes(ranges), 0, None
    for _ in range(width - gram + 1):
        counts = source.mapInArrow(k.trimmed(count_leaves(width, gram, prefixes, since)), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
        if total is None:
            found = counts.collect()
            total = sum(r.n for r in found)
        else:
            found = counts.filter(F.col("n") > group).collect()
        heavy = {r.leaf: r.n for r in found if r.n > group}
        if not heavy or len(prefixes.levels) == width - gram:
            break
        since = prefixes.size
        prefixes.grow(heavy, group)
    return prefixes, total


def planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: small numbers pack well."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def from_planes(data: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


def pack(parts: np.ndarray, rows: tuple[np.ndarray, ...], stretches: list[bytes], gone_parts: np.ndarray, gone: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) of runs: rows are doc_id, text hash, first window, windows; stretches their text; gone the same of runs that are to go."""
    order, gone_order = np.argsort(parts, kind="stable"), np.argsort(gone_parts, kind="stable")
    parts, gone_parts = parts[order], gone_parts[gone_order]
    used = np.unique(np.concatenate([parts, gone_parts]))
    ends = [np.searchsorted(x, used, side=s).tolist() for x in (parts, gone_parts) for s in ("left", "right")]
    rows, gone = [x[order] for x in rows], [x[gone_order] for x in gone]
    names = order.tolist()
    zstd = pa.Codec("zstd", 3)
    for part, a, b, c, d in zip(used.tolist(), *ends, strict=True):
        texts = [stretches[i] for i in names[a:b]]
        sizes = np.fromiter(map(len, texts), np.uint32, b - a)
        numbers = [np.concatenate([x[a:b], y[c:d]]) for x, y in zip(rows, gone, strict=True)]
        numbers[0][1:] -= numbers[0][:-1].copy()
        body = b"".join([planes(numbers[0]), planes(numbers[1]), planes(numbers[2].astype(np.uint32)), planes(numbers[3].astype(np.uint32)), planes(sizes), *texts])
        yield part, np.array([b - a, d - c, len(body)], np.int64).tobytes() + zstd.compress(body, asbytes=True)


def unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """What pack() took for one part: rows, sizes of the stretches, gone, all stretches as bytes."""
    n, g, size = np.frombuffer(blob, np.int64, 3).tolist()
    body, at, out = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[24:], size), np.uint8), 0, []
    for kind, count in ((np.int64, n + g), (np.int64, n + g), (np.uint32, n + g), (np.uint32, n + g), (np.uint32, n)):
        width = np.dtype(kind).itemsize * count
        out.append(from_planes(body[at : at + width], kind).astype(np.int64))
        at += width
    out[0] = np.cumsum(out[0])
    return [x[:n] for x in out[:4]], out[4], [x[n:] for x in out[:4]], body[at:]


def file_suffixes(width: int, gram: int, prefixes: Prefixes, parts: int):
    """Map documents (doc_id, text, row_hash) to rows for each part: runs of windows with their text, and the runs that a block itself removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0

        def flush() -> Iterator[pa.RecordBatch]:
            join = lambda i: np.concatenate([h[i] for h in held])
            both = lambda i: tuple(np.concatenate([h[i][j] for h in held]) for j in range(4))
            found = list(pack(join(0), both(1), [s for h in held for s in h[2]], join(3), both(4)))
            for i in range(0, len(found), 1000):
                some = found[i : i + 1000]
                yield pa.record_batch([pa.array([p for p, _ in some], pa.int64()), pa.array([b for _, b in some], pa.binary())], ["part", "packed"])

        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("row_hash").to_numpy(zero_copy_only=False).astype(np.int64)
            for block, tokens, hashes, whole, leaf in windows(batch, width, gram, prefixes, 2 * k.BLOCK_BYTES):
                own_ids, own_keys = ids[block.first : block.last], keys[block.first : block.last]
                row = tokens.row[: len(whole)]
                at = np.flatnonzero(whole)
                here = np.zeros(len(whole), bool)
                here[at] = later(hashes, k.window_hashes(hashes, width)[at], at, own_ids[row[at]], width)
                part = (k.mix(leaf.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                first, count = runs_of(whole & ~here, row, part)
                gone, gone_count = runs_of(here, row)
                text = block.data.tobytes()
                begin, end = tokens.start[first].tolist(), tokens.end[first + count + width - 2].tolist()
                stretches = [text[a:b] for a, b in zip(begin, end, strict=True)]
                of = lambda x, n: (own_ids[row[x]], own_keys[row[x]], x - tokens.bounds[row[x]], n)  # noqa: B023, E731
                gone_rows = of(gone, gone_count)
                held.append((part[first], of(first, count), stretches, (k.mix(gone_rows[1].view(np.uint64)) % np.uint64(parts)).astype(np.int64), gone_rows))
                weight += len(text)
                if weight >= PACK_BYTES:
                    yield from flush()
                    held, weight = [], 0
        if held:
            yield from flush()

    return run


def resolve(groups: Iterator[tuple[int, list[bytes]]], width: int) -> Iterator[pa.RecordBatch]:
    """For each part its runs that are to go: doc_id, row_hash, first, windows."""
    for _, blobs in groups:
        found = [unpack(b) for b in blobs]
        blobs.clear()
        ids, keys, start, count = (np.concatenate([f[0][i] for f in found]) for i in range(4))
        hashes: list[np.ndarray] = [np.empty(0, np.uint64)]
        pending: list[tuple] = []

        def tokenised(pending: list[tuple]) -> np.ndarray:
            offsets = np.append(0, np.cumsum(np.concatenate([p[0] for p in pending])))
            block = k.Block(0, len(offsets) - 1, np.concatenate([p[1] for p in pending]), offsets)
            return k.token_hashes(block, k.tokenise(block, k.SPACES))

        for i, (_, size, _, body) in enumerate(found):
            pending.append((size, body))
            if i + 1 == len(found) or sum(len(b) for _, b in pending) >= k.BLOCK_BYTES:
                hashes.append(tokenised(pending))
                pending = []
        gone = [np.concatenate([f[2][i] for f in found]) for i in range(4)]
        del found
        tokens = np.concatenate(hashes)
        heads = np.cumsum(count + width - 1) - (count + width - 1)
        run = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        at = heads[run] + inner
        paths = k.window_hashes(tokens, width)
        out = later(tokens, paths[at] if len(at) else paths[:0], at, ids[run], width)
        hit, length = runs_of(out, run)
        rows = (ids[run[hit]], keys[run[hit]], start[run[hit]] + inner[hit], length)
        columns = [np.concatenate([a, b]) for a, b in zip(rows, gone, strict=True)]
        for a in range(0, len(columns[0]), 200_000):
            yield pa.record_batch([pa.array(c[a : a + 200_000], pa.int64()) for c in columns], ["doc_id", "row_hash", "first", "windows"])


def by_key(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[tuple[int, list[bytes]]]:
    """Values of a binary column by an integer key, from batches sorted by that key."""
    now, held = None, []
    for batch in batches:
        for x, blob in zip(batch.column(key).to_pylist(), batch.column(value), strict=True):
            if x != now and held:
                yield now, held
                held = []
            now = x
            held.append(blob.as_py())
    if held:
        yield now, held


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row_hash, which tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def repeated_runs(docs: DataFrame, width: int = 13, gram: int = 3, group: int = 1_000_000, ranges: int = RANGES) -> tuple[DataFrame, int]:
    """Runs of consecutive windows that also start in a document with a smaller id (doc_id, row_hash, first word, windows), and in how many tasks.

    The runs of a row may touch; words covered are first to first + windows + width - 2.
    """
    source = keyed(docs)
    prefixes, total = plan(source.select("doc_id", "text"), width, gram, group, ranges)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // group))
    filed = source.mapInArrow(k.trimmed(file_suffixes(width, gram, prefixes, tasks)), "part long, packed binary")
    runs = (
        filed.repartition(tasks, "part")
        .sortWithinPartitions("part")
        .mapInArrow(k.trimmed(lambda batches: resolve(by_key(batches, "part", "packed"), width)), "doc_id long, row_hash long, first long, windows long")
    )
    return runs, tasks


def cut(width: int):
    """Map documents with their runs to the words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("runs"), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if (spans := spans.values) is not None and len(spans):
                    first, n = (spans.field(i).to_numpy() for i in (0, 1))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + n + width - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = 13, **options: int) -> DataFrame:
    """Each row of docs as doc_id, n_words, n_removed, kept (binary UTF-8): its text without repeated windows, words joined by one space.

    options: see repeated_runs().
    """
    runs, tasks = repeated_runs(docs, width, **options)
    runs = runs.select(F.col("doc_id").alias("of"), F.col("row_hash").alias("of_hash"), F.struct("first", "windows").alias("run"))
    of_row = runs.repartition(tasks, "of", "of_hash").groupBy("of", "of_hash").agg(F.collect_set("run").alias("runs"))
    source = keyed(docs).repartition(tasks, "doc_id", "row_hash")
    joined = source.join(of_row, (source["doc_id"] == of_row["of"]) & (source["row_hash"] == of_row["of_hash"]), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(k.trimmed(cut(width)), "doc_id long, n_words long, n_removed long, kept binary")
