"""Toxicity: logistic regression learnt by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the presence of a text's words, of its pairs of neighbours and of its pairs with one word between, lower case, hashed to
`2 ** bits`. Per-coordinate learning rates and an L1 term leave a few weights other than 0; only those are sent to the executors,
so what is broadcast is bounded by the model and not by the data.

The model is fitted on a bounded sample: at most `quota` labelled documents of each class and at most `most_chars` characters of
text, of which a class that needs less than its half keeps all its documents (one document of each class stays at any length). Of rows
that share a doc_id one text is learnt from, that with the least hash; an id with both labels is learnt from under both.

Every row is scored by its own text; equal texts have equal scores. Null or empty texts have no feature and get the score of the bias.
Without labels of both classes all scores are next to 0. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.sampling import held_out, place, stratified
from tessera.session import materialise

BITS = 20


def features(block: k.Block, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row in block, hash) of words, pairs and skip-grams; a feature may come again."""
    tokens = k.tokenise(block, k.WORDS)
    hashes, row, shift = k.token_hashes(block, tokens), tokens.row, np.uint64(64 - bits)
    yield row, (hashes >> shift).astype(np.int64)
    for gap in (1, 2):
        same = row[:-gap] == row[gap:]
        yield row[:-gap][same], (k.mix(hashes[:-gap] * np.uint64(2 * gap + 1) + hashes[gap:])[same] >> shift).astype(np.int64)


def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct features as a binary of int32, beside its label."""
    for batch in batches:
        out: list[bytes] = []
        for block in k.blocks(batch.column("text"), lower=True):
            row, bucket = (np.concatenate(x) for x in zip(*features(block), strict=True))
            both = np.unique(row << BITS | bucket)
            bounds = np.searchsorted(both, np.arange(block.last - block.first + 1) << BITS)
            low = (both & ((1 << BITS) - 1)).astype(np.int32)
            out += [low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "features"])


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with weights other than 0, and the bias."""

    index: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.index] = self.weights
        out = np.full(batch.num_rows, self.bias)
        for block in k.blocks(batch.column("text"), lower=True):
            hits = []
            for row, bucket in features(block):
                hit = dense[bucket] != 0
                hits.append(row[hit] << BITS | bucket[hit])
            both = np.unique(np.concatenate(hits))
            out[block.first : block.last] += np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], block.last - block.first)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = 2.0, beta: float = 1.0, l1: float = 16.0, l2: float = 0.1, epochs: int = 20, balance: bool = True, seed: int = 1) -> Model:
    """FTRL-proximal: w = 0 where |z| <= l1, else -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2); the bias has no L1 term."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == size, 0.0, l1)
        return np.where(np.abs(z[at]) <= penalty, 0.0, -(z[at] - np.sign(z[at]) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in examples])
    each = np.array([1.0, max(1.0, (labels == 0).sum() / max(1, (labels == 1).sum()))]) if balance else np.ones(2)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at = np.append(examples[i][0], size)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -500, 500))) - labels[i]) * each[labels[i]]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    all_w = weights(np.arange(size + 1))
    index = np.flatnonzero(all_w[:size])
    return Model(index, all_w[index].astype(np.float32), float(all_w[size]))


def fitting(rows: list[tuple[int, int, int, int]], most_chars: int) -> list[tuple[int, int]]:
    """(doc_id, label) of the (doc_id, label, place, chars) that fit into most_chars together, by place and at least one of each label.

    The label with the fewest characters comes first; each may have an equal share of what is left.
    """
    of: dict[int, list] = {}
    for doc_id, label, at, chars in rows:
        of.setdefault(label, []).append((at, doc_id, chars))
    out, left, waiting = [], most_chars, len(of)
    for label in sorted(of, key=lambda x: (sum(c for _, _, c in of[x]), x)):
        share, used, waiting = left // waiting, 0, waiting - 1
        for i, (_, doc_id, chars) in enumerate(sorted(of[label])):
            if i == 0 or used + chars <= share:
                out.append((doc_id, label))
                used += chars
        left = max(0, left - used)
    return out


def fit(docs: DataFrame, labels: DataFrame, quota: int = 3000, most_chars: int = 40_000_000) -> Model:
    """The model from labels (doc_id, toxic) of documents that aren't held out: see above for its bounds."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~held_out()).distinct()
    ids = [(r.doc_id, r.label) for r in stratified(known, "label", "doc_id", quota).collect()]
    if len({label for _, label in ids}) < 2:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), -1000.0)
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, label int"))  # about 2 * quota rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    text = text.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    text = materialise(text.select("doc_id", "label", F.col("least.text").alias("text")))
    sizes = text.select("doc_id", "label", place(F.col("doc_id")).alias("at"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")).collect()
    if sum(r.chars for r in sizes) > most_chars:
        within = F.broadcast(spark.createDataFrame(fitting(list(map(tuple, sizes)), most_chars), "doc_id long, label int"))
        text = text.join(within, ["doc_id", "label"])
    found = text.select("doc_id", "label", "text").mapInArrow(k.trimmed(present), "doc_id long, label int, features binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.label, bytes(r.features)))
    return ftrl([(np.frombuffer(r.features, np.int32).astype(np.int64), r.label) for r in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(batch))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(k.trimmed(run), "doc_id long, score double")
