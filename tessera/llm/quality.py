"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k sampling.

Tokens are runs of word bytes or of punctuation; their unigrams and bigrams are hashed to `buckets`. The raw model counts all
documents; the target model counts those of a bounded sample of ids known to be good. The log ratio of a bucket is that of its
count in the target to the count expected there if the target were raw text, both plus `smoothing`, so that rare n-grams say little.
A document's log weight is the sum over its n-grams, the logarithm of the two models' ratio. Its key is the log weight plus Gumbel
noise, and the documents with the k largest keys are a sample without replacement in proportion to the weights.

By default k is a share of the documents that doesn't depend on any weight: the share of good ones among the labelled, and `spare` of
the rest, so that junk which the models can't tell from good text doesn't push good documents out. Without labels all documents are sampled.

`effective` (off by default) tempers log weights to at most so many n-grams. The noise is a hash of doc_id and the seed, so reruns agree
and rows that repeat a document stay or go together; rows with the same key at the cut all stay. Null or empty texts have no n-grams and
the log weight 0. Without any target document all log weights are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.sampling import kth_largest, stratified
from tessera.session import materialise


def grams(block: k.Block, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row in block, bucket) of the block's unigrams, then of its bigrams."""
    tokens = k.tokenise(block, k.MARKS)
    hashes = k.token_hashes(block, tokens)
    yield tokens.row, (hashes % np.uint64(buckets)).astype(np.int64)
    pairs = k.window_hashes(hashes, 2)
    same = tokens.row[:-1] == tokens.row[1:]
    yield tokens.row[:-1][same], (pairs[same] % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket, and how many n-grams of a text count in full (None: all)."""

    ratios: np.ndarray
    effective: int | None

    def log_weights(self, batch: pa.RecordBatch) -> np.ndarray:
        out, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for block in k.blocks(batch.column("text")):
            for row, bucket in grams(block, len(self.ratios)):
                out[block.first : block.last] += np.bincount(row, self.ratios[bucket], block.last - block.first)
                count[block.first : block.last] += np.bincount(row, minlength=block.last - block.first)
        return out if self.effective is None else out * np.minimum(1, self.effective / np.maximum(count, 1))


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    """Standard Gumbel noise by hash of the id; null ids share one draw."""
    x = ids.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    u = (k.mix(x ^ k.mix(np.full(1, seed, np.uint64))) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def fit(docs: DataFrame, labels: DataFrame, most_good: int = 20_000, buckets: int = 1 << 14, smoothing: float = 4.0, effective: int | None = None) -> Model:
    """The model from all docs and those of them whose doc_id has quality 1 in labels (doc_id, quality).

    At most most_good ids are used, chosen by hash; they are the only thing sent to all tasks and don't grow with the input.
    """
    good = labels.filter(F.col("quality") == 1)
    ids = good.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null").distinct()
    wanted = np.unique(np.array([r.doc_id for r in stratified(ids, "quality", "doc_id", most_good).collect()], np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            known = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), wanted) & ids.is_valid().to_numpy(zero_copy_only=False)
            for block in k.blocks(batch.column("text")):
                for row, bucket in grams(block, buckets):
                    raw += np.bincount(bucket, minlength=buckets)
                    target += np.bincount(bucket[known[block.first : block.last][row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(k.trimmed(count), "bucket int, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return Model(np.log((target + smoothing) / (expected + smoothing)) if target.any() else np.zeros(buckets), effective)


def score(docs: DataFrame, model: Model, seed: int = 5) -> DataFrame:
    """doc_id, log_weight, key for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = model.log_weights(batch)
            yield pa.record_batch([batch.column("doc_id"), pa.array(weights), pa.array(weights + gumbel(batch.column("doc_id"), seed))], ["doc_id", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(k.trimmed(run), "doc_id long, log_weight double, key double")


def share_of_good(labels: DataFrame, spare: float) -> float:
    """The part of the documents to sample: that of the good ones among labels (doc_id, quality), and `spare` of the rest."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return 1.0 if share is None else share + spare * (1 - share)


def threshold(scored: DataFrame, count: int | None, share: float) -> float:
    """The least key among the `count` largest; by default of that share of all rows."""
    if count is None:
        count = math.ceil(share * scored.count())
    cut = kth_largest(scored, "key", count)
    return float("inf") if count < 1 else float("-inf") if cut is None else cut


def resample(docs: DataFrame, labels: DataFrame, count: int | None = None, spare: float = 0.1, seed: int = 5, **options: float) -> DataFrame:
    """doc_id, log_weight, key of the documents in the sample. labels: doc_id, quality (1: good); options: see fit()."""
    scored = materialise(score(docs, fit(docs, labels, **options), seed))
    return scored.filter(F.col("key") >= threshold(scored, count, share_of_good(labels, spare)))


def keep(docs: DataFrame, labels: DataFrame, count: int | None = None, spare: float = 0.1, seed: int = 5, **options: float) -> DataFrame:
    """The rows of docs in the sample, with all their columns. They are scored again rather than joined, so no text is shuffled."""
    model = fit(docs, labels, **options)
    cut = threshold(materialise(score(docs, model, seed)), count, share_of_good(labels, spare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = model.log_weights(batch) + gumbel(batch.column("doc_id").cast(pa.int64()), seed)
            yield batch.filter(pa.array(keys >= cut))

    return docs.mapInArrow(k.trimmed(run), docs.schema)
