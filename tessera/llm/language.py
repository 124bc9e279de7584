"""Language ID: a blended-spectrum string kernel with Nystroem landmarks and one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams (n from 1 to 4, lower case, everything but letters as a blank), hashed to `DIM`
cells; the kernel of two texts is the cosine of their sets. Training texts are mapped to landmarks, and ridge regression gives one
column of coefficients for each language. Blocks of texts are scored by two matrix products: sets by landmarks, and
kernel values by coefficients. Texts are read whole.

Learnt from a bounded sample: at most `quota` documents of each language and `most` of all (one at least of each language), chosen by
a hash of id and text. `landmarks` of them are landmarks, or two for each language where that is more, up to `most_landmarks`. All
languages are learnt, however many. Only the sample's packed sets (DIM bits each) reach the driver.

A null text or one without a letter is `und` with the score 0; so is every text if no language can be learnt. Rows that repeat an id are
predicted each by its own text, equal texts alike; of equal values the first language by code point is predicted. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.sampling import held_out, stratified

DIM, LONGEST, ROWS = 1 << 14, 4, 256

_LETTERS = np.full(256, 32, np.uint32)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_MULTIPLIERS = (k.seeded(LONGEST, 99) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sets(block: k.Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first row in block, uint8 matrix of rows by cells): which n-grams occur."""
    codes = _LETTERS[block.data]
    n_rows = len(block.offsets) - 1
    for first in range(0, n_rows, ROWS):
        last = min(n_rows, first + ROWS)
        a, b = block.offsets[first], block.offsets[last]
        base = (np.repeat(np.arange(last - first, dtype=np.int64), np.diff(block.offsets[first : last + 1])) * DIM).astype(np.int64)
        out = np.zeros((last - first) * DIM + 1, np.uint8)
        part, ends = codes[a:b], block.offsets[first + 1 : last + 1] - a
        rolled = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            rolled = rolled[:m] * np.uint32(257) + part[n - 1 :]
            cell = base[:m] + ((rolled * _MULTIPLIERS[n - 1] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(18))
            if n > 1:
                over = (ends[:, None] - np.arange(1, n)).ravel()
                cell[over[(over >= 0) & (over < m)]] = (last - first) * DIM
            out[cell] = 1
        yield first, out[:-1].reshape(-1, DIM)


def has_letter(column: pa.Array, block: k.Block) -> np.ndarray:
    """Which rows of a block hold a letter of any script."""
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[97:123] = ascii_letter[65:91] = 1
    sums = lambda x: np.diff(np.append(0, np.cumsum(x))[block.offsets])
    out = sums(ascii_letter[block.data]) > 0
    for i in np.flatnonzero(~out & (sums(block.data >= 128) > 0)):
        out[i] = any(c.isalpha() for c in column[int(block.first + i)].as_py())
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set as bits, beside its language."""
    for batch in batches:
        out: list[bytes] = []
        for block in k.blocks(batch.column("text"), lower=True):
            for _, m in sets(block):
                out += [row.tobytes() for row in np.packbits(m, axis=1)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.binary())], ["doc_id", "lang", "bits"])


@dataclass(frozen=True)
class Model:
    """Landmark sets scaled to length 1 (cells by landmarks), coefficients (landmarks by languages), language names."""

    landmarks: np.ndarray
    coefficients: np.ndarray
    names: list[str]

    def predict(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        if not self.names:
            return names, score
        column = batch.column("text")
        landmarks = np.unpackbits(self.landmarks, axis=1, count=DIM).astype(np.float32)
        landmarks = (landmarks / np.sqrt(np.maximum(landmarks.sum(1, keepdims=True), 1))).T.copy()
        for block in k.blocks(column, lower=True):
            letters = has_letter(column, block)
            for first, m in sets(block):
                x = m.astype(np.float32)
                kernel = (x @ landmarks) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                values = kernel @ self.coefficients
                best = values.argmax(1)
                for i in np.flatnonzero(letters[first : first + len(m)]):
                    at = int(block.first + first + i)
                    names[at], score[at] = self.names[best[i]], min(1.0, max(0.0, float(values[i, best[i]])))
        return names, score


def solve(bits: np.ndarray, langs: list[str], landmarks: int = 128, ridge: float = 1e-3, most_landmarks: int = 1024) -> Model:
    """Kernel ridge regression on the landmarks' span; landmarks are spread evenly over the rows, which are sorted by language."""
    names = sorted(set(langs))
    if not names:
        return Model(np.empty((0, DIM // 8), np.uint8), np.empty((0, 0), np.float32), [])
    n = len(bits)
    at = np.unique(np.linspace(0, n - 1, min(n, max(landmarks, min(most_landmarks, 2 * len(names))))).astype(int))

    def scaled(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1, count=DIM).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    base = scaled(bits[at])
    cross = np.concatenate([scaled(bits[i : i + 1024]) @ base.T for i in range(0, n, 1024)]).astype(np.float64)
    values, vectors = np.linalg.eigh(cross[at])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = cross @ root
    sums = np.zeros((len(names), z.shape[1]))
    np.add.at(sums, np.searchsorted(np.array(names), np.array(langs)), z)
    w = np.linalg.solve(z.T @ z + ridge * n * np.eye(z.shape[1]), sums.T)
    return Model(bits[at], (root @ w).astype(np.float32), names)


def fit(docs: DataFrame, quota: int = 300, landmarks: int = 128, most: int = 50_000) -> Model:
    """The model from text and lang of documents that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = stratified(rows, "lang", "doc_id", quota, "text", most)
    found = rows.mapInArrow(k.trimmed(packed), "doc_id long, lang string, bits binary").collect()
    found.sort(key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, bytes(r.bits)))
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in found), np.uint8).reshape(-1, DIM // 8)
    return solve(bits, [r.lang for r in found], landmarks)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = model.predict(batch)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(k.trimmed(run), "doc_id long, lang_pred string, score double")
