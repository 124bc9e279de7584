import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import repeats


def brute_force(rows, width=13):
    """What the query returns, in plain Python."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[i : i + width])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row_hash int, runs string")
    out = repeats.remove_repeats(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=str)


def case(rng):
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, loop = text(30), "a b " * 20
    rows = [(i, text(rng.randint(0, 60))) for i in range(30)]
    rows += [(100 + i, f"{text(rng.randint(0, 9))}\t{passage}\n{text(5)}") for i in range(8)]
    rows += [(200, loop), (201, loop + "c"), (202, passage[: len(passage) // 2]), (7, passage), (None, passage), (None, None), (300, None), (301, ""), (5, rows[5][1]), (302, " \x0b "), (303, "é" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"group": 3, "ranges": 4}, {"group": 40, "ranges": 1, "gram": 1}])
def test_matches_brute_force(spark, options):
    rows = case(random.Random(3))
    want = sorted(brute_force(rows), key=str)
    assert sum(x[2] for x in want) > 200
    assert run(spark, rows, **options) == want


def test_rows_of_one_id(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))
    p, y, z = text(), text(), text()
    for rows in ([(1, p), (5, p), (5, y)], [(1, p), (5, p), (5, "short one")], [(1, p), (5, p), (5, p), (5, y + " " + p), (5, None), (5, z), (9, y), (9, z), (9, z)]):
        assert run(spark, rows) == sorted(brute_force(rows), key=str)


def test_one_very_frequent_prefix(spark):
    """Many different windows under the same three words: the prefix grows, and no window is lost or taken for another."""
    texts = [f"the common start {' '.join(f'{j}x{i}' for j in range(10))}" for i in range(40_000)]
    rows = list(enumerate(texts)) + [(50_000, texts[7]), (50_001, "and " + texts[9] + " end")]
    prefixes, total = repeats.plan(spark.createDataFrame(rows, "doc_id long, text string"), 13, 3, 2000, 16)
    assert total == 40_004 and prefixes.levels
    got = {r[0]: r for r in run(spark, rows, group=2000, ranges=16)}
    assert got[50_000][2] == 13 and got[50_001][2] == 13 and sum(r[2] for r in got.values()) == 26


def test_empty_table(spark):
    assert run(spark, []) == []


def test_words_decide(monkeypatch):
    """Windows whose hashes meet are still told apart by their words."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(20))) for i in range(20)] + [(50, "a b " + " ".join(f"w3_{j}" for j in range(20)))]
    whole = repeats.k.window_hashes
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], ["doc_id", "text", "row_hash"])
    halves = [batch.slice(0, 10), batch.slice(10)]

    def removed():
        blobs = {}
        for half in halves:
            for out in repeats.file_suffixes(13, 3, repeats.Prefixes(4), 2)(iter([half])):
                for part, packed in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                    blobs.setdefault(part, []).append(packed)
        return sorted((r["doc_id"], i) for out in repeats.resolve(iter(blobs.items()), 13) for r in out.to_pylist() for i in range(r["first"], r["first"] + r["windows"]))

    want = [(50, i) for i in range(2, 10)]
    assert removed() == want
    monkeypatch.setattr(repeats.k, "window_hashes", lambda hashes, n: whole(hashes, n) if n == 3 else np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    assert removed() == want


def brute_repeats(texts, least):
    """Maximal repeats by comparing all pairs of places."""
    found = {}
    places = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
    for x, (i, j) in enumerate(places):
        for a, b in places[:x]:
            n = 0
            while j + n < len(texts[i]) and b + n < len(texts[a]) and texts[i][j + n] == texts[a][b + n]:
                n += 1
            if n >= least and (j == 0 or b == 0 or texts[i][j - 1] != texts[a][b - 1]):
                found[tuple(texts[i][j : j + n])] = None
    return {w: sorted((i, j) for i, j in places if tuple(texts[i][j : j + len(w)]) == w) for w in found}


@pytest.mark.parametrize("least", [1, 3, 5])
def test_maximal_repeats_of_a_tree(least):
    rng = random.Random(least)
    texts = [[rng.randrange(1, 4) for _ in range(rng.randint(0, 25))] for _ in range(8)]
    texts += [texts[0] + [9] + texts[1], [2] * 12, texts[3]]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    where = [(i, j) for i, t in enumerate(texts) for j in range(len(t))]
    tokens = np.array([x for t in texts for x in t], np.uint64)
    got = {}
    for depth, starts in repeats.maximal_repeats(tokens, bounds, least):
        assert tuple(tokens[starts[0] : starts[0] + depth].tolist()) not in got
        got[tuple(tokens[starts[0] : starts[0] + depth].tolist())] = [where[s] for s in starts]
    assert got == brute_repeats(texts, least) and len(got) > 5
    assert list(repeats.maximal_repeats(tokens[:0], np.zeros(1, np.int64), 1)) == []
