import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import jaccard_join as j
from tessera.llm.components import components


def brute_force(rows, n=5, threshold=0.8):
    """What join() returns, in plain Python."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def test_bands():
    b, r = j.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**r) ** b >= 0.9995 and b * r <= 192


def case(rng):
    text = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = text(rng.choice([3, 5, 12, 60, 150]))
        for _ in range(rng.randint(1, 14)):
            new = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                new[rng.randrange(len(new))] = f"x{rng.randrange(100)}"
            rows.append(" ".join(new) + rng.choice(["", "\n", " tail"]))
    rows += ["", None, " ", "a", "a", "a a a a a a a a a"]
    rng.shuffle(rows)
    return [(i * 7 % 1000, t) for i, t in enumerate(rows)]


def test_against_brute_force(spark):
    rows = case(random.Random(11))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")
    want = sorted(brute_force(rows))
    assert sum(n for _, _, n in want) > 100
    for cell in (256, 3):
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in j.join(df, cell=cell).collect())
        assert got == want
    kept = j.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, long), (3, long + " end"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, j.join(df).collect()), key=str)
    assert got == sorted([(None, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1), (None, None, 0)], key=str)
    assert sorted((r.doc_id or 0) for r in j.keep_first(df).collect()) == [0, 0, 1, 2]
    assert j.join(df.limit(0)).collect() == [] and j.keep_first(df.limit(0)).collect() == []


def test_repeated_rows_within_a_region(spark):
    """Rows that repeat an id, with equal and with other texts, have the links of their own text."""
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    t, u, v = text(), text(), text()
    rows = [(1, t), (1, t), (2, t + " more"), (4, u), (4, v), (4, v), (9, u + " end"), (8, v + " end"), (3, "and " + v), (7, text()), (7, text()), (7, text()), (6, ""), (6, v)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, j.join(df).collect())) == sorted(brute_force(rows))


def test_keep_first_with_texts_under_one_id(spark):
    text = lambda name, *more: " ".join([f"{name}{i}" for i in range(60)] + list(more))
    rows = [(5, text("a")), (5, text("b")), (5, text("b")), (3, text("a", "end")), (7, text("b", "end")), (5, ""), (5, None), (2, text("c")), (2, text("c", "end"))]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, id int, _of int")
    for order in (df, df.orderBy(F.desc("text"))):
        kept = j.keep_first(order)
        got = sorted((r.doc_id, (r.text or "")[:1]) for r in kept.collect())
        assert kept.columns == df.columns and got == [(2, "c"), (3, "a"), (5, ""), (5, "b")]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
