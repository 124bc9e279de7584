import datetime
import random
import re
from itertools import combinations

import pyarrow as pa

from tessera.llm import decontaminate as d
from tessera.llm import query_decontaminate


def brute_force(texts, items, window=13, share=0.8):
    """All pairs in which some window of the item agrees with the text at some offset in enough places."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    out = set()
    for i, t in enumerate(map(words, texts)):
        for j, b in enumerate(map(words, items)):
            w = min(window, len(b))
            for d in range(-len(b), len(t)):
                agree = [0 <= d + x < len(t) and t[d + x] == b[x] for x in range(len(b))]
                if any(sum(agree[s : s + w])  >= share * w - 1e-9 for s in range(len(b) - w + 1)):
                    out.add((i, j))
    return out


def case(rng):
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "é"] * 200
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.choice([40, 30, 13, 12, 7, 5])) for _ in range(20)] + [text(3), []]
    docs = []
    for _ in range(60):
        t, b = text(rng.randint(0, 80)), list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if len(b) > 15:
                b[rng.randrange(len(b))] = "changed"
        docs.append(t + (b if rng.random() < 0.7 else b[: len(b) // 2]) + text(5))
    return [" ".join(x) for x in docs], [" ".join(x) for x in items]


def test_against_brute_force(spark):
    texts, items = case(random.Random(5))
    want = {(i, j) for i, j in brute_force(texts, items) if len(items[j].split()) >= 5}
    docs = spark.createDataFrame([(i, t.upper() + "!", 1) for i, t in enumerate(texts)] + [(900, None, 1), (None, items[0], 1), (901, "", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    assert (None, 0) in got
    got.discard((None, 0))
    assert got == want and len(want) > 30
    assert got == {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench, part_chars=900).collect()} - {(None, 0)}
    hit = {i for i, _ in got}
    assert {r.doc_id for r in d.remove_contaminated(docs, bench).collect()} == (set(range(60)) - hit) | {900, 901}


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, bench).collect() == [] and d.remove_contaminated(docs, bench).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert d.contaminated(docs, some).collect() == []


def found(texts, items, **options):
    from tessera.llm import kernels as k

    (block,) = k.blocks(pa.array(texts), lower=True)
    row, item, _ = d.overlaps(block, d.build(list(enumerate(items)), **options))
    return set(zip(row.tolist(), item.tolist(), strict=True))


def test_short_items_with_every_substitution():
    for n in range(1, 15):
        words, texts = [f"w{i}" for i in range(n)], []
        for changed in (0, 1, 2, 3):
            texts += [" ".join(["before", *("x" if i in gone else w for i, w in enumerate(words)), "after"]) for gone in combinations(range(n), changed)]
        texts += [" ".join(words[a:b]) for a in range(3) for b in range(n - 2, n + 1)]
        items = [" ".join(words)]
        assert found(texts, items, least=1) == brute_force(texts, items), n
        assert found(texts, items) == (brute_force(texts, items) if n >= 5 else set()), n


def test_short_windows():
    rng = random.Random(2)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 6, 9, 10, 11, 12, 20)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    for window, share in ((7, 0.8), (11, 0.8), (11, 1.0), (10, 0.7), (13, 0.8)):
        assert found(texts, items, window=window, share=share) == brute_force(texts, items, window, share), (window, share)


def test_query_finds_items_of_any_length(spark, tmp_path):
    spark.createDataFrame([(1, "He said: open sesame!"), (2, "open the sesame"), (3, "one two three x five six")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Open Sesame"), (8, "one two three four five"), (9, "sesame"), (10, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id, r["items"]) for r in query_decontaminate.op5(spark, str(tmp_path)).collect()) == [(1, "7,9"), (2, "9"), (3, "8")]


def test_hot_seed():
    """A phrase that all items and texts share many times is looked at in blocks, with the same result."""
    from tessera.llm import kernels as k

    phrase = " ".join(f"p{i}" for i in range(13))
    items, texts = [f"{phrase} item {i}" for i in range(40)], [f"{phrase} " * 6, f"x {phrase} item 7", "nothing of it"]
    (block,) = k.blocks(pa.array(texts), lower=True)
    index = d.build(list(enumerate(items)))
    small, large = d.overlaps(block, index, most_hits=900), d.overlaps(block, index)
    best = lambda x: {(r, i): max(n for a, b, n in zip(*x, strict=True) if (a, b) == (r, i)) for r, i in zip(x[0].tolist(), x[1].tolist(), strict=True)}
    assert best(small) == best(large) and set(best(small)) == {(r, i) for r in (0, 1) for i in range(40)}


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 7), (1, "other", 7), (None, "ONE two three, four five six", 7)], "doc_id int, text string, matched int")
    for kind, value in (("int", 3), ("string", "q1"), ("smallint", 4), ("double", 1.5), ("date", datetime.date(2020, 1, 2)), ("bigint", None)):
        bench = spark.createDataFrame([(value, "one two three four five six")] * 2, f"item_id {kind}, text string")
        got = sorted(((r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()), key=str)
        assert got == sorted([(1, value)] * 2 + [(None, value)] * 2, key=str)
        assert [tuple(r) for r in d.remove_contaminated(docs, bench).collect()] == [(1, "other", 7)]
