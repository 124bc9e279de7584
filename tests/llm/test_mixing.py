import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, query_mixing


def reshared(sizes, weights=(5, 2, 1), most=3):
    """The rule as it is worded: share, stop those above, share their excess among the others, until none is above."""
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes))}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in sizes if s not in fixed]
        got = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if got[s] > most * sizes[s]]
        if not above:
            return fixed | got
        fixed |= {s: most * sizes[s] for s in above}


def test_targets_match_the_rule():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000]) + rng.randint(0, 50) for i in range(rng.randint(1, 9))}
        want, got = reshared(sizes), mixing.fill_targets(sizes)
        assert all(abs(want[s] - got[s]) < 1e-6 * (1 + want[s]) for s in sizes), (sizes, want, got)


def test_flow_against_all_routes():
    """Two overlapping patterns: the least repetition of all integer splits."""
    patterns, quotas = {("a",): 3, ("a", "b"): 4, ("b",): 2}, {"a": 7, "b": 5}
    cost = lambda n, size: sum(max(0, min(size, n - k * size)) * (k * (k + 1) // 2) for k in range(3))
    best = min(
        cost(x, 3) + cost(7 - x + y, 4) + cost(5 - y, 2)
        for x, y in itertools.product(range(8), range(6))
        if x <= 9 and 7 - x + y <= 12 and 5 - y <= 6
    )
    got = mixing.route(patterns, quotas, 3)
    assert sum(got.values()) == 12 and sum(cost(got[p], patterns[p]) for p in patterns) == best


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "a", "a", "ä", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (None, "x y", "b"), (5, "again and again", "a"), (5, "again and again", "a"), (1002, "w " * 5000, "big"), (1003, None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_pattern", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    got = query_mixing.op7(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, query_mixing.op7(spark, str(tmp_path)).collect()), key=str)
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    sizes, taken = {}, {}
    for r in got:
        s = source[r.doc_id, r.size] or "\U0010ffff"
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
    want = reshared(sizes)
    for r in got:
        s = source[r.doc_id, r.size] or "\U0010ffff"
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert s == "big" or abs(taken[s] - want[s]) <= 16


def test_mix_keeps_columns(spark):
    names = ["times", "target", "cut", "passes", "source_size", "mix_size", "mix_hash", "mix_pattern", "mix_cut", "doc", "rest", "at", "bin"]
    df = spark.createDataFrame([(1, "a b", "x", *range(9, 22)), (2, None, None, *[None] * 13)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix(df)
    assert got.columns == [*(c for c in df.columns if c != "times"), "times"]
    assert [tuple(r) for r in got.collect()] == [(1, "a b", "x", *range(10, 22), 1)]
    assert mixing.mix(df.limit(0)).collect() == []


def test_targets_in_tables(spark):
    rng = random.Random(7)
    for n in (1, 2, 7, 60):
        sizes = {f"s{rng.randrange(10**6)}é": rng.choice([0, 1, 5, 100, 10_000]) + rng.randint(0, 50) for _ in range(n)} | {None: rng.randint(0, 99)}
        got = {r.source: (r.size, r.target) for r in mixing.targets_of(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == {s: (sizes[s], t) for s, t in mixing.fill_targets(sizes).items()}
    assert mixing.targets_of(spark.createDataFrame([], "source string, size long")).collect() == []


def test_many_sources(spark):
    """More sources than a driver's graph may have patterns: they are planned in tables."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 1000) as source", "repeat('w ', cast(id % 7 as int)) as text")
    rows = mixing.measured(docs).select("doc.*", "mix_pattern", "mix_size", "mix_hash")
    got = mixing.take(rows, mixing.plan_mix(rows, most_patterns=10)).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source], taken[r.source] = sizes.get(r.source, 0) + r.mix_size, taken.get(r.source, 0) + r.mix_taken
    want = reshared(sizes)
    assert len(got) == 3000 and all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    both = docs.withColumn("source", F.lit("all")).select("doc_id", "text", F.array("source", F.col("doc_id").cast("string")).alias("of"))
    rows = mixing.measured(both, F.col("of"))
    with pytest.raises(ValueError, match="more than 10"):
        mixing.plan_mix(rows, most_patterns=10)


def test_overlapping_sources(spark, tmp_path):
    """The flow decides: quotas are met, and no other split of the words repeats less."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 9), rng.choice(["a", "b"]), rng.choice(["en", "de", None])) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query_mixing.mix_overlapping(spark, str(tmp_path)).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.sources], taken[r.sources] = sizes.get(r.sources, 0) + r.size, taken.get(r.sources, 0) + r.taken
    patterns = {tuple(json.loads(p)): n for p, n in sizes.items()}
    of = {}
    for p, n in patterns.items():
        for s in p:
            of[s] = of.get(s, 0) + n
    quotas = {s: int(t + 0.5) for s, t in mixing.fill_targets(of).items()}
    words = mixing.route(patterns, quotas, 3)
    assert len(got) == 600 and all(abs(taken[p] - words[tuple(json.loads(p))]) <= 9 for p in sizes)


def test_flow_against_linear_search():
    """Random small graphs: as much is sent as possible, and no cycle could make it cheaper (checked by all splits)."""
    rng = random.Random(3)
    for _ in range(40):
        patterns = {p: rng.randint(0, 3) for p in [("a",), ("a", "b"), ("b", "c")]}
        quotas = {s: rng.randint(0, 6) for s in "abc"}
        cost = lambda n, size: sum(max(0, min(size, n - k * size)) * (k * (k + 1) // 2) for k in range(3))
        best = None
        for a, ab_a, ab_b, bc_b, bc_c in itertools.product(*(range(3 * patterns[p] + 1) for p in [("a",), ("a", "b"), ("a", "b"), ("b", "c"), ("b", "c")])):
            if ab_a + ab_b > 3 * patterns["a", "b"] or bc_b + bc_c > 3 * patterns["b", "c"] or a + ab_a > quotas["a"] or ab_b + bc_b > quotas["b"] or bc_c > quotas["c"]:
                continue
            n = a, ab_a + ab_b, bc_b + bc_c
            now = (-sum(n), sum(cost(x, y) for x, y in zip(n, patterns.values(), strict=True)))
            best = now if best is None else min(best, now)
        got = mixing.route(patterns, quotas, 3)
        assert (-sum(got.values()), sum(cost(got[p], patterns[p]) for p in patterns)) == best


def test_large_graph_ends():
    rng = random.Random(4)
    patterns = {tuple(sorted(rng.sample(range(300), 2))): rng.randint(1, 1000) for _ in range(4000)}
    patterns = {(f"s{a}", f"s{b}"): n for (a, b), n in patterns.items()}
    sizes = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quotas = {s: int(t + 0.5) for s, t in mixing.fill_targets(sizes).items()}
    got = mixing.route(patterns, quotas, 3)
    assert sum(got.values()) == sum(quotas.values()) and all(got[p] <= 3 * n for p, n in patterns.items())
