"""Language, quality and toxicity: held-out accuracy, and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, quality, query_models, sampling, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, key int, score int, label int, bits int"
ODD = [(None, None, None, None, 1, 1, 1, 1), (None, "x", "en", None, 1, 1, 1, 1), (7, "", "en", "s", 1, 1, 1, 1), (7, "", "en", "s", 1, 1, 1, 1), (8, None, "en", "s", 1, 1, 1, 1), (9, "1234 !?", None, "s", 1, 1, 1, 1), (10, "Ж" * 200_000, "ru", "s", 1, 1, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = query_models.op2(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd):
    model = language.fit(odd)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language.predict(odd, model).collect()), key=str)
    assert len(got) == 7 and {p for d, p, _ in got if d in (7, 8, 9)} == {"und"} and all(s == 0 for d, _, s in got if d in (7, 8, 9))
    assert all(p in model.names for d, p, _ in got if d == 10)
    none = language.fit(odd.limit(0))
    assert language.predict(odd.limit(0), none).collect() == [] and {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}


def test_language_kernel():
    """Sets of n-grams against plain Python: equal kernels up to hash collisions."""
    import pyarrow as pa

    from tessera.llm import kernels as k

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    (block,) = k.blocks(pa.array(texts), lower=True)
    m = np.vstack([x for _, x in language.sets(block)]).astype(int)
    plain = [{b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)} for b in (t.encode() for t in texts)]
    want = np.array([[len(p & q) for q in plain] for p in plain])
    assert np.abs(m @ m.T - want).max() <= 4 and (m @ m.T == want).mean() > 0.8


def test_language_many_labels(spark):
    """More languages than any list of them, and rows that share an id: all are learnt, and the sample is bounded."""
    rng = random.Random(4)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3)] for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[i % 300]) for _ in range(12)), f"l{i % 300}") for i in range(3000)] + [(1, "one text " * 3, "l1")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sampling.stratified(df, "lang", "doc_id", 5, "text").groupBy("lang").count().collect()
    assert len(kept) == 300 and {r["count"] for r in kept} == {5}
    assert sampling.stratified(df, "lang", "doc_id", 5, "text", most=700).count() == 600
    model = language.fit(df, quota=5)
    got = [r for r in language.predict(df.withColumn("held", sampling.held_out()), model).collect() if r.doc_id % 3 == 1]
    assert len(model.names) == 300 and sum(r.lang_pred == f"l{r.doc_id % 300}" for r in got if r.doc_id != 1) >= 0.95 * len([r for r in got if r.doc_id != 1])


def test_stratified_rows_of_one_key(spark):
    df = spark.createDataFrame([(0, "same", "a")] * 900 + [(0, f"t{i}", "b") for i in range(900)] + [(i, "x", "c") for i in range(3)] + [(None, None, "d"), (4, "y", None)], "doc_id long, text string, lang string")
    got = {r.lang: r["count"] for r in sampling.stratified(df, "lang", "doc_id", 50, "text").groupBy("lang").count().collect()}
    assert got == {"a": 50, "b": 50, "c": 3, "d": 1}
    assert sampling.stratified(df.limit(0), "lang", "doc_id", 5, "text", 10).collect() == []


def test_language_against_plain_regression():
    """Predictions against ridge regression in plain numpy on sets of n-grams that aren't hashed."""
    import pyarrow as pa

    rng = random.Random(8)
    letters = {"x": "aaabcde", "y": "aabbcdé", "z": "zzzyxab"}
    langs = [rng.choice("xyz") for _ in range(120)]
    texts = ["".join(rng.choice(letters[g] + "  ") for _ in range(rng.randint(20, 90))) for g in langs]
    sets = [{b[i : i + n] for n in range(1, 5) for i in range(len(b) - n + 1)} for b in (t.encode() for t in texts)]
    kernel = lambda p, q: len(p & q) / math.sqrt(len(p) * len(q))
    order = sorted(range(60), key=lambda i: langs[i])
    at = sorted(set(np.linspace(0, 59, 20).astype(int).tolist()))
    marks = [sets[order[i]] for i in at]
    cross = np.array([[kernel(sets[i], q) for q in marks] for i in order])
    values, vectors = np.linalg.eigh(cross[at])
    root = vectors @ np.diag(values**-0.5)
    z, y = cross @ root, np.array([[langs[i] == g for g in "xyz"] for i in order], float)
    w = root @ np.linalg.solve(z.T @ z + 1e-3 * 60 * np.eye(20), z.T @ y)
    want = np.array([[kernel(sets[i], q) for q in marks] for i in range(60, 120)]) @ w
    (batch,) = language.packed(iter([pa.record_batch([pa.array(order), pa.array([langs[i] for i in order]), pa.array([texts[i] for i in order])], ["doc_id", "lang", "text"])]))
    bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(60, -1)
    model = language.solve(bits, [langs[i] for i in order], landmarks=20)
    names, score = model.predict(pa.record_batch([pa.array(texts[60:])], ["text"]))
    sure = np.sort(want, 1)[:, -1] - np.sort(want, 1)[:, -2] > 0.1
    assert all(n == "xyz"[v.argmax()] for n, v, s in zip(names, want, sure, strict=True) if s) and sure.sum() > 40
    assert np.abs(score - np.clip(want.max(1), 0, 1)).max() < 0.08


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in query_models.op9(spark, SF).collect()}
    good, bad = [d for d in labels if labels[d] == 1], [d for d in labels if labels[d] == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_weights(rows, good, buckets, smoothing):
    """Log weights by the words of the docstring, one n-gram at a time."""
    import re

    from tessera.llm import kernels as k

    codes = [plain_mix((i + 1 + 77) * 0x9E3779B97F4A7C15 & M64) for i in range(256)]
    hash_of = lambda values, base, extra: plain_mix((sum(v * pow(base, i, 1 << 64) for i, v in enumerate(values)) + extra) & M64)
    grams = []
    for _, text in rows:
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())
        one = [hash_of([codes[b] for b in t], k._BYTE_BASE, len(t)) for t in tokens]
        grams.append([h % buckets for h in one] + [hash_of(p, k._TOKEN_BASE, 0) % buckets for p in zip(one, one[1:])])
    raw, target = [0] * buckets, [0] * buckets
    for (doc, _), g in zip(rows, grams, strict=True):
        for x in g:
            raw[x] += 1
            target[x] += doc in good
    rate = sum(target) / max(1, sum(raw))
    return [sum(math.log((target[x] + smoothing) / (raw[x] * rate + smoothing)) for x in g) for g in grams]


def plain_gumbel(doc, seed):
    u = plain_mix((doc & M64) ^ plain_mix(seed)) >> 11
    return -math.log(-math.log((u + 0.5) / (1 << 53)))


def test_quality_against_plain_version(spark):
    rng = random.Random(12)
    rows = [(i * 7 - 30, " ".join(rng.choice(["alpha", "beta,", "gamma!", "Délta", "x x", "--"]) if i % 3 else rng.choice(["JUNK!!", "alpha", "$$$"]) for _ in range(rng.randint(0, 40)))) for i in range(90)]
    labels = [(d, int(i % 3 > 0)) for i, (d, _) in enumerate(rows) if i % 2] + [(10**9, 1), (None, 0)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, key double")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = plain_weights(rows, {d for d, q in labels if q == 1}, 512, 4.0)
    keys = {d: w + plain_gumbel(d, 5) for (d, _), w in zip(rows, weights, strict=True)}
    known = [q for d, q in labels if d is not None]
    share = sum(known) / len(known)
    for count, k in ((None, math.ceil((share + 0.1 * (1 - share)) * 90)), (17, 17)):
        want = sorted(keys, key=lambda d: -keys[d])[:k]
        got = {r.doc_id: (r.log_weight, r.key) for r in quality.resample(docs, table, count, buckets=512).collect()}
        assert set(got) == set(want)
        assert all(abs(got[d][0] - w) < 1e-9 * (1 + abs(w)) and abs(got[d][1] - keys[d]) < 1e-9 * (1 + abs(w)) for (d, _), w in zip(rows, weights, strict=True) if d in got)
        assert {r.doc_id for r in quality.keep(docs, table, count, buckets=512).collect()} == set(want)


def test_quality_odd_rows(spark, odd):
    good = spark.createDataFrame([(7, 1), (None, 1), (99, 1), (8, None)], "doc_id long, quality int")
    assert quality.keep(odd, good).columns == odd.columns and quality.keep(odd, good).count() == len(ODD)
    assert all(w == 0 for (w,) in map(tuple, quality.score(odd, quality.fit(odd, good.limit(0))).select("log_weight").collect()))
    assert quality.keep(odd.limit(0), good).collect() == [] and quality.resample(odd.limit(0), good).collect() == []
    assert quality.resample(odd, good, count=0).collect() == [] and quality.resample(odd, good, count=10**9).count() == len(ODD)


def test_gumbel_top_k_follows_the_weights(spark):
    """With weights 1 and 3, one draw takes the heavy item three times in four."""
    import pyarrow as pa

    ids = pa.array(range(4000), pa.int64())
    light, heavy = quality.gumbel(ids, 1), math.log(3) + quality.gumbel(ids, 2)
    assert abs((heavy > light).mean() - 0.75) < 0.03


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 1e6]) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert sampling.kth_largest(df, "x", k, close=10) == known[k - 1]
    assert sampling.kth_largest(df, "x", 3001) is None and sampling.kth_largest(df.limit(0), "x", 1) is None


def test_ftrl_finds_the_feature():
    rng = np.random.default_rng(1)
    examples = [(np.unique(np.append(rng.integers(10, 5000, 40), np.array([3] * (i % 2), int))), i % 2) for i in range(400)]
    model = toxicity.ftrl(examples)
    assert model.index[np.argmax(model.weights)] == 3 and len(model.index) < 200


def test_ftrl_against_a_scalar_loop():
    """FTRL-proximal written out for one coordinate at a time."""
    rng = np.random.default_rng(2)
    examples = [(np.unique(rng.integers(0, 30, 6)), int(rng.random() < 0.4)) for _ in range(60)]
    alpha, beta, l1, l2, size = 0.7, 1.0, 2.5, 0.1, 1 << toxicity.BITS
    z, n = {}, {}

    def weight(i):
        penalty = 0.0 if i == size else l1
        if abs(z.get(i, 0.0)) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order, negative = np.random.default_rng(1), sum(y == 0 for _, y in examples)
    for _ in range(3):
        for e in order.permutation(len(examples)):
            at, y = [*examples[e][0].tolist(), size], examples[e][1]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (max(1.0, negative / (len(examples) - negative)) if y else 1.0)
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = toxicity.ftrl(examples, alpha, beta, l1, l2, epochs=3)
    want = {i: weight(i) for i in range(30) if weight(i)}
    assert got.index.tolist() == sorted(want) and np.allclose(got.weights, [want[i] for i in sorted(want)], rtol=1e-5) and abs(got.bias - weight(size)) < 1e-9
    assert 3 < len(want) < 30


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(6)
    text = lambda toxic: " ".join(["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(60)] + [rng.choice(["Idiot!", "scum"])] * toxic)
    rows = [(i, text(i % 5 == 0)) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = query_models.op10(spark, str(tmp_path)).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == 1500 and sum(r.predicted == (r.doc_id % 5 == 0) for r in out) >= 0.97 * len(out)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(7, 1), (10, 0), (9, 0), (8, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(odd, labels.limit(0))
    assert max(r.score for r in toxicity.score(odd, none).collect()) < 1e-9 and toxicity.score(odd.limit(0), none).collect() == []


@pytest.mark.parametrize("n_toxic", [150, 15])
def test_toxicity_bounded_sample(spark, monkeypatch, n_toxic):
    """The bound on characters holds, the frequent class is thinned, and a rare one keeps what its half can hold."""
    rows = [(i, f"{i:0100d}", int(i < n_toxic)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "ftrl", lambda examples: seen.extend(y for _, y in examples))
    toxicity.fit(df, df.select("doc_id", "toxic"), quota=100, most_chars=10_000)
    learnt = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(n_toxic))
    assert 90 <= len(seen) <= 100 and seen.count(1) == min(50, learnt)


def test_toxicity_rows_of_one_id(spark, monkeypatch):
    """However many rows share a labelled id, one text of them is learnt from."""
    a, b, c = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = [(a, f"text {i}") for i in range(500)] + [(b, "other"), (c, None)]
    seen = []
    monkeypatch.setattr(toxicity, "ftrl", lambda examples: seen.extend(examples))
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(a, 1), (b, 0), (b, 1), (c, 0)], "doc_id long, toxic int"))
    assert len(seen) == 4 and sorted(y for _, y in seen) == [0, 0, 1, 1]


def test_toxicity_long_documents():
    rows = [(1, 1, 5, 900), (2, 1, 6, 10), (3, 0, 1, 40), (4, 0, 2, 70), (5, 0, 3, 30), (6, 1, 9, 1)]
    assert sorted(toxicity.fitting(rows, 100)) == [(1, 1), (3, 0)] and sorted(toxicity.fitting(rows, 2000)) == sorted((d, y) for d, y, _, _ in rows)
    assert toxicity.fitting([], 5) == []
