import math
import random

from pyspark.sql import functions as F
from test_decontaminate import brute_force as contaminated_pairs
from test_jaccard import brute_force as near_duplicates
from test_models import plain_gumbel, plain_weights

import corpus_pipeline
from tessera.llm import mixing, secrets

SF = "/root/testdata/sf0.001"


def plain(rows, labels, items):
    """The pipeline's rules over (doc_id, text, source) in plain Python; only the spans of secrets come from the operator."""
    weights = plain_weights([(d, t) for d, t, _ in rows], {d for d, q in labels if q == 1}, 1 << 14, 4.0)
    keys = sorted(((w + plain_gumbel(d, 5), d) for (d, _, _), w in zip(rows, weights, strict=True)), reverse=True)
    share = sum(q == 1 for _, q in labels) / len(labels)
    kept = {d for _, d in keys[: math.ceil((share + 0.1 * (1 - share)) * len(rows))]}
    rows = [r for r in rows if r[0] in kept]
    classes = {d: c for d, c, _ in near_duplicates([(d, t) for d, t, _ in rows])}
    rows = [r for r in rows if classes[r[0]] == r[0]]
    hit = {i for i, _ in contaminated_pairs([t for _, t, _ in rows], items)}
    rows = [r for i, r in enumerate(rows) if i not in hit]
    rows = [(d, secrets.masked(t, [{"start": a, "end": b} for a, _, b in secrets.spans_of(t)]), s) for d, t, s in rows]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    return rows, sizes, mixing.fill_targets(sizes)


def test_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want, sizes, targets = plain(rows, labels, items)
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, SF)
        assert stages.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.source) for r in stages.collect()) == sorted(want)
    got = corpus_pipeline.run(spark, SF).collect()
    text = {d: t for d, t, _ in want}
    taken = {}
    for r in got:
        assert text[r.doc_id] == r.text and 1 <= r.times <= 3 and r.n_chars == len(r.text)
        taken[r.source] = taken.get(r.source, 0) + r.times * len(r.text.split())
    for s in sizes:
        longest = max(len(t.split()) for _, t, x in want if x == s)
        assert abs(taken.get(s, 0) - targets[s]) <= longest / 2 + 1


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(30))
    rows = [(i, text(), "en", "s", 1) for i in range(20)] + [(None, None, None, None, None), (None, "x", None, None, 1), (21, "", "en", "s", 0), (3, "again", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("key", "times", "target", "cut", "passes", "source_size", "mix_size", "row_hash", "doc", "spans", "runs", "rep", "node", "id", "hash", "place", "_of", "_id")})
    spark.createDataFrame([(1, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some other words than those here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {*docs.columns} and got.count() > 0
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
