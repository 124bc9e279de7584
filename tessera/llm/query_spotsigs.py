"""op6: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import spotsigs
from tessera.plans.registry import Registry, table

R = Registry()


@R.add("op6_spotsigs")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = spotsigs.with_next(docs.withColumn("s", spotsigs.signature_set(F.col("text"))), ["text", "s"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "s", "next_s", spotsigs.signature_set(F.col("edited")).alias("e"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spotsigs.fingerprint(F.col("s")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("e")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("s"), F.col("e")).alias("near_edited"),
        spotsigs.likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


@R.add(
    "spotsigs_near_duplicates",
    rf"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
    v AS (SELECT string_split('{" ".join(spotsigs.ANCHORS)}', ' ') AS anchors),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
    c AS (SELECT doc_id, w[i] AS x, list_slice(list_filter(list_slice(w, i + 1, i + 8), lambda y: NOT list_contains(anchors, y)), 1, 3) AS chain FROM p, v WHERE list_contains(anchors, w[i])),
    s0 AS (SELECT DISTINCT doc_id, x || ' ' || array_to_string(chain, ' ') AS sig FROM c WHERE len(chain) > 0),
    n0 AS (SELECT t.doc_id, count(sig) AS n FROM t LEFT JOIN s0 ON t.doc_id = s0.doc_id GROUP BY t.doc_id),
    s AS (SELECT doc_id, sig FROM s0 UNION SELECT t.doc_id, unnest(w) FROM t JOIN n0 ON t.doc_id = n0.doc_id WHERE n < 3),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sig = b.sig AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k) - 1e-9),
    g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, g.b FROM r JOIN g ON r.other = g.a)
    SELECT doc_id, coalesce(min(other), doc_id) AS class_id FROM documents LEFT JOIN r ON doc_id = id GROUP BY doc_id""",
)
def near_duplicates(spark, sf_dir):
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))
