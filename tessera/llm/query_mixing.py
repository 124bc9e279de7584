"""op7: a mix of all documents by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.plans.registry import Registry, table
from tessera.session import materialise

R = Registry()


@R.add(
    "op7_mix_sources",
    r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS u FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
    w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM w),
    c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS share, sum(source_size) OVER ()::BIGINT AS total FROM o),
    f AS (SELECT min(k) AS k FROM c WHERE 3 * source_size * share > w * (total - capped)),
    t AS (SELECT c.source, source_size, CASE WHEN f.k IS NULL OR c.k < f.k THEN (3 * source_size)::DOUBLE
    ELSE (c.w * (SELECT total - capped FROM c JOIN f USING (k)))::BIGINT::DOUBLE / (SELECT share FROM c JOIN f USING (k)) END AS target FROM c, f),
    q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
    r AS (SELECT d.*, source_size, target, quota // greatest(source_size, 1) AS passes, quota % greatest(source_size, 1) AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY u) AS upto, sum(size) OVER (PARTITION BY d.source, u) AS n
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
    SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN rest > 0 AND upto - n / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
)
def op7(spark, sf_dir):
    rows = materialise(mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc.doc_id", "mix_pattern", "mix_size", "mix_hash"))
    out = mixing.take(rows, mixing.plan_mix(rows))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


@R.add("mix_overlapping_sources")
def mix_overlapping(spark, sf_dir):
    """Every document belongs to its source and, as a second source, to its language, so the flow has choices."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    sources = F.array_compact(F.array("source", F.concat(F.lit("lang:"), "lang")))
    rows = materialise(mixing.measured(docs, sources).select("doc.doc_id", "mix_pattern", "mix_size", "mix_hash"))
    out = mixing.take(rows, mixing.plan_mix(rows))
    return out.select("doc_id", F.col("mix_pattern").alias("sources"), F.col("mix_size").alias("size"), F.col("mix_taken").alias("taken"))
