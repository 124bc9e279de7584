"""op5: documents that hold passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated
from tessera.plans.registry import Registry, table

R = Registry()


@R.add(
    "op5_decontaminate",
    r"""WITH d AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL)),
    b AS (SELECT item_id, len(w) AS size, least(13, len(w)) AS width, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL)),
    m AS (SELECT doc_id, item_id, i - j AS diagonal, j, width, least(j, size - width + 1) AS first FROM d JOIN b ON d.x = b.x),
    h AS (SELECT doc_id, item_id, diagonal, width, list_sort(list(j)) AS js, list(DISTINCT first) AS firsts FROM m GROUP BY doc_id, item_id, diagonal, width HAVING count(*) >= ceil(0.8::DOUBLE * width - 1e-9)),
    o AS (SELECT doc_id, item_id, width, list_max(list_transform(firsts, lambda f: len(list_filter(js, lambda j: j >= f AND j < f + width)))) AS best FROM h),
    g AS (SELECT doc_id, item_id, max(best) AS best FROM o WHERE best >= ceil(0.8::DOUBLE * width - 1e-9) GROUP BY doc_id, item_id)
    SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(best)::INT AS matched FROM g GROUP BY doc_id""",
)
def op5(spark, sf_dir):
    pairs = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1)
    found = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"), F.max("matched").alias("matched"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items").cast("array<string>"), ",").alias("items"), "matched")
