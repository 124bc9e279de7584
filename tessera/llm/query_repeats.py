"""op8: repeated 13-word windows go from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.repeats import remove_repeats
from tessera.plans.registry import Registry, table

R = Registry()


@R.add(
    "op8_substring_dedup",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM w WHERE doc_id IS NOT NULL),
    s AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS win FROM p),
    m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY win) AS gone FROM s),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE gone),
    k AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id),
    o AS (SELECT w.doc_id, words, list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(coalesce(js, []), j)) AS keep FROM w LEFT JOIN k ON w.doc_id = k.doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(keep))::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(list_transform(keep, lambda j: words[j]), ' '), '')) AS kept_sha256 FROM o""",
)
def op8(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
