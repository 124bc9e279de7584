"""op3: near-duplicate classes and links of all documents."""

from __future__ import annotations

from tessera.llm.jaccard_join import join
from tessera.plans.registry import Registry, table

R = Registry()


@R.add(
    "op3_ngram_jaccard_join",
    r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
    p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM p),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k) - 1e-9),
    r(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
    c AS (SELECT id, min(other) AS root FROM r GROUP BY id), l AS (SELECT a, count(*) AS links FROM e GROUP BY a)
    SELECT doc_id, least(doc_id, coalesce(root, doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS n_links FROM documents LEFT JOIN c ON doc_id = c.id LEFT JOIN l ON doc_id = l.a""",
)
def op3(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
