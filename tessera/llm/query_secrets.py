"""op4: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.secrets import find_secrets
from tessera.plans.registry import Registry, table

R = Registry()


@R.add("op4_secret_scan")
def op4(spark, sf_dir):
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", shown), ",").alias("spans"),
    )
