"""op2, op9 and op10: languages, quality and toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import language, quality, toxicity
from tessera.llm.sampling import held_out
from tessera.plans.registry import Registry, table

R = Registry()


@R.add("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@R.add("op9_quality_resample")
def op9(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@R.add("op10_toxicity")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
