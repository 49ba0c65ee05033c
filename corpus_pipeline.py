"""Documents to training sequences: language, exact copies, near copies, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import bagminhash, decontaminate, exact_dedup, langid, packing
from boxloom.llm.common import small_side, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document is rejected if it has no letter, or if its bytes agree on no language: less than this pooled probability.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; learned from the labelled documents outside the held-out fold.

    If nothing could be learned every document stays that has a letter. Null ids and repeated rows stay.
    """
    net = langid.learn(docs)
    named = langid.identify(docs.withColumn("_row", F.struct(*COLUMNS)), net, "_row", "text")
    good = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)) if net else named.filter(F.col("id.text").rlike(r"\p{L}"))
    return good.select("id.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays, as in op5; an id with several texts loses only the copies."""
    return exact_dedup.keep_exact(docs, keep="max").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the smallest id stays; rows without an id or without words stay.

    Rows that share an id go by numbers made of id and text, below all ids, so each text is judged by itself. Ids alone tell which these are.
    """
    docs = docs.select(*COLUMNS)
    several = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    several = written(several.select(F.col("doc_id").alias("_several")), "several")
    if several.isEmpty():
        named = docs.withColumn("_node", F.col("doc_id"))
    else:
        own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).bitwiseOR(F.lit(1 << 62)) * -1
        named = docs.join(small_side(several, 16), F.col("doc_id") == F.col("_several"), "left")
        named = named.select(*COLUMNS, F.when(F.col("_several").isNotNull(), own).otherwise(F.col("doc_id")).alias("_node"))
    groups = written(bagminhash.near_groups(named, id_col="_node").filter(~F.col("kept")).select(F.col("id").alias("_gone")).distinct(), "near")
    return named.join(small_side(groups, 16), F.col("_node") == F.col("_gone"), "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage, also a re-parameterised one. A row is named by its id and its text's digest."""
    named = docs.select(*COLUMNS).withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", _text().alias("text"))))
    found = decontaminate.contamination(named, table(spark, sf_dir, "benchmark"), id_col="_row").select(F.col("id").alias("_hit")).distinct()
    return named.join(small_side(written(found, "leaks"), 90), F.col("_row") == F.col("_hit"), "left_anti").select(*COLUMNS)


def _text():
    return F.md5(F.coalesce("text", F.lit("")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as in op10."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("packing", packed)]

#: The network, the signatures and the tokenizer have no SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
