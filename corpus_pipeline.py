"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, PII, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm import bpe, decontamination, language_id, minhash, pii
from entwine.llm.common import drop_staged, fold, staged, table, tokenizer_path

#: Surrogates can be drawn again by whoever knows it; ENTWINE_PII_KEY sets it.
PII_KEY = pii.key_of_environment()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects; a missing language is filled in."""
    model = language_id.fit_language_model(docs.filter(fold("doc_id", 4) != 2))
    out = language_id.identify(docs, model).filter("accepted")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates."""
    return minhash.keep_one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets; n_chars follows the new text."""
    out = pii.replace_entities(docs, PII_KEY)
    n_chars = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids (packed little-endian unsigned 32-bit integers) and whether they decode to the text."""
    out = bpe.encode_and_decode(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("bpe", tokenize),
]

#: SQL cannot express the trained classifier, the surrogates or BPE; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        after = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
        if k:
            drop_staged(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
