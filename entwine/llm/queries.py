"""The opN_ queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, tokenizer_path
from .oracle import SQL  # noqa: F401


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_language_model, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(fold("doc_id", 4) != 2))
    out = identify(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    from .bpe import encode_and_decode

    vocabulary_path = vocabulary_path or tokenizer_path("byte_bpe_50k.json")
    out = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    model = fit_quality(docs, labels)
    out = score_quality(docs.withColumn("held_out", fold("doc_id", 5) == 0), model, keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import match_benchmark

    out = match_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.similarity", "m.word_start", "m.n_words")


def op10_pii(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    from .pii import key_of_environment, replace_entities

    out = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key or key_of_environment())
    return out.select("doc_id", "text", "n_entities", "entities")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), as_text=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents, train_model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train_model(docs), keep=["doc_id"])


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_minhash": op3_minhash,
    "op4_bpe": op4_bpe,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}
