"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entwine.llm import bpe, decontamination, embedding_dedup, language_id, lm_scoring, minhash, pii, quality, sharding, suffix_dedup
from entwine.llm.common import tokenizer_path

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s"),
    (2, None, "en", None),
    (3, "", None, "s"),
    (4, LONG, "en", "s"),
    (5, "der schnelle braune fuchs springt über den faulen hund und noch mehr", "de", "s"),
    (None, "a row without an id but with some words in it", None, None),
    (6, " \n\t ", "de", "s"),
    (7, "!!! ??? 123", "en", "s"),
    (8, LONG, None, "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for clash in ("score", "matches", "entities", "n_entities", "n_tokens", "key", "id", "shard", "bucket", "bands", "kept", "a", "b"):
        df = df.withColumn(clash, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (None, "x"), (3, "")], "item_id long, text string")


def operators(docs, items):
    """Name, function of a table; each must take the table as it is and an empty one."""
    model = language_id.fit_language_model(docs)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    voter = quality.fit_quality(docs, labels)
    window = lm_scoring.train_model(docs, rounds=1)
    return {
        "lm": lambda d: lm_scoring.score_documents(d, window),
        "sharding": sharding.shard_documents,
        "minhash": minhash.near_duplicates,
        "bpe": lambda d: bpe.encode_and_decode(d, tokenizer_path("byte_bpe_50k.json")),
        "suffix": suffix_dedup.remove_repeats,
        "quality": lambda d: quality.score_quality(d, voter),
        "language": lambda d: language_id.identify(d, model),
        "benchmark": lambda d: decontamination.match_benchmark(d, items),
        "pii": lambda d: pii.replace_entities(d, b"k"),
    }


def test_rows_in_rows_out(docs, items):
    for name, fn in operators(docs, items).items():
        out = fn(docs)
        assert out.count() == len(ROWS), name
        assert len(out.columns) == len(set(out.columns)), name
        rows = [r for r in out.collect() if r["doc_id"] == 1]
        if name != "sharding":
            floats = [[v for v in r if isinstance(v, float)] for r in rows]
            assert floats[0] == pytest.approx(floats[1], abs=1e-2 if name == "lm" else 1e-6), name  # repeated rows get equal results
            assert [v for v in rows[0] if not isinstance(v, float)] == [v for v in rows[1] if not isinstance(v, float)], name
        empty = fn(docs.limit(0))
        assert empty.count() == 0 and empty.columns == out.columns, name


def test_training_on_nothing(spark, docs):
    none = docs.limit(0)
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit_language_model(none)).collect()} == {"und"}
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(none, none.select("doc_id", F.lit(1).alias("quality")))).collect()} == {0.5}
    assert lm_scoring.score_documents(docs, lm_scoring.train_model(none, rounds=1)).count() == len(ROWS)


def test_defined_results(docs, items):
    by = lambda df, c: {r["doc_id"]: r[c] for r in df.collect()}
    lang = by(language_id.identify(docs, language_id.fit_language_model(docs)), "lang_pred")
    assert lang[2] == lang[3] == lang[6] == lang[7] == "und" and lang[1] == "en"
    dup = minhash.near_duplicates(docs)
    kept, component = by(dup, "kept"), by(dup, "component_id")
    assert component[8] == 4 and not kept[8] and kept[4] and kept[2] and kept[3] and kept[6] and component[None] is None and kept[None]
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut[4] == cut[8] == (len(LONG), len(LONG), 1) and cut[2] == (0, 0, 0)
    found = by(decontamination.match_benchmark(docs, items), "matches")
    assert [m["item_id"] for m in found[1]] == [1] and found[2] == found[3] == found[4] == []
    tokens = {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in bpe.encode_and_decode(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert tokens[2] == (0, "") and tokens[3] == (0, "") and tokens[4][1] == LONG
    text = by(pii.replace_entities(docs, b"k"), "text")
    assert text[2] is None and text[3] == "" and text[4] == LONG


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [0.0, 1.0], 0)]
    for kind in ("array<float>", "array<double>"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, n_links int").withColumn("key", F.lit("clash"))
        out = embedding_dedup.near_vectors(df)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
        assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[None] == (0, None, True)
        assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10))
        assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_stages(spark, docs, items, tmp_path):
    sf = f"file://{tmp_path}"
    items.write.parquet(f"{sf}/benchmark.parquet")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars", F.col("id").alias("extra"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        assert set(table.columns) <= set(out.columns), name
        ids = {r["doc_id"] for r in out.collect()}
        if name == "language_id":
            assert ids == {1, 4, 5, 8, None}
        elif name == "minhash_near_dedup":
            assert ids == {1, 2, 3, 4, 5, 6, 7, None}
        elif name == "decontamination":
            assert ids == {2, 3, 4, 5, 6, 7, 8, None}
        else:
            assert ids == {1, 2, 3, 4, 5, 6, 7, 8, None}
        assert stage(spark, table.limit(0), sf).count() == 0, name
