"""The registered queries: (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity as S
from ..functions.vector import check_dimension, cosine, mock_embedding
from ..operators import blocking as B
from ..operators import groups as G
from ..operators import matching as M
from ..operators.search import similar, similar_pairs, top_k, top_k_in_block
from ..operators.vector_groups import VectorEdges
from ..sources.json_io import read_entities, to_json_rows, write_json
from ..sources.store import EntityStore
from .fixture import FIELDS, entities, entity_pairs
from .shared import shared_dir, ship_package, staged

DIM = 16
ALL_FIELDS = sorted([*FIELDS, *[f"{f}_normalized" for f in FIELDS]])
WEIGHTS = {"name": 0.4, "address": 0.2, "city": 0.1, "state": 0.05, "zip": 0.05, "phone": 0.1, "email": 0.1}
QUERIES: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits: int = 6):
    return F.round(c, digits)


# Normalizers
@query
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.normalize_text("text").alias("value"))


@query
def tokenize(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", N.tokenize("text").alias("t"))
    return out.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def _normalized(name: str, fn, field: str):
    def run(spark, sf_dir):
        return entities(spark, sf_dir).select("id", fn(field).alias("value"))

    run.__name__ = name
    query(run)


for _f in ("name", "address", "phone", "email", "state", "zip"):
    _normalized(f"normalize_{_f}", N.NORMALIZERS[_f], _f)
_normalized("normalize_name_compat", lambda c: N.normalize_name(c, N.NormalizeOptions(compat_initials=True)), "name")


@query
def normalize_entity(spark, sf_dir):
    return N.normalize_entity(entities(spark, sf_dir)).select("id", *ALL_FIELDS)


@query
def combine_fields(spark, sf_dir):
    df = N.normalize_entity(entities(spark, sf_dir))
    return df.select("id", N.combine_fields(df).alias("combined"))


@query
def entity_projection(spark, sf_dir):
    e = entities(spark, sf_dir)
    pairs = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))], F.lit("other"), F.lit("dropped"))
    return M.flatten(e.select("id", pairs.alias("fields"), F.lit(None).cast("map<string,string>").alias("metadata"))).select("id", *FIELDS)


# Comparators
def _compared(name: str, fn, field: str):
    def run(spark, sf_dir):
        return entity_pairs(spark, sf_dir).select("id_a", "id_b", rounded(fn(F.col(f"{field}_a"), F.col(f"{field}_b"))).alias("score"))

    run.__name__ = name
    query(run)


_compared("sim_exact", S.exact, "name")
_compared("sim_case_insensitive", S.case_insensitive, "name")
_compared("sim_jaro", S.jaro_similarity, "name")
_compared("sim_jaro_winkler", S.jaro_winkler_similarity, "name")
_compared("sim_levenshtein", S.levenshtein_similarity, "name")
_compared("sim_jaccard", S.jaccard, "name")
_compared("sim_token_cosine", S.token_cosine, "name")
_compared("sim_contained_in", S.contained_in, "name")
_compared("sim_name", S.name_similarity, "name")
_compared("sim_address", S.address_similarity, "address")
_compared("sim_phone", S.phone_similarity, "phone")
_compared("sim_email", S.email_similarity, "email")
_compared("sim_zip", S.zip_similarity, "zip")


@query
def infer_similarity_fn(spark, sf_dir):
    names = "name company_name business_id organization address street_1 phone telephone mobile cell fax email email_address zip postal_code city hotel notes".split()
    df = spark.createDataFrame([(n,) for n in names], "field string")
    return df.select("field", S.infer_column(F.col("field")).alias("fn"))


@query
def similarity_registry(spark, sf_dir):
    """Comparators by their other names and by field types; unknown ones get the default."""
    names = sorted({a.upper() for x in S.ALIASES.values() for a in x.split()} | {"UNKNOWN"})
    types = sorted({t.upper() for x in S.FIELD_TYPES.values() for t in x.split()} | {"UNKNOWN"})
    rows = [("name", n, S.by_name(n)) for n in names] + [("type", t, S.by_field_type(t)) for t in types]
    return spark.createDataFrame(rows, "kind string, alias string, fn string")


# Vectors
def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, v.filter("id % 50 = 0").withColumnRenamed("id", "query_id")


@query
def vector_cosine(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return similar(asked, rows, -2.0).select("query_id", "id", rounded("score").alias("score"))


@query
def vector_topk(spark, sf_dir):
    rows, _ = _vectors(spark, sf_dir)
    first = rows.agg(F.min("id").alias("id")).join(rows, "id").select(F.col("id").alias("query_id"), "vector")
    return top_k(first, rows, 10).select("query_id", "id", rounded("score").alias("score"), "rank")


@query
def vector_topk_per_query(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return top_k(asked, rows, 10).select("query_id", "id", rounded("score").alias("score"), "rank")


@query
def threshold_filter(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return top_k(asked, rows, 20).filter("score >= 0.3").select("query_id", "id", rounded("score").alias("score"))


@query
def block_filtered_search(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return top_k_in_block(asked, rows, 10, "label").select("query_id", "id", rounded("score").alias("score"), "rank")


@query
def filter_conjunction_search(spark, sf_dir):
    """Several equality filters at once."""
    rows, asked = (df.withColumn("half", F.col(c) % 2) for df, c in zip(_vectors(spark, sf_dir), ("id", "query_id")))
    return top_k_in_block(asked, rows, 10, ["label", "half"]).select("query_id", "id", rounded("score").alias("score"), "rank")


@query
def vector_match_explain(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    found = top_k(asked, rows, 10).filter("score >= 0.3")
    on = F.when(F.col("score") >= 0.75, "vector").otherwise("")
    return found.select("query_id", "id", rounded("score").alias("score"), rounded("score").alias("vector_score"), on.alias("matched_on"), rounded("score", 2).alias("explained"))


@query
def vector_dim_check(spark, sf_dir):
    return check_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", "valid")


@query
def mock_embedding_query(spark, sf_dir):
    out = entities(spark, sf_dir).select("id", F.posexplode(mock_embedding(F.col("name"), DIM)).alias("dim", "value"))
    return out.select("id", F.col("dim").cast("long").alias("dim"), rounded(F.col("value").cast("double")).alias("value"))


QUERIES["mock_embedding"] = QUERIES.pop("mock_embedding_query")


# Blocking
def _blocked(spark, sf_dir):
    return B.assign_blocks(N.normalize_entity(entities(spark, sf_dir)))


@query
def blocking_key(spark, sf_dir):
    return _blocked(spark, sf_dir).select("id", "cluster_id")


@query
def recompute_clusters(spark, sf_dir):
    stale = N.normalize_entity(entities(spark, sf_dir)).withColumn("cluster_id", F.lit("stale"))
    return B.assign_blocks(stale).select("id", "cluster_id")


@query
def block_sizes(spark, sf_dir):
    return B.block_sizes(_blocked(spark, sf_dir))


@query
def block_candidate_pairs(spark, sf_dir):
    # Written once: the two sides of the join would each normalize all records.
    blocked = staged(_blocked(spark, sf_dir).select("cluster_id", "id"), "blocked")
    return B.candidate_pairs(blocked, []).select("cluster_id", "id_a", "id_b")


# Matching
def _ready(spark, sf_dir):
    """Ingested entities; matching reads them as a stored table."""
    return staged(M.prepare(entities(spark, sf_dir), DIM), "entities")


@query
def ingest_pipeline(spark, sf_dir):
    out = M.ingest(entities(spark, sf_dir), DIM, now=0)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("id", *ALL_FIELDS, "cluster_id", "text", rounded(total).alias("vector_sum"), "created_at", "updated_at")


@query
def match_text(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), mock_embedding(F.col("text"), DIM).alias("vector"), F.lit(B.DEFAULT_BLOCK).alias("cluster_id"))
    out = M.find_matches(asked, _ready(spark, sf_dir), M.MatchOptions(limit=10, threshold=0.9))
    return out.select("query_id", "id", "rank", rounded("score").alias("score"))


def match_rows(spark, sf_dir):
    """Matches inside blocks with all columns of the result."""
    ready = _ready(spark, sf_dir)
    options = M.MatchOptions(limit=3, threshold=0.85, include_field_scores=True, exact_fields=("phone",))
    return M.find_matches(_asked(ready), ready, options, clustering=True)


@query
def match_projection(spark, sf_dir):
    out = match_rows(spark, sf_dir)
    return out.select("query_id", "id", "rank", rounded("score").alias("score"), rounded("vector_score").alias("vector_score"), F.array_join("matched_on", ",").alias("matched_on"), "explanation", *FIELDS, rounded("score_phone").alias("score_phone"), rounded("score_zip").alias("score_zip"))


def _asked(ready):
    return ready.filter("CAST(substr(id, 2) AS INT) % 50 = 0").withColumnRenamed("id", "query_id")


@query
def match_entity(spark, sf_dir):
    ready = _ready(spark, sf_dir)
    out = M.find_matches(_asked(ready), ready, M.MatchOptions(limit=10, threshold=0.85), clustering=True)
    return out.select("query_id", "id", "rank", rounded("score").alias("score"))


@query
def match_topk_ranked(spark, sf_dir):
    ready = _ready(spark, sf_dir)
    found = top_k(_asked(ready), ready, 5).drop("rank")
    return M.rank_matches(found, 5).select("query_id", "id", "rank", rounded("score").alias("score"))


@query
def matched_on(spark, sf_dir):
    return entities(spark, sf_dir).select("id", F.array_join(M.matched_on(FIELDS), ", ").alias("matched_on"))


@query
def match_explanation(spark, sf_dir):
    pairs = entity_pairs(spark, sf_dir)
    on = M.matched_on(FIELDS, "_b")
    text = M.explanation(S.jaccard(F.col("name_a"), F.col("name_b")), on)
    return pairs.select("id_a", "id_b", F.regexp_replace(text, r" \([0-9.]+\)", "").alias("explanation"))


@query
def parse_query_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sep = F.when(F.col("c_custkey") % 3 == 0, ";").otherwise(",")
    text = F.concat(F.lit("name = "), "c_name", sep, F.lit(" segment="), "c_mktsegment", sep, F.when(F.col("c_custkey") % 2 == 0, "name=again").otherwise("broken"))
    return c.select(F.col("c_custkey").alias("id"), F.explode(M.parse_query_fields(text)).alias("field", "value"))


def _pairs_qm(spark, sf_dir):
    pairs = entity_pairs(spark, sf_dir)
    return pairs.withColumnsRenamed({f"{f}_{a}": f"{f}_{b}" for f in FIELDS for a, b in (("a", "q"), ("b", "m"))})


def _score_columns(df):
    return df.select("id_a", "id_b", *[rounded(f"score_{f}").alias(f"score_{f}") for f in FIELDS])


@query
def field_scores(spark, sf_dir):
    return _score_columns(M.field_scores(_pairs_qm(spark, sf_dir), list(FIELDS)))


@query
def field_scores_exact_override(spark, sf_dir):
    return _score_columns(M.field_scores(_pairs_qm(spark, sf_dir), list(FIELDS), M.MatchOptions(exact_fields=("name",))))


@query
def field_scores_self(spark, sf_dir):
    return _score_columns(M.field_scores(_pairs_qm(spark, sf_dir), list(FIELDS), M.MatchOptions(self_scores=True)))


@query
def field_scores_by_type(spark, sf_dir):
    """Comparators named by the type that the options give a field."""
    options = M.MatchOptions(field_types={"city": "phone_number", "state": "postal_code", "zip": "mobile"})
    out = M.field_scores(_pairs_qm(spark, sf_dir), ["city", "state", "zip"], options)
    return out.select("id_a", "id_b", *[rounded(f"score_{f}").alias(f"score_{f}") for f in ("city", "state", "zip")])


@query
def weighted_score(spark, sf_dir):
    scored = M.field_scores(_pairs_qm(spark, sf_dir), list(FIELDS))
    score = M.weighted_score({f: F.col(f"score_{f}") for f in FIELDS}, WEIGHTS)
    return scored.select("id_a", "id_b", rounded(score).alias("score"))


@query
def blended_score(spark, sf_dir):
    scored = M.field_scores(_pairs_qm(spark, sf_dir), list(FIELDS))
    near = cosine(mock_embedding(F.col("name_q"), DIM).cast("array<double>"), mock_embedding(F.col("name_m"), DIM).cast("array<double>"))
    score = M.blended_score(near, {f: F.col(f"score_{f}") for f in FIELDS}, WEIGHTS)
    return scored.select("id_a", "id_b", rounded(score).alias("score"))


# Groups
def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"))


def _group(spark, sf_dir, max_size=None, **options):
    """Neighbours of each frontier are searched among all vectors."""
    edges = VectorEdges(_vectors(spark, sf_dir)[0], 0.3)
    return G.match_groups(_seeds(spark, sf_dir), edges, G.GroupOptions(threshold=0.3, max_size=max_size, **options))


def _members(df):
    return df.select("group_id", "id", rounded("score").alias("score"), "hop_distance")


@query
def group_direct(spark, sf_dir):
    return _members(_group(spark, sf_dir, strategy="direct"))


@query
def group_transitive(spark, sf_dir):
    return _members(_group(spark, sf_dir, strategy="transitive", hops=3))


@query
def group_hybrid(spark, sf_dir):
    return _members(_group(spark, sf_dir, strategy="hybrid", hops=3, direct_floor=0.35))


@query
def group_capped(spark, sf_dir):
    return _members(_group(spark, sf_dir, max_size=8, strategy="transitive", hops=3))


@query
def group_stats(spark, sf_dir):
    return G.group_stats(_group(spark, sf_dir, strategy="transitive", hops=3)).select("group_id", rounded("score").alias("score"), "size")


def _block_groups(spark, sf_dir):
    blocked = _blocked(spark, sf_dir)
    return blocked.select(F.col("cluster_id").alias("group_id"), "id", F.lit(1.0).alias("score")), blocked


@query
def field_value_counts(spark, sf_dir):
    return G.field_value_counts(*_block_groups(spark, sf_dir), ALL_FIELDS)


@query
def field_agreement(spark, sf_dir):
    out = G.field_agreement(*_block_groups(spark, sf_dir), ALL_FIELDS)
    return out.select("group_id", "field", "value", rounded("agreement").alias("agreement"), rounded("confidence").alias("confidence"))


@query
def golden_record(spark, sf_dir):
    return G.golden_record(*_block_groups(spark, sf_dir), list(FIELDS))


@query
def all_components(spark, sf_dir):
    return G.components(similar_pairs(_vectors(spark, sf_dir)[0], 0.35))


# Store: on collections of their own, in the shared folder
def _store(spark, sf_dir):
    """A collection that holds the entities, in two appends."""
    store = EntityStore(spark, f"{shared_dir(spark)}/entwine/collection-{uuid.uuid4().hex}", buckets=8)
    store.create()
    e = entities(spark, sf_dir)
    store.add(e.filter("id LIKE 'a%'"))
    store.add(e.filter("id LIKE 'b%'"))
    return store


def _twins(spark, sf_dir):
    """What the dirty twins would change of the clean records."""
    return entities(spark, sf_dir).filter("id LIKE 'b%'").withColumn("id", F.concat(F.lit("a"), F.substring("id", 2, 8)))


@query
def entity_count(spark, sf_dir):
    return spark.createDataFrame([(_store(spark, sf_dir).count(),)], "entities long")


@query
def entity_get(spark, sf_dir):
    return _store(spark, sf_dir).get("a00000007").select("id", *FIELDS)


@query
def entity_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("id")).distinct()
    return _store(spark, sf_dir).get_all(ids).select("id", *FIELDS)


@query
def entity_list_page(spark, sf_dir):
    return _store(spark, sf_dir).list(50, 100).select("id", "name")


@query
def entity_update(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update(_twins(spark, sf_dir).select("id", "name", "zip"))
    return store.read().select("id", "name", "zip", "phone")


@query
def entity_upsert(spark, sf_dir):
    """Whole records: known ids are replaced, unknown ones and blank ones added."""
    store = _store(spark, sf_dir)
    twins = _twins(spark, sf_dir)
    new = twins.filter("CAST(substr(id, 2) AS INT) % 2 = 0").withColumn("id", F.concat(F.lit("c"), F.substring("id", 2, 8)))
    store.upsert(twins.unionByName(new).unionByName(new.filter("id LIKE '%2'").withColumn("id", F.lit(""))).select("id", "name", "zip"))
    return store.read().select(F.when(F.length("id") == 64, F.lit("new")).otherwise(F.col("id")).alias("id"), "name", "zip", "phone")


@query
def entity_delete(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete(entities(spark, sf_dir).filter("id LIKE 'b%'").select("id"))
    return store.read().select("id", "name")


# JSON
@query
def json_entities(spark, sf_dir):
    """Entities written as JSON and read again, through the record projection."""
    e = entities(spark, sf_dir)
    pairs = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])
    path = f"{shared_dir(spark)}/entwine/json-{uuid.uuid4().hex}"
    write_json(e.select("id", pairs.alias("fields"), F.create_map(F.lit("source"), F.lit("view")).alias("metadata")), path)
    return M.flatten(read_entities(spark, path, lines=True)).select("id", *FIELDS, F.element_at("metadata", "source").alias("source"))


@query
def json_matches(spark, sf_dir):
    """Matches as JSON rows, read back field by field."""
    found = match_rows(spark, sf_dir).select("query_id", "id", "rank", "matched_on")
    got = F.from_json("json", "query_id string, id string, rank long, matched_on array<string>")
    return to_json_rows(found).select(got.alias("j")).select("j.query_id", "j.id", "j.rank", F.array_join("j.matched_on", ",").alias("matched_on"))


@query
def json_groups(spark, sf_dir):
    """Blocks as groups in JSON, with members in order and the agreement of the name."""
    members, blocked = _block_groups(spark, sf_dir)
    members = members.withColumn("hop_distance", F.lit(0))
    rows = G.as_json(members, G.field_agreement(members, blocked, ["name"]))
    got = F.from_json("json", "id string, size long, entities array<struct<id:string>>, sample_fields map<string,struct<value:string,agreement:double>>").alias("j")
    name = F.col("j.sample_fields")["name"]
    return rows.select(got).select(F.col("j.id").alias("group_id"), "j.size", F.array_join("j.entities.id", ",").alias("ids"), name["value"].alias("name"), rounded(name["agreement"]).alias("agreement"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalize, block, compare names in blocks, keep the good pairs, best first."""
    ship_package(spark)
    pairs = B.candidate_pairs(staged(_blocked(spark, sf_dir).select("cluster_id", "id", "name"), "blocked"), ["name"])
    scored = pairs.select("cluster_id", "id_a", "id_b", rounded(S.name_similarity(F.col("name_a"), F.col("name_b"))).alias("score"))
    return scored.filter("score >= 0.85").orderBy(F.desc("score"), "id_a", "id_b")
