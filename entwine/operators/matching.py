"""Ingest, matching, field scores, weighted scores, ranking and explanations, for whole tables of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.normalize import DEFAULTS, FIELDS, NormalizeOptions, combine_fields, normalize_entity, text_of
from ..functions.vector import mock_embedding
from .blocking import DEFAULT_BLOCK, assign_blocks
from .search import top_k, top_k_in_block

OVERFETCH = 3  # candidates for each wanted match when blocks are searched


@dataclass(frozen=True)
class MatchOptions:
    """use_clustering: None follows the configuration. post_threshold also bounds the final score."""

    limit: int = 10
    threshold: float = 0.85
    use_clustering: bool | None = None
    include_field_scores: bool = False
    field_weights: dict[str, float] = field(default_factory=dict)
    field_types: dict[str, str] = field(default_factory=dict)
    exact_fields: tuple[str, ...] = ()
    self_scores: bool = False
    post_threshold: float | None = None
    fallback_global: bool = False


def parse_query_fields(text: Column | str) -> Column:
    """field=value pairs of a text as a map: split at ; or else at commas; the last of equal fields counts."""
    t = text_of(text)
    trim = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    pieces = F.when(F.contains(t, F.lit(";")), F.split(t, ";")).when(F.contains(t, F.lit(",")), F.split(t, ",")).otherwise(F.array(t))
    pairs = F.transform(pieces, lambda p: F.struct(trim(F.substring_index(p, "=", 1)).alias("key"), trim(F.substr(p, F.instr(p, "=") + 1)).alias("value"), F.contains(p, F.lit("=")).alias("ok")))
    good = F.filter(pairs, lambda p: p["ok"] & (p["key"] != "") & (p["value"] != ""))
    none = F.array().cast("array<struct<key:string,value:string>>")
    last = F.aggregate(good, none, lambda acc, p: F.array_append(F.filter(acc, lambda x: x["key"] != p["key"]), F.struct(p["key"].alias("key"), p["value"].alias("value"))))
    return F.map_from_entries(last)


def flatten(entities: DataFrame) -> DataFrame:
    """id, fields, metadata -> flat record with the known fields; blank ids become a hash of the fields."""
    sorted_fields = F.to_json(F.array_sort(F.map_entries("fields")))
    blank = F.col("id").isNull() | (F.col("id") == "")
    return entities.select(F.when(blank, F.sha2(sorted_fields, 256)).otherwise(F.col("id")).alias("id"), *[F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("")).alias(f) for f in FIELDS], "metadata")


def embed(df: DataFrame, dim: int, embedder=None) -> DataFrame:
    """Adds `vector` for `text`: by an embedder (DataFrame -> DataFrame), else the mock embedding."""
    return embedder(df) if embedder else df.withColumn("vector", mock_embedding(F.col("text"), dim))


def prepare(df: DataFrame, dim: int, fields=("name", "zip"), clustering: bool = True, options: NormalizeOptions = DEFAULTS, embedder=None) -> DataFrame:
    """Normalized fields, embedding text, vector and block of flat records."""
    out = normalize_entity(df, options)
    out = embed(out.withColumn("text", combine_fields(out)), dim, embedder)
    return assign_blocks(out, fields, clustering)


def ingest(df: DataFrame, dim: int, now: int | None = None, **options) -> DataFrame:
    """Flat records ready to be stored: prepare(), timestamps set where they are missing."""
    stamp = F.lit(now) if now is not None else F.unix_timestamp()
    created = F.coalesce(F.nullif(F.col("created_at"), F.lit(0)), stamp) if "created_at" in df.columns else stamp
    return prepare(df, dim, **options).withColumns({"created_at": created.cast("long"), "updated_at": stamp.cast("long")})


def field_score(name: str, a: Column, b: Column, options: MatchOptions) -> tuple[Column, str]:
    """Score of a field and the name of its comparator: exact if forced, else by mapping, else by the field's name."""
    if name in options.exact_fields:
        fn = "ExactMatch"
    elif name in options.field_types:
        fn = sim.by_field_type(options.field_types[name])
    else:
        fn = sim.infer(name)
    return sim.FUNCTIONS[fn](a, b), fn


def field_scores(pairs: DataFrame, names: list[str], options: MatchOptions = MatchOptions()) -> DataFrame:
    """Adds score_<field>: null where the query (<field>_q) has no value; with self_scores the match against itself."""
    cols = {}
    for n in names:
        q = F.col(f"{n}_m") if options.self_scores else F.col(f"{n}_q")
        score = field_score(n, q, F.col(f"{n}_m"), options)[0]
        cols[f"score_{n}"] = F.when(text_of(q) != "", score)
    return pairs.withColumns(cols)


def weighted_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the scores that are there; weight 1 where none is given; 0 without weight."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, s in scores.items():
        w = float(weights.get(name, 1.0))
        total = total + F.coalesce(s * w, F.lit(0.0))
        weight = weight + F.when(s.isNotNull(), w).otherwise(0.0)
    return F.when(weight == 0, 0.0).otherwise(total / F.when(weight == 0, 1.0).otherwise(weight))


def blended_score(vector_score: Column, scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of vector and weighted score, if weights are given and any field was scored."""
    if not weights or not scores:
        return vector_score
    any_score = F.coalesce(*scores.values()).isNotNull()
    return F.when(any_score, (vector_score + weighted_score(scores, weights)) / 2).otherwise(vector_score)


def matched_on(names: list[str] | tuple[str, ...] = FIELDS, suffix: str = "") -> Column:
    """Fields of the match that hold a value, by name."""
    return F.array_compact(F.array(*[F.when(text_of(f"{n}{suffix}") != "", F.lit(n)) for n in sorted(names)]))


def explanation(score: Column, fields: Column) -> Column:
    level = F.when(score >= 0.9, "high").when(score < 0.7, "low").otherwise("medium")
    return F.format_string("Matched with %s confidence (%.2f) on fields: %s", level, score, F.array_join(fields, ", "))


def find_matches(queries: DataFrame, entities: DataFrame, options: MatchOptions = MatchOptions(), clustering: bool = False) -> DataFrame:
    """Matches of prepared queries (query_id, fields, vector, cluster_id) among prepared entities.

    Columns: query_id, id, rank, score, vector_score, matched_on, explanation, the fields of the match, and
    score_<field> when fields are scored. The threshold holds before the blend; ties go by id. Inside blocks the
    OVERFETCH * limit nearest vectors are blended, so a record that is only near by its fields is not found there.
    """
    blocks = clustering if options.use_clustering is None else options.use_clustering
    want = options.limit * OVERFETCH if blocks else options.limit
    slim = ["query_id", "vector", "cluster_id"]
    if blocks:
        keyed = queries.filter(F.col("cluster_id") != DEFAULT_BLOCK)
        found = top_k_in_block(keyed, entities, want, "cluster_id")
        open_ = queries.filter(F.col("cluster_id") == DEFAULT_BLOCK)
        if options.fallback_global:
            open_ = open_.unionByName(keyed.join(found.select("query_id").distinct(), "query_id", "left_anti"))
        found = found.unionByName(top_k(open_.select(*slim), entities, want))
    else:
        found = top_k(queries.select(*slim), entities, want)
    found = found.filter(F.col("score") >= options.threshold).withColumnRenamed("score", "vector_score").drop("rank")
    names = [f for f in FIELDS if f in entities.columns and f in queries.columns]
    keep = [f for f in FIELDS if f in entities.columns]
    pairs = found.join(entities.select("id", *[F.col(f).alias(f"{f}_m") for f in keep]), "id").join(queries.select("query_id", *[F.col(f).alias(f"{f}_q") for f in names]), "query_id")
    scores = {}
    if options.include_field_scores or options.field_weights:
        pairs = field_scores(pairs, names, options)
        scores = {n: F.col(f"score_{n}") for n in names}
    out = pairs.withColumn("score", blended_score(F.col("vector_score"), scores, options.field_weights))
    if options.post_threshold is not None:
        out = out.filter(F.col("score") >= options.post_threshold)
    out = rank_matches(out, options.limit).withColumn("matched_on", matched_on(keep, "_m"))
    out = out.withColumn("explanation", explanation(F.col("vector_score"), F.col("matched_on")))
    return out.select("query_id", "id", "rank", "score", "vector_score", "matched_on", "explanation", *[F.col(f"{f}_m").alias(f) for f in keep], *[f"score_{n}" for n in scores])


def rank_matches(df: DataFrame, limit: int) -> DataFrame:
    """The best of each query, by score, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return df.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
