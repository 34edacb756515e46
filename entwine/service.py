"""One object for all operations: the Python counterpart of an entity-resolution service's routes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.normalize import normalize_entity
from .functions.vector import check_dimension
from .operators import blocking, groups, matching
from .operators.search import top_k, top_k_in_block
from .plans.shared import ship_package, staged
from .sources.embedder import embed_texts, http_client
from .sources.store import EntityStore


class Linker:
    """embedder: a function of a DataFrame with `text` that adds `vector`; None: the configured service; "mock"."""

    def __init__(self, spark: SparkSession, config: Config | None = None, embedder="mock"):
        ship_package(spark)
        self.spark, self.config = spark, config or Config()
        self.dim = self.config.embedding.embedding_dim
        self.store = EntityStore(spark, self.config.store.path, self.config.store.class_name)
        e = self.config.embedding
        self.embedder = None if embedder == "mock" else embedder or (lambda df: embed_texts(df, lambda: http_client(e.url, e.model_name, e.timeout), e.embedding_dim, e.batch_size, cache_size=e.cache_size, cache_name=f"{e.url} {e.model_name}"))

    # Entities
    def _flat(self, entities: DataFrame) -> DataFrame:
        return matching.flatten(entities) if "fields" in entities.columns else entities

    def _prepared(self, entities: DataFrame) -> DataFrame:
        c = self.config
        return matching.prepare(self._flat(entities), self.dim, tuple(c.clustering.fields), c.clustering.enabled, c.normalization.options(), self.embedder)

    def add_entities(self, entities: DataFrame, raw: bool = False) -> None:
        """Normalizes, embeds, blocks and stores; raw: stores records with vectors of their own as they are."""
        if raw:
            self._check(entities)
            self.store.add(entities)
        else:
            self.store.add(self._prepared(entities).drop("text"))

    def _check(self, df: DataFrame) -> None:
        bad = check_dimension(df, "vector", self.dim).filter(~F.col("valid")).limit(1).count()
        if bad:
            raise ValueError(f"every record needs a vector of dimension {self.dim}")

    def get_entity(self, entity_id: str) -> DataFrame:
        return self.store.get(entity_id)

    def update_entities(self, changes: DataFrame) -> None:
        if "vector" in changes.columns:
            self._check(changes)
        self.store.update(changes)

    def upsert_entities(self, entities: DataFrame) -> None:
        """Normalizes, embeds and blocks whole records and puts them in the place of those with their ids; others are added."""
        self.store.upsert(self._prepared(entities).drop("text"))

    def delete_entities(self, ids: DataFrame) -> None:
        self.store.delete(ids)

    def count(self) -> int:
        return self.store.count()

    def list_entities(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return self.store.list(offset, limit)

    def health(self) -> bool:
        return self.store.health()

    def recompute_clusters(self) -> None:
        if not self.config.clustering.enabled:
            raise ValueError("clustering is not enabled")
        self.store.replace_all(blocking.assign_blocks(self.store.read(), tuple(self.config.clustering.fields)))

    # Matching
    def _options(self, options: matching.MatchOptions | None) -> matching.MatchOptions:
        m = self.config.matching
        return options or matching.MatchOptions(limit=m.default_limit, threshold=m.similarity_threshold)

    def match_entities(self, queries: DataFrame, options: matching.MatchOptions | None = None) -> DataFrame:
        """Matches of each query entity (id, fields or flat columns)."""
        prepared = self._prepared(queries).withColumnRenamed("id", "query_id")
        return matching.find_matches(prepared, self.store.read(), self._options(options), self.config.clustering.enabled)

    def match_text(self, text: str, options: matching.MatchOptions | None = None) -> DataFrame:
        """Matches of a text; field=value pairs in it are scored field by field."""
        options = self._options(options)
        row = self.spark.createDataFrame([("query", text)], "query_id string, text string")
        pairs = row.select(F.map_entries(matching.parse_query_fields("text")).alias("p")).first()["p"] or []
        found = {p["key"]: p["value"] for p in pairs}
        known = {k: v for k, v in found.items() if k in matching.FIELDS}
        if known and not options.self_scores:
            options = replace(options, include_field_scores=True)
        query = normalize_entity(row.withColumns({k: F.lit(v) for k, v in known.items()}), self.config.normalization.options())
        query = matching.embed(query, self.dim, self.embedder)
        query = blocking.assign_blocks(query, tuple(self.config.clustering.fields), bool(known) and self.config.clustering.enabled)
        return matching.find_matches(query, self.store.read(), options, self.config.clustering.enabled)

    # Groups
    def edges(self, seeds: DataFrame | None = None, limit: int = 100) -> DataFrame:
        """src, dst, score for the best matches of the seeds (column id), or of each stored record; inside blocks if enabled."""
        rows = self.store.read()
        asked = (rows.join(seeds.select("id"), "id", "left_semi") if seeds is not None else rows).withColumnRenamed("id", "query_id")
        found = top_k_in_block(asked, rows, limit, "cluster_id") if self.config.clustering.enabled else top_k(asked, rows, limit)
        return found.filter(F.col("query_id") != F.col("id")).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")

    def match_groups(self, seeds: DataFrame, options: groups.GroupOptions = groups.GroupOptions()) -> DataFrame:
        """Only the frontier of each hop is searched for."""
        return groups.match_groups(seeds, lambda ids: self.edges(ids, options.max_size or 100), options)

    def group_json(self, seeds: DataFrame, options: groups.GroupOptions = groups.GroupOptions()) -> DataFrame:
        members = staged(self.match_groups(seeds, options), "members")
        rows = self.store.read()
        names = [n for f in matching.FIELDS for n in (f, f"{f}_normalized")]
        return groups.as_json(members, groups.field_agreement(members, rows, names))
