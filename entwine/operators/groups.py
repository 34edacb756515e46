"""Match groups over an edge table (src, dst, score): direct, transitive and hybrid, for all seeds in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import drop_staged, staged
from .vector_groups import VectorEdges, walk


@dataclass(frozen=True)
class GroupOptions:
    """max_size None: no bound. direct_floor: least score of direct members in hybrid groups."""

    threshold: float = 0.85
    max_size: int | None = 100
    strategy: str = "hybrid"
    hops: int = 3
    direct_floor: float = 0.9


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair (a, b, score)."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score"))


def _capped(members: DataFrame, max_size: int | None) -> DataFrame:
    if max_size is None:
        return members
    order = Window.partitionBy("group_id").orderBy("hop_distance", F.desc("score"), "id")
    return members.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_size).drop("n")


Neighbours = Callable[[DataFrame], DataFrame]


def _near(edges: DataFrame | Neighbours, frontier: DataFrame, least: float) -> DataFrame:
    """Edges from the ids of a frontier: of a table, or asked for just these."""
    if isinstance(edges, DataFrame):
        return edges.filter(F.col("score") >= least)
    return edges(frontier.select("id").distinct()).filter((F.col("score") >= least) & (F.col("src") != F.col("dst")))


def _walk(start: DataFrame, edges: DataFrame | Neighbours, least: float, hops: int, max_size: int | None) -> DataFrame:
    """Breadth first from (group_id, id, score, hop_distance); first visit counts, best edge from the last hop.

    Groups that have reached max_size go no further.
    """
    seen = frontier = start
    for _ in range(hops):
        if max_size is not None:
            full = seen.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") >= max_size).select("group_id")
            frontier = frontier.join(full, "group_id", "left_anti")
        step = frontier.select("group_id", F.col("id").alias("src"), "hop_distance").join(_near(edges, frontier, least), "src").groupBy("group_id", F.col("dst").alias("id")).agg(F.max("score").alias("score"), (F.min("hop_distance") + 1).alias("hop_distance"))
        frontier = staged(step.join(seen.select("group_id", "id"), ["group_id", "id"], "left_anti").select("group_id", "id", "score", "hop_distance"), "group_frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _vector_groups(seeds: DataFrame, edges: VectorEdges, options: GroupOptions) -> DataFrame | None:
    """match_groups without a bound of size; None if the vectors do not fit in a task."""
    if options.strategy == "direct":
        least = [options.threshold]
    elif options.strategy == "transitive":
        least = [options.threshold] * options.hops
    elif options.strategy == "hybrid":
        least = [max(options.threshold, options.direct_floor), *[options.threshold] * (options.hops - 1)]
    else:
        raise ValueError(f"unknown group strategy: {options.strategy}")
    members = walk(seeds, edges, least, without_seed=options.strategy == "hybrid")
    if members is None:
        return None
    primary = seeds.select(F.col("id").alias("group_id"), "id", F.lit(1.0).alias("score"), F.lit(0).alias("hop_distance")).distinct()
    return primary.unionByName(members)


def match_groups(seeds: DataFrame, edges: DataFrame | Neighbours, options: GroupOptions = GroupOptions()) -> DataFrame:
    """group_id, id, score, hop_distance: members of the group of each seed (column id), seed first with score 1.

    edges: src, dst, score; or a function from ids to their edges, which is asked for each hop's frontier alone. Of
    VectorEdges, groups without a bound of size take a path whose disk does not grow with the paths.
    """
    most = options.max_size
    if isinstance(edges, VectorEdges) and most is None:
        out = _vector_groups(seeds, edges, options)
        if out is not None:
            return out
    primary = staged(seeds.select(F.col("id").alias("group_id"), "id", F.lit(1.0).alias("score"), F.lit(0).alias("hop_distance")).distinct(), "group_seeds")
    if options.strategy == "direct":
        out = _walk(primary, edges, options.threshold, 1, most)
    elif options.strategy == "transitive":
        out = _walk(primary, edges, options.threshold, options.hops, most)
    elif options.strategy == "hybrid":
        out = direct = _walk(primary, edges, max(options.threshold, options.direct_floor), 1, most)
        if options.hops > 1:
            near = direct.filter("hop_distance = 1")
            far = _walk(near, edges, options.threshold, options.hops - 1, most).join(direct.select("group_id", "id"), ["group_id", "id"], "left_anti")
            out = direct.unionByName(far)
    else:
        raise ValueError(f"unknown group strategy: {options.strategy}")
    return _capped(out, most)


def group_stats(members: DataFrame) -> DataFrame:
    """group_id, score (mean, the seed's 1 included), size."""
    return members.groupBy("group_id").agg(F.avg("score").alias("score"), F.count("*").alias("size"))


def field_value_counts(members: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """group_id, field, value, count of the members' non-blank values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    long = members.select("group_id", "id").join(entities.select("id", *fields), "id").select("group_id", pairs.alias("p"))
    return long.select("group_id", "p.field", "p.value").filter(F.coalesce("value", F.lit("")) != "").groupBy("group_id", "field", "value").agg(F.count("*").alias("count"))


def field_agreement(members: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """group_id, field, value, agreement, confidence: the commonest value, ties to the smaller one."""
    counts = field_value_counts(members, entities, fields)
    best = counts.groupBy("group_id", "field").agg(F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("best"))
    agreement = -F.col("best.n") / F.col("size")
    return best.join(group_stats(members), "group_id").select("group_id", "field", F.col("best.value").alias("value"), agreement.alias("agreement"), (agreement * F.col("score")).alias("confidence"))


def golden_record(members: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each group: its commonest values."""
    best = field_agreement(members, entities, fields)
    return best.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def components(pairs: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """id, component: the smallest id that each id of a pair reaches, by spreading minima with pointer jumps."""
    both = staged(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "component_edges")
    now = staged(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("c")).select(F.col("x").alias("id"), "c"), "component_labels")
    for _ in range(most_rounds):
        near = both.join(now.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("m"))
        low = now.join(near, "id").select("id", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = low.join(now.select(F.col("id").alias("c"), F.col("c").alias("up")), "c", "left")
        after = staged(jump.select("id", F.least("c", F.coalesce("up", "c")).alias("c"), "old"), "component_labels")
        drop_staged(now)
        if after.filter("c <> old").isEmpty():
            return after.select("id", F.col("c").alias("component"))
        now = after.select("id", "c")
    raise RuntimeError("components did not settle")


def as_json(members: DataFrame, agreement: DataFrame) -> Column | DataFrame:
    """One JSON document for each group: id, primary_id, size, score, entities, sample_fields."""
    stats = group_stats(members)
    people = members.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "score", "hop_distance"))).alias("entities"))
    sample = agreement.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "agreement", "confidence"))))).alias("sample_fields"))
    row = stats.join(people, "group_id").join(sample, "group_id", "left")
    entities = F.transform("entities", lambda e: F.struct(e["id"].alias("id"), e["score"].alias("score"), e["hop_distance"].alias("hop_distance")))
    return row.select("group_id", F.to_json(F.struct(F.col("group_id").alias("id"), F.col("group_id").alias("primary_id"), "size", "score", entities.alias("entities"), "sample_fields")).alias("json"))
