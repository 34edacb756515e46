"""Command line: python -m entwine.cli --ingest FILE --match TEXT --match-file FILE --group ID ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config as settings
from .operators.groups import GroupOptions
from .operators.matching import MatchOptions
from .service import Linker
from .sources.json_io import pretty, read_entities

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="entwine")
    p.add_argument("--config", default="config.yaml", help="configuration file")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--ingest", help="JSON file with entities to ingest")
    p.add_argument("--match-file", help="JSON file with an entity to match")
    p.add_argument("--match", help="text to match")
    p.add_argument("--threshold", type=float, default=0)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--details", action="store_true", help="accepted, without effect")
    p.add_argument("--recompute-clusters", action="store_true")
    p.add_argument("--group", help="id of the entity whose match group is wanted")
    p.add_argument("--group-strategy", default="direct", choices=["direct", "transitive", "hybrid"])
    p.add_argument("--group-hops", type=int, default=2)
    p.add_argument("--field-scores", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None, linker: Linker | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("entwine").getOrCreate()
    r = linker or Linker(spark, settings.load(a.config), embedder=None)
    m = r.config.matching
    options = MatchOptions(limit=a.limit or m.default_limit, threshold=a.threshold or m.similarity_threshold, include_field_scores=a.field_scores)
    if a.ingest:
        before = r.count()
        r.add_entities(read_entities(spark, a.ingest))
        print(f"ingested {r.count() - before} entities")
    if a.match_file:
        print(pretty(r.match_entities(read_entities(spark, a.match_file), options)))
    if a.match:
        print(pretty(r.match_text(a.match, options)))
    if a.recompute_clusters:
        r.recompute_clusters()
        print("recomputed clusters")
    if a.group:
        seeds = spark.createDataFrame([(a.group,)], "id string")
        for row in r.group_json(seeds, GroupOptions(threshold=options.threshold, strategy=a.group_strategy, hops=a.group_hops)).collect():
            print(row["json"])


if __name__ == "__main__":
    main()
