"""Incremental ingest and matching: each micro-batch is matched against the store, then added to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import MatchOptions
from ..plans.shared import staged
from ..service import Linker


def stream_entities(stream: DataFrame, linker: Linker, checkpoint: str, matches_path: str | None = None, options: MatchOptions | None = None, trigger: dict | None = None):
    """Starts a query that feeds a stream of entities into the store.

    With matches_path, the matches of each batch among the records stored before go there as Parquet, one folder
    for each batch, so a batch that is run again replaces its own output. Records whose id the store has already
    are left out, which makes a repeated batch harmless.
    """

    def feed(batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch.dropDuplicates(["id"]), "stream_batch")
        if matches_path:
            linker.match_entities(rows, options).write.mode("overwrite").parquet(f"{matches_path}/batch={batch_id}")
        fresh = rows.join(linker.store.read().select("id"), "id", "left_anti")
        linker.add_entities(fresh)

    writer = stream.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def windowed_counts(stream: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Records of each key and time window; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), F.col(key)).agg(F.count("*").alias("records"))
