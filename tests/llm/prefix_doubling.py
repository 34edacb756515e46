"""Prefix doubling over all positions, the plain form of what suffix_dedup does over sampled ones; to compare with."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.plans.shared import staged

START = 8


def repeated_positions(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """doc, pos of every string of `threshold` bytes that starts twice at least.

    In each round positions are ranked by the pair of their rank and of the rank at the offset; a rank is the least
    position of equal pairs, and unique ones drop out.
    """
    def first_ranks(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode()
                n = len(raw) - START + 1
                if n > 0:
                    ranks = [int.from_bytes(raw[p : p + START], "big", signed=True) for p in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ranks, pa.int64())], names=["doc", "pos", "rank"])

    now, h = docs.select("doc_id", "text").mapInArrow(first_ranks, "doc long, pos long, rank long"), START
    while h < threshold:
        step = min(h, threshold - h)
        now = staged(now, "ranks")
        ahead = now.select("doc", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = staged(now.join(ahead, ["doc", "pos"]), "pairs")
        least = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first")).filter("n > 1")
        name = F.shiftleft(F.col("first.doc"), 32) + F.col("first.pos")
        now = pairs.join(least.select("rank", "next", name.alias("new")), ["rank", "next"]).select("doc", "pos", F.col("new").alias("rank"))
        h += step
    return now.select("doc", "pos")
