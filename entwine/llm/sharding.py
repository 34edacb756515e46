"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups of equal texts are atomic and ordered by the SHA-256 of their text. The smallest capacity for which the
ordered groups fit into the shards is found by binary search with a greedy check, then the order is cut there.
Groups larger than an even share come first in the order and take a shard each; the capacity of the shards after them is
minimised anew, so that the others still share theirs evenly.

The driver never holds all groups: it starts from the bytes of at most 16**3 ranges of the order, searches with
bounds, and asks only for finer ranges around cuts that are still open.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

COARSE = 3  # hex digits of the first ranges
FINER = 2  # hex digits added each round
DIGEST = 64


def _fits(cum: list[int], capacity: int, shards: int, up: bool) -> tuple[bool, list[int]]:
    """Greedy check over ranges with running totals cum. up: a range that a cut falls into counts to the left."""
    at, cuts, n = 0, [], len(cum) - 1
    for _ in range(shards):
        if at >= n:
            break
        stop = bisect_right(cum, cum[at] + capacity) - 1
        if up and stop < n and cum[stop] < cum[at] + capacity:
            stop += 1
        if stop == at:
            return False, cuts
        at = stop
        cuts.append(at)
    return at >= n, cuts


def _search(cum: list[int], shards: int, low: int, high: int, up: bool) -> int:
    """The smallest capacity in [low, high] that fits; high is known to fit."""
    while low < high:
        mid = (low + high) // 2
        if _fits(cum, mid, shards, up)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(ranges, refine, shards: int, largest: int) -> list[str]:
    """Keys of the first group of each shard but the first.

    ranges: sorted [(prefix, bytes, groups)], the whole order. refine(prefixes) gives the finer ranges of some.
    A range of one group is exact. Bounds: capacity for which cuts at range borders suffice is enough (high);
    one for which even ranges split for free don't suffice is too small (low). Ranges are refined until the capacity
    is known and no cut falls into one, so the cuts are those of the greedy check over single groups.
    """
    ranges = list(ranges)
    total = sum(r[1] for r in ranges)
    if not total or shards < 2:
        return []
    low_all = max(largest, -(-total // shards))
    while True:
        cum = [0]
        for r in ranges:
            cum.append(cum[-1] + r[1])
        high = _search(cum, shards, low_all, total, False)
        low = low_all
        if any(r[2] > 1 for r in ranges):
            low = _search(cum, shards, low_all, high, True)
            early, late = _fits(cum, low, shards, False)[1], _fits(cum, high, shards, True)[1]
            early += [len(ranges)] * (shards - len(early))
            late += [len(ranges)] * (shards - len(late))
            open_ = {r for a, b in zip(early, late) for r in range(min(a, b) - 1, max(a, b) + 1) if 0 <= r < len(ranges) and ranges[r][2] > 1}
            if open_:
                finer = {}
                for p, size, n, parent in refine([ranges[i][0] for i in sorted(open_)]):
                    finer.setdefault(parent, []).append((p, size, n))
                ranges = [x for i, r in enumerate(ranges) for x in (sorted(finer[r[0]]) if i in open_ else [r])]
                continue
        cuts = _fits(cum, high, shards, False)[1]
        return [ranges[c][0] for c in cuts if c < len(ranges)]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, rows_a_bucket: int = 50_000) -> DataFrame:
    """Puts every row into a shard by the law `bytes`: sizes near equal, equal texts together.

    Returns id, size, text_crc32, law, shard, slot, grown_shard and group_key (hex SHA-256 of the text). A null
    text counts as empty and shares the group of empty texts; its size is the overhead alone. Repeated ids are
    rows of their own. Slots run without gaps from 0 in each shard, in the order of the first digits of the SHA-256 of the id, then id.
    An empty table gives an empty result. Other input columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = staged(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("group_key"),
        ),
        "shard_rows",
    )

    stats = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, n = stats["b"] or 0, stats["n"]
    by_group = rows.groupBy("group_key").agg(F.sum("size").alias("size"))
    top = by_group.orderBy(F.desc("size"), "group_key").limit(shards).collect() if n else []
    giants, rest, left = [], total, shards
    for g in top:  # those larger than an even share of what is left take a shard each
        if left > 1 and g["size"] * left > rest:
            giants.append(g["group_key"])
            rest, left = rest - g["size"], left - 1
        else:
            break
    largest = next((g["size"] for g in top[len(giants) :]), 0)
    others = rows.filter(~F.col("group_key").isin(giants)) if giants else rows

    def summary(df: DataFrame, digits: int):
        """Name and bytes of each range, and whether it is a single group, which goes by its whole key."""
        out = df.groupBy(F.substring("group_key", 1, digits).alias("p")).agg(F.sum("size").alias("b"), F.min("group_key").alias("lo"), F.max("group_key").alias("hi"))
        one = F.col("lo") == F.col("hi")
        return out.select(F.when(one, F.col("lo")).otherwise(F.col("p")).alias("p"), "b", F.when(one, 1).otherwise(2).alias("n"))

    def refine(prefixes: list[str]):
        by_len: dict[int, list[str]] = {}
        for p in prefixes:
            by_len.setdefault(len(p), []).append(p)
        for k, ps in by_len.items():
            digits = min(DIGEST, k + FINER)
            hit = others.filter(F.substring("group_key", 1, k).isin(ps))
            for r in summary(hit, digits).collect():
                yield r["p"], r["b"], r["n"], r["p"][:k]

    first = [tuple(r) for r in summary(others, COARSE).collect()] if n else []
    cuts = minimax_cuts(sorted(first), refine, left, largest)

    shard = F.lit(len(giants))
    for c in cuts:
        shard = shard + (F.col("group_key") >= F.lit(c)).cast("int")
    for i, g in enumerate(giants):
        shard = F.when(F.col("group_key") == g, F.lit(i)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))

    digits = 1
    while 16**digits * rows_a_bucket < n:
        digits += 1
    placed = placed.withColumn("bucket", F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, digits))
    start = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("c")).select("shard", "bucket", F.coalesce(F.sum("c").over(start), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group_key")
    return (
        placed.withColumn("nth", F.row_number().over(inside))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key")
    )
