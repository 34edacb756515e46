"""Blocking: a short key from a few fields; records are compared inside their block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import digits_of, text_of

DEFAULT_BLOCK = "default"


def _head(value: Column, n: int) -> Column:
    """The first n bytes, kept as bytes: a cut may fall inside a character."""
    return F.substring(F.encode(value, "utf-8"), 1, n)


def _component(field: str, value: Column) -> Column:
    if field == "zip":
        return _head(value, 5)
    if field == "phone":
        return F.encode(F.right(digits_of(value), F.lit(4)), "utf-8")
    if field == "email":
        parts = F.split(value, "@")
        return F.encode(F.when(F.size(parts) == 2, parts[1]).otherwise(value), "utf-8")
    return _head(value, 3)


def blocking_key(df: DataFrame, fields: list[str] | tuple[str, ...] = ("name", "zip"), enabled: bool = True) -> Column:
    """The block id: 16 hex digits of the MD5 of the key, or `default` without a key.

    Each configured field that the frame has, in order of its name, gives a component from its normalized value,
    or the raw one where that is blank; components are joined, each with a bar after it.
    """
    present = [f for f in sorted(fields) if f in df.columns or f"{f}_normalized" in df.columns]
    if not enabled or not present:
        return F.lit(DEFAULT_BLOCK)
    key = F.lit(b"")
    for f in present:
        raw = text_of(f) if f in df.columns else F.lit("")
        value = F.coalesce(F.nullif(text_of(f"{f}_normalized"), F.lit("")), raw) if f"{f}_normalized" in df.columns else raw
        part = _component(f, value)
        key = F.concat(key, F.when(F.octet_length(part) > 0, F.concat(part, F.lit(b"|"))).otherwise(F.lit(b"")))
    return F.when(F.octet_length(key) == 0, DEFAULT_BLOCK).otherwise(F.substring(F.md5(key), 1, 16))


def assign_blocks(df: DataFrame, fields=("name", "zip"), enabled: bool = True) -> DataFrame:
    """Adds or recomputes cluster_id, in one pass."""
    return df.withColumn("cluster_id", blocking_key(df, fields, enabled))


def block_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster_id").agg(F.count("*").alias("block_size"))


def candidate_pairs(df: DataFrame, columns: list[str], id_col: str = "id", include_default: bool = False) -> DataFrame:
    """Pairs of records in the same block, smaller id first: cluster_id, id_a, id_b, <column>_a, <column>_b.

    An equi-join on the block: adaptive execution splits blocks that are too large for a task. The block of records
    without a key is left out unless asked for, as all of its pairs would be quadratic; block_sizes() tells how many
    these are.
    """
    rows = df if include_default else df.filter(F.col("cluster_id") != DEFAULT_BLOCK)
    a = rows.select("cluster_id", F.col(id_col).alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rows.select("cluster_id", F.col(id_col).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, "cluster_id").filter("id_a < id_b")


def block_filter(query_block: str | None, enabled: bool = True) -> Column:
    """Which rows a query searches: its block, or all without one."""
    if not enabled or not query_block or query_block == DEFAULT_BLOCK:
        return F.lit(True)
    return F.col("cluster_id") == query_block
