"""Vector expressions and the mock embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors; null when a vector is null or the dimensions differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(size == 0, 0.0).otherwise(dot(a, b) / F.when(size == 0, 1.0).otherwise(size))


def mock_embedding(text: Column, dim: int) -> Column:
    """Component i is byte i of the text over 255; zeros after the end."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    at = lambda i: F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("double") / F.lit(255.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i < F.octet_length(raw), at(i)).otherwise(0.0).cast("float"))


def check_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Adds `valid`: the vector is there and has the dimension."""
    return df.withColumn("valid", F.col(column).isNotNull() & (F.coalesce(F.size(column), F.lit(-1)) == dim))
