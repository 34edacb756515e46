"""Schemas of inputs, the stored table and results."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions.normalize import FIELDS

STRING_MAP = T.MapType(T.StringType(), T.StringType())
#: A record as it comes in.
ENTITY = T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", STRING_MAP), T.StructField("metadata", STRING_MAP)])
#: A stored record.
RECORD = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [T.StructField(n, T.StringType()) for f in FIELDS for n in (f, f"{f}_normalized")]
    + [
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("metadata", STRING_MAP),
        T.StructField("cluster_id", T.StringType()),
    ]
)
