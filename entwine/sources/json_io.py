"""JSON sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY


def read_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of entities, or one entity: id, fields, metadata. lines: one entity a line, which tasks share out."""
    return spark.read.schema(ENTITY).option("multiLine", not lines).json(path)


def text_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("query", text)], "query_id string, text string")


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pretty(df: DataFrame) -> str:
    """The rows as one JSON array, for results that a person reads; bounded by the caller's limit."""
    row = df.agg(F.to_json(F.collect_list(F.struct(*[F.col(c) for c in df.columns])), {"pretty": "true"}).alias("j")).first()
    return row["j"] if row else "[]"
