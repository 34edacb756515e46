"""The entity table as Parquet: create, add, look up, update, upsert, delete, count, list, compact.

Rows lie in buckets by a hash of their id. Each write makes new parts for the buckets that it touches and then a new
pointer file that lists the parts of all buckets; so readers see whole versions, a lost executor never leaves half a
table, and a change rewrites its buckets alone. Pointer files are numbered: a writer creates the number after the one
that it has read, which fails if another one was faster. That needs a file system whose create is exclusive (HDFS and
local ones are; plain object stores are not, and want a single writer).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD

BUCKETS = 64
MOST_PARTS = 8  # parts of a bucket that compact() lets be


class Conflict(RuntimeError):
    """Another writer was faster; read again and repeat."""


def one_of_each(changes: DataFrame) -> DataFrame:
    """One row for each id: of several the greatest by its JSON text."""
    whole = F.struct(*[F.col(c) for c in changes.columns])
    return changes.groupBy("id").agg(F.max_by(whole, F.to_json(whole)).alias("__row")).select("__row.*")


def merged(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the values of `changes` (same id) in place of their own, for the columns that changes has."""
    new = one_of_each(changes).select("id", F.struct(*[c for c in changes.columns if c != "id"]).alias("__new"))
    out = rows.join(new, "id", "left")
    pick = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    return out.select(*[pick(c) if c in changes.columns and c != "id" else F.col(c) for c in rows.columns])


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


class EntityStore:
    """A named collection under a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, class_name: str = "Entity", schema=RECORD, buckets: int = BUCKETS):
        self.spark, self.schema, self.buckets = spark, schema, buckets
        self.path = f"{path.rstrip('/')}/{class_name}"

    # Versions
    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _state(self) -> tuple[int, dict]:
        """Number of the current version, and its parts by bucket. A pointer that is still being written does not count."""
        for n in sorted((int(f) for f in self._names("current") if f.isdigit()), reverse=True):
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/current/{n}").collect())
            if text.endswith("}"):
                return n, json.loads(text)
        return 0, {"buckets": self.buckets, "parts": {}}

    def _point(self, after: int, state: dict) -> None:
        """The version after the one that was read."""
        fs, p = self._fs(f"current/{after + 1}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            raise Conflict(f"version {after + 1} is there already") from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def _bucket(self, state: dict, id_: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col("id") if id_ is None else id_), F.lit(state["buckets"])).cast("int")

    def _write(self, df: DataFrame, state: dict) -> dict[str, str]:
        """Writes rows; the new part of each bucket that got any."""
        part = uuid.uuid4().hex
        df.withColumn("bucket", self._bucket(state)).repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{self.path}/parts/{part}")
        return {n.split("=")[1]: part for n in self._names(f"parts/{part}") if n.startswith("bucket=")}

    def _load(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/parts/{p}/bucket={b}" for b, ps in state["parts"].items() if buckets is None or b in buckets for p in ps]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _touched(self, state: dict, ids: DataFrame) -> set[str]:
        """The buckets of some ids: at most as many as there are."""
        return {str(r[0]) for r in ids.select(self._bucket(state)).distinct().collect()}

    def _rewrite(self, number: int, state: dict, touched: set[str], rows: DataFrame) -> None:
        """Puts rows in the place of all that the touched buckets held."""
        new = self._write(rows, state)
        parts = {b: ps for b, ps in state["parts"].items() if b not in touched} | {b: [p] for b, p in new.items()}
        self._point(number, state | {"parts": parts})

    def _shaped(self, df: DataFrame) -> DataFrame:
        """All columns of the schema; a blank id becomes a hash of the values, so a retried task gives the same."""
        have = [f.name for f in self.schema if f.name in df.columns]
        text = F.to_json(F.struct(*[c for c in have if c not in ("id", "created_at", "updated_at")]))
        given = F.col("id") if "id" in df.columns else F.lit(None)
        row_id = F.when(F.coalesce(given, F.lit("")) == "", F.sha2(text, 256)).otherwise(given)
        return df.select(*[row_id.cast("string").alias("id") if f.name == "id" else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def _stamped(self, df: DataFrame) -> DataFrame:
        stamp = F.unix_timestamp()
        created = F.coalesce(F.nullif(F.col("created_at"), F.lit(0)), stamp) if "created_at" in df.columns else stamp
        return self._shaped(df.withColumns({"created_at": created, "updated_at": stamp}))

    # Operations
    def create(self) -> None:
        """Does nothing if the collection is there."""
        number, state = self._state()
        if not number:
            self._point(0, state)

    def read(self) -> DataFrame:
        return self._load(self._state()[1])

    def add(self, df: DataFrame, tries: int = 5) -> None:
        """Appends. Rows of other writers stay: after a conflict the same parts are added to the newer version."""
        number, state = self._state()
        new = self._write(self._stamped(df), state)
        for left in reversed(range(tries)):
            parts = {**state["parts"], **{b: [*state["parts"].get(b, []), p] for b, p in new.items()}}
            try:
                return self._point(number, state | {"parts": parts})
            except Conflict:
                if not left:
                    raise
                number, state = self._state()

    def get(self, entity_id: str) -> DataFrame:
        """The row with an id: reads one bucket, with the filter pushed down to its files."""
        state = self._state()[1]
        bucket = self.spark.range(1).select(self._bucket(state, F.lit(entity_id))).first()[0]
        return self._load(state, {str(bucket)}).filter(F.col("id") == entity_id)

    def get_all(self, ids: DataFrame) -> DataFrame:
        """The rows with the ids of a frame."""
        return self.read().join(ids.select("id"), "id", "left_semi")

    def update(self, changes: DataFrame) -> None:
        """Takes the changed rows' columns; other columns and rows stay. Ids that are new are not added."""
        number, state = self._state()
        touched = self._touched(state, changes)
        self._rewrite(number, state, touched, merged(self._load(state, touched), changes.withColumn("updated_at", F.unix_timestamp())))

    def upsert(self, df: DataFrame) -> None:
        """Puts whole rows in the place of those with their ids; new ids are added, a blank id becomes a new one."""
        number, state = self._state()
        new = one_of_each(self._stamped(df))
        touched = self._touched(state, new)
        self._rewrite(number, state, touched, without(self._load(state, touched), new).unionByName(new))

    def delete(self, ids: DataFrame) -> None:
        number, state = self._state()
        touched = self._touched(state, ids)
        self._rewrite(number, state, touched, without(self._load(state, touched), ids))

    def replace_all(self, rows: DataFrame) -> None:
        number, state = self._state()
        self._rewrite(number, state, set(state["parts"]), self._shaped(rows))

    def compact(self) -> None:
        """Writes the buckets with more than MOST_PARTS parts anew."""
        number, state = self._state()
        many = {b for b, ps in state["parts"].items() if len(ps) > MOST_PARTS}
        if many:
            self._rewrite(number, state, many, self._load(state, many))

    def count(self) -> int:
        return self.read().count()

    def list(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return self.read().orderBy("id").offset(offset).limit(limit)

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
