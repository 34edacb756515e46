"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A hash rotates the unit vector by three rounds of random signs and Hadamard transforms and takes the nearest
signed axis. Each table joins several hashes into a bucket; a vector also probes the buckets that its runner-up
axes give. All vectors that meet in a bucket are compared exactly, by blocked matrix products in double precision.

Equal vectors make a class that is compared once. Buckets larger than a block are compared block by block, each
pair of blocks in its own place, so no task holds a whole bucket. Links are counted, not listed: a block adds up
how many links each vector gets, and tells the smallest id that each reaches inside the block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, staged, whole_groups
from .components import connected_components

BLOCK = 1024
PROBES = 2  # runner-up buckets a table


def rotations(dim: int, tables: int, hashes: int, seed: int = 11) -> np.ndarray:
    """Random signs of the three rounds: tables x hashes x 3 x padded dimension."""
    wide = 1 << max(0, dim - 1).bit_length()
    return np.random.RandomState(seed + dim).choice([-1.0, 1.0], (tables, hashes, 3, wide))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, wide = x.shape
    step = 1
    while step < wide:
        y = x.reshape(n, wide // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, wide)
        step *= 2
    return x / math.sqrt(wide)


def buckets(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Home bucket, then probed ones: vectors x tables x (1 + PROBES)."""
    tables, hashes, _, wide = signs.shape
    n = len(unit)
    padded = np.zeros((n, wide))
    padded[:, : unit.shape[1]] = unit
    out = np.empty((n, tables, 1 + PROBES), np.int64)
    for t in range(tables):
        best, second, loss = [], [], []
        for h in range(hashes):
            x = padded
            for r in range(3):
                x = hadamard(x * signs[t, h, r])
            size = np.abs(x)
            top = np.argpartition(-size, 1, axis=1)[:, :2] if wide > 1 else np.zeros((n, 2), int)
            pair = np.take_along_axis(size, top, 1)
            swap = pair[:, 1] > pair[:, 0]
            top[swap] = top[swap][:, ::-1]
            signed = top * 2 + (np.take_along_axis(x, top, 1) < 0)
            best.append(signed[:, 0])
            second.append(signed[:, 1])
            loss.append(np.abs(pair[:, 0] - pair[:, 1]))
        base = 2 * wide
        home = np.zeros(n, np.int64)
        for b in best:
            home = home * base + b
        out[:, t, 0] = home
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
        for p in range(PROBES):
            if hashes == 1 and p:
                out[:, t, 1 + p] = home
                continue
            which = order[:, min(p, hashes - 1)]
            code = np.zeros(n, np.int64)
            for h, (b, s) in enumerate(zip(best, second)):
                code = code * base + np.where(which == h, s, b)
            out[:, t, 1 + p] = code
    return out


def compare(ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, bucket: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links counted here of each vector, and the smallest id each reaches here.

    left, right: positions of the two sides; a pair counts once, in the first bucket that the two share.
    """
    cos = vectors[left] @ vectors[right].T
    i, j = np.nonzero(cos >= least)
    i, j = left[i], right[j]
    i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
    if len(left) == len(right) and (left == right).all():
        i, j = i[i < j], j[i < j]
    home_i, home_j = codes[i, table, 0], codes[j, table, 0]
    i_there = (codes[j, table] == home_i[:, None]).any(1)
    j_there = (codes[i, table] == home_j[:, None]).any(1)
    first = np.minimum(np.where(i_there, home_i, np.iinfo(np.int64).max), np.where(j_there, home_j, np.iinfo(np.int64).max))
    keep = first == bucket
    i, j = i[keep], j[keep]
    for t in range(table):
        before = (codes[i, t, :1] == codes[j, t]).any(1) | (codes[j, t, :1] == codes[i, t]).any(1)
        i, j = i[~before], j[~before]
    links = np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
    root = np.arange(len(ids))
    if len(i):
        label = ids.copy()
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == label).all():
                break
            label = new
        return links, label
    return links, ids[root]


def _prepare(double: bool):
    kind = np.float64 if double else np.float32

    def run(batches):
        for b in batches:
            dims, keys, raws = [], [], []
            for v in b.column(1).to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, kind)
                ok = x is not None and len(x) and np.isfinite(x).all() and np.any(x != 0)
                raw = (x + kind(0)).tobytes() if ok else None  # adding zero makes -0.0 and 0.0 equal
                dims.append(len(x) if ok else None)
                keys.append(hashlib.md5(raw).digest() if ok else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "key", "vec"])

    return run


def _unit(raws: list[bytes], double: bool) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64 if double else np.float32) for r in raws]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _code(signs: dict[int, np.ndarray], double: bool):
    """The buckets of each vector, for all tables."""

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            codes: list[bytes] = [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim).tolist()
                for s in range(0, len(mine), 1024):
                    part = mine[s : s + 1024]
                    found = buckets(_unit([b.column(3)[k].as_py() for k in part], double), signs[dim])
                    for k, c in zip(part, found):
                        codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], names=["id", "dim", "size", "vec", "codes"])

    return run


def _places(tables: int):
    """One row for each bucket of a vector, without the vector."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(n, tables, 1 + PROBES)
            new = np.ones(codes.shape, bool)  # a probe may give the same bucket again
            for p in range(1, 1 + PROBES):
                new[:, :, p] = (codes[:, :, p, None] != codes[:, :, :p]).all(2)
            i, t, p = np.nonzero(new)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(t.astype(np.int32)), pa.array(codes[i, t, p]), pa.array(p == 0)], names=["id", "dim", "t", "bucket", "home"])

    return run


def _blocks(double: bool, tables: int, least: float):
    def run(batches):
        for rows, (_, t, bucket, b1, b2) in whole_groups(batches, ("dim", "t", "bucket", "b1", "b2")):
            if rows.num_rows < 2:
                continue
            ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
            left = np.flatnonzero(own == b1)
            right = left if b1 == b2 else np.flatnonzero(own == b2)
            codes = np.stack([np.frombuffer(c, np.int64) for c in rows.column("codes").to_pylist()]).reshape(len(ids), tables, 1 + PROBES)
            if not len(left) or not len(right) or not (codes[:, t, 0] == bucket).any():
                continue
            links, label = compare(ids, _unit(rows.column("vec").to_pylist(), double), rows.column("size").to_numpy().astype(float), codes, left, right, int(t), int(bucket), least)
            hit = np.flatnonzero(links > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(label[hit])], names=["id", "links", "low"])

    return run


def default_hashes(n: int, dim: int) -> int:
    """Hashes in a table so that few vectors meet by chance; each more one multiplies the buckets by 2 dim."""
    return max(2, math.ceil(math.log(max(2, n * (1 + PROBES))) / math.log(2 * max(2, dim))))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a
    null id (component_id null, kept). Vectors link only with others of their dimension. Repeated rows are vectors
    of their own and link with each other. Other columns, labels among them, are ignored. An empty table gives an
    empty result. More rows need more hashes for a bucket, and these more tables: recall of a pair at 0.95 is measured
    in the tests for each setting.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    double = base.schema["v"].dataType.simpleString() != "array<float>"
    base = base.withColumn("v", F.col("v").cast("array<double>")) if double else base
    rows = staged(base.mapInArrow(_prepare(double), "vec_id long, dim int, key binary, vec binary"), "vector_rows")
    classes = staged(rows.filter("key is not null and vec_id is not null").groupBy("dim", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("vec").alias("vec")), "vector_classes")
    dims = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    k = hashes or max([2, *(default_hashes(n, d) for d, n in dims.items())])
    tables = tables or {1: 6, 2: 10, 3: 18}.get(k, 32)
    signs = {d: rotations(d, tables, k) for d in dims}

    if dims:
        coded = staged(classes.select("id", "dim", "size", "vec").mapInArrow(_code(signs, double), "id long, dim int, size long, vec binary, codes binary"), "vector_codes")
        places = staged(coded.select("id", "dim", "codes").mapInArrow(_places(tables), "id long, dim int, t int, bucket long, home boolean"), "vector_places")
        # Buckets where someone is at home and others meet them; only their members fetch their vectors.
        full = places.groupBy("dim", "t", "bucket").agg(F.count("*").alias("n"), F.max("home").alias("home")).filter("n > 1 and home")
        full = staged(full.select("dim", "t", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "vector_full")
        placed = places.join(full, ["dim", "t", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
        placed = placed.drop("dim").join(coded, "id")
        keys = ["dim", "t", "bucket", "b1", "b2"]
        found = placed.select(*keys, "own", "id", "size", "vec", "codes").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks(double, tables, least), "id long, links long, low long")
        found = staged(found, "vector_links")
    else:
        found = spark.createDataFrame([], "id long, links long, low long")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), "a", "b").withColumnRenamed("node", "id")
    by_class = classes.join(links, "id", "left").join(parts, "id", "left").select("dim", "key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id", "dim", "key").join(by_class, ["dim", "key"], "left")
    own = F.col("vec_id").isNull() | F.col("key").isNull()
    component = F.when(own, F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
