"""Search by cosine: a stated set of queries against all rows, and all similar pairs, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..plans.shared import staged

QUERY_BYTES = 64 << 20  # queries that go to the executors at once
PAIR_ROWS = 4096  # rows of a block when all rows meet all
CELLS = 1 << 22  # products held at once


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _vectors(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a vector of the dimension, without nulls in it."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    ids, flat = ids.filter(ok), vectors.filter(ok).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, dim))
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(x.shape).any(1)
        ids, x = ids.filter(pa.array(whole)), x[whole]
    names = ids.to_numpy(zero_copy_only=False)
    return (np.array(names.tolist(), str) if names.dtype == object else names), _unit(x)


def _first_k(q: np.ndarray, s: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties by id."""
    order = np.lexsort((names, -s, q))
    q, s, names = q[order], s[order], names[order]
    start = np.flatnonzero(np.diff(q, prepend=-1))
    nth = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
    return q[nth < k], s[nth < k], names[nth < k]


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "id", vector: str = "vector", least: float | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows of greatest cosine for each query; ties by id.

    Queries travel in blocks of bounded size, each with a pass over the rows, in which every task keeps its own
    best k; a window over those k times tasks rows for each query makes the final choice. Rows and queries without
    a vector, or of another dimension than the queries', are left out.
    """
    best = _passes(queries, rows, k, query_id, row_id, vector, least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def similar(queries: DataFrame, rows: DataFrame, least: float, query_id: str = "query_id", row_id: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, id, score: all rows whose cosine with a query is `least` or more. Tasks hand them on as they come."""
    return _passes(queries, rows, None, query_id, row_id, vector, least)


def _passes(queries: DataFrame, rows: DataFrame, k: int | None, query_id: str, row_id: str, vector: str, least: float | None) -> DataFrame:
    stated = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    shape = stated.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dim = shape["n"], shape["d"] or 0
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, id {rows.schema[row_id].dataType.simpleString()}, score double"
    passes = max(1, -(-n * dim * 8 // QUERY_BYTES))
    out = None
    for p in range(passes):
        block = stated if passes == 1 else stated.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)
        got = block.toArrow().combine_chunks()
        ids, unit = _vectors(*(pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], got.schema.field(c).type) for c in ("q", "v")), dim)
        shared = rows.sparkSession.sparkContext.broadcast((ids, unit))
        part = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_scan(shared, k, least), schema)
        if passes > 1:  # written, so that the executors can give up these queries before the next come
            part = staged(part, "search_pass")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _scan(shared, k: int | None, least: float | None):
    def run(batches):
        ids, unit = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, kind = 0, pa.null()

        def rows_of(q, s, names):
            return pa.RecordBatch.from_arrays([pa.array(ids[q].tolist()), pa.array(names.tolist(), kind), pa.array(s)], names=["query_id", "id", "score"])

        for b in batches:
            kind = b.schema.field(0).type
            names, x = _vectors(b.column(0), b.column(1), unit.shape[1])
            step = max(1, CELLS // max(1, len(names)))
            for at in range(0, len(ids) if len(names) else 0, step):
                cos = np.round(unit[at : at + step] @ x.T, 12)
                keep = np.ones(cos.shape, bool) if least is None else cos >= least
                if k is not None and k < cos.shape[1]:  # all that tie with the k-th stay until the final choice
                    keep &= cos >= np.partition(cos, -k, axis=1)[:, -k, None]
                q, j = np.nonzero(keep)
                if not len(q):
                    continue
                if k is None:
                    for i in range(0, len(q), 100_000):
                        yield rows_of(at + q[i : i + 100_000], cos[q[i : i + 100_000], j[i : i + 100_000]], names[j[i : i + 100_000]])
                    continue
                held.append((at + q, cos[q, j], names[j]))
                size += len(q)
            if size > 2 * (k or 0) * len(ids) + 1_000_000:
                held = [_first_k(*(np.concatenate(c) for c in zip(*held)), k)]
                size = len(held[0][0])
        if held:
            best = _first_k(*(np.concatenate(c) for c in zip(*held)), k)
            for i in range(0, len(best[0]), 100_000):
                yield rows_of(*(c[i : i + 100_000] for c in best))

    return run


def similar_pairs(rows: DataFrame, least: float, row_id: str = "id", vector: str = "vector", block_rows: int = PAIR_ROWS) -> DataFrame:
    """a, b, score: all pairs of rows (a < b) whose cosine is `least` or more.

    Rows are dealt into blocks by a hash of their id, and each pair of blocks is multiplied in a task of its own, which
    returns the similar pairs alone. Exact, so its arithmetic grows with the square of the rows: for large tables
    search inside blocks instead. Rows without a vector are left out; so are pairs of different dimensions.
    """
    known = rows.filter(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = max(1, -(-known.count() // block_rows))
    kind = known.schema["id"].dataType.simpleString()
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    placed = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("id", "v", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def multiply(key, group):
        found = []
        all_ids, all_v = group.column("id").combine_chunks(), group.column("v").combine_chunks()
        own, lengths = group.column("own").to_numpy(), pc.list_value_length(all_v).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            sides = [_vectors(all_ids.filter(m), all_v.filter(m), dim) for m in (pa.array((own == k.as_py()) & (lengths == dim)) for k in key)]
            (a, x), (b, y) = sides
            step = max(1, CELLS // max(1, len(b)))
            for s in range(0, len(a), step):
                cos = np.round(x[s : s + step] @ y.T, 12)
                i, j = np.nonzero(cos >= least)
                p, r, c = a[s + i], b[j], cos[i, j]
                use = p < r if key[0] == key[1] else p != r
                found.append((np.minimum(p, r)[use] if p.dtype.kind != "U" else np.where(p < r, p, r)[use], np.maximum(p, r)[use] if p.dtype.kind != "U" else np.where(p < r, r, p)[use], c[use]))
        a, b, c = (np.concatenate(z) for z in zip(*found)) if found else ([], [], [])
        id_type = group.schema.field("id").type
        return pa.table({"a": pa.array(list(a), id_type), "b": pa.array(list(b), id_type), "score": pa.array(c, pa.float64())})

    return placed.groupBy("x", "y").applyInArrow(multiply, f"a {kind}, b {kind}, score double")


def top_k_in_block(queries: DataFrame, rows: DataFrame, k: int, block: str | list[str], query_id: str = "query_id", row_id: str = "id", vector: str = "vector", least: float | None = None) -> DataFrame:
    """Like top_k among rows with the query's values in all columns of `block`: an equi-join, then the best k by query.

    A query's best come in two steps: among the rows of each hash bucket of ids, then among those, so no task sees all
    rows of a hot block.
    """
    names = [block] if isinstance(block, str) else list(block)
    as_key = lambda df: [F.col(c).alias(f"__b{i}") for i, c in enumerate(names)]
    keys = [f"__b{i}" for i in range(len(names))]
    q = queries.select(F.col(query_id).alias("query_id"), *as_key(queries), F.col(vector).alias("q_vector"))
    r = rows.select(F.col(row_id).alias("id"), *as_key(rows), F.col(vector).alias("r_vector"))
    score: Column = cosine(F.col("q_vector"), F.col("r_vector"))
    scored = q.join(r, keys).select("query_id", "id", score.alias("score")).filter(F.col("score").isNotNull())
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    rank = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc(F.round("score", 12)), "id"))
    near = scored.withColumn("__bucket", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", rank("__bucket")).filter(F.col("rank") <= k)
    return near.drop("__bucket", "rank").withColumn("rank", rank().cast("long")).filter(F.col("rank") <= k)
