"""Match groups over the cosine of vectors: the frontiers of all groups as bits, one for each row and group.

A join of each group's frontier with the edges makes a row for each path, and the paths outnumber the members by far.
Here a hop takes rows in blocks, computes the edges of a block and combines the bits of its neighbours, so what travels
between hops is a bit for each row and group. A last pass reads the score of each member off its best neighbour and hands
members on as they come; nothing is shuffled. Vectors and bits are written once, in pieces, and come to the tasks as rows of
a broadcast join, which stay in memory: a broadcast of Python's leaves a file with the driver and with each executor.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import drop_staged, staged
from .search import CELLS, _unit, _vectors, similar

VECTOR_BYTES = 512 << 20  # vectors that each task can hold; with more, groups go by joins
BIT_BYTES = 64 << 20  # bits of a hop that each task can hold; with more groups, several blocks of groups
PIECE = 1 << 18  # bytes of a row of a join, few enough to share a region of the heap
PIECES = range(4 * PIECE, 48 << 20)  # bytes of a value that go by a join; more go by a broadcast, as the driver's heap holds a join's rows more than once


@dataclass(frozen=True)
class VectorEdges:
    """Edges between all rows (id, vector) whose cosine is `least` or more; called, those of some ids."""

    rows: DataFrame
    least: float

    def __call__(self, ids: DataFrame) -> DataFrame:
        asked = self.rows.join(ids, "id").withColumnRenamed("id", "query_id")
        return similar(asked, self.rows, self.least).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")

    def held(self) -> tuple[pa.Array, np.ndarray] | None:
        """Ids and vectors; None if they are too many, of several dimensions, or ids are not unique."""
        known = self.rows.filter(F.col("vector").isNotNull())
        shape = known.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("d")).first()
        if not shape["n"] or shape["least"] != shape["d"] or shape["n"] * shape["d"] * 8 > VECTOR_BYTES:
            return None
        got = known.select("id", "vector").toArrow()
        ids, vectors = (pa.concat_arrays(got.column(c).chunks) for c in ("id", "vector"))
        if ids.null_count or pc.count_distinct(ids).as_py() < len(ids):
            return None
        whole = pa.array(_vectors(pa.array(np.arange(len(ids))), vectors, shape["d"])[0])
        x = vectors.take(whole).flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)
        return ids.take(whole), x if x.dtype == np.float32 else x.astype(np.float64)


def _neighbours(unit: np.ndarray, start: int, stop: int, among: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each row from start to stop with its neighbours among some rows, best first, and their cosines."""
    cos = unit[start:stop] @ (unit if len(among) == len(unit) else unit[among]).T
    for i, row in enumerate(cos):
        j = np.flatnonzero(row >= least - 1e-9)
        c = np.round(row[j], 12)
        ok = (c >= least) & (among[j] != start + i)
        order = np.argsort(-c[ok], kind="stable")
        yield start + i, among[j[ok][order]], c[ok][order]


def _first_hits(bits: np.ndarray, near: np.ndarray, cos: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups among the wanted bits that hold a neighbour, and the cosine of the best one in each."""
    score = np.empty(64 * len(wanted))
    found, left = np.zeros_like(wanted), wanted.copy()
    at, step = 0, 16
    while at < len(near) and left.any():
        hit = bits[near[at : at + step]] & left
        k = np.flatnonzero(hit != 0)
        if len(k):
            r, word = np.divmod(k, len(wanted))
            k, bit = np.divmod(np.flatnonzero(_unpacked(hit.ravel()[k])), 64)
            # The last of equal places stays: the best neighbour's.
            score[(word[k] * 64 + bit)[::-1]] = cos[at + r[k]][::-1]
            new = np.bitwise_or.reduce(hit, axis=0)
            found |= new
            left &= ~new
        at, step = at + step, min(4 * step, 1024)
    groups = np.flatnonzero(_unpacked(found))
    return groups, score[groups]


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _packed(hops: list[np.ndarray]) -> list[tuple[tuple[int, ...], bytes]]:
    """Bits as they travel, compressed: driver and executors each keep a copy."""
    return [(h.shape, pa.compress(np.ascontiguousarray(h), codec="zstd", asbytes=True)) for h in hops]


def _whole(packed: list[tuple[tuple[int, ...], bytes]]) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(data, 8 * shape[0] * shape[1], codec="zstd"), np.uint64).reshape(shape) for shape, data in packed]


class _Handed:
    """A value of about some bytes for all tasks, in pieces or as a broadcast of Python's."""

    def __init__(self, spark: SparkSession, value: tuple, size: int):
        self.pieces = self.broadcast = None
        if size not in PIECES:
            self.broadcast = spark.sparkContext.broadcast(value)
            return
        data = pickle.dumps(value, protocol=5)
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
        self.pieces = staged(spark.createDataFrame(pa.table({"piece": pa.array(range(len(pieces)), pa.int64()), "data": pa.array(pieces, pa.binary())})), "group_pieces")

    def destroy(self) -> None:
        if self.broadcast is not None:
            self.broadcast.destroy()
        else:
            drop_staged(self.pieces)


def _over(spark: SparkSession, blocks: int, handed: list[_Handed], run: Callable, schema: str) -> DataFrame:
    """The batches of run(values, blocks) over all blocks, of which each task takes a range."""
    tasks = min(blocks, 8 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, tasks, 1, tasks)
    pieces = [h.pieces.withColumn("value", F.lit(k)) for k, h in enumerate(handed) if h.pieces is not None]
    if pieces:
        rows = rows.crossJoin(F.broadcast(reduce(DataFrame.unionByName, pieces)))
    broadcasts = [h.broadcast for h in handed]

    def each(batches):
        mine, parts = set(), [{} for _ in broadcasts]
        for b in batches:
            mine.update(b.column(0).to_pylist())
            for piece, data, k in zip(*(c.to_pylist() for c in b.columns[1:])):
                parts[k][piece] = data
        if mine:
            values = []
            for shared, part in zip(broadcasts, parts):
                values.append(shared.value if shared is not None else pickle.loads(b"".join(part.pop(k) for k in sorted(part))))
            for task in sorted(mine):
                yield from run(values, range(task * blocks // tasks, (task + 1) * blocks // tasks))

    return rows.mapInArrow(each, schema)


def _seen(hops: list[np.ndarray], at: int, without_seed: bool) -> np.ndarray:
    """The bits of a row that hops before the next have reached."""
    out = np.zeros_like(hops[0][at])
    for bits in hops[1:] if without_seed and len(hops) > 1 else hops:
        out |= bits[at]
    return out


def walk(seeds: DataFrame, edges: VectorEdges, least: list[float], without_seed: bool = False) -> DataFrame | None:
    """group_id, id, score, hop_distance of the members that each seed (column id) reaches, itself left out.

    least: the least score of the edges of each hop. A member's hop is the first that reaches it, its score that of the
    best edge from a member of the hop before. without_seed: from the second hop on the seed counts as not seen, so that
    its edges are followed again. None if the vectors do not fit in a task.
    """
    held = edges.held()
    if held is None:
        return None
    ids, x = held
    spark, n = edges.rows.sparkSession, len(ids)
    names = pc.unique(pa.concat_arrays(seeds.select("id").toArrow().column(0).chunks or [pa.array([], ids.type)]))
    places = pc.index_in(names.cast(ids.type), value_set=ids)
    names, places = names.filter(places.is_valid()), places.drop_null().to_numpy()
    schema = f"group_id {seeds.schema['id'].dataType.simpleString()}, id {edges.rows.schema['id'].dataType.simpleString()}, score double, hop_distance int"
    if not len(places) or not least:
        return spark.createDataFrame([], schema)
    least = [max(x, edges.least) for x in least]
    rows = max(1, CELLS // n)
    blocks = -(-n // rows)
    vectors = _Handed(spark, (ids, x), ids.nbytes + x.nbytes)
    out = None
    step = max(64, BIT_BYTES * 8 // n // 64 * 64)
    for first in range(0, len(places), step):
        mine = places[first : first + step]
        hops: list[np.ndarray] = []
        for h in range(1, len(least)):
            shared = _handed_bits(spark, (mine,), hops)
            got = _over(spark, blocks, [vectors, shared], _spread(rows, least[h - 1], without_seed), "row long, bits binary").toArrow()
            shared.destroy()
            after = np.zeros((n, -(-len(mine) // 64)), np.uint64)
            if got.num_rows:
                after[got.column("row").to_numpy()] = np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint64).reshape(got.num_rows, -1)
            hops.append(after)
        shared = _handed_bits(spark, (names[first : first + step], mine), hops)
        members = _over(spark, blocks, [vectors, shared], _members(rows, least, without_seed), schema)
        out = members if out is None else out.unionByName(members)
    return out


def _handed_bits(spark: SparkSession, groups: tuple, hops: list[np.ndarray]) -> _Handed:
    packed = _packed(hops)
    return _Handed(spark, (*groups, packed), sum(len(data) for _, data in packed))


def _with_seeds(n: int, places: np.ndarray, packed: list[tuple[tuple[int, ...], bytes]]) -> list[np.ndarray]:
    """The bits of all hops, those of the seeds' own places first."""
    g = np.arange(len(places))
    bits = np.zeros((n, -(-len(places) // 64)), np.uint64)
    bits[places, g >> 6] |= np.uint64(1) << (g & 63).astype(np.uint64)
    return [bits, *_whole(packed)]


def _spread(rows: int, least: float, without_seed: bool):
    """The bits that the next hop reaches first, for the rows of some blocks."""

    def run(values, blocks):
        (_, x), shared_hops = values
        unit = _unit(x.astype(np.float64))
        hops = _with_seeds(len(unit), *shared_hops)
        last = hops[-1]
        among = np.flatnonzero(last.any(1))
        for block in blocks:
            at, bits = [], []
            for i, near, _ in _neighbours(unit, block * rows, min(len(unit), (block + 1) * rows), among, least):
                new = np.bitwise_or.reduce(last[near], axis=0) & ~_seen(hops, i, without_seed)
                if new.any():
                    at.append(i)
                    bits.append(new.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits, pa.binary())], names=["row", "bits"])

    return run


def _members(rows: int, least: list[float], without_seed: bool):
    """The members of all groups among the rows of some blocks."""

    def run(values, blocks):
        (ids, x), (names, *shared_hops) = values
        unit = _unit(x.astype(np.float64))
        hops = _with_seeds(len(unit), *shared_hops)
        some = [h.any(1) for h in hops]
        among = np.flatnonzero(np.any(some, axis=0))
        every = np.packbits(np.arange(64 * hops[0].shape[1]) < len(names), bitorder="little").view(np.uint64)
        for block in blocks:
            found = []
            for i, near, cos in _neighbours(unit, block * rows, min(len(unit), (block + 1) * rows), among, min(least)):
                for h, bits in enumerate(hops):
                    wanted = hops[h + 1][i] if h + 1 < len(hops) else every & ~_seen(hops, i, without_seed)
                    use = some[h][near] & (cos >= least[h])
                    group, score = _first_hits(bits, near[use], cos[use], wanted & ~hops[0][i])
                    order = np.argsort(score, kind="stable")  # few best neighbours serve many groups: equal scores in a row take little room
                    group, score = group[order], score[order]
                    found.append((group, np.full(len(group), i), score, np.full(len(group), h + 1, np.int32)))
            group, row, score, hop = (np.concatenate(x) for x in zip(*found))
            for s in range(0, len(group), 100_000):
                part = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(group[part])), ids.take(pa.array(row[part])), pa.array(score[part]), pa.array(hop[part])], names=["group_id", "id", "score", "hop_distance"])

    return run
