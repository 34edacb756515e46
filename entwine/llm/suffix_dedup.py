"""Repeated byte strings by distributed prefix doubling over sampled suffixes.

Wanted are all strings of THRESHOLD bytes that start at two places at least. Spark sorts rows by rank, equal ones come
together, unique ones drop out, and the others are ranked anew by pairs: the rank so far and the name of the bytes
that follow at a growing offset (here on both sides), until the threshold is passed. A rank is a 64-bit name, the
same for equal strings wherever they stand.

Not every position takes part. Each string of THRESHOLD bytes has an anchor: the leftmost of its
GRAM-byte grams with the least hash. Equal strings have equal anchors at equal distances, so

round 0  ranks the grams at the anchors (145 bytes; about one position in 128),
round 1  ranks, for each 128 neighbouring distances to the anchor, the bytes common to their strings (273 bytes),
round 2  does so for each 16 distances (385 bytes),
round 3  ranks the single strings (400 bytes).

A row stands for the neighbouring strings of one anchor (`lo` to `hi`: their distances to it). Its core is what all
of them share, its hull what they cover together. A core that occurs once settles that none of the strings repeats;
equal hulls settle that all of them do; of cores with several hulls, one row for each goes to the next round. What
repeats inside a batch is settled there, and one row for each hull stands for it, so copies and periodic texts
shuffle little.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteHash, U64, encoded, mix, ship_package, slices, staged

THRESHOLD = 400
GRAM = 145
SPAN = THRESHOLD - GRAM + 1  # distances from a string's start to its anchor: 0 to SPAN - 1
STEPS = (SPAN, 128, 16, 1)  # how many distances share a core in each round; each divides the one before
PLACE = U64((1 << 31) - 1)
BLOCK = 1 << 20  # starts handled at once, to bound memory
SEEN = 1 << 20  # texts a task remembers
#: Rows without a key are settled: all strings from `anchor` on, `hi` bytes together, repeat.
ROW = "key long, hull long, k1 long, k2 long, anchor long, lo int, hi int"


def anchors(data: np.ndarray, hashes: ByteHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, least and greatest distance of each run of neighbouring strings with the same anchor."""
    n = len(data) - GRAM + 1
    at = np.arange(n)
    least = hashes.of(at, at + GRAM) & ~PLACE | at.astype(U64)
    step = 1
    while step < SPAN:  # SPAN is a power of two
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    place = (least & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    a = place[first]
    return a, a - last, a - first


def names(hashes: ByteHash, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, round_: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the cores and names of the hulls. Distances lo to hi lie in one slot of the round; rank: of the round before."""
    step = STEPS[round_]
    slot = lo // step
    start, end = a - slot * step, a - (slot + 1) * step + 1 + THRESHOLD
    if rank is None:
        core = hashes.of(start, end)
    else:  # the pair of the rank and of what the core adds to the one before, left and right of it
        wide = STEPS[round_ - 1]
        before = lo // wide
        core = mix(rank * U64(0x9FB21C651E98DF25) + hashes.of(start, a - before * wide)) * U64(0x9FB21C651E98DF25)
        core += hashes.of(a - (before + 1) * wide + 1 + THRESHOLD, end)
    start, end = a - hi, a - lo + THRESHOLD
    middle = start + THRESHOLD // 2
    pair = mix(hashes.of(start, middle) + U64(round_)) * U64(0x9FB21C651E98DF25) + hashes.of(middle, end)
    hull = mix(pair ^ mix((lo * 1024 + hi).astype(U64)))
    return mix(core + mix((slot * 4 + round_).astype(U64))), hull


def split(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts runs at the slots of a round; the last result tells which run each piece is of."""
    first, last = lo // step, hi // step
    n = last - first + 1
    row = np.repeat(np.arange(len(a)), n)
    slot = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a[row], np.maximum(lo[row], slot * step), np.minimum(hi[row], slot * step + step - 1), row


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(encoded(text), np.uint8)


def merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins overlapping or adjoining ranges of each owner (numbers from 0)."""
    shift = owner.astype(np.int64) << 32
    order = np.argsort(shift + start, kind="stable")
    s, e = (shift + start)[order], np.maximum.accumulate((shift + end)[order])
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    last = np.append(first[1:], len(s)) - 1
    own = s[first] >> 32
    return own, s[first] - (own << 32), e[last] - (own << 32)


def settle(key: np.ndarray, hull: np.ndarray, k1: np.ndarray, k2: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One row for each core and hull; those that occur twice here are settled, in ranges joined by text."""
    order = np.lexsort((hull, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (hull[order][1:] != hull[order][:-1])])
    group = np.cumsum(new) - 1
    again = order[np.bincount(group)[group] > 1]
    one = order[new]
    cols = [x[one] for x in (key.view(np.int64), hull.view(np.int64), k1, k2, a, lo, hi)]
    nulls = np.zeros(len(one), bool)
    if len(again):
        _, owner = np.unique(np.stack([k1[again], k2[again]]), axis=1, return_inverse=True)
        owner = owner.ravel()
        place = np.empty(owner.max() + 1, np.int64)
        place[owner] = again
        own, start, end = merge(owner, (a - hi)[again], (a - lo)[again] + THRESHOLD)
        zero = np.zeros(len(own), np.int64)
        cols = [np.concatenate(c) for c in zip(cols, (zero, zero, k1[place[own]], k2[place[own]], start, zero, end - start))]
        nulls = np.concatenate([nulls, np.ones(len(own), bool)])
    kinds = [np.int64] * 5 + [np.int32] * 2
    arrays = [pa.array(c.astype(k), mask=nulls if i == 0 else None) for i, (c, k) in enumerate(zip(cols, kinds))]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ROW.split(", ")])


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return settle(*[np.concatenate(c) for c in zip(*parts)])


def _whole(texts: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Texts that repeat from end to end."""
    k1, k2, n = (np.array(x, np.int64) for x in zip(*texts))
    zero = np.zeros(len(n), np.int64)
    cols = [pa.nulls(len(n), pa.int64()), zero, k1, k2, zero, zero.astype(np.int32), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in ROW.split(", ")])


def _first_round(batches):
    seen: set[tuple[int, int]] = set()
    for b in batches:
        parts, size, copies = [], 0, []
        for row in zip(*b.columns):
            k1, k2 = row[0].as_py(), row[1].as_py()
            if (k1, k2) in seen:
                copies.append((k1, k2, row[3].as_py()))
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add((k1, k2))
            data = _bytes(row[2].as_py())
            for s in range(0, len(data) - THRESHOLD + 1, BLOCK):
                piece = data[s : s + BLOCK + THRESHOLD - 1]
                hashes = ByteHash(piece)
                a, lo, hi = anchors(piece, hashes)
                key, hull = names(hashes, a, lo, hi, 0)
                parts.append((key, hull, np.full(len(a), k1), np.full(len(a), k2), a + s, lo, hi))
                size += len(a)
                if size > 50_000:
                    yield _batch(parts)
                    parts, size = [], 0
        if parts:
            yield _batch(parts)
        if copies:
            yield _whole(list(dict.fromkeys(copies)))


def _next_round(round_: int):
    def run(batches):
        for b in batches:
            parts, size = [], 0
            for row in zip(*b.columns):
                k1, k2, text, runs = row[0].as_py(), row[1].as_py(), row[2].as_py(), row[3].values
                data = _bytes(text)
                a, lo, hi = (runs.field(x).to_numpy().astype(np.int64) for x in ("anchor", "lo", "hi"))
                rank = runs.field("key").to_numpy().view(np.uint64)
                order = np.argsort(a, kind="stable")
                a, lo, hi, rank = a[order], lo[order], hi[order], rank[order]
                block = (a - hi) // BLOCK
                for k in np.unique(block).tolist():
                    mine = np.flatnonzero(block == k)
                    x, y, z, of = split(a[mine], lo[mine], hi[mine], STEPS[round_])
                    base = max(0, int((x - z).min() // BLOCK * BLOCK) - SPAN)
                    piece = data[base : (k + 1) * BLOCK + 2 * THRESHOLD + SPAN]
                    key, hull = names(ByteHash(piece), x - base, y, z, round_, rank[mine][of])
                    parts.append((key, hull, np.full(len(x), k1), np.full(len(x), k2), x, y, z))
                    size += len(x)
                    if size > 50_000:
                        yield _batch(parts)
                        parts, size = [], 0
            if parts:
                yield _batch(parts)

    return run


def _judge(rows: DataFrame, round_: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Ranges (k1, k2, start, end) that repeat, and rows for the next round: one for each hull of a core with several."""
    ranked = rows.filter("key is not null")
    shared = ranked.groupBy("key").agg(F.count("*").alias("n"), F.min("hull").alias("h_min"), F.max("hull").alias("h_max")).filter("n > 1").drop("n")
    shared = staged(shared, f"suffix_keys_{round_}")  # a table of its own, so that the join can split hot keys
    left = staged(ranked.join(shared, "key"), f"suffix_shared_{round_}")
    even = left.filter("h_min = h_max")
    uneven = left.filter("h_min < h_max")
    cols = ["key", "k1", "k2", "anchor", "lo", "hi"]
    hulls = staged(uneven.groupBy("key", "hull").agg(F.count("*").alias("n"), F.min(F.struct(*cols)).alias("one")), f"suffix_hulls_{round_}")
    done = even.select(*cols).unionByName(uneven.join(hulls.filter("n > 1").select("key", "hull"), ["key", "hull"], "left_semi").select(*cols))
    ranges = done.select("k1", "k2", (F.col("anchor") - F.col("hi")).alias("start"), (F.col("anchor") - F.col("lo") + THRESHOLD).alias("end"))
    settled = rows.filter("key is null").select("k1", "k2", F.col("anchor").alias("start"), (F.col("anchor") + F.col("hi")).alias("end"))
    return [ranges, settled], hulls.select("one.*") if round_ + 1 < len(STEPS) else None


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """k1, k2 (hashes of a text) and spans: starts and ends of byte ranges covered by repeated strings, unordered."""
    ship_package(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    keyed = docs.filter(F.octet_length(text) >= THRESHOLD).select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"), F.octet_length(text).alias("n"))
    rows = staged(keyed.mapInArrow(_first_round, ROW), "suffix_anchors")
    found, open_ = _judge(rows, 0)
    texts = None
    for round_ in range(1, len(STEPS)):
        of_text = staged(open_.groupBy("k1", "k2").agg(F.collect_set(F.struct("key", "anchor", "lo", "hi")).alias("runs")), f"suffix_open_{round_}")
        if texts is None:
            # Each text once: a hull that copies share stands in the next round for all of them. The keys of the
            # grouping differ from those of the join, so the join may split a hot text, and tasks reduce its copies first.
            wanted = keyed.join(of_text.select("k1", "k2"), ["k1", "k2"], "left_semi")
            once = wanted.groupBy(F.bitwise_not("k1").alias("n1"), F.bitwise_not("k2").alias("n2")).agg(F.first("text").alias("text"))
            texts = staged(once.select(F.bitwise_not("n1").alias("k1"), F.bitwise_not("n2").alias("k2"), "text"), "suffix_texts")
        rows = staged(texts.join(of_text, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_next_round(round_), ROW), f"suffix_rows_{round_}")
        more, open_ = _judge(rows, round_)
        found += more
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    return spans.groupBy("k1", "k2", "start").agg(F.max("end").alias("end")).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(as_text: bool):
    def run(batches):
        names_ = ["n_removed", "n_spans", "kept", "kept_sha256"]
        for b in (part for batch in batches for part in slices(batch, column=-2)):
            n = b.num_columns
            removed, count, kept, sha = [], [], [], []
            for text, spans in zip(b.column(n - 2), b.column(n - 1)):
                raw = encoded(text.as_py())
                at, out, gone, runs = 0, [], 0, 0
                if spans.values is not None and len(spans.values):
                    start, end = (spans.values.field(x).to_numpy() for x in ("start", "end"))
                    _, start, end = merge(np.zeros(len(start), np.int64), start, end)
                    gone, runs = int((end - start).sum()), len(start)
                    for s, e in zip(start.tolist(), end.tolist()):
                        out.append(raw[at:s])
                        at = e
                out.append(raw[at:])
                rest = b"".join(out)
                removed.append(gone)
                count.append(runs)
                kept.append("".join(x.decode("utf-8", "ignore") for x in out) if as_text else rest)
                sha.append(hashlib.sha256(rest).hexdigest())
            cols = [pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n - 2)] + cols, names=b.schema.names[: n - 2] + names_)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the remaining bytes.

    as_text: kept is a string, without the characters that a cut has split.

    Every byte in a string of 400 bytes that starts anywhere else too goes. Null texts count as empty; texts under
    400 bytes lose nothing. Rows are documents of their own, so a row that occurs twice loses all it can. Null and
    repeated ids pass through. Very long texts are worked on in blocks. An empty table gives an empty result. Other
    input columns are ignored, whatever their names.
    """
    text = F.col(f"`{text_col}`")
    spans = staged(repeated_spans(docs, text_col), "suffix_spans")  # a table of its own, so that the join can split hot keys
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    joined = base.join(spans, ["k1", "k2"], "left").select("doc_id", "n_bytes", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut(as_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, kept_sha256 string")
