"""Circulant MinHash near-duplicates: two permutations, banding, exact Jaccard check.

The first permutation spreads the shingle ids over [0, 2**32); the second, applied after a circular shift of its
argument by k steps, gives coordinate k of the signature. Both are bijections of the 32-bit integers computed in
place, so no permutation is stored.

Texts with equal shingle sets make a class; all further work is on one representative of each. Documents that
share a band are compared with the smallest one of a bucket first; only where a bucket still holds
several components are its other pairs looked at, block by block. Counts of shingles in cells bound the size of an
intersection from above: members whose bounds all fall short are out. For the others exact intersections come from
products of incidence matrices, of which only the links between components leave the task. So a large group of copies
costs a few rows for each member, and no pair between components goes unchecked, whatever the size of a bucket.

Words are hashed by keyed BLAKE2b, and every link that counts is confirmed on the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, exact_shingles, map_text, mix, real_shingles, ship_package, staged, whole_groups
from .components import connected_components

BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
STEP = np.uint32(0x9E3779B1)
SHIFTS = (np.arange(COORDS, dtype=np.uint64) * U64(int(STEP)) & U64(0xFFFFFFFF)).astype(np.uint32)[:, None]
LEAST_PERCENT = 75  # bands are made for it
BLOCK = 512  # members
BLOCK_SHINGLES = 1 << 21
COLUMNS = 8192


def first_permutation(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B)
    return x ^ x >> np.uint32(16)


def signature(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """All coordinates for a non-empty set of 64-bit shingle hashes."""
    x = first_permutation((shingles ^ shingles >> U64(32)).astype(np.uint32))
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), block):
        y = x[None, s : s + block] + SHIFTS  # circular shift modulo 2**32
        t = y >> np.uint32(16)
        y ^= t
        y *= np.uint32(0x85EBCA6B)
        np.right_shift(y, np.uint32(13), out=t)
        y ^= t
        y *= np.uint32(0xC2B2AE35)
        np.right_shift(y, np.uint32(16), out=t)
        y ^= t
        np.minimum(out, y.min(1), out=out)
    return out


def describe(text: str | None) -> tuple[int, int, int, list[int]]:
    """Set size, two hashes of the set, band hashes."""
    sh = exact_shingles(text)
    if not len(sh):
        return 0, 0, 0, []
    sig = signature(sh)
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    band = np.arange(BANDS, dtype=np.uint64) + U64(1)
    for r in range(ROWS):
        band = mix(band * U64(0x9FB21C651E98DF25) + rows[:, r])
    h1, h2 = mix(sh).sum(dtype=np.uint64), mix(sh ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    signed = np.array([h1, h2]).view(np.int64).tolist()
    return len(sh), signed[0], signed[1], band.view(np.int64).tolist()


FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def really_alike(a: str, b: str, percent: int) -> bool:
    """Whether the sets of shingles, not their hashes, reach the similarity."""
    x, y = real_shingles(a), real_shingles(b)
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. texts: id, text of the representatives."""
    ship_package(pairs.sparkSession)

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            keep_a, keep_b = [], []
            for row in zip(*batch.columns):  # one pair of texts at a time
                a, b, ta, tb = (x.as_py() for x in row)
                if b not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[b] = exact_shingles(tb)
                x, y = exact_shingles(ta), seen[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common) and really_alike(ta, tb, percent):
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _best(star: DataFrame) -> DataFrame:
    """For each a the b with most bands in common, the smaller one of equals."""
    return star.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right sets."""
    out = np.zeros((len(left), len(right)), np.float32)
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shingle, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set alone counts nowhere
    place = np.cumsum(shared) - 1
    keep = shared[column]
    member, column = member[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[member[a:b], column[a:b] - c] = 1
        out += x[left] @ x[right].T
    return out


def cells(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each cell of their hashes' lowest bits; about four a cell."""
    n = 1 << max(4, (len(shingles) // 4).bit_length())
    return np.minimum(np.bincount((shingles & U64(n - 1)).astype(np.int64), minlength=n), 65535).astype(np.uint16)


def fold_cells(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) == n else x.reshape(-1, n).sum(0, dtype=np.int64)


def may_link(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, component: np.ndarray, percent: int) -> np.ndarray:
    """Which of the members have one in another component on the other side that they may be similar to, by cells."""
    out = np.zeros(len(sets), bool)
    width = np.array([len(x) for x in sets])
    full = np.array([(x == 65535).any() for x in sets])  # a count that is too large for its cell tells nothing
    for i in left.tolist():
        a, b = np.minimum(sizes[i], sizes[right]), np.maximum(sizes[i], sizes[right])
        open_ = right[(component[right] != component[i]) & (100 * a >= percent * b)]
        for n in np.unique(np.minimum(width[open_], width[i])).tolist():
            mine = open_[np.minimum(width[open_], width[i]) == n]
            own = fold_cells(sets[i], n)
            for s in range(0, len(mine), max(1, (1 << 20) // n)):
                part = mine[s : s + max(1, (1 << 20) // n)]
                most = np.minimum(np.stack([fold_cells(sets[j], n) for j in part.tolist()]), own).sum(1, dtype=np.int64)
                hit = part[full[i] | full[part] | (100 * most >= percent * (sizes[i] + sizes[part] - most))]
                out[hit] = True
                out[i] |= bool(len(hit))
    return out


def _bound(percent: int):
    """Rows of members that may be similar to one of another component in their bucket."""

    def run(batches):
        for rows, (key, b1, b2) in whole_groups(batches, ("key", "b1", "b2")):
            own, component = rows.column("own").to_numpy(), rows.column("component").to_numpy()
            left = np.flatnonzero(own == b1)
            right = left if b1 == b2 else np.flatnonzero(own == b2)
            if not len(left) or not len(right) or component.min() == component.max():
                continue
            sets = [np.frombuffer(x, np.uint16) for x in rows.column("cells").to_pylist()]
            hit = may_link(sets, rows.column("n_shingles").to_numpy(), left, right, component, percent)
            if hit.any():
                ids = rows.column("id").to_numpy()[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids)], names=["key", "id"])

    return run


def _in_blocks(members: DataFrame, carried: DataFrame) -> DataFrame:
    """Rows of key, id and so on with what `carried` has for the id, once for each pair of blocks of the bucket."""
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("all_shingles") / BLOCK_SHINGLES), F.col("n")))
    placed = members.withColumn("parts", parts.cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("parts", "other", "n", "all_shingles")
    keys = ["key", "b1", "b2"]
    return placed.join(carried, "id").repartition(*keys).sortWithinPartitions(*keys)


def _cross(percent: int):
    """Links between components in blocks of buckets: as many as it takes to join those that belong together."""

    def run(batches):
        keep_a, keep_b = [], []
        for rows, (_, b1, b2) in whole_groups(batches, ("key", "b1", "b2")):
            own, component = rows.column("own").to_numpy(), rows.column("component").to_numpy()
            left = np.flatnonzero(own == b1)
            right = left if b1 == b2 else np.flatnonzero(own == b2)
            if not len(left) or not len(right) or component.min() == component.max():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets], np.float64)
            common = intersections(sets, left, right).astype(np.float64)
            i, j = np.nonzero((100 * common >= percent * (n[left][:, None] + n[right] - common)) & (component[left][:, None] != component[right]))
            ids = rows.column("id").to_numpy()
            names, place = np.unique(component, return_inverse=True)
            low = np.arange(len(names))
            for a, b in zip(left[i].tolist(), right[j].tolist()):  # links that join what was apart, a forest of them
                x, y = _root(low, place[a]), _root(low, place[b])
                if x != y:
                    low[max(x, y)] = min(x, y)
                    keep_a.append(ids[a])
                    keep_b.append(ids[b])
            if keep_a:
                yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])
                keep_a, keep_b = [], []

    return run


def _root(low: np.ndarray, x: int) -> int:
    while low[x] != x:
        low[x] = low[low[x]]
        x = low[x]
    return x


def _of_texts(texts: DataFrame, members: DataFrame, name: str, make) -> DataFrame:
    wanted = texts.join(members.select("id").distinct(), "id", "left_semi")
    out = map_text(wanted, "text", [T.StructField(name, T.BinaryType())], lambda: lambda texts: [[make(exact_shingles(t)).tobytes() for t in texts]], keep=["id"])
    return staged(out, f"minhash_{name}")


def _cross_links(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """mixed: key, n (members of the bucket), all_shingles (of all of them), id, component, n_shingles."""
    blocks = _in_blocks(mixed, _of_texts(texts, mixed, "cells", cells))
    near = staged(blocks.mapInArrow(_bound(percent), "key long, id long").distinct(), "minhash_near")
    rest = staged(mixed.join(near, ["key", "id"], "left_semi"), "minhash_rest")
    blocks = _in_blocks(rest, _of_texts(texts, rest, "shingles", lambda x: x))
    return blocks.mapInArrow(_cross(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for each row.

    Null and empty texts and texts without words have an empty set and link with nothing. Rows with a null id link
    with nothing either: their component_id is null and they are kept. Repeated rows share a class; rows that share an id but not
    a text count as one document, linked where any of its texts is. class_id is the smallest id with the same set
    (null for empty sets). Other input columns are ignored. Very long texts are read in pieces; percent below 75 is
    refused, as bands are made for 75 and more.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} at least")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sig = staged(map_text(base, "text", FIELDS, lambda: lambda texts: [list(c) for c in zip(*map(describe, texts))], keep=["doc_id"]), "minhash_sig")
    full = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "minhash_classes")

    spread = classes.select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = staged(spread.groupBy("key").agg(F.min("id").alias("lead"), F.min_by("n_shingles", "id").alias("lead_n"), F.count("*").alias("size")).filter("size > 1"), "minhash_buckets")
    fits = lambda x, y: (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))
    # Rows of shared buckets, once: they are few, and all further steps start from them.
    shared = staged(spread.join(buckets, "key"), "minhash_shared")
    star = shared.filter((F.col("id") != F.col("lead")) & fits(F.col("n_shingles"), F.col("lead_n")))
    star = staged(star.groupBy(F.col("id").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("bands")), "minhash_star")
    # Texts of all members of shared buckets, once: the checks below shuffle these alone, not the whole corpus.
    # A merge join whatever the size: the plan stays the same when the members outgrow a broadcast. Rows that repeat an
    # id and a text go to one by a key of its own, so that the join may split a hot id and tasks reduce copies first.
    members = shared.select(F.col("id").alias("doc_id")).distinct()
    texts = base.join(members.hint("merge"), "doc_id", "left_semi").groupBy(F.bitwise_not("doc_id").alias("other"), F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = staged(texts.select(F.bitwise_not("other").alias("id"), "text"), "minhash_texts")
    # Each member meets the leader that it shares most bands with; then, if still apart, the next such leader.
    links = staged(_verify(_best(star), texts, percent), "minhash_links")
    label = staged(connected_components(links, "a", "b"), "minhash_label")
    apart = star.join(_best(star), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        own = label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        apart = apart.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    second = staged(_verify(_best(apart.filter("of_a <> of_b")), texts, percent), "minhash_links")
    links = links.unionByName(second)

    # Buckets that still hold several components: all their pairs between components.
    label = staged(connected_components(links, "a", "b"), "minhash_label")
    member = classes.join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    placed = staged(shared.select("id", "key").join(member, "id"), "minhash_placed")
    who = (F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(20,0)")).alias("y"))
    of_key = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("all_shingles"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), *who)
    # Two members whose sizes don't fit need no look at their sets; of buckets with the same members one is enough.
    of_key = of_key.filter("lo < hi").filter((F.col("n") > 2) | fits(F.col("least"), F.col("most")))
    of_key = of_key.groupBy("n", "x", "y", "all_shingles").agg(F.min("key").alias("key"))
    of_key = staged(of_key.select("key", "n", "all_shingles"), "minhash_mixed_keys")
    mixed = staged(placed.join(of_key, "key").select("key", "n", "all_shingles", "id", "component", "n_shingles"), "minhash_mixed")
    across = staged(_cross_links(mixed, texts, percent).distinct(), "minhash_across")
    links2 = links.unionByName(_verify(across, texts, percent))
    final = staged(connected_components(links2, "a", "b"), "minhash_components")

    by_class = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select("n_shingles", "h1", "h2", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(by_class, ["n_shingles", "h1", "h2"], "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(own, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.when(~own, F.col("class_id")).alias("class_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The documents without near-duplicates of a smaller id, with their columns; one row for each id.

    Of rows that repeat an id, the one with the least text stays (null first; then the least hash of the row). Rows
    with a null id all stay.
    """
    found = staged(near_duplicates(docs, id_col, text_col, percent).select(F.col("doc_id").alias(id_col), "kept"), "minhash_kept")
    per_id = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    # As above, a merge join whatever the size.
    out = docs.join(per_id.filter("not kept or n > 1").select(id_col).hint("merge"), id_col, "left_anti").select(*docs.columns)
    again = staged(per_id.filter("kept and n > 1").select(id_col), "minhash_again")
    if again.isEmpty():
        return out
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.join(again, id_col, "left_semi").select(*docs.columns)
    one = rows.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(f"`{text_col}`").isNotNull(), F.col(f"`{text_col}`"), F.xxhash64(*plain))).alias("__row"))
    return out.unionByName(one.select("__row.*"))
