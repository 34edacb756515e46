"""Benchmark decontamination: SimHash of item-sized word windows, multi-index Hamming lookup, exact check.

Every window with as many words as an item gets a 128-bit SimHash of its words. Fingerprints are cut into BLOCKS
blocks. Two within RADIUS bits differ by at most NEAR bits in one block at least; items are stored in every block under
all values so near to their own, so one lookup for each block of a window finds all of them.
Candidates are confirmed by the weighted Jaccard similarity of their five-word shingles, weights being counts.

A window can only reach the required similarity if it holds a shingle of the item. Windows without any are not
fingerprinted: this loses nothing, and leaves few windows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_words, map_text, mix, pieces, shingle_hashes

U64 = np.uint64
BITS = 128
NEAR = 2
EDGES = np.linspace(0, BITS, 13).round().astype(int)  # of the blocks of 10 or 11 bits
BLOCKS = len(EDGES) - 1
RADIUS = BLOCKS * (NEAR + 1) - 1  # 35: else every block would differ by NEAR + 1 bits
SHINGLE = 5
_NOT_WORD = bytes(c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123))
_TO_SPACES = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()), T.StructField("word_start", T.LongType()), T.StructField("n_words", T.IntegerType())]))


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters and digits of the lower-cased text), and where each text's begin."""
    found = [[hash_words(p.split()) for p in pieces((t or "").lower().encode("utf-8", "replace").translate(_TO_SPACES))] for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([sum(map(len, f)) for f in found], out=first[1:])
    flat = [w for f in found for w in f]
    return np.concatenate(flat) if flat else np.empty(0, U64), first


def bit_votes(words: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a word's 128-bit hash, one row for each word."""
    two = np.stack([mix(words + U64(1)), mix(words ^ U64(0x5851F42D4C957F2D))], 1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of each window words[s : s + length], as 16 bytes."""
    sums = np.zeros((len(words) + 1, BITS), np.int32)
    np.cumsum(bit_votes(words), axis=0, out=sums[1:])
    return np.packbits(sums[starts + length] - sums[starts] > 0, axis=1)


class MultiIndex:
    """Finds all stored fingerprints within RADIUS bits of given ones: one sorted list of items for each block's value."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.first, self.items = [], []
        for width, value in zip(np.diff(EDGES).tolist(), self.blocks(prints)):
            near = np.array([x for x in range(1 << width) if x.bit_count() <= NEAR])
            codes = (value[:, None] ^ near).ravel()
            order = np.argsort(codes, kind="stable")
            self.items.append((order // len(near)).astype(np.int32))
            self.first.append(np.searchsorted(codes[order], np.arange((1 << width) + 1)).astype(np.int32))

    @staticmethod
    def blocks(prints: np.ndarray) -> list[np.ndarray]:
        """The value of each block."""
        bits = np.unpackbits(prints, axis=1).astype(np.int32)
        return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int32)) for a, b in zip(EDGES, EDGES[1:])]

    def near(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """Place of the given print, place of the stored one, distance."""
        pairs = []
        for first, items, value in zip(self.first, self.items, self.blocks(prints)):
            a, n = first[value], first[value + 1] - first[value]
            q = np.repeat(np.arange(len(prints)), n)
            pairs.append(q * len(self.prints) + items[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        q, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.prints))
        dist = np.bitwise_count(self.prints[i] ^ prints[q]).sum(1)
        hit = dist <= RADIUS
        return list(zip(q[hit].tolist(), i[hit].tolist(), dist[hit].tolist()))


class ItemIndex:
    """Items by length in words: shingles, fingerprints and their multi-index."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.of_length: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        by_shingle: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words, _ = split_words([text])
            n = len(words)
            if not n:
                continue
            shingles = shingle_hashes(words, SHINGLE).tolist()
            self.of_length[n].append((item_id, Counter(shingles)))
            prints[n].append(fingerprints(words, np.array([0]), n)[0])
            for s in shingles:
                by_shingle[min(n, SHINGLE)][s].add(n)
        self.index = {n: MultiIndex(np.stack(p)) for n, p in prints.items()}
        self.shingles = {size: _Lookup(known) for size, known in by_shingle.items()}

    def match(self, texts: list[str | None]) -> list[list[dict]]:
        """Shorter items than SHINGLE words have one shingle of all of them; so do windows as long as they."""
        out: list[list[dict]] = [[] for _ in texts]
        words, first = split_words(texts)
        for size, lookup in self.shingles.items():
            if len(words) < size:
                continue
            sh = shingle_hashes(words, size)
            at, lengths = lookup.find(sh)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[doc + 1]
            at, lengths, doc = at[inside], lengths[inside], doc[inside]
            for d, a, b in zip(*_runs(doc)):
                lo, hi = int(first[d]), int(first[d + 1])
                out[d] += self._match_one(words[lo:hi], sh[lo:hi], size, (at[a:b] - lo).tolist(), [lookup.lengths[k] for k in lengths[a:b].tolist()])
        return [sorted(m, key=lambda x: x["item_id"]) for m in out]

    def _match_one(self, words: np.ndarray, sh: np.ndarray, shingle: int, at: list[int], lengths: list[list[int]]) -> list[dict]:
        anchors: dict[int, set[int]] = defaultdict(set)
        for p, ns in zip(at, lengths):
            for n in ns:
                anchors[n].add(p)
        best: dict[int, tuple] = {}
        for n, places in anchors.items():
            size = min(n, len(words))
            p = np.array(sorted(places))
            for s in range(0, len(p), 512):  # so many anchors at once, to bound memory
                starts = np.unique((p[s : s + 512, None] - np.arange(size - shingle + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(words) - size)]
                for s2 in range(0, len(starts), 4096):
                    self._judge(words, sh, shingle, n, size, starts[s2 : s2 + 4096], best)
        return [{"item_id": i, "similarity": -b[0], "distance": b[2], "word_start": b[1], "n_words": b[3]} for i, b in best.items()]

    def _judge(self, words: np.ndarray, sh: np.ndarray, shingle: int, n: int, size: int, starts: np.ndarray, best: dict[int, tuple]) -> None:
        if not len(starts):
            return
        for q, i, dist in self.index[n].near(_prints_at(words, starts, size)):
            item_id, bag = self.of_length[n][i]
            start = int(starts[q])
            window = Counter(sh[start : start + size - shingle + 1].tolist())
            common = sum(min(c, bag[x]) for x, c in window.items() if x in bag)
            similarity = common / (sum(window.values()) + sum(bag.values()) - common)
            if similarity >= self.threshold and (item_id not in best or (-similarity, start) < best[item_id][:2]):
                best[item_id] = (-similarity, start, dist, size)


class _Lookup:
    """Which lengths of items hold a shingle."""

    def __init__(self, known: dict[int, set[int]]):
        self.keys = np.array(sorted(known), U64)
        self.lengths = [sorted(known[k]) for k in self.keys.tolist()]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.keys & U64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bitmap[(sh & U64((1 << 20) - 1)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, sh[at]), len(self.keys) - 1)
        hit = self.keys[key] == sh[at]
        return at[hit], key[hit]


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values of the runs of equal numbers, their starts and ends."""
    start = np.flatnonzero(np.diff(x, prepend=-1))
    return x[start].tolist(), start.tolist(), [*start[1:].tolist(), len(x)]


def _prints_at(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of some windows; runs of neighbouring windows share their running sums."""
    out = np.empty((len(starts), BITS // 8), np.uint8)
    for run in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) > size) + 1):
        if len(run):
            a, b = int(starts[run[0]]), int(starts[run[-1]]) + size
            out[run] = fingerprints(words[a:b], starts[run] - a, size)
    return out


def match_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.75, items_a_pass: int = 5_000, keep: list[str] | None = None) -> DataFrame:
    """Adds `matches` to each document: items of which a window reaches the similarity, best window of each.

    Items are the stated query set: at most items_a_pass of them go to the executors at once, with a pass over the
    documents for each such block. Items with a null id or text, or without words, match nothing; those of fewer than
    five words match where all their words stand in a row; equal items are all reported. A document shorter than an
    item is one window. Null and empty texts match nothing. Rows are independent: repeated rows get equal matches; of
    windows of an item that tie, the first counts. Very long texts are read in pieces.
    A column named `matches` gives way to the new one.
    """
    out, cols = _with_matches(docs, items, text_col, item_id, item_text, threshold, items_a_pass, keep)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "matches"]
    return out.select(*[F.col(f"`{c}`") for c in keep], (F.concat(*cols) if len(cols) > 1 else F.col(cols[0])).alias("matches"))


def _with_matches(docs, items, text_col, item_id, item_text, threshold, items_a_pass, keep) -> tuple[DataFrame, list[str]]:
    """The documents with a column of matches for each block of items, and the names of those columns."""
    known = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    passes = max(1, -(-known.count() // items_a_pass))
    out, cols = docs, []
    for k in range(passes):
        block = known if passes == 1 else known.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        index = ItemIndex([(r["i"], r["t"]) for r in block.collect()], threshold)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        name = f"__matches_{k}"
        kept = keep if keep is None else [*dict.fromkeys([*keep, text_col])] + cols
        out = map_text(out, text_col, [T.StructField(name, MATCH)], lambda shared=shared: lambda texts: [shared.value.match(texts)], kept)
        cols.append(name)
    return out, cols


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.75, items_a_pass: int = 5_000) -> DataFrame:
    """The documents without a benchmark passage, with their columns; null and empty texts stay."""
    out, cols = _with_matches(docs, items, text_col, item_id, item_text, threshold, items_a_pass, None)
    for c in cols:
        out = out.filter(F.size(c) == 0)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
