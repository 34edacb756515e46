"""Byte-level BPE with segment trees over the ranks of adjacent pairs.

The leaves of a tree hold rank * width + position of each adjacent pair, inner nodes the least of their leaves; so
the root is the leftmost merge of lowest rank. A merge changes three leaves, each updated along its path to the
root, until no pair can be merged. Short pieces are merged together, one tree for each row of a numpy matrix;
long pieces have a tree of their own.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

# Fixed value: the pattern that splits text into pieces before the merges (byte-level pre-tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTHS = (8, 16, 32, 64, 128, 256)
CACHE = 400_000
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE file in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip blanks or want whole words are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)


class ByteBPE:
    """encode() and decode() as the tokenizers library does, special tokens in the text included."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pieces = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.known: dict[str, bytes] = {}
        self.rank_of = dict(zip(vocabulary.keys.tolist(), vocabulary.ranks.tolist()))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.ranks[at], NONE)

    def _forest(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merges pieces of at most width bytes, one segment tree for each."""
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        sym = self.v.byte_ids[raw]
        sym[np.arange(width) >= length[:, None]] = -1
        right = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        left = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int32)
        ranks = self._rank(sym[:, :-1], sym[:, 1:])
        ranks[(np.arange(width - 1) + 1) >= length[:, None]] = NONE
        where = np.arange(width - 1, dtype=np.int32)
        tree[:, width : 2 * width - 1] = np.where(ranks == NONE, NONE, ranks * np.int32(width) + where)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        flat_tree, flat_sym, flat_right, flat_left = tree.ravel(), sym.ravel(), right.ravel(), left.ravel()
        wide, w32 = 2 * width, np.int32(width)

        def put(rows, pos, ok, value):
            """Point update: the leaves at pos, then the nodes above them."""
            rows, pos, value = rows[ok], pos[ok], value[ok]
            base = rows * wide
            node = pos.astype(np.int64) + width
            flat_tree[base + node] = value
            while width > 1:
                node >>= 1
                at = base + 2 * node
                flat_tree[base + node] = np.minimum(flat_tree[at], flat_tree[at + 1])
                if node.size == 0 or node[0] == 1:
                    break

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            root = flat_tree[rows * wide + 1]
            i = root % w32
            at = rows * width
            j = flat_right[at + i]
            after = flat_right[at + j]
            before = flat_left[at + i]
            new = self.v.merged[root // w32]
            flat_sym[at + i] = new
            flat_sym[at + j] = -1
            flat_right[at + i] = after
            has_after = (after < length[rows]) & (after < width)
            flat_left[(at + after)[has_after]] = i[has_after]
            has_before = before >= 0
            every = np.ones(len(rows), bool)
            put(rows, j, every, np.full(len(rows), NONE, np.int32))
            r = np.full(len(rows), NONE, np.int32)
            got = self._rank(new[has_after], flat_sym[(at + after)[has_after]])
            r[has_after] = np.where(got == NONE, NONE, got * w32 + i[has_after])
            put(rows, i, every, r)
            got = self._rank(flat_sym[(at + before)[has_before]], new[has_before])
            r = np.full(len(rows), NONE, np.int32)
            r[has_before] = np.where(got == NONE, NONE, got * w32 + before[has_before])
            put(rows, before, has_before, r)
            rows = rows[flat_tree[rows * wide + 1] != NONE]
        stay = sym >= 0
        packed = sym[stay].astype("<u4").tobytes()
        ends = np.cumsum(stay.sum(1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _tree(self, piece: bytes) -> bytes:
        """Merges one long piece."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        sym = self.v.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self._rank(sym[:-1], sym[1:]).astype(np.int64)
        heap = np.full(2 * width, none, np.int64)
        heap[width : width + n - 1] = np.where(first == NONE, none, first * width + np.arange(n - 1))
        level = width
        while level > 1:
            level //= 2
            heap[level : 2 * level] = np.minimum(heap[2 * level : 4 * level : 2], heap[2 * level + 1 : 4 * level : 2])
        # Views give Python's integers without holding them all.
        ids, after_, before_ = sym.astype(np.int64), np.arange(1, n + 1), np.arange(-1, n - 1)
        tree, sym, right, left = (memoryview(x) for x in (heap, ids, after_, before_))
        merged, rank_of = memoryview(self.v.merged), self.rank_of

        def put(pos: int, value: int) -> None:
            node = pos + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = right[i]
            sym[i], sym[j] = merged[rank], -1
            after, before = right[j], left[i]
            right[i] = after
            put(j, none)
            value = none
            if after < n:
                left[after] = i
                r = rank_of.get(sym[i] << 32 | sym[after])
                value = none if r is None else r * width + i
            put(i, value)
            if before >= 0:
                r = rank_of.get(sym[before] << 32 | sym[i])
                put(before, none if r is None else r * width + before)
        return ids[ids >= 0].astype("<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        raw = [p.encode("utf-8", "replace") for p in pieces]
        by_width: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            w = next((w for w in WIDTHS if len(b) <= w), 0)
            by_width.setdefault(w, []).append(k)
        for w, members in by_width.items():
            step = (1 << 20) // w if w else 1
            for s in range(0, len(members), step):
                part = members[s : s + step]
                out = self._forest([raw[k] for k in part], w) if w else [self._tree(raw[part[0]])]
                for k, ids in zip(part, out):
                    self.known[pieces[k]] = ids

    def encode_packed(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers. None counts as empty."""
        split: list[list] = []
        for t in texts:
            runs: list = []
            at = 0
            if t and self.marks:
                for m in self.marks.finditer(t):
                    runs += [self.pieces.findall(t[at : m.start()]), np.array([self.v.special[m[0]]], "<u4").tobytes()]
                    at = m.end()
            runs.append(self.pieces.findall(t[at:] if at else t or ""))
            split.append(runs)
        needed = set().union(*(r for runs in split for r in runs if isinstance(r, list)))
        missing = [p for p in needed if p not in self.known]
        if missing:
            if len(self.known) + len(missing) > CACHE:
                missing = list(needed)
            self._learn(missing)
        known = self.known
        return [b"".join(r if isinstance(r, bytes) else b"".join([known[p] for p in r]) for r in runs) for runs in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode_packed(self, packed: bytes) -> str:
        of = self.v.bytes_of
        return b"".join([of[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, "<u4").tobytes())


def encode_and_decode(df: DataFrame, vocabulary_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids (packed little-endian unsigned 32-bit integers) and decoded (the text of the ids).

    Whole texts; null and empty ones give no ids and an empty decoded text. Rows are independent: repeated rows
    get equal results, an empty table an empty one. Input columns named like the new ones give way to them.
    The file is read on the driver; its tables (a few MB, set by the vocabulary) go to the executors.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def make():
        bpe = ByteBPE(shared.value)

        def run(texts: list[str | None]) -> list[list]:
            ids = bpe.encode_packed(texts)
            return [[len(x) // 4 for x in ids], ids, [bpe.decode_packed(x) for x in ids]]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return map_text(df, text_col, fields, make, keep)
