"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms of a text are its hashed lower-cased words, the n-grams of its collapsed character classes (how letters,
capitals, digits, spaces and signs follow each other) and its immediate repetitions. Term weights use document
frequencies counted over all documents. A truncated SVD of a bounded labelled sample gives the latent space; the
sample's vectors are broadcast, and every document gets exact cosines with all of them, block by block. The
nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, mix, ship_package, slices, word_hashes

SHAPES, WORDS, EXTRA = 2048, 2048, 16
DIM = SHAPES + WORDS + EXTRA
U64 = np.uint64
_CLASS = np.minimum(np.arange(256) + 8, 255).astype(np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 11, 12, 13]] = 5
AT_ONCE = 1 << 20  # bytes or runs that are worked on at once


def class_runs(raw: bytes) -> np.ndarray:
    """The character classes of a text and a line end after it, runs collapsed."""
    out, last = [], 0
    for s in range(0, len(raw), AT_ONCE):
        cls = _CLASS[np.frombuffer(raw, np.uint8, min(AT_ONCE, len(raw) - s), s)]
        out.append(cls[np.diff(cls, prepend=np.uint8(last)) != 0])
        last = cls[-1]
    return np.concatenate([*out, np.array([5] * int(last != 5), np.uint8)])


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the terms, one row for each text; no term reaches from one text into another."""
    n = len(texts)
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    out = np.zeros(n * DIM, np.int64)
    runs = [class_runs(r) for r in raws]
    run, doc = np.concatenate(runs), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in runs])
    for s in range(0, len(run), AT_ONCE):
        r, d = run[s : s + AT_ONCE + 3].astype(U64), doc[s : s + AT_ONCE + 3]
        for size in (2, 3, 4):
            m = min(AT_ONCE, len(r) - size + 1)
            if m > 0:
                code = r[:m].copy()
                for k in range(1, size):
                    code = code * U64(512) + r[k : k + m]
                own = d[:m] == d[size - 1 : size - 1 + m]
                out += np.bincount(d[:m][own] * DIM + (mix(code[own] + U64(size)) % U64(SHAPES)).astype(np.int64), minlength=n * DIM)
    words = [word_hashes(r) for r in raws]
    h, counts = np.concatenate(words), np.array([len(w) for w in words])
    if len(h):
        wd = np.repeat(np.arange(n), counts)
        out += np.bincount(wd * DIM + SHAPES + (h % U64(WORDS)).astype(np.int64), minlength=n * DIM)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])
        reps = np.bincount(wd[same], minlength=n)
        level = np.minimum(EXTRA - 1, (EXTRA * reps) // np.maximum(counts, 1))
        out.reshape(n, DIM)[np.arange(n), SHAPES + WORDS + level] += np.where(level > 0, counts, 0)
    return out.reshape(n, DIM)


@dataclass
class QualityModel:
    weight: np.ndarray = field(repr=False)  # of each term
    basis: np.ndarray = field(repr=False)  # terms x latent dimensions
    vectors: np.ndarray = field(repr=False)  # of the labelled sample, unit length
    labels: np.ndarray = field(repr=False)
    class_weight: np.ndarray
    prior: float
    neighbours: int = 15
    power: float = 8.0

    def embed(self, counts: np.ndarray) -> np.ndarray:
        z = weighted(counts, self.weight) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None], block: int = 256) -> list[float]:
        if not len(self.labels):
            return [self.prior] * len(texts)
        out: list[float] = []
        for s in range(0, len(texts), block):
            cos = np.round(self.embed(term_counts(texts[s : s + block])) @ self.vectors.T, 9)
            k = min(self.neighbours, cos.shape[1])
            kth = np.partition(cos, -k, axis=1)[:, -k]
            doc, near = np.nonzero(cos >= kth[:, None])  # all that tie with the k-th vote too
            y = self.labels[near]
            vote = np.maximum(cos[doc, near], 0) ** self.power * self.class_weight[y]
            total, good = np.bincount(doc, vote, len(cos)), np.bincount(doc, vote * y, len(cos))
            out += np.where(total > 1e-9, good / np.maximum(total, 1e-9), self.prior).round(6).tolist()
        return out


def _packed(counts: np.ndarray) -> bytes:
    """The terms of one text and their counts, zeros left out."""
    at = np.flatnonzero(counts)
    return np.concatenate([at, counts.ravel()[at]]).astype(np.int64).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    at, n = np.frombuffer(raw, np.int64).reshape(2, -1)
    out = np.zeros(DIM, np.int64)
    out[at] = n
    return out


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies in each block of terms, times the terms' weights."""
    x = counts.astype(np.float64)
    for a, b, share in ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.15), (SHAPES + WORDS, DIM, 0.5)):
        total = counts[:, a:b].sum(1, keepdims=True)
        x[:, a:b] = np.sqrt(counts[:, a:b] / np.maximum(total, 1)) * share
    return x * weight


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, over all of them, and how many documents there are."""

    def run(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for part in slices(b, 1 << 20):
                texts = part.column(0).to_pylist()
                for s in range(0, len(texts), 256):
                    total += (term_counts(texts[s : s + 256]) > 0).sum(0)
                n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(total, n))], names=["term", "n"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(text_col)).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:DIM], int(out[DIM])


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", key_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 3000, rank: int = 32, seed: int = 5) -> QualityModel:
    """Fits on at most about sample_rows labelled rows, half of each class, chosen by a hash of the key.

    docs: all documents, for the term statistics. labels: key and label (0 or 1); null keys and labels are left
    out, of repeated keys the least label counts. Without labels every score is 0.5.
    """
    df, n = document_frequencies(docs, text_col)
    weight = np.log((n + 1) / (df + 1)) + 0.1
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("k")).agg(F.min(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    nothing = QualityModel(weight, np.zeros((DIM, 1)), np.zeros((0, 1)), np.zeros(0, int), np.ones(2), 0.5)
    if not counts:
        return nothing
    where = None
    for y, c in counts.items():
        limit = int(min(1.0, sample_rows / len(counts) / c) * 2**31)
        test = (F.col("y") == y) & (F.pmod(F.xxhash64("k", F.lit(77)), F.lit(2**31)) < F.lit(limit))
        where = test if where is None else where | test
    sample = known.filter(where)  # bounded by sample_rows, so it may be broadcast
    pairs = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample), "k")
    got = map_text(pairs, "t", [T.StructField("c", T.BinaryType())], lambda: lambda texts: [[_packed(term_counts([t])) for t in texts]], keep=["k", "y"]).collect()
    if not got:
        return nothing
    got.sort(key=lambda r: (r["k"], r["c"]))
    y = np.array([r["y"] for r in got])
    x = weighted(np.stack([_unpacked(r["c"]) for r in got]), weight)
    rng = np.random.RandomState(seed)
    q = x.T @ rng.normal(size=(len(x), min(rank + 8, len(x))))
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        q, _ = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = q @ vt[:rank].T
    total = sum(counts.values())
    class_weight = np.array([counts.get(c, 0) / total / max(1e-9, (y == c).mean()) for c in (0, 1)])
    model = QualityModel(weight, basis, np.zeros((0, 1)), y, class_weight, counts.get(1, 0) / total)
    z = x @ basis
    model.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier).

    Null, empty and all other texts are scored by their own terms alone (an empty text has none and gets the share of
    label 1), so repeated rows get equal scores and neighbours in a batch don't matter. Neighbours that tie with the
    last one vote too. Scores have six digits. Very long texts are read in pieces; counts have 64 bits. An empty table
    gives an empty result. An input column named score gives way to the new one.
    """
    return map_text(docs, text_col, [T.StructField("score", T.DoubleType())], lambda: lambda texts: [model.score(texts)], keep)
