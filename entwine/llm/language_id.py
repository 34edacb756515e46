"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its letter n-grams (2 to 4 bytes of the lower-cased text, with word
borders), hashed into buckets. The model is fitted on a bounded sample; each prediction reads the whole text.
Probabilities are calibrated by a temperature on validation rows; texts whose probability is below a quantile
of the validation rows' are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

BITS = 12
BUCKETS = 1 << BITS
GRAMS = (2, 3, 4)
PAD = max(GRAMS) - 1
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[128:] = True


def has_letters(text: str | None) -> bool:
    return bool(text) and _letter.search(text) is not None


def gram_codes(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram at each byte, one array for each n, and where each text begins (one end more).

    Grams that begin in the last PAD places of a text reach into the next one and are not to be used.
    """
    parts = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " * PAD for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    b = np.frombuffer(b"".join(parts), np.uint8)
    b = np.where(_IS_LETTER[b], b, np.uint8(32)).astype(np.uint32)
    two = np.append(b[1:], np.uint32(32)) << np.uint32(8) | b
    code = {2: two}
    code[3] = np.append(b[2:], [np.uint32(32)] * 2).astype(np.uint32) << np.uint32(16) | two
    code[4] = np.append(b[3:], [np.uint32(32)] * 3).astype(np.uint32) << np.uint32(24) | code[3]
    out = [((code[n] ^ np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.intp) for n in GRAMS]
    return out, starts


def histogram(text: str | None) -> bytes:
    """The buckets that occur and their shares, zeros left out."""
    codes, _ = gram_codes([text])
    counts = sum(np.bincount(c[:-PAD], minlength=BUCKETS) for c in codes)
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + (counts[at] / counts.sum()).astype("<f4").tobytes()


def shares(rows: list[bytes]) -> np.ndarray:
    """Histograms as one dense matrix."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for row, h in zip(out, rows):
        n = len(h) // 6
        row[np.frombuffer(h, "<u2", n)] = np.frombuffer(h, "<f4", n, 2 * n)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray = field(repr=False)  # buckets x languages: embeddings times output weights
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # smallest probability that is accepted

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        codes, starts = gram_codes(texts)
        own = np.stack([starts[:-1], starts[1:] - PAD], 1).ravel()
        sums = sum(np.add.reduceat(self.scores[c], own, axis=0)[::2] for c in codes)
        z = (sums / (len(GRAMS) * (np.diff(starts) - PAD))[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, top = p.argmax(1), p.max(1)
        ok = [has_letters(t) for t in texts]
        return (
            [self.langs[k] if o else UNKNOWN for k, o in zip(best, ok)],
            [round(float(s), 6) if o else 0.0 for s, o in zip(top, ok)],
            [bool(o and s >= self.least) for s, o in zip(top, ok)],
        )


def train(x: np.ndarray, labels: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 30, rate: float = 20.0, batch: int = 32, reject: float = 0.001, floor: float = 0.5, seed: int = 13) -> LanguageModel:
    """SGD on 80 % of the rows; temperature and rejection threshold from the other 20 %. x: shares of the buckets, a row a text."""
    rng = np.random.RandomState(seed)
    order = rng.permutation(len(x))
    cut = max(1, len(x) - len(x) // 5)
    fit, val = order[:cut], order[cut:] if cut < len(x) else order
    k = len(langs)
    e = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, k)).astype(np.float32)
    c = np.zeros(k, np.float32)
    share = np.bincount(labels, minlength=k) / max(1, len(labels))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.05
        rng.shuffle(fit)
        for s in range(0, len(fit), batch):
            rows = fit[s : s + batch]
            h = x[rows] @ e
            z = h @ w + c
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            g = (p / (len(rows) * np.maximum(share[labels[rows]] * k, 0.2))[:, None]).astype(np.float32)
            back = g @ w.T
            w -= 0.1 * step * h.T @ g
            c -= 0.01 * step * g.sum(0)
            e -= step * x[rows].T @ back
    model = LanguageModel(langs, (e @ w).astype(np.float32), c)
    z = x[val] @ model.scores + c
    grid = np.geomspace(0.05, 5, 60)

    def prob(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    model.temperature = float(min(grid, key=lambda t: -np.log(prob(t)[np.arange(len(val)), labels[val]] + 1e-9).mean()))
    model.least = float(min(floor, np.quantile(prob(model.temperature).max(1), reject)))
    return model


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = 4000, **options) -> LanguageModel:
    """Fits on at most about sample_rows rows, as many of each language, chosen by a hash of the key.

    Rows with a null text or language are not used. Without usable rows the model predicts `und`.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    langs = sorted(counts)
    each = max(1, sample_rows // len(langs))
    where = None
    for name in langs:
        limit = min(1.0, each / counts[name]) * 2**31
        test = (F.col("l") == name) & (F.pmod(F.xxhash64("k", F.lit(8)), F.lit(2**31)) < F.lit(int(limit)))
        where = test if where is None else where | test
    got = map_text(known.filter(where), "t", [T.StructField("h", T.BinaryType())], lambda: lambda texts: [[histogram(t) for t in texts]], keep=["l", "k"]).collect()
    if not got:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    got.sort(key=lambda r: (r["l"], str(r["k"]), r["h"]))
    labels, x = np.array([langs.index(r["l"]) for r in got]), shares([r["h"] for r in got])
    del got  # the driver holds the sample once
    return train(x, labels, langs, **options)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (calibrated, 0 to 1) and accepted.

    A text that is null, empty or without letters gets `und`, score 0 and is not accepted. Rows are independent:
    repeated rows get equal results, an empty table an empty one. A column of the input named like a new one
    gives way to it; others pass (or those in keep).
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return map_text(docs, text_col, fields, lambda: lambda texts: list(model.predict(texts)), keep)
