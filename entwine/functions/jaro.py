"""Jaro similarity on bytes, for whole Arrow batches at once.

Pairs of a batch are laid out as byte matrices; the greedy matching runs over positions, for all pairs together.
A native expression of the same formula is in native_jaro(), for plans that must stay in the JVM; per pair it is
slower, as higher-order functions are interpreted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, SCALE = 4, 0.1


def _matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    wide = int(size.max(initial=0))
    out = np.zeros((len(rows), wide), np.uint8)
    out[np.arange(wide) < size[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    return out, size


def jaro_batch(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Jaro similarity of each pair; equal strings give 1, no common byte gives 0."""
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda k: max(len(a[k]), len(b[k])))
    at = 0
    while at < len(order):
        part, cells = [], 0
        while at < len(order) and (not part or cells + max(len(a[order[at]]), len(b[order[at]])) <= 2_000_000):
            cells += max(len(a[order[at]]), len(b[order[at]]))
            part.append(order[at])
            at += 1
        swap = [len(a[k]) > len(b[k]) for k in part]
        out[part] = _jaro([b[k] if x else a[k] for k, x in zip(part, swap)], [a[k] if x else b[k] for k, x in zip(part, swap)])
    return out


def _jaro(short: list[bytes], long: list[bytes]) -> np.ndarray:
    s, n_s = _matrix(short)
    t, n_t = _matrix(long)
    reach = np.maximum(0, n_t // 2 - 1)
    used, hit = np.zeros(t.shape, bool), np.zeros(s.shape, bool)
    place = np.arange(t.shape[1])
    rows = np.arange(len(s))
    free = place < n_t[:, None]
    for i in range(s.shape[1]):
        live = np.flatnonzero(n_s > i)
        lo = max(0, i - int(reach[live].max(initial=0)))
        hi = i + int(reach[live].max(initial=0)) + 1
        near = place[lo:hi]
        can = (t[live, lo:hi] == s[live, i : i + 1]) & free[live, lo:hi] & (np.abs(near - i) <= reach[live, None])
        if not can.size:
            continue
        got = can.any(1)
        who, where = live[got], can[got].argmax(1) + lo
        used[who, where] = True
        free[who, where] = False
        hit[who, i] = True
    m = hit.sum(1)
    pair = np.nonzero(hit)[0]
    swapped = np.bincount(pair, s[hit] != t[used], len(rows)) if len(pair) else np.zeros(len(rows))
    safe = np.maximum(m, 1)
    score = np.where(m > 0, (m / np.maximum(n_s, 1) + m / np.maximum(n_t, 1) + (m - swapped / 2) / safe) / 3, 0.0)
    equal = np.array([x == y for x, y in zip(short, long)], bool)
    return np.where(equal, 1.0, score)


def jaro_winkler_batch(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Adds a bonus for a common prefix of up to four bytes, at every score."""
    j = jaro_batch(a, b)
    p = np.array([next((k for k in range(min(PREFIX, len(x), len(y))) if x[k] != y[k]), min(PREFIX, len(x), len(y))) for x, y in zip(a, b)])
    empty = np.array([not x or not y for x, y in zip(a, b)], bool)
    both = np.array([not x and not y for x, y in zip(a, b)], bool)
    return np.where(both, 1.0, np.where(empty, 0.0, j + p * SCALE * (1 - j)))


def _bytes(s: pd.Series) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in s]


def jaro(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_batch(_bytes(x), _bytes(y)))

    return run(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_batch(_bytes(x), _bytes(y)))

    return run(a, b)


def jaro_winkler_of(a: Column, b: Column) -> Column:
    """A struct of the score and both values: what comes back is computed once, however often it is used."""

    @F.pandas_udf("score double, a string, b string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"score": jaro_winkler_batch(_bytes(x), _bytes(y)), "a": x, "b": y})

    return run(a, b)


def native_jaro(a: Column, b: Column) -> Column:
    """The same on characters, from builtin functions alone (equal for ASCII)."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    flip = F.length(a) > F.length(b)
    s, t = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b)
    reach = F.greatest(F.lit(0), F.floor(F.length(t) / 2).cast("int") - 1)
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("s"), none.alias("t"))

    def step(acc, i):
        span = F.sequence(F.greatest(F.lit(1), i - reach), F.greatest(F.lit(1), F.least(i + reach, F.length(t))))
        free = F.filter(span, lambda k: (F.substring(t, k, 1) == F.substring(s, i, 1)) & (k >= i - reach) & (k <= i + reach) & ~F.array_contains(acc["t"], k))
        return F.when(F.size(free) > 0, F.struct(F.array_append(acc["s"], i).alias("s"), F.array_append(acc["t"], free[0]).alias("t"))).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s))), start, step)
    m = F.size(found["s"]).cast("double")
    differ = F.zip_with(found["s"], F.array_sort(found["t"]), lambda i, j: F.substring(s, i, 1) != F.substring(t, j, 1))
    swapped = F.size(F.filter(differ, lambda d: d))
    score = (m / F.length(a) + m / F.length(b) + (m - swapped / F.lit(2.0)) / m) / 3
    return F.when(a == b, 1.0).when((F.length(s) == 0) | (m == 0), 0.0).otherwise(score)
