"""Helpers that the operators of this subpackage share: shared storage, Arrow batch maps, text hashing."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import drop_staged, shared_dir, ship_package, staged  # noqa: F401

U64 = np.uint64
# Text that map_text hands to a function at once.
MAP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, n: int):
    """crc32 of a column as text, modulo n; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def map_text(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds columns computed in Arrow batches from one text column.

    make() runs once in each task and returns a function from a list of texts (None for null) to a list of
    columns, one for each field. keep: the input columns to pass on (all by default); an input column with the
    name of a new one gives way to it.
    """
    ship_package(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    own = text_col not in keep  # else the text travels once, as one of the columns to keep
    src = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{text_col}`").alias("__text")] * own)
    at = len(keep) if own else keep.index(text_col)
    schema = T.StructType([src.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        give_back()
        fn, kinds = make(), [to_arrow_type(f.dataType) for f in fields]
        b = part = cols = None
        try:
            for b in batches:
                for part in slices(b, MAP_BYTES, at):
                    cols = fn(part.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(i) for i in range(len(keep))] + [pa.array(c, type=k) for c, k in zip(cols, kinds)],
                        names=keep + [f.name for f in fields],
                    )
        finally:
            fn = b = part = cols = None
            give_back()

    return src.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, column: int = -1) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most so many bytes (one row at least), to bound memory."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column % batch.num_columns)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Groups of rows with equal (long or int) keys from sorted batches; a group may run over several batches."""
    held: list[pa.Table] = []
    for b in batches:
        table = pa.concat_tables([*held, pa.Table.from_batches([b])])
        key = np.stack([table.column(c).to_numpy() for c in keys], 1)
        start = 0
        for end in (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist():
            yield table.slice(start, end - start), key[start]
            start = end
        held = [table.slice(start)]
    if held and held[0].num_rows:
        yield held[0], np.array([held[0].column(c)[0].as_py() for c in keys])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the unsigned 64-bit integers that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            a = np.empty(size, U64)
            a[0] = 1
            filled = 1
            while filled < size:
                step = pow(b, filled, 1 << 64)
                m = min(filled, size - filled)
                a[filled : filled + m] = a[:m] * U64(step)
                filled += m
            out.append(a)
        _pow[base] = have = (out[0], out[1])
    return have


_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(U64) | U64(1)


class ByteHash:
    """64-bit hashes of any range of a byte array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        up, self.down = powers(n + 1, base)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class WordHashes(dict):
    """64-bit hashes of words by keyed BLAKE2b, each word's computed once while it is held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"words").digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_words = WordHashes()


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about so many bytes, cut at white space."""
    at = 0
    while len(raw) - at > size:
        m = _SPACE.search(raw, at + size)
        if not m:
            break
        yield raw[at : m.start()]
        at = m.end()
    yield raw[at:] if at else raw


def give_back() -> None:
    """Drops what this process holds between tasks and returns freed memory to the system: workers live on from stage to
    stage, and each would keep what every operator before has held."""
    _words.clear()
    _pow.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), U64, len(words))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case, in order; long texts go piece by piece."""
    found = [hash_words(p.lower().split()) for p in pieces(raw)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of so many words; of the whole sequence when there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = words[: n - size + 1].copy()
    for k in range(1, size):
        out = mix(out * U64(0x9FB21C651E98DF25) + words[k : n - size + 1 + k])
    return out


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def exact_shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct word shingles of a text, as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(word_hashes(encoded(text)), size))


def real_shingles(text: str | None, size: int = 5) -> set[tuple[bytes, ...]]:
    """The distinct word shingles of a text themselves."""
    words = encoded(text).lower().split()
    size = min(size, len(words))
    return set(zip(*(words[k:] for k in range(size))))
