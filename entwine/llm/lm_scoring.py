"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are all words that occur MIN_COUNT times in the corpus (the WORDS commonest at least), and hashed endings of
the others, a third as many; so the vocabulary grows with the corpus. For each token the embeddings of its WINDOW
neighbours on either side, the token itself left out, are averaged; a layer predicts the token's group, a second
one, which also sees the group, its place there. Frequent tokens have a place of their own, the others share one with
as many as there are groups, and a third layer tells them apart. The sum of the conditional log-probabilities of all
tokens is the score of a document.

Training covers all documents. Hashes of the rows deal them to rounds and to shards of about SHARD_BYTES; in each round
every shard trains a copy of the network by Adagrad in numpy, in an order of its own; the rows of weights that moved
are averaged, weighted by their tokens (embeddings by the occurrences of their word), and the average starts the next
round. So the model depends on the table alone, not on how its rows lie or on the cluster. The driver only sees the
average: its size depends on the model alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, ByteHash, encoded, map_text, pieces, ship_package, slices

GROUPS = 32
VOCAB = GROUPS * GROUPS
ENDINGS = 256
WORDS = VOCAB - ENDINGS
WINDOW = 2
DIM = 16
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
# Occurrences that give a word a token of its own.
MIN_COUNT = 256
# Rows of weights travel packed, in so many parts.
BLOCKS = 128
# Bytes of text that one copy of the network trains on in a round.
SHARD_BYTES = 18 << 20
# Bytes of text whose words are hashed at once, and of the longest words that are hashed with others.
PIECE = 1 << 18
# Tokens that a copy mixes at once.
CHUNK = 1 << 20
# Products that exp can bear in single precision, with sums over all groups.
SAFE = 60.0
# Log-probabilities add up as whole multiples of this, so sums do not depend on their order.
GRAIN = 2.0**-24


@dataclass(frozen=True)
class Shape:
    """Groups (and places of each), and how many of the last places are shared by as many tokens as there are groups."""

    groups: int = GROUPS
    shared: int = 0

    @property
    def vocab(self) -> int:
        return self.groups * self.groups + self.shared * (self.groups - 1)

    @property
    def parts(self) -> dict[str, tuple[int, ...]]:
        """Rows of DIM numbers: embeddings (with one for the border), group layer, group embeddings, place layer, biases; those of shared places."""
        g, v, t = self.groups, self.vocab, self.shared
        out = {"emb": (v + 1, DIM), "w1": (g, DIM), "grp": (g, DIM), "w2": (g, DIM), "b1": (g,), "b2": (g, g)}
        return out | {"slot": (t, DIM), "w3": (g if t else 0, DIM), "b3": (t, g)}

    @property
    def rows(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts.values()) // DIM


def shape_for(words: int) -> Shape:
    """The smallest shape for so many words and a third as many endings."""
    need = words + -(-words // 3)
    g = GROUPS
    while g**3 < need:
        g += 16  # whole rows
    return Shape(g, max(0, -(-(need - g * g) // (g - 1))))


def unpack(flat: np.ndarray, shape: Shape = Shape()) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, dims in shape.parts.items():
        size = int(np.prod(dims))
        out[k] = flat[at : at + size].reshape(dims)
        at += size
    return out


def start_weights(seed: int = 3, shape: Shape = Shape()) -> np.ndarray:
    rng = np.random.RandomState(seed)
    flat = rng.normal(0, 0.3, shape.rows * DIM).astype(np.float32)
    p = unpack(flat, shape)
    p["b1"][:] = 0
    p["b2"][:] = 0
    p["b3"][:] = 0
    return flat


def _keys(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some text begin, with A-Z in lower case their hashes, and those of their last three bytes."""
    raw = raw.lower()
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & (data - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    of = ByteHash(data).of
    words = of(start, end)
    for k in np.flatnonzero(end - start > PIECE):
        words[k] = _long_key(raw[start[k] : end[k]])
    return start, words, of(np.maximum(start, end - 3), end)


def _long_key(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, as those of texts."""
    return np.concatenate([np.empty(0, U64), *[w for *_, w, _ in hashed(words)]])


def hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The text of each word, its hash and that of its ending, for all words in order, in runs of bounded size."""
    held: list[bytes] = []
    owner: list[int] = []

    def run():
        offsets = np.cumsum([0, *[len(p) + 1 for p in held]])
        start, words, endings = _keys(b"\n".join(held))
        return np.array(owner, np.int64)[np.searchsorted(offsets, start, "right") - 1], words, endings

    size = 0
    for k, t in enumerate(texts):
        for p in pieces(t, PIECE):
            tail = b""
            if len(p) > 2 * PIECE:  # ends in a word too long to be hashed with others
                *head, tail = p.rsplit(maxsplit=1)
                p = b"".join(head)
            held.append(p)
            owner.append(k)
            size += len(p)
            if size >= PIECE or tail:
                yield run()
                held, owner, size = [], [], 0
            if tail:
                tail = tail.lower()
                yield np.array([k]), np.array([_long_key(tail)], U64), _keys(tail[-3:])[1]
    if held:
        yield run()


@dataclass
class WindowModel:
    words: np.ndarray = field(repr=False)  # sorted hashes of the frequent words
    places: np.ndarray = field(repr=False)  # their token ids: rank by frequency
    flat: np.ndarray = field(repr=False)
    shape: Shape = Shape()

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text's begin."""
        below = max(WORDS, len(self.words))
        ids, counts = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        for owner, words, endings in hashed([encoded(t) for t in texts]):
            out = (endings % U64(self.shape.vocab - below)).astype(np.int32) + np.int32(below)
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
                known = np.flatnonzero(self.words[at] == words)
                out[known] = self.places[at[known]]
            ids.append(out)
            counts += np.bincount(owner, minlength=len(texts))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def score(self, texts: list[str | None], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Summed conditional log-probability and number of tokens of each text.

        Products are exact, so a token's terms do not depend on what else is scored with it, nor on the processor's kernels.
        """
        tokens, first = self.tokens(texts)
        p = unpack(self.flat, self.shape)
        sums = np.zeros(len(tokens) + 1, np.int64)
        for s in range(0, len(tokens), block):
            at = np.minimum(np.arange(s, s + block), len(tokens) - 1)
            grains = np.rint(forward(p, contexts(tokens, first, self.shape.vocab, at), tokens[at], _exact)[0] / GRAIN).astype(np.int64)
            sums[s + 1 : s + 1 + block] = grains[: len(tokens) - s]
        np.cumsum(sums, out=sums)
        return (sums[first[1:]] - sums[first[:-1]]) * GRAIN, np.diff(first)


def contexts(tokens: np.ndarray, first: np.ndarray, border: int = VOCAB, at: np.ndarray | None = None) -> np.ndarray:
    """Neighbours at each offset of some places (of all by default); the border token stands outside the text."""
    at = np.arange(len(tokens)) if at is None else at
    doc = np.searchsorted(first, at, "right") - 1
    low, high = first[doc], first[doc + 1]
    out = np.empty((len(OFFSETS), len(at)), np.int32)
    for k, o in enumerate(OFFSETS):
        inside = (at + o >= low) & (at + o < high)
        out[k] = np.where(inside, tokens[np.where(inside, at + o, 0)] if len(tokens) else 0, border)
    return out


def _softmax(h: np.ndarray, w: np.ndarray, bias: np.ndarray, of: np.ndarray | None, target: np.ndarray, product=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For h @ w.T + bias (or its rows `of`): log-probability of each row's target; probabilities times their sum, and that sum.

    Rows of h lie between -1 and 1, so weights bound the products; where exp can bear these, no row's maximum is needed.
    """
    z = (product or _product)(h, w)
    z += bias if of is None else bias.take(of, 0)
    if np.abs(w).sum(1).max(initial=0) + np.abs(bias).max(initial=0) > SAFE:
        z -= z.max(1, keepdims=True)
    picked = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    total = np.einsum("ij->i", z)
    return picked - np.log(total), z, total


def _product(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """h @ w.T with rows in whole sixteens: few rows would be added up in another order."""
    n = len(h)
    if n % 16:
        h = np.concatenate([h, np.zeros((-n % 16, h.shape[1]), h.dtype)])
    return (h @ w.T)[:n]


def _exact(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """h @ w.T of factors rounded to whole numbers whose sums of products all fit in a double: the same in any order of adding."""
    most = np.abs(w).sum(1, dtype=np.float64).max(initial=1)
    scale = 2.0 ** (31 - np.ceil(np.log2(most)))
    whole = np.rint(w.astype(np.float64) * scale) / (scale * (1 << 20))  # powers of two only move the point
    return (np.rint(h * np.float32(1 << 20)).astype(np.float64) @ whole.T).astype(np.float32)


def _error(z: np.ndarray, total: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Probabilities less 1 at the target, in the place of z."""
    z /= total[:, None]
    z[np.arange(len(z)), target] -= 1
    return z


def forward(p: dict, context: np.ndarray, tokens: np.ndarray, product=None):
    groups = len(p["w1"])
    own = groups * groups - len(p["slot"])  # tokens with a place of their own
    sub = np.flatnonzero(tokens >= own)
    slot, member = np.divmod(tokens[sub] - own, groups)
    places = tokens.copy()
    places[sub] = own + slot
    group, place = np.divmod(places, groups)
    h = p["emb"].take(context[0], 0)  # take is some four times faster than an index
    for c in context[1:]:
        h += p["emb"].take(c, 0)
    h = np.tanh(h / len(context))
    total, *e1 = _softmax(h, p["w1"], p["b1"], None, group, product)
    g = np.tanh(h + p["grp"].take(group, 0))
    l2, *e2 = _softmax(g, p["w2"], p["b2"], group, place, product)
    total += l2
    f, e3 = None, None
    if len(sub):
        f = np.tanh(h.take(sub, 0) + p["slot"].take(slot, 0))
        l3, *e3 = _softmax(f, p["w3"], p["b3"], slot, member, product)
        total[sub] += l3
    return total, h, g, f, (e1, group), (e2, place), (e3, member), sub, slot


def _by_key(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys and the sums of each one's rows."""
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")  # by digits if small
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return [k[start], *[np.add.reduceat(v.take(order, 0), start, axis=0) for v in values]]


class Trainer:
    def __init__(self, flat: np.ndarray, rate: float, shape: Shape = Shape()):
        self.flat, self.rate = flat.copy(), rate
        self.p = unpack(self.flat, shape)
        self.seen = np.full_like(self.flat, 1e-4)
        self.s = unpack(self.seen, shape)
        self.weight = np.zeros(shape.rows, np.int64)  # occurrences of embeddings; all tokens for other rows that moved
        self.shape, self.tokens = shape, 0

    def _move(self, part: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Adagrad for all or some rows of a part; the others have gradient 0 and stay."""
        p, s = self.p[part], self.s[part]
        if rows is None:
            s += grad * grad
            p -= self.rate * grad / np.sqrt(s)
            return
        seen = s.take(rows, 0)
        seen += grad * grad
        s[rows] = seen
        p[rows] = p.take(rows, 0) - self.rate * grad / np.sqrt(seen)

    def step(self, context: np.ndarray, tokens: np.ndarray) -> None:
        p, n = self.p, len(tokens)
        _, h, g, f, (e1, group), (e2, place), (e3, member), sub, slot = forward(p, context, tokens)
        d1, d2 = _error(*e1, group), _error(*e2, place)
        dg = (d2 @ p["w2"]) * (1 - g * g)
        dh = d1 @ p["w1"] + dg
        moves = [("w1", d1.T @ h / n), ("b1", d1.sum(0) / n), ("w2", d2.T @ g / n)]
        if len(sub):
            d3 = _error(*e3, member)
            df = (d3 @ p["w3"]) * (1 - f * f)
            dh[sub] += df
            rows, df, b3 = _by_key(slot, df, d3)
            moves += [("w3", d3.T @ f / n), ("slot", df / n, rows), ("b3", b3 / n, rows)]
        dh *= (1 - h * h) / len(context)
        rows, dg, b2 = _by_key(group, dg, d2)
        moves += [("grp", dg / n, rows), ("b2", b2 / n, rows)]
        order = np.argsort(context, axis=None)
        key = context.ravel()[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        moves.append(("emb", np.add.reduceat(dh.take(order % n, 0), start, axis=0) / n, key[start]))
        for m in moves:
            self._move(*m)
        self.weight[key[start]] += np.diff(start, append=len(key))
        self.tokens += n

    def moved(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of weights that differ from before, and the weight of each in the average."""
        rows = np.flatnonzero((self.flat != before).reshape(-1, DIM).any(1))
        return rows, np.where(rows <= self.shape.vocab, np.maximum(1, self.weight[rows]), self.tokens)


def count_words(docs: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> np.ndarray:
    """Hashes of the words that occur min_count times in all documents, of the WORDS most frequent at least, most frequent first."""
    ship_package(docs.sparkSession)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def rows():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

        for b in batches:
            for part in slices(b):
                for _, words, _ in hashed([encoded(t) for t in part.column(0).to_pylist()]):
                    held.append(words)
                    size += len(words)
                    if size >= 4 * CHUNK:  # bounded memory: hand over and go on
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    words = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "word long, n long")
    counted = words.groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= min_count).toArrow()
    if top.num_rows < WORDS:  # a small corpus
        top = counted.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    return word[np.lexsort((word, -n))].view(np.uint64)


def _train(model: WindowModel, rate: float, batch: int):
    """Trains a copy of the network for each shard; rows come sorted by shard."""

    def packed(shard: int, trainer: Trainer):
        rows, weight = trainer.moved(model.flat)
        v = trainer.flat.reshape(-1, DIM)
        for block in range(BLOCKS):
            at = np.flatnonzero(rows % BLOCKS == block)
            if len(at):
                values = [rows[at].astype(np.int32), weight[at].astype(np.float64), v[rows[at]].astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in values]], names=["block", "shard", "row", "n", "v"])

    def learn(trainer: Trainer, held: list[np.ndarray]) -> None:
        if not held:
            return
        tokens, first = np.concatenate(held), np.cumsum([0, *map(len, held)])
        deal = np.random.RandomState(len(tokens) % (1 << 32)).permutation(len(tokens))
        near = contexts(tokens, first, model.shape.vocab)
        for s in range(0, len(tokens), batch):
            k = deal[s : s + batch]
            trainer.step(near.take(k, 1), tokens[k])

    def run(batches):
        shard, trainer, held, size = -1, None, [], 0
        for b in batches:
            for part in slices(b, column=0):
                tokens, first = model.tokens(part.column(0).to_pylist())
                for now, start, end in zip(part.column(1).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    if now != shard:
                        if trainer:
                            learn(trainer, held)
                            yield from packed(shard, trainer)
                        shard, trainer, held, size = now, Trainer(model.flat, rate, model.shape), [], 0
                    if end > start:
                        held.append(tokens[start:end])
                        size += end - start
                    if size >= CHUNK:
                        learn(trainer, held)
                        held, size = [], 0
        if trainer:
            learn(trainer, held)
            yield from packed(shard, trainer)

    return run


def _average(shape: Shape):
    """Weighted means of the rows of each block, added up in the order of the shards."""

    def run(batches):
        block, sums = -1, np.empty(0)

        def mean():
            at = np.flatnonzero(sums[:, 0])
            row = (at * BLOCKS + block).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (row, (sums[at, 1:] / sums[at, :1]).astype(np.float32))], names=["row", "v"])

        for b in batches:
            for now, row, n, v in zip(b.column(0).to_pylist(), *(b.column(k) for k in (2, 3, 4))):
                if now != block:
                    if block >= 0:
                        yield mean()
                    block, sums = now, np.zeros((shape.rows // BLOCKS + 1, DIM + 1))
                at, n = np.frombuffer(row.as_py(), np.int32) // BLOCKS, np.frombuffer(n.as_py())
                sums[at, 0] += n
                sums[at, 1:] += np.frombuffer(v.as_py(), np.float32).reshape(-1, DIM) * n[:, None]
        if block >= 0:
            yield mean()

    return run


def train_model(docs: DataFrame, text_col: str = "text", rounds: int = 3, rate: float = 0.15, batch: int = 4096, min_count: int = MIN_COUNT) -> WindowModel:
    """Trains on all documents, each in one of the rounds and in one shard, dealt out by hashes of whole rows."""
    ship_package(docs.sparkSession)
    ranked = count_words(docs, text_col, min_count)
    order = np.argsort(ranked)
    shape = shape_for(max(WORDS, len(ranked)))
    model = WindowModel(ranked[order], order.astype(np.int64), start_weights(shape=shape), shape)
    text = F.col(f"`{text_col}`")
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // (rounds * SHARD_BYTES)))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = docs.filter(F.octet_length(text) > 0).select(text.alias("t"), F.xxhash64(*plain).alias("h"))
    shard = F.pmod(F.floor(F.col("h") / F.lit(1024)), F.lit(shards)).cast("int")

    for r in range(rounds):
        part = dealt.filter(F.pmod("h", F.lit(rounds)) == r).select("t", shard.alias("shard"), "h")
        part = part.repartition(shards, "shard").sortWithinPartitions("shard", "h", "t").select("t", "shard")
        moved = part.mapInArrow(_train(model, rate / (1 + r), batch), "block int, shard int, row binary, n binary, v binary")
        means = moved.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_average(shape), "row binary, v binary").toArrow()
        flat = model.flat.reshape(-1, DIM).copy()
        for row, v in zip(means.column("row").to_pylist(), means.column("v").to_pylist()):
            flat[np.frombuffer(row, np.int32)] = np.frombuffer(v, np.float32).reshape(-1, DIM)
        model = WindowModel(model.words, model.places, flat.ravel(), shape)
    return model


def score_documents(docs: DataFrame, model: WindowModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, log_prob (sum over all tokens of a text) and mean_log_prob.

    Null and empty texts and texts without words have no tokens, log_prob 0 and mean_log_prob null. Rows are
    independent: repeated rows get equal scores. Very long texts are read in pieces and scored in blocks. An empty table
    gives an empty result. Input columns named like the new ones give way to them.
    """

    def make():
        def run(texts):
            sums, n = model.score(texts)
            sums = sums.round(3)
            return [n.tolist(), sums.tolist(), [s / k if k else None for s, k in zip(sums.tolist(), n.tolist())]]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())]
    return map_text(docs, text_col, fields, make, keep)
