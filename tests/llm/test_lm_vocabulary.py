"""The vocabulary of the LM scorer grows with the corpus, and the layer of shared places is exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine.llm import lm_scoring


def test_lm_vocabulary_grows(spark):
    words = [f"{chr(97 + k % 26)}{k}zing" for k in range(2000)]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(" ".join(words)).alias("text"))
    model = lm_scoring.train_model(docs, rounds=1, min_count=50)
    tokens = model.tokens([" ".join(words)])[0]
    assert len(set(tokens.tolist())) == 2000 and model.shape.vocab >= 2000 * 4 // 3
    a, b = words[1000], words[1990]  # same ending, both outside the 768 commonest
    sums, _ = model.score([f"{words[0]} {a} {words[2]}", f"{words[0]} {b} {words[2]}"])
    assert sums[0] != sums[1]
    rare = lm_scoring.train_model(docs.limit(40), rounds=1, min_count=50)
    assert len(rare.words) == lm_scoring.WORDS


def test_lm_shared_places():
    shape = lm_scoring.shape_for(3000)
    assert shape.shared and shape.vocab >= 4000
    rng = np.random.RandomState(4)
    flat = lm_scoring.start_weights(shape=shape).astype(np.float64)
    p = lm_scoring.unpack(flat, shape)
    p["b3"][:] = rng.normal(0, 1, p["b3"].shape)
    every = np.arange(shape.vocab)
    one = np.repeat(np.array([[3], [700], [2500], [shape.vocab]]), shape.vocab, 1)
    assert np.exp(lm_scoring.forward(p, one, every)[0]).sum() == pytest.approx(1)
    context, tokens = rng.randint(0, shape.vocab + 1, (4, 40)), rng.randint(0, shape.vocab, 40)
    t = lm_scoring.Trainer(flat, 1e-3, shape)
    t.step(context, tokens)
    loss = lambda f: -lm_scoring.forward(lm_scoring.unpack(f, shape), context, tokens)[0].mean()
    grad = np.sqrt(t.seen - 1e-4)
    for k in rng.choice(np.flatnonzero(grad > 1e-4), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert slope == pytest.approx(grad[k] * np.sign(flat[k] - t.flat[k]), rel=1e-2, abs=1e-6)
    assert set(t.moved(flat)[0].tolist()) == set(np.flatnonzero((t.flat != flat).reshape(-1, lm_scoring.DIM).any(1)).tolist())


def test_lm_scores_as_brute_force(spark):
    """Token by token: mean of the neighbours' embeddings, softmax over groups, over places, over what shares a place."""
    words = [f"{chr(97 + k % 26)}{k}zing" for k in range(1500)]
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(" ".join(words)).alias("text"))
    model = lm_scoring.train_model(docs, rounds=1, min_count=50)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.unpack(model.flat, model.shape).items()}
    g, own = model.shape.groups, model.shape.groups**2 - model.shape.shared

    def log_softmax(z, k):
        return z[k] - z.max() - np.log(np.exp(z - z.max()).sum())

    texts = [" ".join(words[3:9]) + " unseen words", "one", "", None, f"{words[5]} {words[1400]}\n{words[1400]}"]
    sums, counts = model.score(texts)
    for t, got, n in zip(texts, sums, counts):
        ids = model.tokens([t])[0].tolist()
        want = 0.0
        for at, token in enumerate(ids):
            near = [ids[at + o] if 0 <= at + o < len(ids) else model.shape.vocab for o in (-2, -1, 1, 2)]
            h = np.tanh(p["emb"][near].mean(0))
            place, member = (token, None) if token < own else (own + (token - own) // g, (token - own) % g)
            group, spot = divmod(place, g)
            want += log_softmax(p["w1"] @ h + p["b1"], group) + log_softmax(p["w2"] @ np.tanh(h + p["grp"][group]) + p["b2"][group], spot)
            if member is not None:
                want += log_softmax(p["w3"] @ np.tanh(h + p["slot"][place - own]) + p["b3"][place - own], member)
        assert n == len(ids) and got == pytest.approx(want, abs=1e-3)


def test_lm_depends_on_the_table_alone(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 2000)
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(30))) for k in range(90)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (lm_scoring.train_model(d, rounds=2, batch=64) for d in (docs.repartition(1), docs.repartition(5)))
    assert (a.flat == b.flat).all() and (a.words == b.words).all()
    together, alone = a.score([t for _, t in rows])[0], [a.score([t])[0][0] for _, t in rows]
    assert together.tolist() == alone


def test_one_rare_word_scores_as_among_others():
    """A product of one row adds up in another order than one of many."""
    shape = lm_scoring.shape_for(3000)
    words = [f"v{k}".encode() for k in range(3000)]
    keys = lm_scoring.hash_words(words)
    order = np.argsort(keys)
    model = lm_scoring.WindowModel(keys[order], order.astype(np.int64), lm_scoring.start_weights(shape=shape), shape)
    texts = [f"v1 v2 v{2000 + k} v3" for k in range(900)]
    assert model.score(texts)[0].tolist() == [float(model.score([t])[0][0]) for t in texts]


def test_probabilities_of_large_products():
    """Without each row's maximum where exp bears the products, with it where it does not: the same probabilities."""
    rng = np.random.RandomState(2)
    h = np.tanh(rng.normal(size=(50, 16))).astype(np.float32)
    target = rng.randint(0, 32, 50)
    for scale in (0.1, 3, 400):
        w, bias = (rng.normal(0, scale, s).astype(np.float32) for s in ((32, 16), 32))
        z = h.astype(float) @ w.T + bias
        z -= z.max(1, keepdims=True)
        want = z[np.arange(50), target] - np.log(np.exp(z).sum(1))
        assert np.allclose(lm_scoring._softmax(h, w, bias, None, target)[0], want, rtol=1e-4, atol=1e-4)
