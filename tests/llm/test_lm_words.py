"""Words of the LM scorer, hashed run by run, and scores that depend on no other text, whatever the processor."""

import os
import random
import subprocess
import sys

import numpy as np

from entwine.llm import lm_scoring as L
from entwine.llm.common import encoded

ALONE = """
import numpy as np
from entwine.llm import lm_scoring as L
shape = L.shape_for(3000)
words = [b"w%d" % k for k in range(3000)]
keys = L.hash_words(words)
order = np.argsort(keys)
model = L.WindowModel(keys[order], order.astype(np.int64), L.start_weights(shape=shape) * 3, shape)
texts = [" ".join(f"w{(k * j) % (37 if k % 2 else 2900)}" for j in range(30)) for k in range(300)]
assert model.score(texts)[0].tolist() == [float(model.score([t])[0][0]) for t in texts]
"""


def test_scores_alone_on_other_kernels():
    """OpenBLAS adds up rows in orders that differ by their place on Haswell; the reviewer's machine took that path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for kernels in ("Haswell", "SkylakeX", "Prescott"):
        env = os.environ | {"OPENBLAS_CORETYPE": kernels, "PYTHONPATH": os.pathsep.join([root, *filter(None, sys.path)])}
        subprocess.run([sys.executable, "-c", ALONE], env=env, check=True, timeout=120)


def test_exact_products():
    rng = np.random.RandomState(1)
    h = np.tanh(rng.normal(size=(500, 16))).astype(np.float32)
    for scale in (1e-3, 1, 300):
        w = rng.normal(0, scale, (48, 16)).astype(np.float32)
        assert np.allclose(L._exact(h, w), h.astype(float) @ w.T, rtol=1e-5, atol=2e-5 * scale)
        shuffled = rng.permutation(16)
        assert (L._exact(h, w) == L._exact(h[:, shuffled], w[:, shuffled])).all()


def test_words_as_split(monkeypatch):
    """The same words, by number, equality and ending, as bytes.lower().split() gives, wherever runs end."""
    rng = random.Random(3)
    some = ["", " ", "Ab", "ab", "é", "É", "x\x1cy", " ", "　", "\x00", "語", "a" * 90, "b" * 700, "b" * 701]
    texts = [None, "", " \t\n"] + ["".join(rng.choice(some) + rng.choice([" ", "\n", "\r\n", "\x0b\x0c", ""]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for size in (1 << 18, 256):  # the second cuts inside of texts and has words too long for a run
        monkeypatch.setattr(L, "PIECE", size)
        want = [encoded(t).lower().split() for t in texts]
        got = [np.concatenate(x) for x in zip(*L.hashed([encoded(t) for t in texts]))]
        assert got[0].tolist() == [k for k, words in enumerate(want) for _ in words]
        flat = [w for words in want for w in words]
        assert len(set(flat)) == len(set(got[1].tolist())) == len(set(zip(flat, got[1].tolist())))
        ends = [w[-3:] for w in flat]
        assert len(set(ends)) == len(set(got[2].tolist())) == len(set(zip(ends, got[2].tolist())))
        assert (L.hash_words(flat) == got[1]).all()
