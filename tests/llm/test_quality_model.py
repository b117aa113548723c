"""Learning of the quality classifier against plain versions: word vectors by loops, steps by numerical gradients."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from themescope.llm import quality_model as q


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["tree", "river", "stone", "light", "!!", "##", "walk", "over", "under", "rare1", "rare2", "x_y"]
    return [" ".join(rng.choices(words, weights=[9, 9, 8, 7, 5, 4, 4, 4, 4, 0.2, 0.2, 2], k=rng.randrange(1, 40))) for _ in range(40)] + ["", "one", "new\nline new"]


def test_word_vectors_match_plain_loops(texts, monkeypatch):
    monkeypatch.setattr(q, "VOCABULARY", 7)
    got = q.index_words(texts)
    count = Counter(t for text in texts for t in q.tokens_of(text))
    known = [w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:7] if n >= 3]
    assert list(got.row) == known and len(known) == 7

    def own(token):
        name = token if token in known else f"\0{got.rows([token])[0] - len(known)}"
        return q.random_vectors(np.array([xxhash.xxh3_64_intdigest(name)], np.uint64))[0].astype(float)

    for w in known:
        context = np.zeros(q.DIM)
        for text in texts:
            tokens = q.tokens_of(text)
            for i, t in enumerate(tokens):
                if t == w:
                    for j in range(max(0, i - q.SIDE), min(len(tokens), i + q.SIDE + 1)):
                        if j != i:
                            context += own(tokens[j])
        unit = lambda x: x / max(np.linalg.norm(x), 1e-6)
        assert got.vectors[got.row[w]] == pytest.approx(unit(context) + 0.5 * unit(own(w)), abs=1e-5)
        assert got.weights[got.row[w]] == pytest.approx(1e-3 / (1e-3 + count[w] / sum(count.values())), rel=1e-5)
    # a word outside the vocabulary keeps its random vector
    row = got.rows(["unheard"])[0]
    assert got.vectors[row] == pytest.approx(own("unheard") / np.linalg.norm(own("unheard")), abs=1e-6)


def test_random_vectors_are_sparse_and_signed():
    v = q.random_vectors(np.arange(2000, dtype=np.uint64))
    assert v.shape == (2000, q.DIM) and (np.abs(v).sum(1) <= q.ENTRIES).all() and (np.abs(v).sum(1) % 2 == q.ENTRIES % 2).all()
    assert abs(v.sum()) < 0.1 * np.abs(v).sum()


def test_training_follows_numerical_gradients(texts, monkeypatch):
    """Two rounds of Adam whose gradients come from differences of the loss, not from the rule of the chain."""
    monkeypatch.setattr(q, "EPOCHS", 2)
    monkeypatch.setattr(q, "HIDDEN", 3)
    rows = [(i, t, int("!!" in t)) for i, t in enumerate(texts)]
    y = np.array([r[2] for r in rows], float)
    shares = (0.7, 0.3)
    got = q.train(rows, shares)

    x = q.index_words(texts).pool(texts).astype(float)
    each = np.where(y == 1, shares[1] / (y == 1).mean(), shares[0] / (y == 0).mean())
    rng = np.random.default_rng(q.SEED)
    order = rng.permutation(len(y))
    tune, fit = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - x[fit].mean(0)) / (x[fit].std(0) + 1e-3)
    n, h = x.shape[1], q.HIDDEN
    flat = np.concatenate([rng.normal(0, n**-0.5, (n, h)).ravel(), np.zeros(h), rng.normal(0, h**-0.5, h), np.zeros(1)])
    decayed = np.concatenate([np.ones(n * h), np.zeros(h), np.ones(h), np.zeros(1)])

    def logits(p, at):
        return np.tanh(z[at] @ p[: n * h].reshape(n, h) + p[n * h : n * h + h]) @ p[n * h + h : -1] + p[-1]

    def loss(p, at):
        out = logits(p, at)
        return (each[at] * np.logaddexp(0, np.where(y[at] == 1, -out, out))).mean() + q.DECAY / 2 * (decayed * p * p).sum()

    m, v, step = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(2):
        rng.shuffle(fit)
        for k in range(0, len(fit), 64):
            at, e = fit[k : k + 64], 1e-6
            g = np.array([(loss(flat + e * d, at) - loss(flat - e * d, at)) / (2 * e) for d in np.eye(len(flat))])
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - q.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    learned = np.concatenate([got.first.ravel(), got.first_bias, got.second, [got.second_bias]])
    steady = np.abs(m) > 1e-6  # Adam divides by the gradient's size: where that is nothing but noise, so is the step
    assert steady.mean() > 0.8 and learned[steady] == pytest.approx(flat[steady], abs=2e-5)

    out, tried = got.logits(x[tune]), np.geomspace(0.25, 8, 61)
    losses = [sum(w * np.logaddexp(0, -o / t if label else o / t) for w, o, label in zip(each[tune], out, y[tune], strict=True)) for t in tried]
    assert got.temperature == pytest.approx(tried[int(np.argmin(losses))])
    assert losses[int(np.argmin(losses))] <= losses[int(np.argmin(np.abs(tried - 1)))]
