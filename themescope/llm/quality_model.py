"""Quality scores: random-indexing word vectors, pooled per document, in a two-layer network with calibrated output.

Every word has a fixed sparse random vector of DIM entries, made from its hash. The vector of a word that occurs
often enough in the training sample is the sum of the random vectors of its neighbours there (random indexing), at
unit length; any other word keeps its random vector. A document is the weighted mean of its words' vectors, with a
few shares of its form beside them. A tanh layer and a logistic output, trained with Adam in numpy, score it, and
one temperature, fitted on training rows that the weights have not seen, makes the scores probabilities.

Everything is learned from a bounded sample of labelled rows outside the held-out fold; only the text is read.
Without labels of both classes every text scores 0.5.

Null and empty texts have the zero vector and are scored as such. Texts of any length are read whole. Repeated rows
are scored each; in training the least of the texts of a doc_id counts. Ties: words of equal count enter the vocabulary
in the order of their characters. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, mix64, spread, table

#: Training takes at most so many rows of each class, each of at most so many code points, all together of MAX_TOTAL.
PER_CLASS, MAX_CHARS, MAX_TOTAL = 2500, 20_000, 48_000_000
#: Entries of a word vector, those of its random vector that aren't 0, neighbours at each side, words with a learned vector, hashed rows for the rest.
DIM, ENTRIES, SIDE, VOCABULARY, ROWS = 48, 4, 2, 8192, 4096
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 60, 3e-3, 1e-3, 5
SHAPE = 8

_token = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, and runs of signs."""
    return _token.findall(text.lower()) if text else []


def random_vectors(keys: np.ndarray) -> np.ndarray:
    """A sparse vector of 1 and -1 for each 64-bit key."""
    out = np.zeros((len(keys), DIM), np.float32)
    with np.errstate(over="ignore"):
        for k in range(ENTRIES):
            h = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
            np.add.at(out, (np.arange(len(keys)), (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


@dataclass
class Words:
    """Row of each known word; unknown ones share ROWS rows by their hash. vectors and weights by row."""

    row: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray
    seen: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def rows(self, tokens: list[str]) -> np.ndarray:
        import zlib

        known, seen = self.row, self.seen
        for t in set(tokens).difference(known).difference(seen):
            if len(seen) > 500_000:
                seen.clear()
            seen[t] = len(known) + zlib.crc32(t.encode()) % ROWS
        # clear() above may drop words of this text
        return np.fromiter((known[t] if t in known else seen[t] if t in seen else len(known) + zlib.crc32(t.encode()) % ROWS for t in tokens), np.int32, len(tokens))

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """A row of DIM + SHAPE numbers for each text."""
        out = np.zeros((len(texts), DIM + SHAPE), np.float32)
        for i, text in enumerate(texts):
            tokens = tokens_of(text)
            n = len(tokens)
            if not n:
                continue
            times = np.bincount(self.rows(tokens), minlength=len(self.weights))
            at = np.flatnonzero(times)
            w = times[at] * self.weights[at]
            out[i, :DIM] = w @ self.vectors[at] / max(float(w.sum()), 1e-6)
            signs = sum(not t[0].isalnum() for t in tokens)
            lines = text.count("\n") + 1
            out[i, DIM:] = (
                np.log1p(n) / 8, signs / n, len(set(tokens)) / n, np.log1p(n / lines) / 8, (text.count(".") + text.count("!") + text.count("?")) / n,
                sum(text.count(c) for c in "#*$%&|<>") / n, len(text) / n / 10, len(set(zip(tokens, tokens[1:], tokens[2:], strict=False))) / n,
            )
        return out


def index_words(texts: list[str]) -> Words:
    """Random indexing over the sample: vectors of its VOCABULARY most frequent words from their neighbours."""
    import xxhash

    cut = [tokens_of(t) for t in texts]
    count = Counter(t for ts in cut for t in ts)
    vocabulary = [w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 3]
    row = {w: i for i, w in enumerate(vocabulary)}
    names = [*vocabulary, *(f"\0{k}" for k in range(ROWS))]
    own = random_vectors(np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64))
    words = Words(row, own, np.ones(len(names), np.float32))
    context = np.zeros_like(own)
    for ts in cut:
        at = words.rows(ts)
        for d in range(1, SIDE + 1):
            if len(at) > d:
                np.add.at(context, at[:-d], own[at[d:]])
                np.add.at(context, at[d:], own[at[:-d]])
    total = sum(count.values()) or 1
    vectors = np.where(np.arange(len(names))[:, None] < len(row), _unit(context) + 0.5 * _unit(own), _unit(own))
    weights = np.full(len(names), 1.0, np.float32)
    weights[: len(row)] = [1e-3 / (1e-3 + count[w] / total) for w in vocabulary]
    return Words(row, vectors.astype(np.float32), weights)


@dataclass
class Model:
    words: Words
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(self.words.pool(texts).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[int, str, int]], shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """A model from (doc_id, text, quality); shares: of the classes among all labels, which the scores are to reflect."""
    y = np.array([q for *_, q in rows], float)
    texts = [t for _, t, _ in rows]
    words = index_words(texts)
    x = words.pool(texts).astype(np.float64)
    size = x.shape[1]
    if len(set(y.tolist())) < 2:
        return Model(words, np.zeros(size), np.ones(size), np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    each = np.where(y == 1, shares[1] / (y == 1).mean(), shares[0] / (y == 0).mean())
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    tune, fit_ = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit_].mean(0), x[fit_].std(0) + 1e-3
    p = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        rng.shuffle(fit_)
        for k in range(0, len(fit_), 64):
            b = fit_[k : k + 64]
            h = np.tanh(z[b] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[b]) * each[b] / len(b)
            back = e[:, None] * p[2] * (1 - h * h)
            g = [z[b].T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], e.sum(keepdims=True)]
            step += 1
            for i, gi in enumerate(g):
                m[i] = 0.9 * m[i] + 0.1 * gi
                v[i] = 0.999 * v[i] + 0.001 * gi * gi
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(words, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(tune):
        out, want, w = model.logits(x[tune]), y[tune], each[tune]
        tried = np.geomspace(0.25, 8, 61)
        loss = [(w * np.logaddexp(0, np.where(want == 1, -out, out) / t)).sum() for t in tried]
        model.temperature = float(tried[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    keep = fold(4) != 2
    rows = labelled_sample(docs, labels, "quality", keep, PER_CLASS, MAX_CHARS, MAX_TOTAL)
    count = {r.quality: r["count"] for r in labels.where(keep & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()}
    total = sum(count.values()) or 1
    return train(rows, (count.get(0, 0) / total, count.get(1, 0) / total))


def quality(text: Column, model: Model, spark: SparkSession) -> Column:
    """The probability of label 1 for a text column."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array(np.concatenate([model.scores(texts[k : k + 512]) for k in range(0, len(texts), 512)] or [np.zeros(0)]))

    return run(text)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = spread(docs).select("doc_id", quality(F.col("text"), model, spark).alias("score"))
    return rows.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
