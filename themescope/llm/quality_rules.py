"""Quality rules: base counts of a text, and its lines marked content or boilerplate by a linear-chain CRF.

Every line that has a word becomes a row of features; a two-state conditional random field with those features
and learned transitions is decoded by Viterbi. A document stays if it passes the base rules and at least
``least_share`` of its words stand in content lines.

The field is trained by gradient ascent on the exact conditional likelihood (forward and backward in numpy, chains
side by side) over a bounded sample of labelled documents, whose label all of their lines take; the driver gets their
features. Without labels of both classes, fixed weights that say the same in outline are used.

Null and empty texts: no words, base_failed, not kept. Lines without a word are no part of the chain. Texts of
any length are decoded whole. Repeated rows are judged each; in training the least of the texts of a doc_id counts.
Ties: of two paths of the same weight the one with boilerplate last. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sample_rows, spread, table

#: Training takes at most so many documents of each class, each of at most so many code points and lines.
PER_CLASS, MAX_CHARS, MAX_LINES = 1000, 20_000, 400
LEAST_SHARE, MIN_WORDS, REPEATED_PERCENT = 0.5, 10, 20
# The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
FEATURES = ("bias", "symbols a word", "bars a word", "few words", "many words", "mean word", "sentence end", "starts upper", "digits", "seen before", "repeated words")
# Weights for "content" when there is nothing to train on, in the order of FEATURES.
OUTLINE = (1.5, -4.0, -4.0, -0.4, 0.5, 0.0, 0.8, 0.3, -1.0, -3.0, -2.0)

_symbol = re.compile(SYMBOLS)


def repeated_words(tokens: list[bytes], width: int = 5) -> int:
    """Words that stand in some window of ``width`` words that the text has twice or more."""
    n = len(tokens)
    if n <= width:
        return 0
    runs = list(zip(*(tokens[k:] for k in range(width)), strict=False))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.fromiter((counts[r] > 1 for r in runs), bool, len(runs)))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def lines_of(text: str | None) -> tuple[list[tuple[str, list[bytes]]], int]:
    """Lines with a word and their words; how many of them equal an earlier one."""
    found, seen, again = [], set(), 0
    for line in (text or "").split("\n"):
        tokens = line.encode().split()
        if tokens:
            again += line in seen
            seen.add(line)
            found.append((line, tokens))
    return found, again


def features(lines: list[tuple[str, list[bytes]]]) -> np.ndarray:
    x = np.zeros((len(lines), len(FEATURES)), np.float32)
    seen: set[str] = set()
    for i, (line, tokens) in enumerate(lines):
        n = len(tokens)
        end = line.rstrip()[-1:]
        x[i] = (
            1, min(1.0, len(_symbol.findall(line)) / n), min(1.0, line.count("|") / n), n < 5, n > 40, min(2.0, (len(line) - n + 1) / n / 6 - 1),
            end in ".!?", line.lstrip()[:1].isupper(), sum(t.isdigit() for t in tokens) / n, line in seen, 1 - len(set(tokens)) / n,
        )
        seen.add(line)
    return x


@dataclass
class Field:
    """weights: by feature, for content against boilerplate; moves[i, j]: from state i to j (1 is content)."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of each chain of feature rows; chains step together, longest first."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        lengths = np.array([len(chains[i]) for i in order])
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        steps = int(lengths[0]) if len(lengths) else 0
        if not steps:
            return out
        live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps + 1)]  # chains longer than t
        ends = np.cumsum(lengths)
        flat = np.concatenate([chains[i] for i in order]) @ self.weights
        first = ends - lengths
        back = np.zeros((int(ends[-1]), 2), np.int8)
        best = np.zeros((len(order), 2))
        for t in range(steps):
            m = int((lengths > t).sum()) if t == 0 else live[t]
            at = first[:m] + t
            if t == 0:
                best[:m, 1] = flat[at]
                continue
            ways = best[:m, :, None] + self.moves
            back[at] = ways.argmax(1)
            best[:m] = ways.max(1)
            best[:m, 1] += flat[at]
        state = best.argmax(1)
        path = np.zeros(int(ends[-1]), np.int8)
        for t in range(steps - 1, -1, -1):
            m = live[t] if t else int((lengths > 0).sum())
            at = first[:m] + t
            path[at] = state[:m]
            if t:
                state[:m] = back[at, state[:m]]
        for k, i in enumerate(order):
            out[i] = path[first[k] : ends[k]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def marginals(up: np.ndarray, moves: np.ndarray, first: list[int], live: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of both states of each line, and of each move into it (0 for first lines); lines by place, then by chain.

    up: log weight of both states; first[t], live[t]: where place t begins and how many chains reach it.
    """
    alpha, beta = up.copy(), np.zeros_like(up)
    for t in range(1, len(live)):
        a, b, k = first[t - 1], first[t], live[t]
        alpha[b : b + k] += _log_sum(alpha[a : a + k, :, None] + moves, 1)
    for t in range(len(live) - 2, -1, -1):
        a, b, k = first[t], first[t + 1], live[t + 1]
        beta[a : a + k] = _log_sum(moves + (up[b : b + k] + beta[b : b + k])[:, None, :], 2)
    both = alpha + beta
    p = np.exp(both - _log_sum(both, 1)[:, None])
    pair = np.zeros((len(up), 2, 2))
    if len(live) > 1:
        before = np.concatenate([np.arange(first[t - 1], first[t - 1] + live[t]) for t in range(1, len(live))])
        way = alpha[before][:, :, None] + moves + (up + beta)[live[0] :, None, :]
        pair[live[0] :] = np.exp(way - _log_sum(way.reshape(-1, 4), 1)[:, None, None])
    return p, pair


def train(chains: list[np.ndarray], states: list[int], rounds: int = 120, rate: float = 0.5, shrink: float = 1e-3) -> Field:
    """Maximum conditional likelihood for chains whose lines all have one state; content weighs 0.7, boilerplate 0.3."""
    order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: -len(chains[i]))
    sizes, y = np.array([len(chains[i]) for i in order]), np.array([states[i] for i in order])
    live = [int((sizes > t).sum()) for t in range(int(sizes[0]))]
    first = np.concatenate([[0], np.cumsum(live)[:-1]]).tolist()
    x = np.concatenate([np.array([chains[i][t] for i in order[:k]], np.float64) for t, k in enumerate(live)])
    doc = np.concatenate([np.arange(k) for k in live])
    each = (np.where(y == 1, 0.7 / max(1, (y == 1).sum()), 0.3 / max(1, (y == 0).sum())) / sizes)[doc]
    state = y[doc]
    rest = slice(live[0], None)
    seen = np.diag([each[rest][state[rest] == s].sum() for s in (0, 1)])
    w, m = np.zeros(len(FEATURES)), np.zeros((2, 2))
    speed_w, speed_m = np.zeros_like(w), np.zeros_like(m)
    for _ in range(rounds):
        p, pair = marginals(np.stack([np.zeros(len(x)), x @ w], 1), m, first, live)
        speed_w = 0.9 * speed_w + ((state - p[:, 1]) * each) @ x - shrink * w
        speed_m = 0.9 * speed_m + seen - (pair * each[:, None, None]).sum(0) - shrink * m
        w, m = w + rate * speed_w, np.clip(m + rate * speed_m, -2, 2)
    return Field(w, m)


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(lines_of(t)[0]).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "x"])

    sample = sample_rows(docs, labels, "quality", F.lit(True), PER_CLASS, MAX_CHARS, MAX_LINES)
    rows = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").where("octet_length(x) > 0").orderBy("doc_id").collect()
    if len({r.y for r in rows}) < 2:
        return Field(np.array(OUTLINE), np.array([[0.5, -0.5], [-0.5, 0.5]]))
    return train([np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in rows], [r.y for r in rows])


#: What judge() returns of each text.
JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, lines array<tinyint>"


def judge(text: Column, field: Field, spark: SparkSession, least_share: float = LEAST_SHARE) -> Column:
    """A struct as in JUDGED for a text column; ``lines`` has 1 for content, 0 for boilerplate, for each line with a word."""
    sent = spark.sparkContext.broadcast(field)

    @F.arrow_udf(JUDGED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = sent.value
        for texts in batches:
            base, chains, sizes = [], [], []
            for text in texts.to_pylist():
                lines, again = lines_of(text)
                tokens = [t for _, ts in lines for t in ts]
                n = len(tokens)
                twice = repeated_words(tokens)
                base.append((n, sum(map(len, map(bytes.decode, tokens))) if text and not text.isascii() else sum(map(len, tokens)), len(_symbol.findall(text or "")), again, twice, n < MIN_WORDS or 100 * twice > REPEATED_PERCENT * n))
                chains.append(features(lines))
                sizes.append(np.fromiter((len(ts) for _, ts in lines), np.int64, len(lines)))
            marks = f.decode(chains)
            share = [float((s * m).sum() / s.sum()) if len(s) else 0.0 for s, m in zip(sizes, marks, strict=True)]
            cols = [pa.array(c, pa.int64()) for c in zip(*[b[:5] for b in base], strict=True)] if base else [pa.array([], pa.int64())] * 5
            failed = [b[5] for b in base]
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            flat = np.concatenate(marks) if marks else np.zeros(0, np.int8)
            cols += [pa.array(failed, pa.bool_()), pa.array([not b and s >= least_share for b, s in zip(failed, share, strict=True)], pa.bool_()), pa.array(share, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int8()))]
            yield pa.StructArray.from_arrays(cols, names=[c.split()[0] for c in JUDGED.split(", ")])

    return run(text)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels"))
    rows = spread(docs).select("doc_id", judge(F.col("text"), field, spark).alias("j"))
    return rows.select("doc_id", *[F.col(f"j.{c.split()[0]}").alias(c.split()[0]) for c in JUDGED.split(", ")[:-1]])
