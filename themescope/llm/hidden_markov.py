"""A hidden Markov language model, trained by Baum-Welch over the corpus, and a unigram base beside it.

Tokens are the words of a text, A-Z in lower case, and one end. Their counts over all training documents are one
distributed aggregation, so what is gathered grows with the corpus. The model's states emit symbols: one for each
of the SYMBOLS most frequent words, one for each of CLASSES classes of the other words (by a hash of their last two
characters), and the end. A word of a class has the probability of the class times (c + 1) / (n + v + 1), with its
count c and the class's tokens n and distinct words v: a proper distribution with one place for the unseen.

Texts are cut into words twice: to count them, and to write each row's symbols and rare words to the shared folder.

Baum-Welch: every task runs the scaled forward and backward recursions over its rows' symbols and emits the expected
counts by symbol and state, which are summed by symbol in a shuffle; the driver gets SYMBOLS + CLASSES + 1 rows,
whatever the corpus. Every round goes over all training documents. Rounds end when one has raised the likelihood by
less than SETTLED a token, at the latest after ROUNDS; a round without any counts keeps the chain before it.

Scoring: the forward recursion of a text is exact, in numpy over many documents at once, longest first. Counts of
the FREQUENT most frequent words go along as a table of that bound; the rare words of each document meet the rest of
the counts in a shuffled join.

Null and empty texts are the end alone. Texts of any length are scored whole. Repeated rows are scored each, under
a row number of their own. Empty table: no rows; without training documents all counts are 0. A null doc_id counts
as the empty text in the fold. Words of equal count take their symbols in the order of their characters. Other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, spread, stored, table

STATES, SYMBOLS, CLASSES, FREQUENT = 8, 16384, 256, 131_072  # SYMBOLS + CLASSES under 65,536: two bytes a symbol
#: Rounds of Baum-Welch at most; rise of the decimal log likelihood a token under which they end; smoothing tokens a state.
ROUNDS, SETTLED, SMOOTH, SEED = 8, 0.02, 20.0, 3
#: Tokens whose recursions run together; distinct words counted before they are passed on.
GROUP, HELD = 400_000, 300_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower() leaves all other characters."""
    return text.encode().lower().split() if text else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % CLASSES


# ---- counts


def word_counts(texts: DataFrame) -> DataFrame:
    """word, class, c over a table with column text; tasks count before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array([class_of(w) for w in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "class", "c"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(tokens_of(text))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word string, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """rank: of the FREQUENT words; counts and symbols by rank; class_log: log10(n + v + 1) of each class; totals."""

    rank: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray
    class_log: np.ndarray
    symbol_counts: np.ndarray
    n: int
    v: int

    @property
    def end(self) -> int:
        return len(self.symbol_counts) - 1

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end, ranks of the words (-1: not frequent), and the words."""
        words = tokens_of(text)
        rank = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))
        symbols = np.empty(len(words) + 1, np.int32)
        symbols[-1] = self.end
        symbols[:-1] = self.symbols[rank] if len(self.symbols) else 0
        first = self.end - CLASSES
        for i in np.flatnonzero(rank < 0):
            symbols[i] = first + class_of(words[i])
        return symbols, rank, words


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """counts: as from word_counts(); documents: in training, each with one end."""
    # words from a count on of which there are at most FREQUENT: found from a histogram, so that no task sends more
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.s
    found = counts.where(step >= least if least is not None else F.lit(False)).toArrow()
    order = pa.compute.sort_indices(found, [("c", "descending"), ("word", "ascending")])
    words, c, kind = (found.column(k).take(order).to_pylist() for k in ("word", "c", "class"))
    classes = {r["class"]: (r.n, r.v) for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n, v = sum(a for a, _ in classes.values()), sum(b for _, b in classes.values())
    own = min(SYMBOLS, len(words))
    c, kind = np.array(c, np.int64), np.array(kind, np.int64)
    rest_n, rest_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k, (a, b) in classes.items():
        rest_n[k], rest_v[k] = a, b
    np.subtract.at(rest_n, kind[:own], c[:own])
    np.subtract.at(rest_v, kind[:own], 1)
    symbols = np.where(np.arange(len(words)) < own, np.arange(len(words)), own + kind).astype(np.int32) if words else np.zeros(0, np.int32)
    return Vocabulary({w.encode(): i for i, w in enumerate(words)}, c, symbols, np.log10(rest_n + rest_v + 1), np.concatenate([c[:own], rest_n, [documents]]), n + documents, v + (documents > 0))


# ---- recursions


@dataclass
class Chain:
    """start by state, moves from state to state, emit by symbol and state."""

    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray


class Group:
    """Documents side by side: all first tokens, then all second ones, longest documents first."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs])
        self.live = np.array([len(sizes) - k for k in np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), side="left")])
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        flat = np.concatenate(docs)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        doc = np.repeat(np.arange(len(docs)), sizes)
        self.symbols = np.empty(len(flat), np.int32)
        self.symbols[self.at[step] + doc] = flat
        self.doc = np.empty(len(flat), np.int64)
        self.doc[self.at[step] + doc] = doc
        self.count = len(docs)

    def forward(self, m: Chain, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values and scales of all tokens, emission probabilities."""
        emit, moves = m.emit.astype(kind, copy=False)[self.symbols], m.moves.astype(kind, copy=False)
        alpha, scale = np.empty_like(emit), np.empty(len(emit), kind)
        for t, k in enumerate(self.live):
            a, b = self.at[t], self.at[t] + k
            x = (m.start * emit[a:b]).astype(kind, copy=False) if t == 0 else alpha[self.at[t - 1] : self.at[t - 1] + k] @ moves * emit[a:b]
            s = x.sum(1)
            scale[a:b] = s
            np.divide(x, s[:, None], out=alpha[a:b])
        return alpha, scale, emit

    def log10(self, m: Chain) -> np.ndarray:
        """log10 probability of each document's symbols."""
        return np.bincount(self.doc, np.log10(self.forward(m)[1]), self.count)

    def expected(self, m: Chain, by_symbol: np.ndarray, moves: np.ndarray, start: np.ndarray, kind: type = np.float32) -> float:
        """Adds expected counts to the last three; returns the natural log likelihood. Values are scaled, so ``kind`` may be short."""
        alpha, scale, emit = self.forward(m, kind)
        back, way = np.ascontiguousarray(m.moves.T, kind), m.moves.astype(kind)
        beta = np.ones_like(alpha)
        emit /= scale[:, None]
        for t in range(len(self.live) - 2, -1, -1):
            k, a, b = self.live[t + 1], self.at[t], self.at[t + 1]
            emit[b : b + k] *= beta[b : b + k]
            np.matmul(emit[b : b + k], back, out=beta[a : a + k])
        gamma = alpha * beta
        for state in range(gamma.shape[1]):
            by_symbol[:, state] += np.bincount(self.symbols, gamma[:, state], len(by_symbol))
        start += gamma[: self.live[0]].sum(0)
        if len(self.live) > 1:
            rows = np.repeat(self.at[:-2] - self.at[1:-1], self.live[1:]) + np.arange(self.live[0], len(self.symbols))
            moves += way * (alpha[rows].T @ emit[self.at[1] :])
        return float(np.log(scale, dtype=np.float64).sum())


def grouped(docs: list[np.ndarray]) -> Iterator[tuple[list[int], Group]]:
    """Documents by length in groups of about GROUP tokens, with their places in the list."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    held: list[int] = []
    size = 0
    for i in order:
        held.append(i)
        size += len(docs[i])
        if size >= GROUP:
            yield held, Group([docs[k] for k in held])
            held, size = [], 0
    if held:
        yield held, Group([docs[k] for k in held])


def first_chain(v: Vocabulary) -> Chain:
    """States that mostly stay, each with its own noise on the symbols' shares."""
    rng = np.random.default_rng(SEED)
    share = (v.symbol_counts + 0.5) / (v.symbol_counts + 0.5).sum()
    emit = share[:, None] * rng.gamma(2.0, 0.5, (len(share), STATES))
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(moves, 0.9)
    return Chain(np.full(STATES, 1 / STATES), moves, emit / emit.sum(0))


def round_of(rows: DataFrame, m: Chain, counts: Vocabulary) -> tuple[Chain, float]:
    """One round of Baum-Welch over a table with column symbols: the next chain, and the log10 likelihood a token of this one."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(m)
    size = len(m.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        by_symbol, moves, start, logs = np.zeros((size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES), 0.0
        for b in batches:
            for _, g in grouped(symbols_of(b.column(0))):
                logs += g.expected(chain, by_symbol, moves, start)
        seen = np.flatnonzero(by_symbol.sum(1) > 0)
        if len(seen):
            last = np.zeros((1, STATES))
            last[0, :2] = logs, by_symbol.sum()
            parts = np.concatenate([by_symbol[seen], moves, start[None], last])
            ids = np.concatenate([seen, size + np.arange(STATES + 2)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(np.ascontiguousarray(parts[:, k])) for k in range(STATES)]], names=["i", *[f"s{k}" for k in range(STATES)]])

    states = [f"s{k}" for k in range(STATES)]
    sums = rows.select("symbols").mapInArrow(run, "i long, " + ", ".join(f"{s} double" for s in states)).groupBy("i").agg(*[F.sum(s).alias(s) for s in states]).toPandas()
    total = np.zeros((size + STATES + 2, STATES))
    total[sums["i"].to_numpy()] = sums[states].to_numpy()
    sent.unpersist()
    if sums.empty:
        return m, 0.0
    share = (counts.symbol_counts + 0.5) / (counts.symbol_counts + 0.5).sum()
    emit = total[:size] + SMOOTH * share[:, None]
    moves = total[size : size + STATES] + 0.1
    start = total[size + STATES] + 0.1
    logs, tokens = total[-1, :2]
    return Chain(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)), float(logs / tokens / math.log(10))


def baum_welch(rows: DataFrame, counts: Vocabulary, rounds: int = ROUNDS, settled: float = SETTLED) -> tuple[Chain, list[float]]:
    """A chain trained on all rows (column symbols), and the likelihood a token before each round."""
    chain, found = first_chain(counts), []
    for _ in range(rounds):
        chain, likelihood = round_of(rows, chain, counts)
        found.append(likelihood)
        if len(found) > 1 and found[-1] - found[-2] < settled:
            break
    return chain, found


@dataclass
class Fitted:
    """counts: as from word_counts(); rows: as from encode(); likelihoods: a token before each round."""

    counts: DataFrame
    vocabulary: Vocabulary
    rows: DataFrame
    chain: Chain
    likelihoods: list[float]


def fit(docs: DataFrame, train: Column, rounds: int = ROUNDS) -> Fitted:
    """Counts and model of the rows of ``docs`` (doc_id, text) that ``train`` admits, and all rows encoded."""
    texts = docs.where(train).select("text")
    counts = stored(word_counts(texts), "counts")
    voc = vocabulary(counts, texts.count())
    rows = stored(encode(docs, train, voc), "encoded")
    chain, likelihoods = baum_welch(rows.where("train"), voc, rounds)
    return Fitted(counts, voc, rows, chain, likelihoods)


# ---- rows

#: A row of ``docs``; symbols: two bytes each. base, single: logs of counts, of all frequent words and the end, and of what single words add to their classes.
ENCODED = "row long, doc_id long, train boolean, n_known long, base double, single double, symbols binary, rare array<struct<word:string,n:int>>"


def encode(docs: DataFrame, train: Column, v: Vocabulary) -> DataFrame:
    """ENCODED for every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        row = TaskContext.get().partitionId() << 33
        log_count = np.append(np.log10(v.counts + 1.0), 0.0)  # rank -1 takes the last
        own = len(v.symbol_counts) - CLASSES - 1
        class_log = np.concatenate([np.zeros(own), v.class_log, [0.0]])
        single = np.append(np.arange(len(v.counts)) >= own, False) * log_count
        end_log, ends = math.log10(v.symbol_counts[-1] + 1.0), int(v.symbol_counts[-1] > 0)
        for b in batches:
            ids, kept, texts = (c.to_pylist() for c in b.columns)
            for k in range(0, len(texts), 500):
                read = [v.read(t) for t in texts[k : k + 500]]
                known = [int((rank >= 0).sum()) + ends for _, rank, _ in read]
                base = [log_count[rank].sum() + end_log for _, rank, _ in read]
                more = [single[rank].sum() - class_log[symbols].sum() for symbols, rank, _ in read]
                rare = [Counter(words[j] for j in np.flatnonzero(rank < 0)) for _, rank, words in read]
                flat = [x for c in rare for x in c.items()]
                pairs = pa.StructArray.from_arrays([pa.array([w.decode() for w, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int32())], names=["word", "n"])
                rows = np.arange(row, row + len(read))
                row += len(read)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()), pa.array(ids[k : k + 500], pa.int64()), pa.array(kept[k : k + 500], pa.bool_()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(more, pa.float64()),
                        pa.array([symbols.astype("<u2").tobytes() for symbols, _, _ in read], pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32)), pairs),
                    ],
                    names=["row", "doc_id", "train", "n_known", "base", "single", "symbols", "rare"],
                )

    return docs.select(F.col("doc_id").cast("long"), train.alias("train"), "text").mapInArrow(run, ENCODED)


def symbols_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


# ---- scores


def score(fitted: Fitted) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row that was encoded."""
    spark = fitted.rows.sparkSession
    sent = spark.sparkContext.broadcast(fitted.chain)

    @F.arrow_udf("double")
    def forward(symbols: pa.Array) -> pa.Array:
        out = np.zeros(len(symbols))
        for at, g in grouped(symbols_of(symbols)):
            out[at] = g.log10(sent.value)
        return pa.array(out)

    rare = fitted.rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    rare = rare.join(fitted.counts.select("word", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum("n").alias("rare_known"))
    v = fitted.vocabulary
    more, per_token = F.coalesce("rare_log", F.lit(0.0)), math.log10(v.n + v.v + 1)
    rows = fitted.rows.select("row", "doc_id", "n_known", "base", "single", (F.octet_length("symbols") / 2).cast("long").alias("n_tokens"), forward("symbols").alias("model"))
    return rows.join(rare, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * per_token).alias("base_score"), (F.col("model") + F.col("single") + more).alias("score"),
    )


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = score(fit(docs, fold(7) != 2))
    return s.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
