"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding lowers case, drops accents and invisible characters, and maps look-alike letters, digits and signs to one
letter of each look-alike class, so that ``1D10T`` and a Cyrillic spelling fall on ``idiot``; whatever is then not
a letter or digit parts words. Whole words and phrases of the lexicon are found in one pass; those inside an
exception phrase don't count. The summed weights are divided by a slowly growing function of the number of words,
and a logistic curve makes that a score.

The lexicon and the curve are learned from a bounded sample of labelled rows, which stays on the executors: the driver
gets a sketch and a number for each of its documents, and the words of the lexicon. The weight of a word is its
smoothed log odds among toxic and other documents, and it enters if the difference is far from chance,
the weight large enough and the word in LEAST_DOCS toxic documents or more. Near copies (SKETCH MinHash values, ALIKE
of them equal) count once in training. Without labels of both classes, a small general list is used.

Null and empty texts: no hits, the lowest score. Very long texts are scanned whole in linear time. Repeated rows
are scored each; in training the least of the texts of a doc_id counts. Ties: of near copies the one with the smallest
doc_id counts. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold as fold_of
from .common import WordHashes, mix64, sample_rows, shingles, spread, table

#: Training takes at most so many rows of each class, each of at most so many code points.
PER_CLASS, MAX_CHARS = 5000, 40_000
#: A word enters the lexicon at this many standard errors, this weight and this many toxic documents.
LEAST_Z, LEAST_WEIGHT, LEAST_DOCS = 5.0, 2.5, 3
#: MinHash values of a training document, values in a band, share of equal values from which two are near copies.
SKETCH, BAND, ALIKE = 64, 4, 0.8
# Look-alikes. Each letter or sign on the left counts as the Latin letter on the right.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "є": "e", "ɡ": "g", "һ": "h", "н": "h",
    "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "μ": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "ө": "o",
    "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ц": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "ѡ": "w",
    "х": "x", "χ": "x", "у": "y", "γ": "y", "ʏ": "y", "з": "e", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "class clown", "sore loser", "pond scum")
#: Used when there is nothing to learn from.
GENERAL = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "clown")

_inside = re.compile(r"(?<=[^\W_])[@$!|€+]+(?=[^\W_])")
_apart = re.compile(r"[\W_]+")
_invisible = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)])
_classes = str.maketrans(LOOKALIKES | DIGITS)
_same = str.maketrans({"l": "i"})  # 1, l, I and i are one class
_plain = re.compile(r"[\x00-\x7F]*\Z")


def fold_text(text: str | None) -> str:
    """Words of one look-alike class per letter, each with one space before and after."""
    if not text:
        return " "
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.translate(_invisible))
        t = "".join(c for c in t if not unicodedata.combining(c)) if not _plain.match(t) else t
    t = t.lower()
    t = _inside.sub(lambda m: "".join(SIGNS[c] for c in m[0]), t)
    return f" {_apart.sub(' ', t.translate(_classes)).strip()} ".translate(_same)


@dataclass
class Lexicon:
    """Weights by folded word or phrase, exceptions, and the curve score = 1 / (1 + exp(-(slope * x + base)))."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    base: float = -2.0
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _built(self):
        if self.automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for word, w in self.weights.items():
                a.add_word(f" {word} ", (len(word) + 2, w, False))
            for phrase in self.exceptions:
                a.add_word(fold_text(phrase), (len(fold_text(phrase)), 0.0, True))
            if len(a):
                a.make_automaton()
            self.automaton = a
        return self.automaton

    def strength(self, text: str | None) -> tuple[float, int, list[tuple[int, int]]]:
        """Normalised weight, number of hits, and their spans in the folded text."""
        folded = fold_text(text)
        a = self._built()
        found = [(end - n + 1, end + 1, w, free) for end, (n, w, free) in a.iter(folded)] if len(a) else []
        if any(x[3] for x in found):
            free = [(x[0], x[1]) for x in found if x[3]]
            found = [x for x in found if not x[3] and not any(s <= x[0] and x[1] <= e for s, e in free)]
        if not found:
            return 0.0, 0, []
        total = sum(x[2] for x in found)
        return total / math.log(math.e + folded.count(" ") / 200), len(found), [(s + 1, e - 1) for s, e, _, _ in found]

    def score(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * x + self.base))))


_factors = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(folded: str, hashes: WordHashes) -> bytes:
    """MinHash values of a folded text's shingles; none for a text without words."""
    s = shingles(hashes.of([w.encode() for w in folded.split()]))
    if not len(s):
        return b""
    low = np.full(SKETCH, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 4096):
            low = np.minimum(low, (s[k : k + 4096, None] * _factors).min(0))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def first_of_copies(rows: list[tuple[int, bytes]]) -> list[int]:
    """Ids of (doc_id, sketch) without those that are a near copy of one before them."""
    kept, bands, sketches = [], {}, []
    for doc_id, raw in sorted(rows):
        mine = np.frombuffer(raw, "<u4")
        keys = [(k, raw[4 * k : 4 * (k + BAND)]) for k in range(0, len(mine), BAND)]
        near = {i for key in keys for i in bands.get(key, ())}
        if any((sketches[i] == mine).mean() >= ALIKE for i in near):
            continue
        for key in keys:
            bands.setdefault(key, []).append(len(sketches))
        sketches.append(mine)
        kept.append(doc_id)
    return kept


def word_weights(rows: DataFrame, n: dict[int, int]) -> dict[str, float]:
    """Weights of the words that enter, from (text, y); n: documents by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, y) for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in set(fold_text(t).split())]
            if found:
                words, toxic = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], names=["word", "toxic"])

    counts = rows.select("text", "y").mapInArrow(run, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")
    z = (a / n[1] - b / n[0]) / F.sqrt((a + b) / (n[0] + n[1]) * (1 / n[0] + 1 / n[1]))
    w = F.log((a + 0.5) / (n[1] + 1) * (n[0] + 1) / (b + 0.5))
    # a word of all documents has the variance 0 and no weight
    found = counts.where(a >= LEAST_DOCS).withColumn("w", w).where((w >= LEAST_WEIGHT) & (z >= LEAST_Z)).select("word", "w").collect()
    return {r.word: r.w for r in sorted(found)}


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve; both classes weigh the same."""
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 1.0, -1.0
    for _ in range(50):  # Newton steps, slightly drawn to 0 so that separable classes end too
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(each * (p - y) * x).sum() + 1e-3 * a, (each * (p - y)).sum() + 1e-4 * b])
        h = each * p * (1 - p)
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]]), g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), min(b, -1e-3)


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from a bounded table (doc_id, text, y)."""
    spark = rows.sparkSession

    @F.arrow_udf("binary")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            yield pa.array([sketch(fold_text(t), hashes) for t in texts.to_pylist()], pa.binary())

    found = rows.select("doc_id", "y", sketches("text").alias("s")).collect()
    firsts = set(first_of_copies([(r.doc_id, bytes(r.s)) for r in found]))
    n = Counter(r.y for r in found if r.doc_id in firsts)
    if not n[0] or not n[1]:
        return Lexicon({fold_text(w).strip(): 4.0 for w in GENERAL})
    ids = spark.createDataFrame([(d,) for d in sorted(firsts)], rows.select("doc_id").schema)
    rows = rows.join(F.broadcast(ids), "doc_id")
    lex = Lexicon(word_weights(rows, n))
    seen = rows.select("doc_id", "y", toxicity(F.col("text"), lex, spark).strength.alias("x")).orderBy("doc_id").collect()
    lex.slope, lex.base = curve(np.array([r.x for r in seen]), np.array([r.y for r in seen], float))
    return lex


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    return learn(sample_rows(docs, labels, "toxic", fold_of(5) != 0, PER_CLASS, MAX_CHARS))


def toxicity(text: Column, lexicon: Lexicon, spark: SparkSession) -> Column:
    """A struct of score, hits and strength for a text column."""
    sent = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf("score double, hits int, strength double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lex = sent.value
        for texts in batches:
            rows = [lex.strength(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([lex.score(x) for x, _, _ in rows], pa.float64()), pa.array([n for _, n, _ in rows], pa.int32()), pa.array([x for x, _, _ in rows], pa.float64())],
                names=["score", "hits", "strength"],
            )

    return run(text)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = toxicity(F.col("text"), fit(docs, table(spark, sf_dir, "labels")), spark)
    rows = spread(docs).select("doc_id", t.alias("t"))
    return rows.select("doc_id", (fold_of(5) == 0).alias("held_out"), F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.hits").alias("hits"))
