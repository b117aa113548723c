"""Ranked lexical search over a bit-sliced impact index.

A term is a maximal run of ASCII letters and digits and of any code points beyond ASCII; only A-Z are lower-cased. What
a term adds to a document's score is an integer, its impact; the index holds impacts by block of at most BLOCK
documents, a posting list a term and, over its postings, a bitmap for each bit of the impact. A search spreads the
slices of an item's terms over the block's documents and adds them by bitwise arithmetic: three numbers become a sum
and a carry by XOR and majority, all slices and documents at once, and a ripple of carries ends the addition. The k
best documents are found from the most significant slice down: as long as at least k of the candidates have the slice's
bit, only they stay; else those that have it are in, and the search goes on among the rest. Scores are read off the sums.

The index of a block is one row of a table in the shared folder: first its postings with the frequencies, in one pass
over the texts; the totals that impacts need (documents, terms, documents a term) are aggregated from it. Impacts,
slices and sums are made where a block is read. Items come in groups of bounded size, each of which runs over all
blocks, with postings for the terms of the group alone. A task keeps its k best of each item; they meet by two ranked
windows, the first over pieces of the tasks.

Null and empty texts have no terms: such a document is in no list, such an item finds nothing. Very long texts are taken
whole. Ties: equal scores by ascending doc_id, null last; rows that repeat a doc_id are documents of their own, and so
are equal item ids, whose terms are taken together. Items without a document above 0 have no rows. Empty tables: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, spread, stored, table

#: Documents of a block; a multiple of 64.
BLOCK = 8192
#: Items and different terms that are searched for at a time.
ITEMS, TERMS = 2_000, 200_000
#: Pieces in which the best documents of the tasks are ranked before they meet.
PIECES = 64
_fold = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_fold).split() if text else []


# ---- bit slices


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps of the bits of non-negative integers, least first: a row of packed bytes for each."""
    width = int(values.max()).bit_length() if len(values) else 0
    return np.packbits((values[None, :] >> np.arange(width, dtype=np.int64)[:, None]) & 1, axis=1, bitorder="little").reshape(width, -1)


def spread_out(slices: np.ndarray, places: np.ndarray, words: int, width: int) -> np.ndarray:
    """Slices over ascending places of a block, as ``width`` bitmaps of ``words`` 64-bit words over the whole block."""
    out = np.zeros((width, words), np.uint64)
    if len(places):
        bits = np.unpackbits(slices, axis=1, count=len(places), bitorder="little").astype(np.uint64) << (places & 63).astype(np.uint64)
        word = places >> 6
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[: len(slices), word[starts]] = np.bitwise_or.reduceat(bits, starts, axis=1)
    return out


def added(numbers: list[np.ndarray]) -> np.ndarray:
    """The sums of bit-sliced numbers of one width, which is wide enough for them."""
    total = numbers[0]
    if len(numbers) == 1:
        return total
    carry = numbers[1]
    for x in numbers[2:]:  # three numbers to two: no carry moves further than one slice
        either = total ^ carry
        majority = (total & carry) | (either & x)
        total = either ^ x
        carry = np.zeros_like(majority)
        carry[1:] = majority[:-1]
    out, moved = np.empty_like(total), np.zeros(total.shape[1], np.uint64)
    for k in range(len(total)):  # the last two ripple
        either = total[k] ^ carry[k]
        out[k] = either ^ moved
        moved = (total[k] & carry[k]) | (either & moved)
    return out


def _members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents above 0: those surely among the k best, and those tied for the rest of the places."""
    rest = np.bitwise_or.reduce(sums, axis=0)
    sure = np.zeros_like(rest)
    for one in sums[::-1]:
        high = rest & one
        n = _count(sure) + _count(high)
        if n >= k:
            rest = high
            if n == k:
                break
        else:
            sure |= high
            rest = rest & ~one
    return _members(sure), _members(rest)


def values_at(sums: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = (sums[:, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(sums), dtype=np.int64)[:, None]).sum(axis=0)


# ---- the index

BLOCKS = "block long, ids array<long>, lengths array<long>, terms array<binary>, counts array<int>, places binary, tfs binary"


def index(docs: DataFrame, wanted: set[bytes] | None = None) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text): ids and lengths of the documents that have a term; of each term (of the wanted ones)
    the number of its postings, their places in the block and frequencies, one term after the other.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        lengths: list[int] = []
        found: dict[bytes, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))

        def block() -> pa.RecordBatch:
            nonlocal made
            names = sorted(found)
            join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(np.array(found[t][k], kind) for t in names)]).astype(kind).tobytes()
            columns = [[base + made], [ids], [lengths], [names], [[len(found[t][0]) for t in names]], [join(0, np.uint16)], [join(1, np.int64)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = terms_of(text.as_py())
                if not tokens:
                    continue
                counts, place = Counter(tokens), len(ids)
                for t in counts if wanted is None else counts.keys() & wanted:
                    places, tfs = found[t]
                    places.append(place)
                    tfs.append(counts[t])
                ids.append(doc_id)
                lengths.append(len(tokens))
                if len(ids) == BLOCK:
                    yield block()
                    ids, lengths = [], []
                    found.clear()
        if ids:
            yield block()

    return stored(spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, BLOCKS), "index")


def statistics(blocks: DataFrame) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and of each indexed term the documents that have it."""
    n, length = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("df"))
    return n or 0, length or 0, {bytes(r.terms): r.df for r in pairs.collect()}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


HITS = "item_id long, doc_id long, score long"


def ranked(blocks: DataFrame, items: dict, k: int, stats: tuple[int, int, dict[bytes, int]]) -> DataFrame:
    """(item_id, doc_id, score): of every item the k best documents of each task; items: terms by id."""
    ship(blocks.sparkSession)
    n, length, df = stats
    weights = {t: weight(n, d) for t, d in df.items()}
    asked = blocks.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = asked.value
        found: dict[object, list[tuple[int, bool, int]]] = defaultdict(list)
        for batch in batches:
            for row in range(batch.num_rows):
                _, ids, lengths, terms, counts, places, tfs = (c[row].as_py() for c in batch.columns)
                places, tfs = np.frombuffer(places, np.uint16).astype(np.int64), np.frombuffer(tfs, np.int64)
                m = np.array([10 + 90 * x * n // length for x in lengths], np.int64)
                words = (len(ids) + 63) >> 6
                ends = np.cumsum(counts)
                held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                for t, a, z in zip(terms, ends - counts, ends, strict=True):
                    own = places[a:z]
                    held[t] = own, slices_of(impacts(weights[t], tfs[a:z], m[own]))
                wide: dict[bytes, np.ndarray] = {}
                for item, its in items.items():
                    here = [t for t in its if t in held]
                    if not here:
                        continue
                    # as many slices as the sum of the largest values can need
                    width = sum((1 << len(held[t][1])) - 1 for t in here).bit_length()
                    numbers = []
                    for t in here:
                        own, bits = held[t]
                        if t not in wide and len(wide) < 256:
                            wide[t] = spread_out(bits, own, words, len(bits))
                        one = wide.get(t)
                        if one is None:
                            one = spread_out(bits, own, words, len(bits))
                        numbers.append(np.concatenate([one, np.zeros((width - len(one), words), np.uint64)]))
                    sums = added(numbers)
                    sure, tied = best(sums, k)
                    both = np.concatenate([sure, tied])
                    mine = found[item]
                    mine += [(-int(s), ids[p] is None, ids[p] or 0) for p, s in zip(both, values_at(sums, both), strict=True)]
                    if len(mine) > k:
                        mine.sort()
                        del mine[k:]
        rows = [(item, None if null else doc_id, -s) for item, mine in found.items() for s, null, doc_id in sorted(mine)[:k]]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 10_000], strict=True)], names=["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, HITS)


def groups(items: DataFrame) -> Iterator[dict]:
    """Terms of the items by id, at most ITEMS and about TERMS different terms at a time; items without terms are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, t) for i, text in zip(part["item_id"], part["text"], strict=True) for t in set(terms_of(text))]
            yield pd.DataFrame(rows, columns=["item_id", "term"]).astype({"item_id": "Int64"})

    pairs = items.select(F.col("item_id").cast("long"), "text").mapInPandas(run, "item_id long, term binary")
    pairs = stored(pairs.groupBy("item_id").agg(F.collect_set("term").alias("terms")), "items")
    held: dict = {}
    terms = 0
    for r in pairs.toLocalIterator():
        if held and (len(held) == ITEMS or terms + len(r.terms) > TERMS):
            yield held
            held, terms = {}, 0
        held[r.item_id] = sorted(map(bytes, r.terms))
        terms += len(r.terms)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    found = None
    for group in groups(items):
        blocks = index(docs, set().union(*group.values()))
        hits = ranked(blocks, group, k, statistics(blocks))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("piece", F.spark_partition_id() % PIECES)
    for keys in (["item_id", "piece"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
listed AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM low),
held AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM listed WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS len_ FROM held),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM listed) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
sized AS (SELECT r, doc_id, 100 - 90 + (90 * n * docs) // len_ AS m FROM held, totals),
scored AS (
  SELECT a.item_id, s.r, s.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked a JOIN postings p ON a.term = p.term JOIN weights w ON w.term = p.term JOIN sized s ON s.r = p.r GROUP BY a.item_id, s.r, s.doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0) WHERE rank <= 10
"""
