"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once; the upper bits of the hash choose one of BINS bins, and each bin keeps the
least of the rest. An empty bin takes the value of the bin that a hash of its number and of the attempt points to,
attempt by attempt until that one is filled (optimal densification), so any two texts choose alike. Of each bin the
lowest BITS bits are stored, packed and written as base64. Two values agree by chance in one of 2^BITS cases; the
likeness (m - c) / (1 - c) with the share m of equal values and c = 2^-BITS corrects that.

Null and empty texts, and those without a word, have the empty fingerprint: like each other (1), unlike the rest
(0). Texts of fewer than five words are one shingle. Very long texts are taken whole. Equal texts have equal
fingerprints, repeated rows each their own row. Ties: rows of one doc_id stand in the order of a hash of their text,
the greatest first; a null doc_id is the last. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, mix64, shingles, stored, table, words

BINS, BITS = 512, 4
#: Bytes of text in a range at most; so many rows tell where to cut, at least and a range.
PART_BYTES, SAMPLE, PER_CUT = 64 << 20, 20_000, 32
#: Cuts are sent to all tasks, 16 bytes each; beyond so many (256 TB of text) ranges grow.
MOST_CUTS = 4_000_000
_EMPTY = np.uint64(2**64 - 1)
_LOW = np.uint64((1 << 55) - 1)
_OWN = mix64(np.arange(1, BINS + 1, dtype=np.uint64))


def bins_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each array of shingle hashes; rows of empty arrays stay empty."""
    out = np.full(len(sets) * BINS, _EMPTY, np.uint64)
    if len(sets):
        owner = np.repeat(np.arange(len(sets), dtype=np.int64) * BINS, [len(s) for s in sets])
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        np.minimum.at(out, owner + (h >> np.uint64(55)).astype(np.int64), h & _LOW)
    return out.reshape(len(sets), BINS)


@lru_cache(8192)
def _way(attempt: int) -> np.ndarray:
    """The bin that each empty bin points to in an attempt."""
    with np.errstate(over="ignore"):
        return (mix64(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) % np.uint64(BINS)).astype(np.int64)


def densify(bins: np.ndarray) -> np.ndarray:
    filled = bins != _EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(1)[:, None])
    out, attempt = bins.copy(), 0
    while len(row):
        to = _way(attempt)[bin_]
        found = filled[row, to]
        out[row[found], bin_[found]] = bins[row[found], to[found]]
        row, bin_, attempt = row[~found], bin_[~found], attempt + 1
    return out


def pack(bins: np.ndarray) -> np.ndarray:
    """Low bits of densified bins, hashed with the bin's number, so that copies agree by chance bin by bin; two values a byte."""
    low = (((bins ^ _OWN) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint8)
    return (low[:, 0::2] << 4) | low[:, 1::2]


def sketch(sets: list[np.ndarray]) -> list[bytes]:
    bins = bins_of(sets)
    packed = pack(densify(bins))
    return [row.tobytes() if len(s) else b"" for row, s in zip(packed, sets, strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = ((x & 15) == 0).sum() + ((x >> 4) == 0).sum()
    c = 2.0**-BITS
    return float(min(1.0, max(0.0, (same / BINS - c) / (1 - c))))


def as_text(fingerprint: bytes) -> str:
    return base64.b64encode(fingerprint).decode()


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for k in range(0, len(texts), 256):
                out += sketch([shingles(hashes.of(words(t))) for t in texts[k : k + 256]])
            yield pa.array([as_text(f) for f in out], pa.string())

    return run(text)


#: Rows with their neighbour: what ``edited`` returns.
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranges(rows: DataFrame, part_bytes: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Cuts between ranges of about as many bytes each, ascending: ids, hashes, and how many of them are of null ids.

    There are at least ``least`` ranges, more if they would be over part_bytes, MOST_CUTS at most. Cuts come from rows
    chosen by hash, SAMPLE at least and PER_CUT a range; these are sorted in ranges of their own, and only sums by range
    and the cuts themselves reach the driver. Only the evenness of the ranges depends on the choice.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    wanted = min(MOST_CUTS + 1, max(least, -(-total // part_bytes)))
    one_in = max(1, n // max(SAMPLE, PER_CUT * wanted))
    sample = rows.select("doc_id", "tie", size.cast("long").alias("size")).where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(one_in)) == 0)
    # rows of one id and hash are equal texts: one row of their sizes together
    sample = sample.groupBy("doc_id", "tie").agg(F.sum("size").alias("size"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie").asc())
    pieces = stored(sample.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "cuts")
    sums = sorted((r.piece, r["size"]) for r in pieces.groupBy("piece").agg(F.sum("size").alias("size")).collect())
    step, before, starts = sum(s for _, s in sums) / wanted, 0, []
    for piece, held in sums:
        starts.append((piece, before))
        before += held
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    start = rows.sparkSession.createDataFrame(starts, "piece int, start long")
    so_far = F.sum("size").over(Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.join(F.broadcast(start), "piece").withColumn("upto", so_far + F.col("start"))
    # a row is a cut if a multiple of the step lies within it
    cuts = placed.where(F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("size")) / step)).select("doc_id", "tie").toArrow()
    known = np.array(cuts["doc_id"].is_valid(), bool)
    ids, ties = cuts["doc_id"].fill_null(0).to_numpy().astype(np.int64), cuts["tie"].to_numpy().astype(np.int64)
    sort = np.lexsort((ties, ids, known))[: wanted - 1]
    return ids[sort], ties[sort], int((~known[sort]).sum())


def part_of(spark: SparkSession, cuts: tuple[np.ndarray, np.ndarray, int]) -> Column:
    """The number of cuts that aren't below (doc_id, tie): parts descend."""
    held = spark.sparkContext.broadcast(cuts)

    @F.arrow_udf("int")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids, ties, nulls = held.value
        for doc_id, tie in batches:
            known = np.array(doc_id.is_valid(), bool)
            x, t = doc_id.fill_null(0).to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False)
            low = np.where(known, nulls + np.searchsorted(ids[nulls:], x, "left"), 0)
            high = np.where(known, nulls + np.searchsorted(ids[nulls:], x, "right"), nulls)
            for k in np.flatnonzero(low < high):  # cuts of the same id
                low[k] += np.searchsorted(ties[low[k] : high[k]], t[k], "left")
            yield pa.array(len(ids) - low, pa.int32())

    return run(F.col("doc_id"), F.col("tie"))


def neighbours(docs: DataFrame, least: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (part, ghost, doc_id, text) in descending order within each part, the part's successor last as a ghost.

    Parts are ranges of (doc_id, hash of the text); the first row of each part, known after one small aggregation, is
    copied to the part before it (that of the first part to the last), so that no row needs more than its part. Each
    part is a partition of its own.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("tie", F.xxhash64("text"))
    cuts = ranges(docs, part_bytes, least)
    rows = docs.select(part_of(spark, cuts).alias("part"), F.lit(False).alias("ghost"), "doc_id", "tie", "text")
    # one row a part: as many as there are cuts, in one window
    tops = stored(rows.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("top")), "tops")
    last = tops.agg(F.max("part")).first()[0]
    spec = tops.select(F.col("part").alias("p"), F.col("top.doc_id").alias("d"), F.col("top.tie").alias("t"), F.coalesce(F.lag("part").over(Window.orderBy("part")), F.lit(last)).alias("to"))
    ghosts = rows.join(F.broadcast(spec), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    ghosts = ghosts.groupBy("to", "d", "t").agg(F.max("text").alias("text")).select(F.col("to").alias("part"), F.lit(True).alias("ghost"), F.col("d").alias("doc_id"), F.col("t").alias("tie"), "text")
    dealt = rows.unionAll(ghosts).repartitionById(len(cuts[0]) + 1, F.col("part"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc_nulls_last())
    return dealt.sortWithinPartitions("part", "ghost", *order).select("part", "ghost", "doc_id", "text")


def edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """EDITED for each row: the text's fingerprint against its edited text's and the next document's."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = neighbours(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        waiting = None  # the last row so far: (part, ghost, doc_id, text)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = list(zip(*columns, strict=True))
            if waiting is not None:
                rows.insert(0, waiting)
            for k in range(0, len(rows) - 1, 256):
                yield _compare(rows[k : k + 257], hashes)
            waiting = rows[-1] if rows else waiting

    return rows.mapInArrow(run, EDITED)


def _compare(rows: list[tuple], hashes: WordHashes) -> pa.RecordBatch:
    """All rows but the last, each with the row after it; a ghost is only ever the row after."""
    texts = [r[3] or "" for r in rows]
    at = [i for i in range(len(rows) - 1) if not rows[i][1]]
    halves = {i: len(texts[i]) // 2 for i in at}
    changed = {i: texts[i][: len(texts[i]) - halves[i]] + texts[i + 1][: halves[i]] for i in at}
    own = sketch([shingles(hashes.of(words(t))) for t in texts])
    new = dict(zip(at, sketch([shingles(hashes.of(words(changed[i]))) for i in at]), strict=True))
    out = [
        (rows[i][2], len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), as_text(own[i]), as_text(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1]))
        for i in at
    ]
    names = [c.split()[0] for c in EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
