"""Exact duplicates by an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text (A-Z lower-cased, nothing else). The upper bits of a key name its range;
every range has an owner, a task that gets all rows of the range. An owner holds a directory over the lower bits of the
keys: 2^depth pointers to buckets of at most CAP keys. A bucket that would hold more is split by one more bit, and the
directory doubles where the bucket was as deep as it. Texts of one key form a chain in which every text that arrives is
compared byte by byte, so texts that only share a hash stay apart. The buckets go to files in the shared folder, a row
an entry, with the text that later rows are compared with: ``lookup()`` finds the entries of other documents.

A key that very many rows have (counted before) is dealt out over salts, about as many as the square root of its
rows; each salted owner makes an index of its own, and the few entries of these are merged by a second round of
owners, in the same structure. So no task gets more than about the square root of a group, in either round.

Null is the empty text. Empty and very long texts are texts like others. Of equal texts the row with the largest doc_id
stays, null being smaller than any; of rows that are equal in the id too, one stays. Empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, spread, stored, table

#: Keys of a bucket at most.
CAP = 32
#: Bits that a directory looks at, at most: keys that share more of them stay in one bucket, whatever their number.
MOST_DEPTH = 16
#: Bytes in a range, about: its texts and what a row takes beside its text.
RANGE_BYTES, ROW_BYTES = 32 << 20, 64
#: Keys that are salted at most, and rows of a key from which on.
HOT, FLOOR = 100_000, 256


def normalised(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def key_of(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def text_key(text: Column) -> Column:
    """The key of a text column, and the bytes of its text."""

    @F.arrow_udf("key long, bytes long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            low = normalised(batch)
            yield pa.StructArray.from_arrays([pa.array([key_of(t.as_buffer()) for t in low], pa.int64()), pc.cast(pc.binary_length(low), pa.int64())], names=["key", "bytes"])

    return run(text)


class Entry:
    """A text, the largest id that has it and how many rows have; ``best`` is the row that stays."""

    __slots__ = ("best", "chain", "count", "data", "digest", "keep", "key")

    def __init__(self, key: int, data: bytes, chain: int):
        self.key, self.data, self.chain, self.keep, self.best, self.count = key, data, chain, None, None, 0
        self.digest = hashlib.sha256(data).hexdigest()

    def add(self, doc_id: int | None, row: int, count: int = 1) -> None:
        """Rows of this text, the largest id among them being ``doc_id``, in row number ``row``; null is the smallest id."""
        self.count += count
        if self.best is None or (doc_id is not None and (self.keep is None or doc_id > self.keep)):
            self.keep, self.best = doc_id, row


class Bucket:
    __slots__ = ("chains", "depth")

    def __init__(self, depth: int):
        self.depth, self.chains = depth, {}


class Directory:
    """An extendible-hash index of texts: ``cap`` keys a bucket, a chain of different texts a key."""

    def __init__(self, cap: int = CAP):
        self.cap, self.depth, self.pointers = cap, 0, [Bucket(0)]

    def place(self, key: int) -> int:
        return key & ((1 << self.depth) - 1)

    def entry(self, key: int, data: bytes) -> Entry:
        """The entry of a text, made if there is none."""
        while True:
            bucket = self.pointers[self.place(key)]
            chain = bucket.chains.get(key)
            if chain is not None:
                for e in chain:
                    if e.data == data:
                        return e
                chain.append(Entry(key, data, len(chain)))
                return chain[-1]
            if len(bucket.chains) < self.cap or bucket.depth == MOST_DEPTH:
                bucket.chains[key] = [Entry(key, data, 0)]
                return bucket.chains[key][0]
            self.split(self.place(key))

    def find(self, key: int, data: bytes) -> Entry | None:
        return next((e for e in self.pointers[self.place(key)].chains.get(key, ()) if e.data == data), None)

    def split(self, place: int) -> None:
        """The bucket at a place gives its keys to two buckets that look at one more bit."""
        old = self.pointers[place]
        if old.depth == self.depth:
            self.pointers += self.pointers
            self.depth += 1
        halves = Bucket(old.depth + 1), Bucket(old.depth + 1)
        for key, chain in old.chains.items():
            halves[key >> old.depth & 1].chains[key] = chain
        for k in range(place & ((1 << old.depth) - 1), len(self.pointers), 1 << old.depth):
            self.pointers[k] = halves[k >> old.depth & 1]

    def buckets(self) -> Iterator[tuple[int, Bucket]]:
        """Each bucket once, with the lower bits that its keys share."""
        for k, b in enumerate(self.pointers):
            if k < 1 << b.depth:
                yield k, b


#: Rows of an index: entries (is_entry) have bucket, depth, text and digest; members name the entry of their row.
INDEX = "is_entry boolean, doc_id long, best boolean, key long, salt int, chain int, keep_id long, group_size long, bucket long, depth int, text binary, text_sha256 string"
_TYPES = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of at most 10,000 rows and about 16 MB of text."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

    for r in rows:
        held.append(r)
        size += len(r[10] or b"")
        if len(held) == 10_000 or size > 16 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def ranges_of(total_bytes: int, least: int) -> int:
    """Number of ranges: a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, least, total_bytes / RANGE_BYTES))))


def owner(bits: int) -> Column:
    """The range of a key: its upper bits; a salted key goes elsewhere with each salt."""
    upper = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    return F.when(F.col("salt") < 0, upper).otherwise(F.pmod(F.xxhash64("key", "salt"), F.lit(1 << bits))).cast("int")


def hot_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """(hot_key, salts) of the keys that many rows have, at most HOT; the bytes of all rows."""
    found = spread(docs.select("text")).select(text_key(F.col("text")).alias("k")).select("k.key", F.col("k.bytes").alias("bytes"))
    counted = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bytes") + ROW_BYTES).alias("bytes")), "keys")
    rows, total = counted.agg(F.sum("n"), F.sum("bytes")).first()
    least = max(FLOOR, (rows or 0) // HOT)
    return counted.where(F.col("n") > least).select(F.col("key").alias("hot_key"), F.ceil(F.sqrt("n")).cast("int").alias("salts")), total or 0


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to ``path`` or the shared folder; ``resolved()`` and ``lookup()`` read it."""
    spark = docs.sparkSession
    ship(spark)
    hot, total = hot_keys(docs)
    bits = int(math.log2(ranges_of(total, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    keyed = spread(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("key", text_key(F.col("text"))["key"])
    # the salt of a row is that of its place in its partition: rows of one key are dealt out evenly, whatever their ids
    salted = keyed.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")), F.lit(-1)).cast("int"))
    rows = salted.select("doc_id", "text", "key", "salt").repartitionById(1 << bits, owner(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Directory] = {}
        members: list[tuple[int | None, int, Entry]] = []
        for b in batches:
            for doc_id, data, key, salt in zip(b.column(0).to_pylist(), normalised(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                e = own.setdefault(salt, Directory()).entry(key, data.as_buffer().to_pybytes())
                e.add(doc_id, len(members))
                members.append((doc_id, salt, e))

        def out() -> Iterator[tuple]:
            for salt, directory in own.items():
                for place, bucket in directory.buckets():
                    for chain in bucket.chains.values():
                        for e in chain:
                            yield True, None, None, e.key, salt, e.chain, e.keep, e.count, place, bucket.depth, e.data, e.digest
            for k, (doc_id, salt, e) in enumerate(members):
                yield False, doc_id, e.best == k, e.key, salt, e.chain, e.keep, e.count, None, None, None, e.digest

        yield from _batches(out())

    made = rows.mapInArrow(run, INDEX)
    if path is None:
        return stored(made, "index")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def merged(index: DataFrame) -> DataFrame:
    """(key, salt, chain, keep_id, group_size, first) of the salted entries: what all entries of the same text have together;
    ``first`` marks the entry whose best row stays.
    """
    rows = index.where("is_entry AND salt >= 0").select("key", "salt", "chain", "keep_id", "group_size", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, seen = Directory(), []
        for b in batches:
            for key, salt, chain, keep, size, data in zip(*(b.column(k).to_pylist() for k in range(5)), b.column(5), strict=True):
                e = directory.entry(key, data.as_buffer().to_pybytes())
                e.add(keep, len(seen), size)
                seen.append((key, salt, chain, e))
        rows = [(key, salt, chain, e.keep, e.count, e.best == k) for k, (key, salt, chain, e) in enumerate(seen)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), kinds, strict=True)], names=["key", "salt", "chain", "keep_id", "group_size", "first"])

    return rows.repartition("key").mapInArrow(run, "key long, salt int, chain int, keep_id long, group_size long, first boolean")


def resolved(index: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each document of the index."""
    members = index.where("NOT is_entry").select("doc_id", "best", "key", "salt", "chain", "keep_id", "group_size", "text_sha256")
    plain = members.where("salt < 0").select("doc_id", "keep_id", "group_size", F.col("best").alias("kept"), "text_sha256")
    salted = members.where("salt >= 0").drop("keep_id", "group_size").join(merged(index), ["key", "salt", "chain"])
    return plain.unionByName(salted.select("doc_id", "keep_id", "group_size", (F.col("best") & F.col("first")).alias("kept"), "text_sha256"))


def lookup(index: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size): for each of ``docs`` (doc_id, text) the row of the index that has its text, compared by bytes; null if none.

    Documents go to the owner of their key's range, with the entries of that range. Keys that many of them have are
    dealt out over salts, and each salt gets the key's entries.
    """
    spark = docs.sparkSession
    ship(spark)
    hot, total = hot_keys(docs)
    bits = int(math.log2(ranges_of(total, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    held = index.where("is_entry").select(F.lit(True).alias("is_entry"), F.lit(None).cast("long").alias("doc_id"), "key", "text", "keep_id", "group_size")
    held = held.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))))
    asked = spread(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("key", text_key(F.col("text"))["key"]).join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    asked = asked.select(F.lit(False).alias("is_entry"), "doc_id", "key", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")), F.lit(-1)).cast("int").alias("salt"))
    rows = held.select(*asked.columns).unionByName(asked).repartitionById(1 << bits, owner(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Directory] = {}
        waiting = []
        for b in batches:
            for is_entry, doc_id, key, data, keep, size, salt in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if is_entry:
                    own.setdefault(salt, Directory()).entry(key, data).add(keep, 0, size)
                else:
                    waiting.append((doc_id, key, data.lower(), salt))
        rows = []
        for doc_id, key, data, salt in waiting:
            e = own[salt].find(key, data) if salt in own else None
            rows.append((doc_id, e and e.keep, e and e.count))
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 10_000], strict=True)], names=["doc_id", "keep_id", "group_size"])

    return rows.mapInArrow(run, "doc_id long, keep_id long, group_size long")


def op11_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(build(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH rows_ AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM rows_
"""
