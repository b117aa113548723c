"""What the operators of this subpackage share: tables, shared storage, words, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white space characters; ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_themescope_sent", False):
        context._themescope_sent = True
        top = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp()}/themescope.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted([*top.rglob("*.py"), *top.rglob("*.txt")]):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, by the modulus; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores (one small file) is dealt out; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/themescope/{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Folders that the open scopes of ``scratch()`` delete, the innermost scope last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose stored tables are deleted at its end, but for those stored with ``keep``, which the scope around it has."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str = "part", keep: bool = False) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark, scopes = df.sparkSession, _scopes.get()
    path = shared_dir(spark)
    scopes = scopes[:-1] if keep else scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(f"{path}/{label}")
    return spark.read.schema(df.schema).parquet(f"{path}/{label}")


#: Keys that are joined by a broadcast at most, and rows of a key from which on.
HOT, FLOOR = 10_000, 256


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key) so that no key, however many rows have it, ends up in one task.

    ``count`` is the number of rows with a key, ``total`` at least the number of all rows. A key with more than
    total / HOT rows (and FLOOR) is hot. There are at most HOT such keys, whatever the table: their part of ``keyed``
    is broadcast, and their rows stay where they are; the others are joined by a shuffle. ``rows`` may have ``count`` too.
    """
    least = max(FLOOR, total // HOT)
    hot, cold = keyed.where(F.col(count) > least), keyed.where(F.col(count) <= least)
    if count in rows.columns:
        many, few = rows.where(F.col(count) > least).drop(count), rows.where(F.col(count) <= least).drop(count)
    else:
        many, few = rows, rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return many.join(F.broadcast(hot), key).unionByName(few.join(cold, key))


def sample_rows(docs: DataFrame, labels: DataFrame, target: str, keep: Column, per_class: int, max_chars: int, max_lines: int | None = None, seed: int = 17) -> DataFrame:
    """At most ``per_class`` labelled documents of each class as (doc_id, text, y), written to the shared folder.

    Ids are chosen by a hash among those that ``keep`` admits. Texts over ``max_chars`` code points or ``max_lines``
    lines only miss the training. Of rows that share a doc_id the least text counts, of labels the greater. Null ids,
    texts and labels are left out.
    """
    ids = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(keep)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    fits = F.length("text") <= max_chars
    if max_lines:
        fits &= F.regexp_count("text", F.lit("\n")) < max_lines
    rows = docs.select("doc_id", "text").where(fits).join(F.broadcast(picked), "doc_id")
    return stored(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), "sample")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, keep: Column, per_class: int, max_chars: int, max_total: int, seed: int = 17) -> list:
    """The rows of sample_rows() on the driver, in the order of doc_id: of each class as many as have ``max_total`` / 2 code points together."""
    rows = sample_rows(docs, labels, target, keep, per_class, max_chars, seed=seed)
    sized = sorted(rows.select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", "y", F.length("text").alias("n")).collect())
    held, wanted = [0, 0], []
    for r in sized:
        held[r.y] += r.n
        if held[r.y] <= max_total // 2:
            wanted.append((r.doc_id,))
    if not wanted:
        return []
    if len(wanted) < len(sized):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, rows.select("doc_id").schema)), "doc_id")
    return sorted((r.doc_id, r.text, r.y) for r in rows.select("doc_id", "text", "y").collect())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 whose output bits depend on every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for at most ``room`` words."""

    def __init__(self, room: int = 1 << 18):
        super().__init__()
        import xxhash

        self.room, self.digest = room, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of ``width`` words, in order with repeats; fewer words make one shingle of all, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        if n < width:
            width = n
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k] + np.uint64(k + 1))
    return h
