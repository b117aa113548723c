"""N-gram Jaccard join by chosen paths: all texts that share at least 0.8 of their five-word shingles.

Equal texts become one node. A node's shingles are embedded as COORDINATES MinHash tokens. In each run, the nodes
are split recursively: a bucket's path decides, for all of its members alike, which one or two coordinates (1.25 on
average, that is 1 / threshold) split it, and members go on together where they share the token. Buckets of at most
SMALL members are compared by brute force. In a larger one all members are compared with a pivot, one of them; if all
are like it the bucket is done, else it is split further, without those that are so like the pivot that none of the
rows unlike it can be linked to them. Runs are repeated until the chance that a pair at the threshold, whose sketch is by
chance better or worse, stays together in some run down to the deepest level that a bucket of it reached is RECALL:
first for DEPTH levels, then, among the nodes of deeper buckets, for as many as those reached. (A pair with a node
that no deep bucket held has been together as long as it had to.) No step makes pairs of rows: each bucket yields at
most one candidate edge a member, and a bucket's members never meet in one task unless they are few.

Candidate edges form components, by star contraction. Inside each, every two nodes whose sizes allow a link are
compared exactly, on their whole shingle sets: components of up to BLOCK nodes in one task, larger ones in pairs of
blocks, whose tasks return numbers of links and a spanning forest of them. So a pair that no path found is still found
through a third text. Pivots of large buckets, hubs, classes and copies that many rows share are joined without a shuffle.

Results: for each document the smallest doc_id of its class (texts connected by links), the smallest doc_id with an
equal text, the number of rows with an equal text, and the number of different texts linked to it.

Null counts as the empty text. Texts without a word have no shingles: equal to their copies, linked to none. Fewer
than five words make one shingle. Very long texts are taken whole. Repeated rows are copies. Rows with a null doc_id
are documents too, but name a class only if none of it has one. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, join_counted, mix64, scratch, shingles, spread, stored, table, words

THRESHOLD, WIDTH, COORDINATES = 0.8, 5, 64
#: Members of a bucket compared by brute force, levels split before buckets are counted, levels up to which the first runs reach the target recall and beyond which candidates are chosen loosely.
SMALL, STEP, DEPTH, RECALL = 256, 2, 4, 0.99
#: Share of equal coordinates from which a pair is a candidate: 4 standard errors below the threshold.
GATE = 0.6
#: GATE beyond DEPTH and in the further runs: what shares a large bucket there becomes a candidate sooner; the exact comparison decides.
LOOSE = 0.4
#: Nodes of a component that meet in one task; columns of its incidence matrix at a time.
BLOCK, COLUMNS = 256, 8192
#: Edges that a task reduces to stars at a time.
CHUNK = 1 << 17
#: Bits for each text that is wanted again in the map that tells so; binary logarithm of the most bits, 128 MB.
BITS_EACH, MOST_BITS = 16, 30

_factors = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def survival(depth: int, likeness: float = THRESHOLD) -> float:
    """The chance that two sets of this likeness share some path of so many levels."""
    extra, s = 1 / THRESHOLD - 1, 1.0
    for _ in range(depth):
        q = 1 - likeness * s
        s = 1 - ((1 - extra) * q + extra * q * q)
    return s


def recall_of(runs: int, depth: int) -> float:
    """The chance that a pair at the threshold becomes a candidate in so many runs of this depth, over all sketches it may have."""
    total = 0.0
    for k in range(math.ceil(GATE * COORDINATES), COORDINATES + 1):
        chance = math.comb(COORDINATES, k) * THRESHOLD**k * (1 - THRESHOLD) ** (COORDINATES - k)
        total += chance * (1 - (1 - survival(depth, k / COORDINATES)) ** runs)
    return total


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    return next(r for r in itertools.count(1) if recall_of(r, depth) >= recall)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(words(text)), WIDTH))


def signature(s: np.ndarray) -> np.ndarray:
    """The upper half of the least hash of each coordinate."""
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 4096):
            low = np.minimum(low, (s[k : k + 4096, None] * _factors).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def split(keys: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the buckets ``keys`` that rows with signatures ``sig`` go to: row numbers and new keys."""
    with np.errstate(over="ignore"):
        u = mix64(keys + np.uint64(0x51ED270B))
        first = (u % np.uint64(COORDINATES)).astype(np.int64)
        again = np.flatnonzero((u >> np.uint64(40)) < np.uint64(int((1 / THRESHOLD - 1) * (1 << 24))))
        second = (first[again] + 1 + (mix64(u[again]) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        rows = np.concatenate([np.arange(len(keys)), again])
        at = np.concatenate([first, second])
        token = (at.astype(np.uint64) << np.uint64(32)) | sig[rows, at].astype(np.uint64)
        return rows, mix64(keys[rows] * np.uint64(0x9E3779B97F4A7C15) + mix64(token))


def _sigs(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def nodes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, copy), stored to outlive the scope, and nodes (copy, at, doc, copies, n, sig), stored; at: the doc_id of one row with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, sig = [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, hashes)
                n.append(len(s))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "copy", "n", "sig"])

    rows = stored(with_copy(docs).mapInArrow(run, "doc_id long, copy binary, n long, sig binary"), "rows", keep=True)
    some = F.min(F.struct("doc_id", "n", "sig"))
    nodes = rows.groupBy("copy").agg(some.alias("m"), F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    return rows.select("doc_id", "copy"), stored(nodes.select("copy", F.col("m.doc_id").alias("at"), "doc", "copies", "m.n", "m.sig"), "nodes")


def with_copy(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("copy"))


# ---- candidates


def _first_paths(nodes: DataFrame, runs: range, levels: int) -> DataFrame:
    """(key, copy) after so many levels of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, names = _sigs(b.column("sig")), b.column("copy")
            for r in runs:
                rows, keys = _descend(np.full(len(sig), mix64(np.array([r + 1], np.uint64))[0]), sig, levels)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), names.take(pa.array(rows))], names=["key", "copy"])

    return nodes.where("n > 0").select("copy", "sig").mapInArrow(run, "key long, copy binary")


def _descend(keys: np.ndarray, sig: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys after so many levels."""
    rows = np.arange(len(sig))
    for _ in range(levels):
        at, keys = split(keys, sig[rows])
        rows = rows[at]
    return rows, keys


def _next_paths(rows: DataFrame) -> DataFrame:
    """(key, copy, sig) STEP levels on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = _descend(b.column("key").to_numpy().view(np.uint64), _sigs(b.column("sig")), STEP)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column("copy").take(at), b.column("sig").take(at)], names=["key", "copy", "sig"])

    return rows.select("key", "copy", "sig").mapInArrow(run, "key long, copy binary, sig binary")


def _forest(names: list[bytes], near: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(member, least name of its component) of a graph, for members other than that one."""
    order = sorted(range(len(names)), key=names.__getitem__)
    near = near[np.ix_(order, order)] | np.eye(len(names), dtype=bool)
    label = np.arange(len(names))
    while True:
        new = np.where(near, label, len(names)).min(1)
        if (new == label).all():
            return [(names[order[i]], names[order[k]]) for i, k in enumerate(label) if i != k]
        label = new


def _compare_small(rows: DataFrame) -> DataFrame:
    """Candidate edges (u, v) in buckets (key, copy, sig) of at most SMALL rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[bytes, bytes]] = set()
            for members in b.column(0).to_pylist():
                names = [m["copy"] for m in members]
                sig = np.frombuffer(b"".join(m["sig"] for m in members), "<u4").reshape(-1, COORDINATES)
                near = (sig[:, None, :] == sig[None, :, :]).mean(2) >= GATE
                found.update(_forest(names, near))
            if found:
                u, v = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    grouped = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("copy", "sig"))).alias("m"))
    return grouped.select("m").distinct().mapInArrow(run, "u binary, v binary")  # runs find the same groups again


def _pivot() -> Column:
    """The member that comes first in an order by chance, the same for all buckets: in those of one group of copies it
    is mostly the same one, and their edges fall together."""
    return F.min(F.struct(F.xxhash64("copy").alias("chance"), "copy", "sig")).alias("p")


def _shares(rows: DataFrame) -> DataFrame:
    """Rows (key, copy, sig, size, p) of large buckets with the share of coordinates they have in common with the pivot p."""

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((_sigs(a) == _sigs(b)).mean(1))

    return rows.select("key", "copy", "sig", "size", F.col("p.copy").alias("pivot"), alike("sig", "p.sig").alias("share"))


def _edges_of(nodes: DataFrame, runs: range, reach: int) -> tuple[list[DataFrame], list[DataFrame], int, DataFrame | None]:
    """Of some runs: candidate edges (u, v), buckets (key, copy, sig) to compare, the deepest level of one, and the nodes of buckets beyond ``reach``."""
    sigs = nodes.select("copy", "sig")
    first = STEP if reach == DEPTH else DEPTH + STEP  # nodes of deep buckets first part beyond DEPTH
    level, depth = stored(_first_paths(nodes, runs, first), "paths"), first
    edges: list[DataFrame] = []
    small: list[DataFrame] = []
    deep = None
    while True:  # members that are unlike part at each level with a chance of 0.4 or more, so the levels end
        size = F.count(F.lit(1)).alias("size")
        keyed = level.groupBy("key").agg(*([size] if depth == first else [size, _pivot()])).where("size > 1")
        rows = join_counted(level, stored(keyed, "sizes"), "key", "size", level.count())
        rows = stored(rows.join(sigs, "copy") if depth == first else rows, "buckets")
        if depth > reach and deep is None:
            deep = rows.select("copy").distinct()  # deeper buckets hold no others
        small.append(rows.where(F.col("size") <= SMALL).select("key", "copy", "sig"))
        large = rows.where(F.col("size") > SMALL)
        total = large.count()
        if not total:
            return edges, small, depth, deep
        if depth == first:
            large = join_counted(large, large.groupBy("key").agg(_pivot(), size), "key", "size", total)
        seen = stored(_shares(large), "pivots")
        gate = GATE if depth <= DEPTH == reach else LOOSE
        edges.append(seen.where((F.col("share") >= gate) & (F.col("copy") != F.col("pivot"))).select(F.col("copy").alias("u"), F.col("pivot").alias("v")))
        # a bucket whose members are all like the pivot ends here; others go on without the rows that have no pair over
        # GATE with one that is unlike it: shares differ by less than what the two don't have in common
        unlike = seen.groupBy("key").agg(F.max(F.when(F.col("share") < gate, F.col("share"))).alias("nearest"), F.max("size").alias("size")).where("nearest is not null")
        on = join_counted(seen.where(F.col("share") < gate + 1 - GATE), unlike, "key", "size", total).where(F.col("share") <= F.col("nearest") + (1 - GATE) + 1e-9)
        level, depth = stored(_next_paths(on), "paths"), depth + STEP


def candidates(nodes: DataFrame, runs: int | None = None) -> DataFrame:
    """Edges (u, v) between nodes that some path brought together and whose signatures are alike."""
    done, want, reach = 0, runs or runs_for(), DEPTH
    edges: list[DataFrame] = []
    small: list[DataFrame] = []  # of all runs and levels, so that they are dealt out once: keys of no two of them are the same
    with scratch(nodes.sparkSession):
        while done < want:
            found, buckets, depth, deep = _edges_of(nodes, range(done, want), reach)
            edges += found
            small += buckets
            done = want
            if runs is None and deep is not None:
                want, reach = max(want, runs_for(depth=depth)), max(reach, depth)
                nodes = stored(nodes.join(deep, "copy", "left_semi"), "deep")
                if nodes.isEmpty():
                    break
        return stored(reduce(DataFrame.unionAll, [_compare_small(reduce(DataFrame.unionAll, small)), *edges]).distinct(), "edges", keep=True)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, of the same components, fewer: of every CHUNK edges of a task only stars around the least nodes."""

    def stars(chunk: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        for u, v in chunk:
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
        found = [(x, top(x)) for x in list(above)]
        found = [(x, y) for x, y in found if x != y]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple[bytes, bytes]] = []
        for b in batches:
            chunk += zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)
            if len(chunk) >= CHUNK:
                yield stars(chunk)
                chunk = []
        yield stars(chunk)

    return edges.select("u", "v").mapInArrow(run, "u binary, v binary")


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("node"), "v", F.lit(0).alias("hub")).unionAll(e.select(F.col("v").alias("node"), F.lit(None).cast("binary").alias("v"), F.lit(1).alias("hub")))
    return ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("hub").alias("hub")).where("low <> high or (low is not null and hub > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, least): each node of the edges (u, v) and the least of its component, by alternating large and small stars.

    Edges are first reduced where they lie, then, if few are left in each piece, once more in pieces of about CHUNK.
    Tables of least neighbours are stored, so that each star is a plan of its own.
    """
    e = stored(_contracted(edges), "pairs")
    pieces = -(-e.count() // CHUNK)
    if pieces < e.rdd.getNumPartitions():
        e = stored(_contracted(e.coalesce(max(1, pieces))), "fewer")
    low = lambda rows: rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    while not _are_stars(e):
        total = 2 * e.count()
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = stored(low(e.unionAll(turned)).withColumn("m", F.least("m", "u")), "large")
        e = stored(join_counted(turned, least, "u", "degree", total).select(F.col("v").alias("u"), F.col("m").alias("v")), "large_stars")  # v > u >= m
        least = stored(low(e), "small")
        small = join_counted(e, least, "u", "degree", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stored(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    e = e.distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("least")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())


# ---- exact links


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two of the sets are alike."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # tokens of one set alone take no part
    on = count[token] > 1
    token, owner = place[token[on]], owner[on]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    inter = np.zeros((len(sets), len(sets)), np.float64)
    total = int(place[-1]) + 1 if len(place) else 0
    for k in range(0, total, COLUMNS):
        a, b = np.searchsorted(token, [k, k + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, total - k)), np.float32)
        x[owner[a:b], token[a:b] - k] = 1
        inter += x @ x.T
    union = sizes[:, None] + sizes[None, :] - inter
    near = inter >= threshold * union - 1e-9
    np.fill_diagonal(near, False)
    return near


def _bits(hashes: DataFrame, total: int) -> tuple[np.ndarray, int]:
    """A bit map of the ``total`` rows (h) and the binary logarithm of its bits: BITS_EACH a row, so that one text in so many
    passes without being wanted, up to MOST_BITS; beyond, the map is fuller and more pass, which a join then drops.
    """
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(total, 1) * BITS_EACH))))
    place = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) % 64 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out, bits


def _blocks(found: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Members (node, least) of components with their block b, and others: the blocks with which b is compared.

    In a component of more than BLOCK nodes, sets are parted into classes of size, each a little wider than the
    threshold allows two linked sets to differ, and classes by hash into blocks of about BLOCK; a block is compared
    with those of its own class and of the two beside it.
    """
    total = found.count()
    sizes = found.groupBy("least").agg(F.count(F.lit(1)).alias("size"))
    members = join_counted(found, sizes, "least", "size", total).join(nodes.select(F.col("copy").alias("node"), "at", "n"), "node")
    kind = F.when(F.col("size") > BLOCK, F.floor(F.log(F.col("n")) / -math.log(threshold - 0.01))).otherwise(0).cast("long")
    members = stored(members.select("node", "least", "at", F.struct("least", kind.alias("kind")).alias("class")), "sized")
    classes = members.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    beside = lambda k, name: classes.select(F.struct(F.col("class.least").alias("least"), (F.col("class.kind") + k).alias("kind")).alias("class"), F.col("blocks").alias(name))
    classes = classes.join(beside(1, "under"), "class", "left").join(beside(-1, "over"), "class", "left")
    members = join_counted(members, classes, "class", "rows", total)

    def numbers(k: int, blocks: str) -> Column:
        """Blocks of a class: its number in the upper half, theirs in the lower."""
        first = F.shiftleft(F.col("class.kind") + k, 32)
        return F.when(F.col(blocks) > 0, F.sequence(first, first + F.col(blocks) - 1)).otherwise(F.array().cast("array<long>"))

    b = F.shiftleft(F.col("class.kind"), 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    return stored(members.select("node", "least", "at", b.alias("b"), F.concat(numbers(0, "blocks"), numbers(-1, "under"), numbers(1, "over")).alias("others")), "members")


def exact_links(docs: DataFrame, nodes: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(copy, links) and edges (u, v) of a spanning forest of the links, from the components ``found`` (node, least)."""
    members = _blocks(stored(found, "found"), nodes, threshold)
    wanted, width = _bits(members.select(F.xxhash64("node", "at").alias("h")), members.count())
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), sent.value
        for b in batches:
            place = b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - width)
            on = pa.array((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool))
            b = b.filter(on)
            out = [shingle_set(t, hashes).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(out, pa.binary())], names=["doc_id", "copy", "shingles"])

    texts = with_copy(docs).withColumn("h", F.xxhash64("copy", "doc_id"))
    texts = texts.select("doc_id", "copy", "h", "text").mapInArrow(sets, "doc_id long, copy binary, shingles binary")
    rows = texts.join(members, (texts["copy"] == members.node) & texts.doc_id.eqNullSafe(members["at"])).dropDuplicates(["copy"])
    rows = rows.select("node", "least", "b", "shingles", F.explode("others").alias("o")).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    dealt = rows.select("least", "i", "j", "b", "node", "shingles").repartition("least", "i", "j").sortWithinPartitions("least", "i", "j", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def close() -> None:
            if len(held) > 1:
                near = _links([np.frombuffer(s, np.uint64) for _, _, s in held], threshold)
                if key[1] != key[2]:
                    side = np.array([b for b, _, _ in held])
                    near &= side[:, None] != side[None, :]
                names = [n for _, n, _ in held]
                least = dict(_forest(names, near))
                out.extend((n, int(k), least.get(n)) for n, k in zip(names, near.sum(1), strict=True) if k)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["copy", "links", "v"])

        for b in batches:
            for least, i, j, block, node, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (least, i, j) != key:
                    close()
                    held, key = [], (least, i, j)
                    if len(out) > 5000:
                        yield batch()
                        out.clear()
                held.append((block, node, s))
        close()
        if out:
            yield batch()

    links = stored(dealt.mapInArrow(compare, "copy binary, links long, v binary"), "links")
    return links.groupBy("copy").agg(F.sum("links").alias("links")), links.where("v is not null").select(F.col("copy").alias("u"), "v")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links for every row of ``docs`` (doc_id, text), and copy, the text's digest."""
    if threshold < THRESHOLD:
        raise ValueError(f"runs and gates are made for {THRESHOLD} or more, a smaller threshold would lose pairs")
    docs = spread(docs.select("doc_id", "text"))
    with scratch(docs.sparkSession):
        rows, nodes = nodes_of(docs)
        counts, edges = exact_links(docs, nodes, components(candidates(nodes)), threshold)
        least = components(edges)
        named = nodes.select("copy", "doc", "copies").join(least.withColumnRenamed("node", "copy"), "copy", "left").join(counts, "copy", "left")
        named = named.select("copy", "doc", "copies", F.coalesce("least", "copy").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
        named = stored(named, "classes")
        classes = named.groupBy("class").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "copy")).alias("c"), F.count(F.lit(1)).alias("texts"))
        named = join_counted(named, classes, "class", "texts", named.count()).select("copy", F.col("c.doc").alias("class_id"), F.col("doc").alias("copy_id"), F.col("copies").alias("n_copies"), F.col("links").cast("long").alias("n_links"), F.col("c.copy").alias("class_copy"))
        return join_counted(rows, stored(named, "named", keep=True), "copy", "n_copies", rows.count())


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")

