"""Byte-level BPE encoding and decoding with numpy, by a rank file of the tiktoken form.

Each match of the splitting pattern is merged by itself: as long as some neighbouring pair of tokens is itself a
token, the leftmost of those with the lowest rank becomes one. New pieces of a batch are sorted into length
buckets, each a padded matrix with a row a piece; in every round each row makes its one merge, looked up in a hash
table of pairs, and rows that have no pair left are taken out. Pieces repeat, so their ids are kept for later
batches, in a table of bounded size. A piece over LONGEST bytes (a run of one kind of character) is merged with a
heap instead, in n log n steps, to the same ids.

Null and empty texts: no ids, decoded to the empty text. Texts are encoded whole, whatever their length. Special
tokens don't exist here: their strings are ordinary text. Repeated rows are encoded each. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

#: Bytes up to which a piece is merged in a matrix; pieces kept for later batches in a worker.
LONGEST, ROOM = 512, 150_000
NONE = np.int32(2**31 - 1)


def public(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of an installed rank file and the splitting pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Pairs:
    """Hash table from two token ids to the id of their concatenation: open addressing, linear probing, half full."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        found = [(a, b, i) for t, i in rank.items() for k in range(1, len(t)) if (a := rank.get(t[:k])) is not None and (b := rank.get(t[k:])) is not None]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(2 * len(found)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, NONE, np.int32)
        key = (left << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # each round one of the keys that want a free slot gets it
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]
            won = self.keys[at] == key[todo]
            self.made[at[won]] = made[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the two make no token or one is padding (negative)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[todo].astype(np.int64) << 32) | right[todo]
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.made[slot[hit]]
            on = ~hit & (there != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)

    def one(self, left: int, right: int) -> int:
        return int(self.of(np.array([left]), np.array([right]))[0])


class Codec:
    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.cut = regex.compile(pattern).findall
        self.pairs = Pairs(self.tokens)
        self.byte_ids = np.array([self.tokens.index(bytes([b])) for b in range(256)], np.int32)
        self.widths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        numbers = [b"%d " % i for i in range(len(self.tokens))]
        self.number_widths = np.array([len(n) for n in numbers], np.int64)
        self.number_starts = np.cumsum(self.number_widths) - self.number_widths
        self.numbers = np.frombuffer(b"".join(numbers), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    # one matrix

    def merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a matrix of byte ids, padded with -1."""
        out: list[np.ndarray] = [ids[:0, 0]] * len(ids)
        rows, ranks = np.arange(len(ids)), self.pairs.of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ranks.shape[1] == 0:
                at, low = None, np.full(len(rows), NONE)
            else:
                at = ranks.argmin(1)  # the first of equal ranks
                low = ranks[np.arange(len(rows)), at]
            done = low == NONE
            if done.any():
                ended = ids[done]
                sizes = (ended >= 0).sum(1)
                for r, row, n in zip(rows[done], ended, sizes, strict=True):
                    out[r] = row[:n]
                on = ~done
                if not on.any():
                    break
                rows, ids, ranks, at, low = rows[on], ids[on], ranks[on], at[on], low[on]
            width = ids.shape[1]
            each = np.arange(len(rows))
            ids[each, at] = low
            past = np.arange(width - 1)[None, :] > at[:, None]
            ids = np.where(past, ids[:, 1:], ids[:, :-1])
            ranks = np.where(past[:, :-1], ranks[:, 1:], ranks[:, :-1])
            # only the pairs at both sides of the new token change
            if ids.shape[1] > 1:
                has = at < ids.shape[1] - 1
                ranks[each[has], at[has]] = self.pairs.of(ids[each[has], at[has]], ids[each[has], at[has] + 1])
                has = at > 0
                ranks[each[has], at[has] - 1] = self.pairs.of(ids[each[has], at[has] - 1], ids[each[has], at[has]])
            full = int((ids >= 0).sum(1).max())
            ids, ranks = ids[:, :full], ranks[:, : max(0, full - 1)]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, version = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
        first = self.pairs.of(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, 0, 0) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, vi, vj = heapq.heappop(heap)
            j = after[i] if version[i] == vi else n
            if j >= n or version[j] != vj:
                continue
            ids[i], version[i], version[j] = rank, vi + 1, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.pairs.one(ids[a], ids[b])) != NONE:
                    heapq.heappush(heap, (r, a, version[a], version[b]))
        return np.array([x for x, v in zip(ids, version, strict=True) if v >= 0], np.int32)

    # batches

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that aren't known yet, bucket by bucket."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        edge = 0
        for top in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, LONGEST):
            mine = np.flatnonzero((sizes > edge) & (sizes <= top))
            edge = top
            for part in np.array_split(mine, max(1, len(mine) * top // (1 << 21))):
                if len(part):
                    n = sizes[part]
                    grid = np.full((len(part), top), -1, np.int32)
                    grid[np.arange(top)[None, :] < n[:, None]] = self.byte_ids[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
                    for i, row in zip(part, self.merge(grid), strict=True):
                        ids[i] = row
        for i in np.flatnonzero(sizes > LONGEST):
            ids[i] = self.merge_long(raw[i])
        count = np.array([len(x) for x in ids], np.int64)
        new = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.known.update(zip(pieces, range(len(self.count), len(self.count) + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all their ids."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > ROOM:
            self.forget()
        fresh = set().union(*cut).difference(self.known) if cut else set()
        if fresh:
            self.learn(sorted(fresh))
        at = np.fromiter((self.known[p] for ps in cut for p in ps), np.int64, sum(map(len, cut)))
        flat, ends = gather(self.flat, self.start[at], self.count[at])
        ends = np.concatenate([[0], ends])
        return ends[np.concatenate([[0], np.cumsum([len(ps) for ps in cut])]).astype(np.int64)], flat

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all their bytes."""
        flat, ends = gather(self.bytes, self.starts[ids], self.widths[ids])
        return np.concatenate([[0], ends])[offsets], flat

    def spell(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all their ids in decimal digits, with a space after each."""
        flat, ends = gather(self.numbers, self.number_starts[ids], self.number_widths[ids])
        return np.concatenate([[0], ends])[offsets], flat


def gather(source: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """source[start : start + count] of each one after another, and where each ends."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(start - ends + count, count)
    return source[at], ends


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process and rank file."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(path, pattern)
    return _codecs[key]


def _parts(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters or ids."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += t
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _sizes(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of ids."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            offsets, ids, base = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], 0
            for a, b in _parts(_sizes(batch)):
                o, x = c.encode(batch.slice(a, b - a).to_pylist())
                offsets.append(o[1:] + base)
                ids.append(x)
                base += len(x)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(ids)))

    return run(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for; ids may end inside a character, so they are binary."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            values = batch.values.to_numpy()
            offsets = batch.offsets.to_numpy().astype(np.int64)
            ends, parts, base = [np.zeros(1, np.int64)], [], 0
            for a, b in _parts(np.diff(offsets).tolist(), 1 << 19):
                o, x = c.decode(offsets[a : b + 1] - offsets[a], values[offsets[a] : offsets[b]])
                ends.append(o[1:] + base)
                parts.append(x.tobytes())
                base += len(x)
            ends = np.concatenate(ends).astype(np.int32)
            yield pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(parts))])

    return run(ids)


def digest(text: Column, path: str, pattern: str) -> Column:
    """A struct of n_tokens and the digests of the ids and of what they decode to.

    Encoding and decoding take place in one worker, a run of texts at a time: ids never leave it.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for batch in batches:
            counts: list[int] = []
            marks: tuple[list[str], list[str]] = [], []
            for a, b in _parts(_sizes(batch)):
                offsets, ids = c.encode(batch.slice(a, b - a).to_pylist())
                counts.extend(np.diff(offsets).tolist())
                for out, (ends, flat), after in zip(marks, (c.spell(offsets, ids), c.decode(offsets, ids)), (1, 0), strict=True):
                    out.extend(hashlib.sha256(flat[x : max(x, y - after)]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(marks[0], pa.string()), pa.array(marks[1], pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to."""
    rows = docs.select("doc_id", digest(F.coalesce("text", F.lit("")), path, pattern).alias("d"))
    return rows.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), *public())
