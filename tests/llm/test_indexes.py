"""The exact index, the bit-sliced search and the audit of filters: plain versions, SQL, edge cases."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from themescope.llm import bit_sliced, exact_index, filter_audit, registry

NEW = ("op11_exact_index", "op12_bit_sliced_search", "op13_filter_audit")
CLASH = "key long, salt int, chain int, part string, mask int, n long, block long, rank int, score long, digest string, best boolean, bytes long"


def same_rows(df, folder, sql):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(sql).to_arrow_table().to_pylist()
    columns = sorted(df.columns)
    assert columns == sorted(want[0]) if want else True
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == sorted(repr([r[c] for c in columns]) for r in want)
    return len(got)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables with nulls, ties, repeated rows, hot texts and ids, very long texts and clashing columns; empty ones."""
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "delta", "Straße", "ción", "x1", "и", "#tag", "e$"]
    texts = [(d, t, lang) for d, t, lang in [
        (1, "Equal Text", "en"), (2, "equal text", "en"), (2, "equal text", "en"), (3, "Equal Text", None), (None, "equal text", ""), (None, "EQUAL TEXT", "de"),
        (4, None, "en"), (5, "", "en"), (6, "ÄQUAL", "de"), (7, "äqual", "de"), (8, "beta " * 40_000, "fr"), (8, "Beta " * 40_000, "fr"), (9, "A B C D " * 60, None), (None, None, None),
    ]]
    texts += [(100 + k % 50, " ".join(rng.choice(words) for _ in range(rng.choice((3, 40, 250)))), rng.choice(("en", "de", None))) for k in range(120)]
    texts += [(1000 + k, "Hot text that many rows have #1", "en") for k in range(300)] + [(7, f"one id, text {k}", "de") for k in range(80)]
    rows = [(d, t, lang, *((1, 2, 3, "p", 4, 5, 6, 7, 8, "d", True, 9) if k % 2 else (None,) * 12)) for k, (d, t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {CLASH}").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 5 == 0), "x") for k in range(0, 1200, 2)] + [(1000, 1, None, None), (1000, None, 1, None), (None, 1, 1, None), (7, None, None, None)], "doc_id long, quality int, toxic int, text string")
    items = [(0, "alpha BETA beta"), (1, None), (2, ""), (3, "nowhere"), (4, "hot text straße ción и x1"), (4, "gamma"), (5, "Equal text"), (None, "delta")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", NEW)
def test_rows_on_edge_cases_are_those_of_the_sql(spark, folders, name, monkeypatch):
    full, empty = folders
    monkeypatch.setattr(exact_index, "FLOOR", 20)
    monkeypatch.setattr(bit_sliced, "ITEMS", 3)
    assert same_rows(registry.QUERIES[name](spark, full), full, registry.ORACLE_SQL[name])
    assert registry.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NEW)
def test_rows_are_those_of_the_sql(spark, name, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        (tmp_path / f"{t}.parquet").mkdir()
        (tmp_path / f"{t}.parquet" / "a.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert same_rows(registry.QUERIES[name](spark, "/root/testdata/sf0.001"), tmp_path, registry.ORACLE_SQL[name])


# ---- exact index


@pytest.mark.parametrize("cap", (1, 2, 7))
def test_directory_doubles_splits_and_chains(cap):
    rng = random.Random(cap)
    keys = [rng.getrandbits(63) - (1 << 62) for _ in range(200)] + [0, 1 << 40, -1]  # the last differ late or by sign
    rows = [(k, b"%d" % rng.randrange(3)) for k in keys for _ in range(4)]  # up to three texts a key
    directory = exact_index.Directory(cap)
    for n, (key, data) in enumerate(rows):
        directory.entry(key, data).add(n, n)
    for key, data in set(rows):
        e = directory.find(key, data)
        assert (e.key, e.data, e.count, e.keep) == (key, data, rows.count((key, data)), max(n for n, r in enumerate(rows) if r == (key, data)))
    assert directory.find(keys[0], b"else") is None and len(directory.pointers) == 1 << directory.depth
    held = []
    for place, bucket in directory.buckets():
        assert 0 < len(bucket.chains) + (bucket.depth > 0) and bucket.depth <= directory.depth
        assert len(bucket.chains) <= cap or bucket.depth == exact_index.MOST_DEPTH
        assert all(k & ((1 << bucket.depth) - 1) == place for k in bucket.chains)
        held += [(k, e.data) for k, chain in bucket.chains.items() for e in chain]
    assert Counter(held) == Counter(set(rows))
    assert all(directory.pointers[p] is b for place, b in directory.buckets() for p in range(place, len(directory.pointers), 1 << b.depth))


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch, tmp_path):
    """Keys of two bits: every chain holds many texts, and every key is hot."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_index, "text_key", lambda text: F.struct(F.length(F.coalesce(text, F.lit(""))).cast("long") % 4, F.octet_length(text).cast("long")).cast("struct<key:long,bytes:long>"))
    monkeypatch.setattr(exact_index, "FLOOR", 10)
    rng = random.Random(0)
    rows = [(k, rng.choice("aAbBcé") * rng.randrange(6)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = exact_index.build(docs, str(tmp_path / "index"))
    low = [(d, t.replace("A", "a").replace("B", "b")) for d, t in rows]
    got = {r.doc_id: r for r in exact_index.resolved(index).collect()}
    assert len(got) == 400
    for d, t in low:
        group = [x for x, u in low if u == t]
        assert (got[d].keep_id, got[d].group_size, got[d].kept) == (max(group), len(group), d == max(group))
    # other documents find the entries of their texts
    index = spark.read.parquet(str(tmp_path / "index"))
    new = [(1, "aaa"), (2, None), (3, "zzz"), (4, "É"), (None, "BBbb")] + [(100 + k, "AaA") for k in range(40)]
    found = exact_index.lookup(index, spark.createDataFrame(new, "doc_id long, text string").repartition(3)).collect()
    texts = {d: (t or "").replace("A", "a").replace("B", "b") for d, t in new}
    assert len(found) == len(new)
    for r in found:
        group = [x for x, u in low if u == texts[r.doc_id]]
        if r.keep_id is not None:
            assert r.keep_id in group
        assert (r.keep_id is None) == (not group)


# ---- bit slices


def test_bit_slices_add_and_rank_as_plain_integers():
    rng = np.random.default_rng(4)
    for docs, lists, top, k in ((64, 1, 5, 3), (130, 2, 1, 10), (1000, 9, 3, 10), (1000, 40, 1 << 34, 7), (70, 5, 2, 500)):
        total, numbers, words = np.zeros(docs, np.int64), [], (docs + 63) >> 6
        width = int(lists * top).bit_length()
        for _ in range(lists):
            places = np.flatnonzero(rng.random(docs) < rng.choice((0.02, 0.5, 1.0)))
            values = rng.integers(0, top + 1, len(places))
            total[places] += values
            numbers.append(bit_sliced.spread_out(bit_sliced.slices_of(values), places, words, width))
        sums = bit_sliced.added(numbers)
        assert bit_sliced.values_at(sums, np.arange(docs)).tolist() == total.tolist()
        sure, tied = bit_sliced.best(sums, k)
        want = sorted((-s, p) for p, s in enumerate(total.tolist()) if s > 0)[:k]
        assert len(sure) <= k and len(np.unique(total[tied])) <= 1
        got = sorted((-total[p], p) for p in np.concatenate([sure, tied]) if total[p] > 0)[:k]
        assert got == want


def test_blocks_hold_every_posting(spark, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK", 64)
    texts = [(k, None if k % 9 == 0 else " ".join(f"w{j % 7}" for j in range(k % 30))) for k in range(500)]
    blocks = bit_sliced.index(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = Counter()
    for b in blocks:
        places, tfs, at = np.frombuffer(b.places, np.uint16), np.frombuffer(b.tfs, np.int64), 0
        for t, n in zip(b.terms, b.counts, strict=True):
            got.update({(b.ids[p], bytes(t)): int(tf) for p, tf in zip(places[at : at + n], tfs[at : at + n], strict=True)})
            at += n
    assert got == Counter({(d, t): n for d, text in texts for t, n in Counter(bit_sliced.terms_of(text)).items()})
    assert {b.block for b in blocks}.__len__() == len(blocks)


def test_terms_are_those_of_the_pattern():
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for text in ("Ab-c_d'E 9é\x7fÀß…и z\x00q", "", "  ", "ABC", "\U0001f600a"):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [t.decode() for t in bit_sliced.terms_of(text)] == pattern.findall(low)


# ---- audit


def test_polynomials_count_what_filters_remove():
    rng = random.Random(5)
    counts = {m: rng.randrange(20) for m in range(32) if rng.random() < 0.7}
    poly = filter_audit.polynomial(counts, 5)
    for s in range(32):
        assert filter_audit.corner(poly, s) == sum(c for m, c in counts.items() if m & s)
    for x in [tuple(Fraction(rng.randrange(5), 4) for _ in range(5)) for _ in range(20)]:  # anywhere else too
        plain = Fraction(0)
        for m, c in counts.items():
            stays = Fraction(1)
            for i in range(5):
                stays *= 1 - x[i] if m >> i & 1 else 1
            plain += c * (1 - stays)
        value = sum(a * Fraction(np.prod([x[i] for i in range(5) if t >> i & 1])) for t, a in poly.items())
        assert value == plain
    for i in range(5):
        removed = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            removed += sum(c for m, c in counts.items() if m >> i & 1 and not m & before)
        assert filter_audit.shapley(poly, i) * 120 == removed


def test_masks_are_those_of_the_rules():
    assert filter_audit.own_mask("") == 1
    assert filter_audit.own_mask("a " * 200) == 2
    assert filter_audit.own_mask(" ".join(f"w{k}" for k in range(200))) == 0
    assert filter_audit.own_mask("A" * 3 + "b" * 97) == 1  # 3% exactly is no failure
    assert filter_audit.own_mask("A" * 4 + "b" * 96) == 1 | 4
    assert filter_audit.own_mask("x@y 5%") == 1 | 8


# ---- ranges of documents


def test_ranges_follow_the_bytes_at_any_size(spark, monkeypatch):
    """As many ranges as wanted, though the sample was small once; ids that repeat, null ids and long texts in them."""
    from pyspark.sql import functions as F

    from themescope.llm import fingerprints

    monkeypatch.setattr(fingerprints, "SAMPLE", 50)
    rng = random.Random(8)
    rows = [(rng.choice([None, 5, 5, k, -k, k]), "x" * rng.choice((0, 20, 100, 400))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    ids, ties, nulls = fingerprints.ranges(docs, 2000, 4)
    total = sum(len(t) + 16 for _, t in rows)
    assert len(ids) + 1 <= -(-total // 2000) and len(ids) + 1 > 0.4 * total / 2000  # half of the bytes are of equal rows, which no cut parts
    cuts = [(None if k < nulls else int(i), int(t)) for k, (i, t) in enumerate(zip(ids, ties, strict=True))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert cuts == sorted(cuts, key=key) and len(set(cuts)) == len(cuts)
    got = docs.select("doc_id", "tie", F.octet_length("text").alias("n"), fingerprints.part_of(spark, (ids, ties, nulls)).alias("part")).collect()
    sizes, equal = Counter(), Counter()
    for r in got:
        assert r.part == sum(key(c) >= key((r.doc_id, r.tie)) for c in cuts)
        sizes[r.part] += r.n + 16
        equal[r.part, r.doc_id, r.tie] += r.n + 16
    for part, size in sizes.items():
        assert size <= 2 * 2000 + max(v for k, v in equal.items() if k[0] == part)
    monkeypatch.setattr(fingerprints, "MOST_CUTS", 7)
    assert len(fingerprints.ranges(docs, 2000, 4)[0]) == 7


# ---- what lies beside the queries


def test_license_texts_come_with_the_package(spark, tmp_path):
    """Also if the package is a zip, as executors get it; none at all is an error."""
    import os
    import subprocess
    import sys
    import zipfile
    from pathlib import Path

    from themescope.llm import common, license_scan

    top = Path(common.__file__).resolve().parents[1]
    ask = "from themescope.llm import license_scan as s; print(__import__('hashlib').md5(repr(sorted(s.TEMPLATES.items())).encode()).hexdigest())"
    want = __import__("hashlib").md5(repr(sorted(license_scan.TEMPLATES.items())).encode()).hexdigest()
    for kinds, good in (((".py", ".txt"), True), ((".py",), False)):
        name = tmp_path / f"{len(kinds)}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(top.rglob("*")):
                if f.suffix in kinds:
                    z.write(f, f.relative_to(top.parent))
        said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(name)}, capture_output=True, text=True)
        assert (said.returncode == 0) == good and (not good or said.stdout.strip() == want), said.stderr


def test_columns_of_ids_decode_to_their_texts(spark):
    from pyspark.sql import functions as F

    from themescope.llm import bpe

    path, pattern = bpe.public()
    texts = [(1, "Hello, world"), (2, None), (3, ""), (4, "é😀 中文\n\n x"), (5, "word " * 5000), (6, "Hello, world")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = docs.select("doc_id", "text", bpe.encode(F.col("text"), path, pattern).alias("ids")).withColumn("back", bpe.decode(F.col("ids"), path, pattern)).collect()
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    plain = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    for r in got:
        assert r.ids == plain.encode_ordinary(r.text or "") and bytes(r.back).decode() == (r.text or "")
