"""Values on the edge rows: nulls, empty and very long texts, ties, repeated rows, clashing columns; against plain Python and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from test_llm import tables  # noqa: F401

from themescope.llm import bpe, registry


@pytest.fixture(scope="module")
def docs(spark, tables):  # noqa: F811
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables[0]}/documents.parquet").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def crc(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def rows(spark, tables, name, *columns):  # noqa: F811
    return sorted(repr(tuple(r[c] for c in columns)) for r in registry.QUERIES[name](spark, tables[0]).collect())


def test_op1_base_columns(spark, tables, docs):  # noqa: F811
    def base(doc_id, text):
        w = words(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        return doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed

    assert rows(spark, tables, "op1_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(repr(base(*d)) for d in docs)


def test_op2_edited_texts(spark, tables, docs):  # noqa: F811
    """Ids that several rows share have no order of their own in the plain version, so only rows beside single ids are compared."""
    from pyspark.sql import functions as F

    tie = {r.text: r.t for r in spark.createDataFrame([(t,) for t in {t for _, t in docs}], "text string").select("text", F.xxhash64("text").alias("t")).collect()}
    nulls = spark.read.parquet(f"{tables[0]}/documents.parquet").where("text IS NULL").count()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, tie[d[1]]), reverse=True)
    want = Counter()
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        want[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in registry.QUERIES["op2_fingerprints"](spark, tables[0]).collect())
    assert nulls > 0 and sum(got.values()) == len(docs)
    single = {d for d, n in Counter(d for d, _ in docs).items() if n == 1 and d is not None}
    known = {d for (d, _), (e, _) in zip(order, order[1:] + order[:1], strict=True) if d in single and e in single}
    assert len(known) > 20 and {k: n for k, n in got.items() if k[0] in known} == {k: n for k, n in want.items() if k[0] in known}


def test_op4_ids(spark, tables, docs):  # noqa: F811
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path, pattern = bpe.public()
    plain = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    want = []
    for doc_id, text in docs:
        ids = plain.encode_ordinary(text)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows(spark, tables, "op4_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(repr, want))


@pytest.mark.parametrize(("name", "part", "of"), [("op3_quality_classifier", 4, 2), ("op7_toxicity", 5, 0)])
def test_folds_and_predictions(spark, tables, docs, name, part, of):  # noqa: F811
    bar = 0.7 if name.startswith("op3") else 0.5
    got = registry.QUERIES[name](spark, tables[0]).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((d, crc(d, part) == of) for d, _ in docs)
    assert all(r.predicted == int(r.score >= bar) for r in got)


def test_op9_base_scores(spark, tables, docs):  # noqa: F811
    low = [(d, ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)]) for d, t in docs]
    counts = Counter(w for d, ws in low if crc(d, 7) != 2 for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    got = {}
    for r in registry.QUERIES["op9_hidden_markov"](spark, tables[0]).collect():
        got.setdefault((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), []).append(r.base_score)
    want = {}
    for d, ws in low:
        tokens = [*ws, None]
        want.setdefault((d, crc(d, 7) == 2, len(tokens), sum(counts[t] > 0 for t in tokens), n), []).append(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    assert set(got) == set(want)
    for k, scores in want.items():
        assert sorted(got[k]) == pytest.approx(sorted(scores), rel=1e-9)


@pytest.mark.parametrize("name", ("op8_mix_sources", "op10_warc"))
def test_rows_are_those_of_the_sql(spark, tables, name):  # noqa: F811
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    columns = sorted(want[0])
    assert rows(spark, tables, name, *columns) == sorted(repr(tuple(r[c] for c in columns)) for r in want)


def test_op5_classes(spark, tables, docs):  # noqa: F811
    """Equal texts are of one class; a text that shares 0.8 of its five-word shingles with no other has no links."""
    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {t: shingles(t) for _, t in docs}
    links = {t: sum(u != t and len(s & sets[u]) >= 0.8 * len(s | sets[u]) > 0 for u in sets) for t, s in sets.items()}
    got = Counter((r.doc_id, r.n_links) for r in registry.QUERIES["op5_ngram_jaccard"](spark, tables[0]).collect())
    assert got == Counter((d, links[t]) for d, t in docs)
