"""The corpus pipeline against the same steps in plain Python, in one process, comparing every pair of documents."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from themescope.llm import bpe, mixing, quality_rules, toxicity
from themescope.llm.common import table

SF = "/root/testdata/sf0.01"


def is_content(text, field):
    tokens = text.encode().split()
    runs = [tuple(tokens[i : i + 5]) for i in range(max(0, len(tokens) - 4))]
    times = Counter(runs)
    twice = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(5)}
    if len(tokens) < 10 or 100 * len(twice) > 20 * len(tokens):
        return False
    lines = quality_rules.lines_of(text)[0]
    marks = field.decode([quality_rules.features(lines)])[0]
    sizes = [len(ts) for _, ts in lines]
    return sum(n for n, m in zip(sizes, marks, strict=True) if m) / sum(sizes) >= quality_rules.LEAST_SHARE


def first_of_each_class(texts):
    """The smallest id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, parent = {}, {}
    for i, t in texts.items():
        w = t.split()
        sets[i], parent[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)), i

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            small, large = sorted((len(a), len(b)))
            if 5 * small >= 4 * large and 5 * (shared := len(a & b)) >= 4 * (small + large - shared):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return {i for i in ids if top(i) == i}


def times_taken(docs):
    """doc_id -> copies in the mix, for docs as doc_id -> (text, source)."""
    size = {i: len(t.encode().split()) for i, (t, _) in docs.items()}
    total = defaultdict(int)
    for i, (_, s) in docs.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    closed = set()
    while True:
        left, sharing = sum(total.values()) - sum(3 * total[s] for s in closed), sum(weight[s] for s in names if s not in closed)
        over = {s for s in names if s not in closed and left / sharing * weight[s] > 3 * total[s]}
        if not over:
            break
        closed |= over
    target = {s: float(3 * total[s]) if s in closed else left / sharing * weight[s] for s in names}
    copies, sent = [], defaultdict(int)
    for i in sorted(docs, key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
        s = docs[i][1]
        sent[s] += size[i]
        copies += [((e * total[s] + sent[s]) / target[s], names.index(s), i) for e in range(3) if size[i]]
    taken, spent = Counter(), 0
    for _, _, i in sorted(copies):
        spent += size[i]
        if spent > sum(total.values()):
            break
        taken[i] += 1
    return taken


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_matches_plain_steps(spark):
    tiktoken = pytest.importorskip("tiktoken")
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    lexicon, field = toxicity.fit(documents, labels), quality_rules.fit(documents, labels)
    docs = {r.doc_id: (r.text, r.source) for r in documents.select("doc_id", "text", "source").collect()}
    n = len(docs)
    docs = {i: d for i, d in docs.items() if lexicon.score(lexicon.strength(d[0])[0]) < 0.5}
    assert 0 < len(docs) < n
    docs = {i: d for i, d in docs.items() if is_content(d[0], field)}
    first = first_of_each_class({i: t for i, (t, _) in docs.items()})
    assert 0 < len(first) < len(docs) < n
    taken = times_taken({i: docs[i] for i in first})
    path, pattern = bpe.public()
    codec = bpe.Codec(path, pattern)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(codec.tokens) if t}, special_tokens={})
    want = []
    for i, times in taken.items():
        ids = plain.encode_ordinary(docs[i][0])
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), docs[i][0])]
        want += [(i, len(ids), *sums)] * times
    got = sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, judged string, copy string, epochs string"
GOOD = "The quick brown fox sees that many small birds sing in the old trees near the river today."


def test_stages_on_null_repeated_and_no_rows(spark, tmp_path):
    rows = [(1, GOOD), (1, GOOD), (2, GOOD), (3, None), (4, ""), (None, GOOD + " It ends."), (5, "z " * 20000)]
    docs = spark.createDataFrame([(i, t, None, None if i == 2 else "s", None if t is None else len(t), "a", "b", "c", "d") for i, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "one/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    for name in ("one", "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    for name in ("one", "none"):
        sf, kept = str(tmp_path / name), spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, kept, sf).write.parquet(str(tmp_path / name / f"{k}"))
            kept = spark.read.parquet(str(tmp_path / name / f"{k}"))
            assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {1, 2, None} and (name == "one") == bool(ids)
        assert corpus_pipeline.encode_tokens(spark, kept, sf).count() == kept.count()


def test_stages_after_the_first_go_without_documents(spark, tmp_path):
    """models learn from the rows of their stage; the table of documents is gone by then."""
    docs = spark.createDataFrame([(i, GOOD if i % 2 else "| | | # #\n| 1 | 2 |\nhome | next | back up", "en", "s", 9) for i in range(1, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        kept = spark.read.parquet(str(tmp_path / f"{k}"))
        if k == 0:
            (tmp_path / "documents.parquet").rename(tmp_path / "gone.parquet")
    assert {r.doc_id for r in kept.collect()} == {1}


def test_mix_tells_rows_with_one_doc_id_apart(spark):
    rows = [(7, GOOD, "s"), (7, GOOD + " And more.", "s"), (7, GOOD, "t"), (8, GOOD, "s"), (8, GOOD, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs, carry=("text",)).collect():
        want[r.doc_id, r.text, r.source] += r.epochs
    got = Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == +want
