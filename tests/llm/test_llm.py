"""The operators of the subpackage against brute force, round trips and held-out rows, and on the edge cases."""

import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from themescope.llm import archives, bpe, chosen_path, common, fingerprints, hidden_markov, license_scan, mixing, quality_model, quality_rules, registry, toxicity

DOCS = "doc_id long, text string, source string, score string"
EDGES = [
    (1, "a b c d e f g h i j k l", "s", "x"), (2, "a b c d e f g h i j k l", None, None), (2, "a b c d e f g h i j k l", None, None),
    (3, None, "t", None), (4, "", "t", None), (None, "one two three four five six seven", "t", None), (6, "one", None, None),
    (7, "\n \n", "s", None), (8, "z " * 20000, "s", None),
]


def random_text(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


def test_repeated_words_match_a_plain_count():
    rng = random.Random(1)
    for n in (0, 3, 5, 6, 40, 80):
        tokens = [rng.choice([b"a", b"b"]) for _ in range(n)]
        runs = [tuple(tokens[i : i + 5]) for i in range(max(0, n - 4))]
        want = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
        assert quality_rules.repeated_words(tokens) == len(want)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    f = quality_rules.Field(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)))
    chains = [rng.normal(size=(n, len(quality_rules.FEATURES))) for n in (4, 1, 6, 0)]

    def value(path, up):
        return sum(u for s, u in zip(path, up, strict=True) if s) + sum(f.moves[a, b] for a, b in itertools.pairwise(path))

    for chain, got in zip(chains, f.decode(chains), strict=True):
        if len(chain):
            up = chain @ f.weights
            best = max(itertools.product((0, 1), repeat=len(chain)), key=lambda p: value(p, up))
            assert value(got.tolist(), up) == pytest.approx(value(best, up))


def test_quality_rules_on_edge_cases(spark, edges):
    f = quality_rules.Field(np.array(quality_rules.OUTLINE), np.zeros((2, 2)))
    rows = edges.select("doc_id", quality_rules.judge(edges.text, f, spark).alias("j")).collect()
    assert len(rows) == len(EDGES)
    assert all(r.j.base_failed and not r.j.kept for r in rows if r.doc_id in (3, 4, 6, 7, 8))
    assert next(r.j.n_repeat_words for r in rows if r.doc_id == 8) == 20000


def test_fingerprints_are_near_the_true_likeness():
    rng = random.Random(2)
    hashes = fingerprints.WordHashes()
    for shift in (0, 20, 60, 200):
        a = random_text(rng, 400).split()
        b = a[shift:] + random_text(rng, shift).split()
        sets = [set(zip(*(x[k:] for k in range(5)), strict=False)) for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        x, y = fingerprints.sketch([fingerprints.shingles(hashes.of([w.encode() for w in t])) for t in (a, b)])
        assert abs(fingerprints.likeness(x, y) - true) < 0.12


def test_edited_texts(spark, edges):
    rows = fingerprints.edited(edges, parts=3).collect()
    assert len(rows) == len(EDGES)
    order = sorted(EDGES, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert any(r.doc_id == doc and r.edited_sha256 == want for r in rows)


def test_bpe_matches_tiktoken_and_decodes():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public()
    c = bpe.Codec(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(c.tokens) if t}, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cé日 \n\t1!😀") for _ in range(rng.randrange(80))) for _ in range(300)] + [None, "", "a" * 3000, "<|endoftext|>"]
    offsets, ids = c.encode(texts)
    ends, flat = c.decode(offsets, ids)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.encode_ordinary(t or "")
        assert flat[ends[i] : ends[i + 1]].tobytes() == (t or "").encode()


def test_bpe_digests_on_edge_cases(spark, edges):
    path, pattern = bpe.public()
    c = bpe.Codec(path, pattern)
    got = bpe.digests(edges, path, pattern).collect()
    want = []
    for doc, text, *_ in EDGES:
        ids = " ".join(map(str, c.encode([text])[1].tolist()))
        want.append((doc, len(ids.split()), *(hashlib.sha256(x.encode()).hexdigest() for x in (ids, text or ""))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(edges.limit(0), path, pattern).count() == 0


def test_join_matches_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = random_text(rng, 120).split()
        for _ in range(40):
            new = list(base)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(len(new))] = random_text(rng, 1)
            texts.append(" ".join(new))
    texts += ["", None, "one two", "one two", "x"]
    docs = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r.doc_id: r for r in chosen_path.join(docs).collect()}

    def shingles(t):
        w = (t or "").split()
        return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    distinct = {t or "": shingles(t) for t in texts}
    for k, t in enumerate(texts):
        s = distinct[t or ""]
        links = sum(1 for u, v in distinct.items() if u != (t or "") and s and 5 * len(s & v) >= 4 * len(s | v))
        assert got[k].n_links == links
        assert got[k].copy_id == min(i for i, u in enumerate(texts) if (u or "") == (t or ""))


def test_runs_reach_the_target_at_every_depth():
    for depth in (5, 8, 12, 15):
        assert chosen_path.recall_of(chosen_path.runs_for(depth=depth), depth) >= chosen_path.RECALL


def test_pairs_inside_a_large_group_that_shares_passages(spark):
    rng = random.Random(8)
    passages = [random_text(rng, 60) for _ in range(4)]
    texts, pairs = [], []
    for k in range(700):
        own = " ".join(passages[: rng.randrange(2, 5)]) + " " + random_text(rng, 200)
        texts.append(own)
        if k % 10 == 0:
            near = own.split()
            for _ in range(6):
                near[rng.randrange(len(near))] = "changed"
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(" ".join(near))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    hashes = chosen_path.WordHashes()
    sets = [chosen_path.shingle_set(t, hashes) for t in texts]
    true = [(a, b) for a, b in pairs if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    rows, nodes = chosen_path.nodes_of(docs)
    copies = {r.doc_id: bytes(r["copy"]) for r in rows.collect()}
    parent = {c: c for c in copies.values()}

    def least(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for r in chosen_path.candidates(nodes).collect():
        parent[least(bytes(r.u))] = least(bytes(r.v))
    assert len(true) > 50
    assert sum(least(copies[a]) == least(copies[b]) for a, b in true) >= 0.99 * len(true)


def test_components_match_a_plain_search(spark):
    rng = random.Random(12)
    names = [hashlib.md5(str(k).encode()).digest() for k in range(3000)]
    path = list(itertools.pairwise(names[:200]))
    star = [(max(names[200:900]), n) for n in names[200:900]]  # the hub is the last of its neighbours, and one of itself
    bridge = [(names[10], names[300])]
    sparse = [tuple(rng.sample(names[900:], 2)) for _ in range(1500)]
    pairs = path + star + bridge + sparse + sparse[:50]
    parent = {n: n for n in names}

    def least(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in pairs:
        a, b = sorted((least(a), least(b)))
        parent[b] = a
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "u binary, v binary").repartition(8)
    got = chosen_path.components(edges).collect()
    want = {n: least(n) for n in names}
    alone = {n for n in names if list(want.values()).count(want[n]) == 1}
    assert {bytes(r.node): bytes(r.least) for r in got} == {n: c for n, c in want.items() if n not in alone}
    assert len(got) == len(names) - len(alone)
    assert chosen_path.components(edges.limit(0)).count() == 0


def test_few_edges_in_many_pieces_take_no_star_rounds(spark, monkeypatch):
    """A chain dealt over 40 pieces; and the buckets of all levels are compared in one step."""
    labels, compared = [], []
    keep, small = chosen_path.stored, chosen_path._compare_small
    monkeypatch.setattr(chosen_path, "stored", lambda df, label="part", **k: labels.append(label) or keep(df, label, **k))
    monkeypatch.setattr(chosen_path, "_compare_small", lambda rows: compared.append(1) or small(rows))
    chain = spark.range(400).select(*[F.unhex(F.lpad(F.hex(F.col("id") + k), 8, "0")).alias(c) for k, c in ((1, "u"), (0, "v"))]).repartition(40, F.rand(7))
    got = chosen_path.components(chain).collect()
    assert len(got) == 401 and {bytes(r.least) for r in got} == {bytes(4)}
    assert "large" not in labels
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"{text} v{i}") for i in range(300)] + [(300, "alone in here")], "doc_id long, text string")
    ids = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.join(docs).collect()}
    assert ids == {i: (0, 299) for i in range(300)} | {300: (300, 0)} and "pivots" in labels
    assert len(compared) == 1


def test_the_map_of_wanted_texts_follows_their_number(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "MOST_BITS", 18)
    sizes = []
    for n in (0, 1, 3000, 40000):
        rows = spark.range(n).selectExpr("xxhash64(id) AS h")
        found, bits = chosen_path._bits(rows, n)
        place = np.array([r.h for r in rows.collect()], np.int64).view(np.uint64) >> np.uint64(64 - bits)
        want = np.zeros(1 << bits, bool)
        want[place.astype(np.int64)] = True
        assert (np.unpackbits(found.view(np.uint8), bitorder="little").astype(bool) == want).all()
        sizes.append(bits)
    assert sizes == [16, 16, 16, 18]


def test_the_join_leaves_only_what_its_rows_are_read_from(spark, edges, tmp_path, monkeypatch):
    folders = (f"file://{tmp_path}/{k}" for k in itertools.count())
    monkeypatch.setattr(common, "shared_dir", lambda spark: next(folders))
    left = lambda: sorted(p.name for p in tmp_path.glob("*/*"))
    found = chosen_path.join(edges)
    assert left() == ["named", "rows"]
    assert found.count() == len(EDGES)
    with pytest.raises(ValueError), common.scratch(spark):
        common.stored(edges, "gone")
        with common.scratch(spark):
            kept = common.stored(edges, "inner", keep=True)
        assert kept.count() == len(EDGES)
        raise ValueError
    assert left() == ["named", "rows"]


def test_join_refuses_a_smaller_threshold():
    with pytest.raises(ValueError):
        chosen_path.join(None, 0.6)


def test_join_on_edge_cases(spark, edges):
    rows = chosen_path.join(edges).select("doc_id", "class_id", "n_copies").collect()
    assert len(rows) == len(EDGES)
    assert {r.class_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert chosen_path.join(edges.limit(0)).count() == 0


def test_folding_sees_through_substitutions():
    lexicon = toxicity.Lexicon({toxicity.fold_text("idiot").strip(): 4.0, toxicity.fold_text("trash").strip(): 3.0})
    for t in ("idiot", "1D10T!", "іdіоt", "(id​iot)", "ÍDÍÓT"):
        assert lexicon.strength(t)[1] == 1, t
    assert lexicon.strength("idiotic")[1] == 0
    assert lexicon.strength("a trash can")[1] == 0
    assert lexicon.strength(None)[0] == 0.0


def test_targets_and_limits_of_the_mix(spark, edges):
    rows = mixing.mix(edges).collect()
    assert len(rows) == len(EDGES)
    assert all(0 <= r.epochs <= 3 and r.target <= 3 * r.source_size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert sorted(map(tuple, mixing.mix(edges).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert mixing.mix(edges.limit(0)).count() == 0


def test_hidden_markov_recursions_match_all_paths(monkeypatch):
    monkeypatch.setattr(hidden_markov, "STATES", 2)
    rng = np.random.default_rng(5)
    m = hidden_markov.Chain(np.array([0.6, 0.4]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 4, 2).T)
    docs = [rng.integers(0, 4, n).astype(np.int32) for n in (5, 4, 2, 1)]
    logs = hidden_markov.Group(docs).log10(m)
    for d, got in zip(docs, logs, strict=True):
        total = 0.0
        for p in itertools.product(range(2), repeat=len(d)):
            total += m.start[p[0]] * math.prod(m.emit[s, q] for s, q in zip(d, p, strict=True)) * math.prod(m.moves[a, b] for a, b in itertools.pairwise(p))
        assert got == pytest.approx(math.log10(total))


def test_expected_counts_match_all_paths(monkeypatch):
    monkeypatch.setattr(hidden_markov, "STATES", 2)
    rng = np.random.default_rng(6)
    m = hidden_markov.Chain(np.array([0.3, 0.7]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 3, 2).T)
    docs = [rng.integers(0, 3, n).astype(np.int32) for n in (6, 4, 4, 1)]
    by_symbol, moves, start, logs = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for d in docs:
        paths = list(itertools.product(range(2), repeat=len(d)))
        chance = [m.start[p[0]] * math.prod(m.emit[s, q] for s, q in zip(d, p, strict=True)) * math.prod(m.moves[a, b] for a, b in itertools.pairwise(p)) for p in paths]
        logs += math.log(sum(chance))
        for p, c in zip(paths, np.array(chance) / sum(chance), strict=True):
            start[p[0]] += c
            for s, q in zip(d, p, strict=True):
                by_symbol[s, q] += c
            for a, b in itertools.pairwise(p):
                moves[a, b] += c
    for kind, near in ((np.float64, 1e-9), (np.float32, 1e-4)):
        got = np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2)
        assert hidden_markov.Group(docs).expected(m, *got, kind) == pytest.approx(logs, rel=near)
        for x, want in zip(got, (by_symbol, moves, start), strict=True):
            np.testing.assert_allclose(x, want, rtol=near, atol=near)


def test_base_scores_match_a_plain_count(spark, edges):
    got = hidden_markov.score(hidden_markov.fit(edges, (edges.doc_id != 8) & edges.doc_id.isNotNull(), rounds=2)).collect()
    assert len(got) == len(EDGES)
    count: dict[bytes, int] = {}
    kept = [t for d, t, *_ in EDGES if d is not None and d != 8]
    for t in kept:
        for w in hidden_markov.tokens_of(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + len(kept), len(count) + 1
    want = [sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count.get(w, 0) for w in hidden_markov.tokens_of(t)), len(kept)]) for _, t, *_ in EDGES]
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(want))
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) + 1 for _, t, *_ in EDGES)


def test_rare_words_are_counted_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(hidden_markov, "FREQUENT", 2)
    rows = [(k, "a a b " + " ".join(f"w{j}" for j in range(k))) for k in range(1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in hidden_markov.score(hidden_markov.fit(docs, docs.doc_id < 5, rounds=1)).collect()}
    count = {"a": 8, "b": 4, "w0": 4, "w1": 3, "w2": 2, "w3": 1}
    n, v = sum(count.values()) + 4, len(count) + 1
    for k, t in rows:
        assert got[k].base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in [*(count.get(w, 0) for w in t.split()), 4]))
        assert got[k].n_known == 1 + sum(w in count for w in t.split())


def test_rounds_raise_the_likelihood_and_part_the_states(spark):
    rng = random.Random(9)
    words = [[random_text(rng, 1) for _ in range(30)] for _ in range(2)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words[k % 2]) for _ in range(60))) for k in range(60)], "doc_id long, text string")
    fitted = hidden_markov.fit(docs, docs.doc_id < 40)
    assert 2 < len(fitted.likelihoods) <= hidden_markov.ROUNDS
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(fitted.likelihoods))
    held = [r for r in hidden_markov.score(fitted).collect() if r.doc_id >= 40]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    for few in (docs.doc_id < 0, docs.doc_id < 1):
        chain = hidden_markov.fit(docs, few, rounds=3).chain
        assert np.isfinite(chain.emit).all() and (chain.emit.min(1) != chain.emit.max(1)).any()


def test_all_rounds_see_all_training_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in range(3)], "doc_id long, text string")
    seen, plain = [], hidden_markov.round_of
    monkeypatch.setattr(hidden_markov, "round_of", lambda rows, *rest: (seen.append(rows.count()), plain(rows, *rest))[1])
    hidden_markov.fit(docs, docs.doc_id >= 0, rounds=2)
    assert seen == [3, 3]


PAGES = [
    (1, "http://a b/", "x" * 200), (2, None, "x" * 200), (1, "http://z", "x" * 200), (None, "u", "x" * 200), (None, "u", None), (3, "http://é", "日本\r\n\r\nz" * 50),
    (4, "q", "short"), (5, "q", "short"), (None, "p", "y" * 100), (None, "p", "y" * 100), (9, "t", "z" * 99), (10, "t", "z" * 99), (7, "c", "HTTP/1.1 200 OK\n\n" * 20),
]


def test_archives_match_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages = spark.createDataFrame([(*r, "own") for r in PAGES], "page_id long, url string, html string, digest string")
    for part in (pages, pages.limit(0)):
        part.write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
        got = archives.op10_warc(spark, str(tmp_path))
        con = duckdb.connect()
        con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        found = con.execute(archives.OP10_SQL)
        assert [c[0] for c in found.description] == got.columns
        assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_documents_are_kept_byte_for_byte(spark, tmp_path):
    bodies = [
        b"HTTP/1.0 404 Not here\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Odd\r\n\r\ncaf\xe9 \x00\xff" + bytes(range(256)),
        b"HTTP/1.1\r\n\r\nno status", b"HTTP/1.0 200 OK\nServer: old\n\nline feeds alone", b"HTTP/1.0 204 None", b"\x89PNG no http", b"",
    ]
    for version in (1, 2):
        data = archives.member(archives.arc_version_block(version, "f"))
        for k, body in enumerate(bodies):
            data += archives.member(archives.arc_document(version, "f", 0, f"http://x/{k} \udce9", "2001" if k else "nodate", "text/html", body))
        captures = list(archives.read_arc(archives.Stream(data)))
        assert [c.http + c.payload for c in captures] == bodies
        assert [c.status for c in captures] == [404, None, 200, 204, None, None]
        assert captures[0].date == archives.FIRST_DAY.strftime(archives.DIGITS) and captures[0].url == "http://x/0%20\udce9"
        arc, warc = tmp_path / f"arc{version}", tmp_path / f"warc{version}"
        arc.mkdir()
        (arc / "part-0").write_bytes(data)
        archives.convert(spark, str(arc), str(warc))
        rows = sorted(archives.read_archives(spark, str(warc), payloads=True).collect(), key=lambda r: bytes(r.target_uri))
        assert [bytes(r.http) + bytes(r.payload) for r in rows] == bodies
        assert [r.record_type for r in rows] == ["response"] * 4 + ["resource"] * 2
        assert rows[1].warc_date == "2001-01-01T00:00:00Z" and bytes(rows[2].target_uri) == b"http://x/2%20\xe9"


def test_a_warc_file_has_a_member_a_record_and_standard_references(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200)], "page_id long, url string, html string").coalesce(1)
    archives.write_arc(pages, str(tmp_path / "arc"))
    archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    members = []
    while data:
        d = zlib.decompressobj(31)
        members.append(d.decompress(data))
        data = d.unused_data
    assert [m[:8] for m in members] == [b"WARC/1.0", b"WARC/1.0", b""]
    first, again = (dict(line.split(": ", 1) for line in m.decode().split("\r\n\r\n")[0].split("\r\n")[1:]) for m in members[:2])
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "http://a/" and again["WARC-Type"] == "revisit"


@pytest.mark.parametrize("version", [1, 2])
def test_both_arc_versions_are_read(version):
    import gzip

    data = archives.arc_version_block(version, "f") + b"".join(archives.arc_record(version, "f", 0, k, "http://x/", b"y" * k) for k in (0, 5, 300))
    assert [len(c.payload) for c in archives.read_arc(archives.Stream(gzip.compress(data)))] == [0, 5, 300]


def test_license_windows_collide_and_verify():
    assert license_scan.collision(license_scan.EXPECTED) > 0.99
    t, h = license_scan.Templates(license_scan.TEMPLATES), license_scan.WordHashes()
    text = "Some prose before. " * 30 + license_scan.TEMPLATES["MIT"] + " And after." * 20
    name, begin, end, share = t.scan(text, h)[0]
    assert (name, share) == ("MIT", 1.0) and text[begin:end].startswith("Released under")
    assert t.scan(None, h) == [] and t.scan("plain words only " * 50, h) == []


@pytest.fixture(scope="module")
def licenses():
    return license_scan.Templates(license_scan.TEMPLATES)


@pytest.mark.parametrize(
    ("license", "line"),
    [
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "Licensed under the GPL version 2"), ("GPL-3.0", "released under the GPLv3"),
        ("LGPL-2.1", "the terms of the GNU Lesser General Public License version 2.1 or later"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
        *[(f"CC-{c}-{v}", f"Licensed under CC {c} {v}.") for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")],
        ("CC-BY-NC", "Licensed under CC BY-NC"), ("CC-BY-NC-ND-4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
        ("BSD", "Distributed under the BSD license"), ("BSD-3-Clause", "Distributed under the BSD 3-Clause license"), ("ISC", "under the ISC license"), ("MPL-2.0", "Mozilla Public License 2.0"),
        ("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("rights-reserved", "All rights reserved."), ("CC0-1.0", "CC0 1.0 Universal"),
    ],
)
def test_each_kind_of_license_line_is_found(licenses, license, line):
    text = "Some prose before. " * 30 + line + " And after." * 20
    assert [m[0] for m in licenses.scan(text, license_scan.WordHashes())] == [license]


def test_full_license_texts_are_found_whole(licenses):
    h = license_scan.WordHashes()
    for p in license_scan.FULL.glob("*.txt"):
        words = p.read_text(encoding="utf-8").split()
        words[len(words) // 2] = "changed"
        text = " ".join(words)
        assert [(m[0], m[2] - m[1] > 0.95 * len(text)) for m in licenses.scan("Before. " * 30 + text + " After." * 30, h)] == [(p.stem, True)]


def test_classifier_learns():
    rng = random.Random(6)
    rows = [(k, random_text(rng, 60) if k % 4 else " | ".join(random_text(rng, 60).split()), int(k % 4 > 0)) for k in range(400)]
    model = quality_model.train(rows[:300], (0.25, 0.75))
    scores = model.scores([t for _, t, _ in rows[300:]] + [None, ""])
    assert np.mean((scores[:-2] >= 0.7) == [y for *_, y in rows[300:]]) > 0.95
    assert ((scores >= 0) & (scores <= 1)).all()


def test_scores_are_calibrated_probabilities():
    rng = random.Random(10)
    rows = []
    for k in range(3000):  # the share of one word tells the chance of label 1
        p = rng.random()
        rows.append((k, " ".join("good" if rng.random() < p else "bad" for _ in range(60)), int(rng.random() < p)))
    share = sum(y for *_, y in rows[:2000]) / 2000
    model = quality_model.train(rows[:2000], (1 - share, share))
    scores, y = model.scores([t for _, t, _ in rows[2000:]]), np.array([y for *_, y in rows[2000:]])
    error = sum(abs(scores[on].mean() - y[on].mean()) * on.mean() for k in range(5) if (on := (scores >= k / 5) & (scores < (k + 1) / 5 + (k == 4))).any())
    assert error < 0.06
    assert model.temperature > 0


def test_pooled_vectors_match_a_plain_sum():
    rng = random.Random(11)
    texts = [random_text(rng, 40) for _ in range(20)]
    words = quality_model.index_words(texts)
    rows = words.pool([*texts, "unheard words, all of them", None])
    for text, row in zip([*texts, "unheard words, all of them"], rows, strict=False):
        tokens = quality_model.tokens_of(text)
        at = words.rows(tokens)
        want = sum(words.weights[i] * words.vectors[i].astype(float) for i in at) / sum(words.weights[i] for i in at)
        np.testing.assert_allclose(row[: quality_model.DIM], want, atol=1e-5)
    assert not rows[-1].any()


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select(hidden_markov.fold(7, "id").alias("f"), "id").collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


# ---- bounds, brute force and SQL

SF = "/root/testdata/sf0.01"
sf = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text").unionAll(spark.sql("SELECT 9L, repeat('x', 50)"))
    labels = spark.createDataFrame([(k, k % 2) for k in (0, 1, 2, 9)] * 50 + [(None, 1)], "doc_id long, quality int")
    every = common.labelled_sample(docs, labels, "quality", common.F.lit(True), 5, 100, 10_000)
    assert [(d, y) for d, _, y in every] == [(0, 0), (1, 1), (2, 0), (9, 1)] and every[0][1] == "text 0"
    assert len(common.labelled_sample(docs, labels, "quality", common.F.col("doc_id") < 9, 5, 100, 20)) == 2  # of each class what has 10 code points
    assert [d for d, *_ in common.labelled_sample(docs, labels, "quality", common.F.lit(True), 5, 40, 10_000)] == [0, 1, 2]


def test_a_salted_join_has_the_rows_of_a_plain_one(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7L, id % 90) AS k", "id AS v")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 5")
    want = sorted(map(tuple, rows.join(keyed, "k").select("k", "v", "n").collect()))
    assert sorted(map(tuple, common.join_counted(rows, keyed, "k", "n", 5000).select("k", "v", "n").collect())) == want
    counted = rows.join(keyed, "k")
    assert sorted(map(tuple, common.join_counted(counted, keyed, "k", "n", 5000).select("k", "v", "n").collect())) == want


@sf
def test_base_counts_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sql = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        SELECT doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n, 0) AS n_dup_lines
        FROM d LEFT JOIN (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id) USING (doc_id)
    """
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = quality_rules.op1_quality_rules(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall())


@sf
def test_edited_texts_match_sql_and_exact_likeness(spark, documents):
    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, SF).collect()}
    order = sorted(documents, reverse=True)
    hashes = fingerprints.WordHashes()
    sets = {d: set(fingerprints.shingles(hashes.of(fingerprints.words(t))).tolist()) for d, t in documents.items()}
    far = []
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        text = documents[d]
        half = len(text) // 2
        new = text[: len(text) - half] + documents[after][:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        own, edit = sets[d], set(fingerprints.shingles(hashes.of(fingerprints.words(new))).tolist())
        far.append((got[d].near_edited - len(own & edit) / max(1, len(own | edit)), got[d].near_next - len(own & sets[after]) / max(1, len(own | sets[after]))))
    far = np.array(far)
    assert np.abs(far).mean() < 0.03 and np.abs(far).max() < 0.2 and np.abs(far.mean(0)).max() < 0.01  # bins of few shingles agree or not as a whole


def test_densified_bins_are_those_of_a_plain_loop():
    rng = np.random.default_rng(12)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40)]
    bins = fingerprints.bins_of(sets)
    for row, got in zip(bins, fingerprints.densify(bins), strict=True):
        for b in range(fingerprints.BINS):
            at, attempt = b, 0
            while row[at] == fingerprints._EMPTY:
                at, attempt = int(fingerprints._way(attempt)[b]), attempt + 1
            assert got[b] == row[at]


@sf
def test_toxic_hits_match_a_plain_search(spark, documents):
    lexicon = toxicity.Lexicon({toxicity.fold_text(w).strip(): 1.0 + k for k, w in enumerate(("idiot", "trash", "stupid", "the", "you are"))}, exceptions=("trash can", "you are stupid"))
    texts = [*documents.values(), "you are stupid", "You are, stupid! trash can trash", "st0pid tr@sh", None, "", "idiot idiot"]
    for text in texts:
        words = toxicity.fold_text(text).split()
        at = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]  # noqa: E731, B023
        free = [(i, i + len(p.split())) for p in map(toxicity.fold_text, lexicon.exceptions) for i in at(p)]
        hits = [(w, i) for w in lexicon.weights for i in at(w) if not any(a <= i and i + len(w.split()) <= b for a, b in free)]
        strength, n, _ = lexicon.strength(text)
        assert n == len(hits)
        assert strength == pytest.approx(sum(lexicon.weights[w] for w, _ in hits) / math.log(math.e + (len(words) + 1) / 200))


@sf
def test_learned_weights_match_a_plain_count(spark, documents):
    import pyarrow.parquet as pq

    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = [(d, documents[d], y) for d, y in toxic.items()]
    hashes = toxicity.WordHashes()
    kept = set(toxicity.first_of_copies([(d, toxicity.sketch(toxicity.fold_text(t), hashes)) for d, t, _ in rows]))
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    n = [sum(y == k for d, _, y in rows if d in kept) for k in (0, 1)]
    has = [{}, {}]
    for d, t, y in rows:
        for w in set(toxicity.fold_text(t).split()) if d in kept else ():
            has[y][w] = has[y].get(w, 0) + 1
    want = {}
    for w, a in has[1].items():
        b = has[0].get(w, 0)
        z = (a / n[1] - b / n[0]) / math.sqrt(max(1e-12, (a + b) / sum(n) * (1 / n[0] + 1 / n[1])))
        weight = math.log((a + 0.5) / (n[1] + 1) * (n[0] + 1) / (b + 0.5))
        if a >= toxicity.LEAST_DOCS and z >= toxicity.LEAST_Z and weight >= toxicity.LEAST_WEIGHT:
            want[w] = weight
    assert want and lexicon.weights == pytest.approx(want)


def test_near_copies_are_told_from_unlike_texts():
    rng = random.Random(13)
    hashes = toxicity.WordHashes()
    base = random_text(rng, 300).split()
    near, unlike = list(base), base[:200] + random_text(rng, 100).split()
    near[150] = "changed"
    rows = [(k, toxicity.sketch(" ".join(t), hashes)) for k, t in enumerate((base, near, unlike, base))] + [(4, b""), (5, b"")]
    assert toxicity.first_of_copies(rows) == [0, 2, 4, 5]


@sf
def test_licenses_match_plain_containment(licenses, documents):
    h, found, n = license_scan.WordHashes(), {}, 0
    wanted = {name: set(s.tolist()) for name, s in licenses.sets.items()}
    for d, text in documents.items():
        found[d] = licenses.scan(text, h)
        tokens, places = license_scan.words_of(text)
        grams = license_scan.shingles(h.of(tokens), license_scan.SHINGLE).tolist() if len(tokens) >= license_scan.SHINGLE else []
        every = set(grams)
        plain = False
        for name, own in wanted.items():
            if len(own & every) >= license_scan.CONTAINMENT * len(own):
                size = licenses.lengths[name]
                plain |= any(len(own & set(grams[i : i + size])) >= license_scan.CONTAINMENT * len(own) for i in range(max(1, len(grams) - size + 1)))
        assert plain == bool(found[d]), d
        n += plain
        for name, begin, end, share in found[d]:
            inside = {g for g, (a, b) in zip(grams, zip([p[0] for p in places], [p[1] for p in places[license_scan.SHINGLE - 1 :]], strict=False), strict=False) if begin <= a and b <= end}
            assert share >= license_scan.CONTAINMENT
            assert any(len(own & inside) >= license_scan.CONTAINMENT * len(own) for k, own in wanted.items() if license_scan.re.split("[#~]", k)[0] == name)
    assert n > 10


CLASH = "lang string, source string, n_chars long, score double, size long, part int, y int, copy binary, key long, word string"
#: Columns of the contracts.
CONTRACT = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_quality_classifier": "doc_id held_out score predicted", "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_ngram_jaccard": "doc_id class_id n_links", "op6_license_scan": "doc_id license",
    "op7_toxicity": "doc_id held_out score predicted", "op8_mix_sources": "doc_id size source_size target taken", "op9_hidden_markov": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with nulls, ties, repeated rows, very long texts and clashing columns, and with empty tables."""
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    texts = [(d, t) for d, t, *_ in EDGES] + [(None, None), (None, None), (20, "released under the MIT License"), (20, "released under the MIT License"), (21, "idiot " * 30), (22, "word, and word. " * 30000)]
    texts += [(100 + k, ("you idiot " if k % 3 == 0 else "") + f"some words of a text number {k} with content") for k in range(40)]
    blank = (None,) * 10
    docs = spark.createDataFrame([(d, t, *((None, "s", 1, 0.5, 1, 0, 1, b"x", 1, "w") if d and d % 2 else blank)) for d, t in texts], f"doc_id long, text string, {CLASH}")
    labels = spark.createDataFrame([(100 + k, int(k % 3 > 0), int(k % 3 == 0), "x") for k in range(30)] + [(100, 1, 0, None), (None, 1, 1, None), (101, None, None, None)], "doc_id long, quality int, toxic int, text string")
    pages = spark.createDataFrame([(*r, "own") for r in PAGES] + [(None, None, None, None)], "page_id long, url string, html string, digest string")
    for path, rows in ((full, (docs, labels, pages)), (empty, (docs.limit(0), labels.limit(0), pages.limit(0)))):
        for name, df in zip(("documents", "labels", "pages"), rows, strict=True):
            df.write.parquet(f"{path}/{name}.parquet")
    return full, empty, len(texts), len(PAGES) + 1


@pytest.mark.parametrize("name", list(CONTRACT))
def test_queries_on_edge_cases(spark, tables, name):
    full, empty, n, pages = tables
    query = registry.QUERIES[name]
    rows = query(spark, full)
    assert rows.columns[: len(CONTRACT[name].split())] == CONTRACT[name].split()
    got = rows.collect()
    if name == "op6_license_scan":
        assert [(r.doc_id, r.license) for r in got] == [(20, "MIT"), (20, "MIT")]
    else:
        assert len(got) == (pages if name == "op10_warc" else n)
    if "score" in rows.columns and "predicted" in rows.columns:
        assert all(0 <= r.score <= 1 for r in got)
    assert sorted(map(repr, query(spark, full).collect())) == sorted(map(repr, got))
    assert query(spark, empty).collect() == []
