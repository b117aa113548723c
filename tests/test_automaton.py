"""The automaton over all terms against a plain search."""

import random

from themescope.operators import automaton
from themescope.plans.ontology import SHIPPED, dimension


def plain(docs, terms):
    out = {}
    for d, text in docs:
        for theory, term in terms:
            if text is not None and term and term.lower() in text.lower():
                out[d, theory] = out.get((d, theory), 0) + 1
    return out


def rows(df):
    return {(r.doc_id, r.theory): r.hits for r in df.collect()}


def test_twenty_thousand_terms_without_a_join(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    terms = [(f"T{k % 90}", word(rng.randrange(2, 7)) + (" " + word(3) if k % 7 == 0 else "")) for k in range(20_000)]
    docs = [(k, " ".join(word(rng.randrange(1, 9)) for _ in range(60))) for k in range(30)]
    found = automaton.term_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(terms, "theory string, term string"))
    assert rows(found) == plain(docs, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_edge_cases_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(automaton, "TERMS", 3)
    docs = [(1, "A b\nABC"), (2, None), (3, ""), (None, "xyz abc"), (1, "abc"), (5, "ÄÖ 😀 straße" * 2000)]
    terms = [("p", "abc"), ("p", "ABC"), ("q", "b"), ("q", ""), ("q", None), (None, "z a"), ("r", "ÄÖ 😀"), ("r", "nowhere"), ("p", "bc"), ("s", "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(terms, "theory string, term string")
    assert len(list(automaton.blocks(frame[1]))) == 3
    assert rows(automaton.term_hits(*frame)) == plain(docs, terms)
    assert automaton.term_hits(frame[0], frame[1].limit(0)).collect() == [] and automaton.term_hits(frame[0].limit(0), frame[1]).collect() == []


def test_the_shipped_ontology_needs_no_compilation(spark):
    terms = dimension(spark).where("kind = 'keyword'").select("theory", "term")
    docs = [(1, "Алгоритм и код: действие, рой"), (2, "theatre of input and output")]
    want = plain(docs, [(t.theme, t.term) for t in SHIPPED.terms if t.kind == "keyword"])
    assert rows(automaton.term_hits(spark.createDataFrame(docs, "doc_id int, text string"), terms)) == want
