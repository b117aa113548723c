"""The lexical scorer against values worked out by hand, and the queries against DuckDB."""

import os

import duckdb
import pytest

from themescope.operators import lexical
from themescope.plans import queries
from themescope.plans.ontology import SHIPPED, ontology

SF = "/root/testdata/sf0.01"


def evidence(spark, *texts):
    rows = lexical.evidence(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")).collect()
    return {(r.doc_id, r.theory): r for r in rows}


def test_ontology_has_its_fixed_size_and_order():
    assert len(SHIPPED.terms) == 131
    assert SHIPPED.themes == ["COMP", "IIT", "PRED", "GWT", "ENACT", "PAN", "EMERG"]
    with pytest.raises(ValueError):
        ontology({"A": {"keyword": [" "]}})


def test_two_keywords_make_an_explicit_term(spark):
    r = evidence(spark, "алгоритм и процессор")[0, "COMP"]
    assert (r.score, r.level, r.span, r.type) == (0.3, "explicit_term", "алгоритм", "decorative")
    assert r.weight == pytest.approx(0.09)


def test_two_of_three_words_fall_just_under_the_threshold(spark):
    # 0.3 * (2 / 3) is 0.19999999999999998: dropped
    assert (0, "ENACT") not in evidence(spark, "сознание через")


def test_terms_match_inside_words(spark):
    assert evidence(spark, "кодирование, программатор")[0, "COMP"].span == "программа"


def test_marker_in_the_text_makes_it_ontological(spark):
    r = evidence(spark, "опыт: рой, сложность")[0, "EMERG"]
    assert (r.type, r.span) == ("ontological", "сложность")
    assert r.weight == pytest.approx(0.36)


def test_marker_in_the_span_makes_it_orientational(spark):
    assert evidence(spark, "театр, рабочее пространство")[0, "GWT"].type == "orientational"


def test_empty_and_null_texts_have_no_evidence(spark):
    assert evidence(spark, "", None, " \n ") == {}


def test_one_pass_finds_each_word_that_the_text_contains(spark):
    o = ontology({"A": {"keyword": [f"w{k}." for k in range(70)] + ["abc", "b", "bcd", "Я ТУТ"]}}, {"ontological": ["abcd", " "], "structural": ["x"], "orientational": ["y"]})
    hits = lexical.Hits(o)
    texts = ["", "abcd", "xabc", "b", "w1.w69.", "w69", "я тут", "w0.w61.w62.w63.b"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text_lc string")
    got = [r.hits for r in rows.select("doc_id", hits.found().alias("hits")).orderBy("doc_id").collect()]
    assert [{w for w, (column, bit) in hits.places.items() if bits[column] >> bit & 1} for bits in got] == [{w for w in hits.places if w in t} for t in texts]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_shipped_pre_analysis_is_one_scan_and_one_search(spark):
    """no join of the evidence with the texts, and no search of the text for each word."""
    plan = queries.QUERIES["shipped_pre_analysis"](spark, SF)._jdf.queryExecution().executedPlan().toString().lower()
    assert (plan.count("filescan"), plan.count("arrowevalpython")) == (1, 1)
    assert not any(step in plan for step in ("mergejoin", "hashjoin", "hashaggregate", "sortaggregate", "contains(text_lc"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(queries.QUERIES_SQL))
def test_queries_match_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    rows = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()]
    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(map(repr, mine)) == sorted(map(repr, rows))


def test_a_pattern_needs_several_pieces_of_evidence(spark):
    assert {r.meta_metaphor_detected for r in queries.QUERIES["meta_pattern"](spark, SF).collect()} == {True, False}
    assert not any(r.meta_metaphor_detected for r in queries.QUERIES["shipped_network"](spark, SF).collect())
