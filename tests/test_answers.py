"""Strict JSON, guards of types, the contract in the row, networks in the row, an answer that breaks off."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from themescope.operators import lexical
from themescope.operators.network import clusters, in_row, network, pre_analysis, pre_analysis_in_rows
from themescope.operators.responses import classified, contract, contract_sql, resolve
from themescope.plans.dialects import Spark
from themescope.plans.ontology import PROXY
from themescope.sources import answers

ATTEMPTS = "row_id long, attempt int, http_status int, body string, exception string"
BODIES = [
    '{"a":1}', "{'a':1}", '{"a":"x\ty"}', '{"a":NaN}', '{"a":Infinity}', '{"a":-Infinity}', '{"a":+Infinity}', '{"a":-INF}', '{"a":INF}', '{"a":"-INF, +Infinity"}', '{"a":"\\"","b":-INF}', '{"a":-NaN}',
    '{"a":1} x', '{"a":1}{"b":2}', '{"a":1}] [{"a":1}', '{}, {}', '{}, 0] x', "[1]", '"a"', "1", "null", "", " ", "{", '{"a":1,"a":2}', '{"a":{"b":1,"b":[2]}}', '{"a":01}', '{"a":1.}', '{"a":.5}', '{"a":+1}',
    '{"a":"\\x"}', '{"a":1,}', '{"a":/*c*/1}', "{a:1}", '{"a":"é😀"}', '{"a":1e400}', '{"a":123456789012345678901234567890123456789012}', '\ufeff{"a":1}', "{}", '```json\n{"a":1}\n```', '```json {"a":"```"}```', '```\n{"a":1}\n```', ' \n{"a":1}\u00a0', '{"a"\n:\t1}', '{"a":tru}', '{"a":[1,2}',
]


def test_bodies_are_judged_as_a_json_parser_does(spark):
    attempts = spark.createDataFrame([(k, 0, 200, b, None) for k, b in enumerate(BODIES)], ATTEMPTS)
    got = {r.row_id: r.answer is not None for r in resolve(attempts).collect()}
    assert {BODIES[k]: v for k, v in got.items()} == {b: answers.is_object(b) for b in BODIES}
    rows = spark.createDataFrame([(k, "t", "text") for k in range(len(BODIES))], "row_id long, title string, combined_description string")
    done = classified(rows, attempts).selectExpr("row_id", "try_variant_get(answer, '$.a', 'double') AS a").collect()
    for r in done:
        body = BODIES[r.row_id]
        if answers.is_object(body) and not body.startswith(("`", " ")):
            value = json.loads(body).get("a")
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                assert r.a == float(value) or (r.a != r.a and value != value), body


def test_no_answer_is_parsed_twice(spark):
    attempts = spark.createDataFrame([(1, 0, 200, "{}", None)], ATTEMPTS)
    rows = spark.createDataFrame([(1, "t", "x")], "row_id long, title string, combined_description string")
    plan = classified(rows, attempts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json(") == 1 and "get_json_object" not in plan


def test_fields_of_another_kind_are_null(spark):
    body = json.dumps({
        "primary_class": 7, "is_hybrid": "true", "scores": {"A": 0.9, "B": "x", "C": None, "D": 1, "E": [1]},
        "evidence": [{"class": "A", "weight": "high", "span": 3}, {"class": {"x": 1}}, 7, None], "metaphor_analysis": [],
    })
    rows = spark.createDataFrame([(k, "t", "text") for k in (1, 2)], "row_id long, title string, combined_description string")
    done = classified(rows, spark.createDataFrame([(1, 0, 200, body, None), (2, 0, 200, '{"scores": [1], "evidence": {"a": 1}}', None)], ATTEMPTS))
    d = Spark()
    r = {x.row_id: x for x in done.collect()}
    assert (r[1].primary_class, r[1].is_hybrid, r[1].meta_metaphor_detected, r[2].primary_class) == ("7", True, False, None)
    scores = done.sparkSession.sql(f"SELECT * FROM {d.scores('{done}', 'row_id')}", done=done).collect()
    assert {(x.row_id, x.theory): x.score for x in scores} == {(1, "A"): 0.9, (1, "B"): None, (1, "C"): None, (1, "D"): 1.0, (1, "E"): None}
    pieces = done.sparkSession.sql(f"SELECT * FROM {d.evidence('{done}', 'row_id')}", done=done).collect()
    assert [tuple(x[c] for c in ("row_id", "position", "class", "span", "weight")) for x in sorted(pieces, key=lambda x: x.position)] == [(1, 0, "A", "3", None), (1, 1, '{"x":1}', None, None), (1, 2, None, None, None), (1, 3, None, None, None)]
    assert len(contract(done, rows.selectExpr("row_id", "combined_description AS text")).collect()) == 2


def test_the_contract_in_the_row_is_that_of_the_joins(spark):
    rng = random.Random(2)
    names = ["A", "B", "C", "UND"]
    bodies = []
    for k in range(80):
        scores = {n: rng.choice([0.0, 0.2, 0.3, 0.31, 0.5, 0.9, None]) for n in rng.sample(names, rng.randrange(5))}
        evidence = [{"class": rng.choice(names), "span": rng.choice(["Code", "tree", "absent", None])} for _ in range(rng.randrange(4))]
        body = {"primary_class": rng.choice(names), "secondary_class": rng.choice([None, *names]), "is_hybrid": rng.choice([True, False, None]), "scores": scores, "evidence": evidence}
        bodies.append((k, 0, 200, json.dumps({n: v for n, v in body.items() if rng.random() < 0.9}), None))
    rows = spark.createDataFrame([(k, "t", rng.choice(["the code", "a TREE of codes", ""]) + ".") for k in range(82)], "row_id long, title string, combined_description string")
    done = classified(rows, spark.createDataFrame(bodies, ATTEMPTS))
    texts = rows.selectExpr("row_id", "combined_description AS text").where("row_id % 9 > 0")
    mine = contract(done, texts)
    joined = spark.sql(contract_sql(Spark(), "{done}", "{texts}"), done=done, texts=texts)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, joined.select(*mine.columns).collect())) and mine.count() == 80


def test_networks_in_the_row_are_those_of_the_table(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(60):
        for k in range(rng.randrange(8)):
            rows.append((doc, rng.choice(["A", "B", "C", None]), k, rng.choice(["meta_metaphor", "scientific_metaphor", "explicit_term", None]), rng.choice([0.1, 0.25, 0.5, 0.7]), rng.choice(["x", "a; b"])))
    given = spark.createDataFrame(rows, "doc_id long, theory string, theory_ord int, level string, weight double, semantic_field string").selectExpr("*", "'decorative' AS type")
    lists = given.selectExpr("doc_id", "struct(theory_ord AS rank, theory, level, weight) AS p").groupBy("doc_id").agg({"p": "collect_list"}).toDF("doc_id", "all_pieces")
    mine = lists.selectExpr("doc_id", f"{in_row('all_pieces')} AS n").select("doc_id", "n.*")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, network(given).collect()))
    empty = spark.sql(f"SELECT {in_row('''CAST(array() AS array<struct<theory string, rank int, level string, weight double>>)''')} AS n").first().n
    assert tuple(empty) == (False, None, "")


def test_fields_of_a_cluster_stay_whole(spark):
    given = spark.createDataFrame([(1, "A", 0, "x", "y", 0.5, "a; b"), (1, "A", 0, "x", "y", 0.5, "a"), (2, "B", 1, "x", "y", 0.5, None)], "doc_id long, theory string, theory_ord int, level string, type string, weight double, semantic_field string")
    assert {r.doc_id: r.semantic_fields for r in clusters(given).collect()} == {1: ["a", "a; b"], 2: []}


def test_pre_analysis_is_a_projection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mine = pre_analysis_in_rows(lexical.analysed(docs, PROXY))
    joined = pre_analysis(docs, lexical.evidence(docs, PROXY)).select(*mine.columns)
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, joined.collect()))
    plan = mine._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("kind", ("cut", "no_length", "garbage"))
def test_an_answer_that_breaks_off_is_an_exception_of_its_attempt(spark, kind):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            if kind == "garbage":
                self.wfile.write(b"no http at all\r\n\r\n")
                return
            self.send_response(200)
            if kind == "cut":
                self.send_header("Content-Length", "1000")
            self.end_headers()
            self.wfile.write(b'{"choices": [')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service = answers.Service(f"http://127.0.0.1:{server.server_port}/", "k", "m", pause=0, backoff=0, timeout=5)
    rows = answers.ask(spark.createDataFrame([(1, "p")], "row_id long, prompt string"), service)
    got = rows.collect()
    server.shutdown()
    assert [(r.attempt, r.http_status) for r in got] == [(0, None), (1, None), (2, None)] and all(r.exception for r in got)
    assert resolve(spark.createDataFrame(got, rows.schema)).first().error == got[-1].exception
