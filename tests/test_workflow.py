"""Sources, retries, networks of a caller's evidence, results and streams on small tables."""

import json
import threading
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from themescope.functions.text import combined, truncated
from themescope.operators import lexical
from themescope.operators.index import row_index
from themescope.operators.network import clusters, network, pre_analysis
from themescope.operators.responses import classified, contract, resolve, tagged
from themescope.plans import prompts
from themescope.plans.ontology import SHIPPED
from themescope.sources import answers, results, tables, xlsx
from themescope.streaming import evidence as stream

ATTEMPTS = "row_id long, attempt int, http_status int, body string, exception string"
GOOD = '{"primary_class": "IIT", "confidence": "high", "is_hybrid": true}'


def test_row_index_counts_over_ranges(spark):
    got = row_index(spark.range(100, 0, -3).selectExpr("id AS k"), "k").collect()
    assert [r.idx for r in sorted(got, key=lambda r: r.k)] == list(range(len(got)))
    assert row_index(spark.range(0), "id").count() == 0


def test_csv_rows_are_prepared(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,descr,descr_en,descr_clean\nA,"x, ""q""\ny",,z\n,,,\n', encoding="utf-8")
    rows = sorted(tables.prepare(tables.read_csv(spark, str(tmp_path / "a.csv"))).collect(), key=lambda r: r.row_id)
    assert [(r.title, r.combined_description) for r in rows] == [("A", 'x, "q"\ny  z'), ("Item_1", "")]
    with pytest.raises(ValueError):
        combined(spark.range(1))
    assert spark.range(1).selectExpr("repeat('é', 200) AS t").select(truncated("t")).first()[0] == "é" * 100 + "..."


def test_retries_end_in_the_first_good_answer_or_the_last_error(spark):
    rows = [
        (1, 0, 429, None, None), (1, 1, 200, f"```json\n{GOOD}\n```", None),
        (2, 0, 500, None, None), (2, 1, 500, None, None), (2, 2, 500, None, None),
        (3, 0, None, None, "t"), (3, 1, 200, "[1]", None), (3, 2, 200, GOOD + " x", None),
        (4, 2, None, None, "timeout"), (7, 0, 429, None, None), (7, 1, None, None, "late"), (8, 0, 200, GOOD + "] [", None), (9, 0, 200, f"{GOOD}] [{GOOD}", None), (10, 4, 500, None, None),
    ]
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    got = {r.row_id: (r.attempt_used, r.answer, r.error) for r in resolve(attempts).collect()}
    assert got == {1: (1, GOOD, None), 2: (None, None, "Max retries exceeded"), 3: (None, None, "invalid JSON"), 4: (None, None, "timeout"), 7: (None, None, "late"), 8: (None, None, "invalid JSON"), 9: (None, None, "invalid JSON"), 10: (None, None, "Max retries exceeded")}
    inputs = spark.createDataFrame([(1, "A", "text"), (2, None, "text"), (5, "B", "  "), (6, "C", "no attempts")], "row_id long, title string, combined_description string")
    done = {r.row_id: r for r in classified(inputs, attempts).collect()}
    assert (done[1].primary_class, done[1].is_hybrid, done[1].status, done[1].description_length) == ("IIT", True, None, 4)
    assert [done[k].status for k in (2, 5, 6)] == ["error", "skipped", "error"] and done[5].description_length is None


def test_networks_of_given_evidence(spark):
    rows = [(1, "COMP", 0, "meta_metaphor", "decorative", 0.5, "b"), (1, "COMP", 0, "scientific_metaphor", "ontological", 0.1, "a"), (1, "IIT", 1, "explicit_term", "decorative", 0.6, "c"), (2, "PAN", 5, "explicit_term", "decorative", 0.4, "d")]
    given = spark.createDataFrame(rows, "doc_id long, theory string, theory_ord int, level string, type string, weight double, semantic_field string")
    got = {r.doc_id: tuple(r)[1:] for r in network(given).collect()}
    assert got == {1: (True, "COMP", "COMP, IIT"), 2: (False, "PAN", "")}  # equal weights: the first cluster
    assert {(r.doc_id, r.theory): r.semantic_fields for r in clusters(given).collect()}[1, "COMP"] == ["a", "b"]
    assert network(given.limit(0)).count() == 0


def test_results_are_written(spark, tmp_path):
    inputs = spark.createDataFrame([(1, "A", "one"), (2, None, "")], "row_id long, title string, combined_description string")
    done = classified(inputs, spark.createDataFrame([(1, 0, 200, GOOD, None)], ATTEMPTS))
    results.write_csv(inputs, done, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"))
    assert back.count() == 2 and {"title", "result_title"} <= set(back.columns)
    results.write_json(done, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    results.write_report(done, str(tmp_path / "txt"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert "processed 2, successful 2, errors 0" in lines and "IIT: 1 (50.0%)" in lines and "A: IIT, confidence high, hybrid, secondary class N/A" in lines
    for few in (results.attached(inputs, done.limit(1)), results.attached(inputs.limit(1), done)):
        with pytest.raises(Exception, match="no pair"):
            few.count()


def test_a_service_is_asked_again(spark):
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            seen[prompt] = seen.get(prompt, 0) + 1
            self.send_response(429 if prompt == "busy" and seen[prompt] == 1 else 500 if prompt == "broken" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": GOOD}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service = answers.Service(f"http://127.0.0.1:{server.server_port}/", "k", "m", pause=0, backoff=0.01)
    prompts = spark.createDataFrame([(1, "busy"), (2, "broken"), (3, "fine")], "row_id long, prompt string").coalesce(1)
    rows = [tuple(r) for r in answers.ask(prompts, service).collect()]
    server.shutdown()
    assert sorted((r, a, s) for r, a, s, *_ in rows) == [(1, 0, 429), (1, 1, 200), (2, 0, 500), (2, 1, 500), (2, 2, 500), (3, 0, 200)]
    with pytest.raises(ValueError):
        answers.Service("http://x", "", "m")


def test_a_stream_gives_the_rows_of_its_table(spark, tmp_path):
    spark.createDataFrame([(1, "алгоритм и процессор"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream.write_evidence(stream.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [(r.doc_id, r.theory) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "COMP")]


def test_text_columns_are_whole(spark):
    from themescope.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["text_column_selection"](spark, sf).collect()
    assert any(len(t or "") > 60 for t in texts.values())
    for r in rows:
        assert r.descr == (None if r.row_id % 7 == 0 else texts[r.row_id])
        assert r.row_id % 3 == 0 or r.row_id % 11 == 0 or r.descr_en == texts[r.row_id].replace(" ", "_")


FULL = json.dumps({
    "primary_class": "COMP", "confidence": "low", "scores": {"COMP": 0.7, "IIT": 0.6, "PAN": 0.35}, "is_hybrid": True, "secondary_class": "IIT",
    "evidence": [{"class": c, "metaphor_level": "explicit_term", "metaphor_type": "decorative", "span": s, "weight": 0.5, "reasoning": "r" * 200} for c, s in (("COMP", "code"), ("IIT", "absent"))],
    "metaphor_analysis": {"meta_metaphor_detected": True, "dominant_semantic_field": "f", "artistic_transformation": "t"},
})


def test_a_full_answer_becomes_report_and_charts(spark, tmp_path):
    inputs = spark.createDataFrame([(1, "A", "the code"), (2, "B", "x"), (3, "C", "")], "row_id long, title string, combined_description string")
    done = classified(inputs, spark.createDataFrame([(1, 0, 200, FULL, None), (2, 0, 500, None, None)], ATTEMPTS)).cache()
    rules = contract(done, inputs.selectExpr("row_id", "combined_description AS text")).collect()
    assert [tuple(r) for r in rules] == [(1, True, True, True, False, False)]  # PAN has no evidence, one span is not in the text
    path = results.save(inputs, done, [*SHIPPED.themes, "UND"], str(tmp_path), datetime(2024, 5, 6, 7, 8, 9), "m", workbook=True)
    assert path.endswith("analysis_20240506_070809")
    lines = [r.value for r in spark.read.text(f"{path}/report").collect()]
    want = ["Date: 2024-05-06 07:08:09", "Model: m", "processed 3, successful 2, errors 1", "patterns 1 (50.0%)", "A: COMP, confidence low, hybrid, secondary class IIT", "  pattern: f, t", "  COMP: 0.70", "B: Max retries exceeded"]
    assert set(want) <= set(lines)
    assert f"  - COMP, explicit_term, decorative, 0.50: code... / {'r' * 150}..." in lines
    heat = {r.theory: r.avg_score for r in spark.read.json(f"{path}/charts/heatmap").collect()}
    assert heat["COMP"] == 0.7 and heat["EMERG"] == 0.0 and len(heat) == 8
    assert {r.colour for r in spark.read.json(f"{path}/charts/confidence").collect()} == {"lightcoral"}
    assert xlsx.read_xlsx(spark, f"{path}/data.xlsx").count() == 3
    more = tagged(done, pre_analysis(inputs.selectExpr("row_id AS doc_id"), lexical.evidence(inputs.selectExpr("row_id AS doc_id", "combined_description AS text"))))
    assert {"index", "detected_metaphors", "evidence_preview"} <= set(more.columns) and more.count() == 3
    assert results.preview(done, 2).count() == 2


def test_workbooks_round_trip(spark, tmp_path):
    rows = [(1, "a <b> & c\n\x01", 1.5, True, ["x"]), (2, None, None, False, None), (3, " é😀 ", -2.25, None, [])]
    df = spark.createDataFrame(rows, "id long, t string, x double, f boolean, l array<string>")
    xlsx.write_xlsx(df, str(tmp_path / "one.xlsx"))
    back = xlsx.read_xlsx(spark, str(tmp_path / "one.xlsx"))
    assert back.dtypes == [("id", "bigint"), ("t", "string"), ("x", "double"), ("f", "boolean"), ("l", "string")]
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, "a <b> & c\n", 1.5, True, '["x"]'), (2, None, None, False, None), (3, " é😀 ", -2.25, None, "[]")]
    assert xlsx.read_xlsx(spark, str(tmp_path / "one.xlsx"), schema="t string, missing double").columns == ["t", "missing"]
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_xlsx(spark, str(tmp_path / "one.xlsx"), sheet="other")
    (tmp_path / "a.csv").write_text("title,n\nA,1\n", encoding="utf-8")
    xlsx.csv_to_xlsx(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.xlsx"))
    assert [tuple(r) for r in xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [("A", "1")]
    assert [xlsx.column_of(f"{xlsx.place_of(k)}7") for k in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_shared_strings_are_read(tmp_path):
    main = xlsx.MAIN[1:-1]
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        for name, part in xlsx.PARTS.items():
            z.writestr(name, part.replace("{sheet}", "data"))
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>title</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c><c r="D2"><v>4</v></c></row></sheetData></worksheet>')
    assert list(xlsx.read_sheet((tmp_path / "s.xlsx").read_bytes(), "data")) == [[None, "title"], [None, "ab", None, 4.0]]


def test_settings_of_a_service():
    given = {answers.KEY: "k", answers.MODEL: "m", answers.TITLE: "t"}
    s = answers.Service.from_settings("http://x", given, system="s")
    assert (s.key, s.model, s.title, s.referer, s.system) == ("k", "m", "t", None, "s")
    with pytest.raises(ValueError):
        answers.Service.from_settings("http://x", {answers.KEY: "k"})


def test_the_section_goes_before_the_format():
    told = prompts.extended(prompts.system_prompt())
    assert told.index("LEVELS:") < told.index(prompts.MARKER) and prompts.extended("none") == "none"
    assert "explicit (1.0), technical_cue (0.6), metaphor (0.4)" in told


def test_every_word_is_searched_once(spark):
    plan = lexical.evidence(spark.createDataFrame([(1, "x")], "doc_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    words = {w for t in SHIPPED.terms for w in ([t.term.lower()] if t.kind == "keyword" else t.words)} | set(SHIPPED.marker("ontological"))
    assert plan.count("Contains(text_lc") == len(words)


def test_csv_keeps_white_space_quotes_and_nulls(spark, tmp_path):
    texts = [" lead", "trail  ", "a\r\nb", "c\nd", "\ttab\t", '"q"', 'say ""', "", None, " ", "a,b", "\\", '\\"', "x\\", "é😀", "\r", "\n", "-1", "null", "#", "x" * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    done = spark.createDataFrame([(k, bool(k % 2) if k % 3 else None, k / 7) for k in range(len(texts))], "row_id long, flag boolean, x double")
    results.write_csv(rows, done, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), results.attached(rows, done).schema).collect()
    assert {r.row_id: (r.text, r.flag, r.x) for r in back} == {k: (t, bool(k % 2) if k % 3 else None, k / 7) for k, t in enumerate(texts)}


def test_rows_without_a_key_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    # the last file is the largest: Spark reads it first
    for k in range(4):
        (tmp_path / f"{k}.csv").write_text("descr\n" + "".join(f"{k} {n} {'y' * 10 * k}\n" for n in range(5 * (k + 1))), encoding="utf-8")
    got = tables.prepare(tables.read_csv(spark, str(tmp_path))).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(50)) and [r.title for r in got] == [f"Item_{k}" for k in range(50)]
    assert [tuple(map(int, r.descr.split()[:2])) for r in got] == [(k, n) for k in range(4) for n in range(5 * (k + 1))]
