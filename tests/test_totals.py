"""Totals taken while writing, networks of a stream, results as one JSON array."""

import datetime as dt
import json
import time

from test_reports import some_results

from themescope.operators import reports
from themescope.operators.network import network
from themescope.sources import results
from themescope.sources.json_array import write_json_array
from themescope.streaming.evidence import network_stream


def test_totals_come_with_the_writing(spark, tmp_path):
    done = some_results(spark, 60).cache()
    want = spark.sql(reports.run_totals("{r}"), r=done).first().asDict()
    watched, seen = results.observed(done)
    results.write_json(watched, str(tmp_path / "out"))
    assert reports.with_percent(seen.get) == want and want["errors"] > 0 and want["meta_metaphors"] > 0
    watched, seen = results.observed(done.limit(0))
    results.write_json(watched, str(tmp_path / "none"))
    assert reports.with_percent(seen.get) == {"processed": 0, "successful": 0, "errors": 0, "meta_metaphors": 0, "meta_percent": None}


def test_totals_of_a_stream(spark, tmp_path):
    done = some_results(spark, 60).drop("answer")
    done.repartition(3).write.parquet(str(tmp_path / "in"))
    want = spark.sql(reports.run_totals("{r}"), r=spark.read.parquet(str(tmp_path / "in"))).first().asDict()
    totals = results.Totals()
    spark.streams.addListener(totals)
    try:
        stream, _ = results.observed(spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination(120)
        end = time.time() + 20
        while totals.counts["processed"] < 60 and time.time() < end:
            time.sleep(0.2)
        assert totals.totals() == want
    finally:
        spark.streams.removeListener(totals)


def test_networks_of_a_stream_are_those_of_the_table(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    kind = "doc_id long, theory string, theory_ord int, level string, type string, weight double, semantic_field string, seen timestamp"
    rows = []
    for doc in range(12):
        for k in range(doc % 5):
            level = ("meta_metaphor", "scientific_metaphor", "explicit_term")[(doc + k) % 3]
            rows.append((doc, "ABC"[(doc * k) % 3], (doc * k) % 3, level, "decorative", 0.2 * (k + 1), "f", at + dt.timedelta(minutes=doc + 3 * k)))
    for n in range(3):  # the pieces of a document lie in several files
        spark.createDataFrame(rows[n::3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(99, "A", 0, "x", "y", 0.1, "f", at + dt.timedelta(days=2))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        network_stream(stream, late="1 hour", gap="20 minutes").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination(120)
    want = network(spark.createDataFrame(rows, kind)).collect()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 5


def test_results_are_one_json_array(spark, tmp_path):
    done = some_results(spark, 25)
    write_json_array(done.repartition(4), str(tmp_path / "all.json"))
    text = (tmp_path / "all.json").read_text(encoding="utf-8")
    held = json.loads(text)
    assert text == json.dumps(held, ensure_ascii=False, indent=2)
    want = {r.row_id: r for r in done.selectExpr("* EXCEPT (answer)", "to_json(answer) AS answer").collect()}
    assert len(held) == 25 and set(held[0]) == set(done.columns)
    for r in held:
        plain = want[r["row_id"]]
        assert r["answer"] == (json.loads(plain.answer) if plain.answer else None) and r["status"] == plain.status
    assert [p.name for p in tmp_path.iterdir()] == ["all.json"]
    write_json_array(done.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
