"""Retries over a stream, against the table's; a service that is asked with timers, over a restart."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from themescope.operators.responses import resolve
from themescope.sources import answers
from themescope.streaming import retries

ATTEMPTS = "row_id long, attempt int, http_status int, body string, exception string"
GOOD = '{"a": 1}'


def until(query, told, seconds=90):
    end = time.time() + seconds
    while not told() and time.time() < end:
        if query.exception():
            raise query.exception()
        time.sleep(0.5)
    query.stop()
    assert told()


@pytest.fixture
def service():
    asked, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            with lock:
                asked.append((prompt, time.time()))
                n = sum(p == prompt for p, _ in asked)
            self.send_response(429 if prompt.startswith("busy") and n == 1 else 500 if prompt.startswith("broken") else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "no json" if prompt.startswith("bad") and n < 3 else GOOD}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield answers.Service(f"http://127.0.0.1:{server.server_port}/", "k", "m", pause=0, backoff=1.0), asked
    server.shutdown()


def test_outcomes_are_those_of_the_table(spark):
    rng = random.Random(1)
    kinds = [(429, None, None), (500, None, None), (200, GOOD, None), (200, "```json\n" + GOOD + "\n```", None), (200, "[1]", None), (None, None, "late"), (200, GOOD + " x", None)]
    rows = [(k, a, *rng.choice(kinds)) for k in range(200) for a in range(3) if a == 0 or rng.random() < 0.7]
    want = {r.row_id: tuple(r)[1:] for r in resolve(spark.createDataFrame(rows, ATTEMPTS)).collect()}
    assert want == {k: retries.outcome({a: tuple(v) for r, a, *v in rows if r == k}) for k in want}


def test_attempts_in_any_order_give_the_rows_of_the_table(spark, tmp_path):
    rng = random.Random(2)
    kinds = [(429, None, None), (500, None, None), (200, GOOD, None), (200, "[1]", None), (None, None, "late")]
    rows = []
    for k in range(40):
        for a in range(3):
            rows.append((k, a, *rng.choice(kinds)))
            if rows[-1][2:4] == (200, GOOD):
                break
    rows += [(100, 0, 429, None, None), (101, 1, 500, None, None)]  # these never end: their time runs out
    rng.shuffle(rows)
    source = tmp_path / "in"
    for n in range(0, len(rows), 30):
        spark.createDataFrame(rows[n : n + 30], ATTEMPTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    out, want = str(tmp_path / "out"), {tuple(r) for r in resolve(spark.createDataFrame(rows, ATTEMPTS)).collect()}
    query = retries.resolve_stream(stream, patience=12).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").format("parquet").start(out)
    held = lambda: [tuple(r) for r in spark.read.schema(retries.RESOLVED).parquet(out).collect()] if (tmp_path / "out").exists() else []
    until(query, lambda: len(held()) >= len(want))
    got = held()
    assert set(got) == want and len(got) == len(want)


def test_no_prompt_is_asked_twice_after_a_restart(spark, tmp_path, service):
    it, asked = service
    prompts = [(1, "fine one"), (2, "busy two"), (3, "broken three"), (4, "bad four"), (5, "fine five")]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(prompts[:3] + prompts[:1], "row_id long, prompt string").write.parquet(source)
    held = lambda: {(r.row_id, r.attempt): r.http_status for r in spark.read.schema(answers.ATTEMPTS).parquet(out).collect()} if (tmp_path / "out").exists() else {}
    read = lambda: spark.readStream.schema("row_id long, prompt string").parquet(source)
    until(retries.write_attempts(read(), it, out, state), lambda: {k for k, _ in held()} == {1, 2, 3})
    spark.createDataFrame(prompts[2:] + prompts[:1], "row_id long, prompt string").write.mode("append").parquet(source)
    done = {(1, 0): 200, (2, 0): 429, (2, 1): 200, (3, 0): 500, (3, 1): 500, (3, 2): 500, (4, 0): 200, (4, 1): 200, (4, 2): 200, (5, 0): 200}
    until(retries.write_attempts(read(), it, out, state), lambda: len(held()) >= len(done))
    assert held() == done
    times = {p: [t for q, t in asked if q == p] for _, p in prompts}
    assert {p: len(t) for p, t in times.items()} == {"fine one": 1, "busy two": 2, "broken three": 3, "bad four": 3, "fine five": 1}
    assert times["busy two"][1] - times["busy two"][0] >= 0.9 and times["bad four"][2] - times["bad four"][1] >= 1.9
    got = {r.row_id: (r.attempt_used, r.error) for r in resolve(spark.read.schema(answers.ATTEMPTS).parquet(out)).collect()}
    assert got == {1: (0, None), 2: (1, None), 3: (None, "Max retries exceeded"), 4: (2, None), 5: (0, None)}


def test_one_pace_for_the_whole_run(spark, service):
    it, asked = service
    slow = answers.Service(it.url, "k", "m", pause=0, pace=0.1)
    prompts = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "row_id long, prompt string").repartition(3)
    began = time.time()
    assert answers.ask(prompts, slow).count() == 12
    assert len(asked) == 12 and time.time() - began >= 0.1 * 12
