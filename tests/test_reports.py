"""Numbers as text against Python's formatting; all charts from one pass over the results."""

import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from themescope.functions.numbers import fixed
from themescope.operators import reports
from themescope.operators.responses import classified
from themescope.plans.dialects import Spark

ATTEMPTS = "row_id long, attempt int, http_status int, body string, exception string"


@pytest.mark.parametrize("digits", (0, 1, 2, 3))
def test_numbers_are_formatted_as_python_does(spark, tmp_path, digits):
    rng = np.random.default_rng(digits)
    scale = 10.0**digits
    n = 250_000
    near_ties = (rng.integers(0, 200_000, n) + 0.5) / scale
    near_ties = np.where(rng.random(n) < 0.5, np.nextafter(near_ties, rng.choice([0.0, 1e9], n)), near_ties)
    values = np.concatenate([
        near_ties, rng.random(n) * 100, rng.integers(0, 1 << 40, n) / 2.0 ** rng.integers(0, 45, n), -rng.random(1000), rng.random(1000) * 10.0 ** rng.integers(-300, 18, 1000),
        [6.25, 0.125, 0.5, 1.5, 2.5, 2.675, 1.005, 0.0, -0.0, -0.04, 99.95, 99.949999, 999999999.995, 2.0**52 + 0.5, 2.0**53, 9.2e18, float("nan"), float("inf"), float("-inf"), 5e-324],
    ])
    pq.write_table(pa.table({"x": values}), tmp_path / "x.parquet")
    got = spark.read.parquet(str(tmp_path / "x.parquet")).select("x", fixed("x", digits).alias("t")).toArrow().to_pydict()
    wrong = [(x, t) for x, t in zip(got["x"], got["t"], strict=True) if t != f"{x:.{digits}f}"]
    assert not wrong, wrong[:5]
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, double('nan') AS y").select(fixed("x", 1), fixed("y", 1)).first()[:] == (None, "nan")


def some_results(spark, n):
    rng = random.Random(n)
    names = ["A", "B", "C", "UND"]
    attempts, rows = [], []
    for k in range(n):
        body = {
            "primary_class": rng.choice([*names, None]), "confidence": rng.choice(["high", "low", "odd", None]), "is_hybrid": rng.choice([True, False]), "scores": {c: rng.choice([0.1, 0.7, None]) for c in rng.sample(names, rng.randrange(4))},
            "evidence": [{"class": rng.choice(names), "metaphor_level": rng.choice(["x", "y", None]), "metaphor_type": rng.choice(["p", "q"])} for _ in range(rng.randrange(4))], "metaphor_analysis": {"meta_metaphor_detected": rng.choice([True, False])},
        }
        attempts.append((k, 0, rng.choice([200, 200, 200, 500]), json.dumps({f: v for f, v in body.items() if rng.random() < 0.9}), None))
        rows.append((k, "t", rng.choice(["", "x" * rng.randrange(1, 60)])))
    return classified(spark.createDataFrame(rows, "row_id long, title string, combined_description string"), spark.createDataFrame(attempts, ATTEMPTS))


@pytest.mark.parametrize("n", (0, 150))
def test_charts_are_the_reports_of_the_same_things(spark, n):
    results, d, classes = some_results(spark, n), Spark(), ["A", "B", "C", "D"]
    got = reports.charts(results, classes)
    sql = {
        "classes": reports.histogram("{r}", "primary_class"), "meta": reports.split_of("{r}", "meta_metaphor_detected"), "hybrid": reports.split_of("{r}", "is_hybrid"), "scores": reports.avg_scores(d, "{r}"),
        "levels": reports.evidence_histogram(d, "{r}", "metaphor_level"), "types": reports.evidence_histogram(d, "{r}", "metaphor_type"), "lengths": reports.avg_length("{r}"), "boxes": reports.length_boxplot(d, "{r}"),
        "heatmap": reports.score_vector(d, "{r}", classes), "shares": reports.pie_shares("{r}"), "confidence": reports.histogram("{r}", "confidence"),
    }
    assert set(got) == set(sql)
    for name, q in sql.items():
        want = spark.sql(q, r=results)
        assert sorted(map(repr, got[name].select(*want.columns).collect())) == sorted(map(repr, want.collect())), name
        assert "ExistingRDD" in got[name]._jdf.queryExecution().optimizedPlan().toString() or "LogicalRDD" in got[name]._jdf.queryExecution().optimizedPlan().toString()


def test_the_summary_reads_the_results_once(spark, tmp_path):
    some_results(spark, 20).drop("answer").write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r")).selectExpr("*", "parse_json('{}') AS answer")
    plan = reports.summary(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("Aggregate") == 1 and "Join" not in plan
