"""Reports over results (``operators.responses``): SQL that Spark and DuckDB both read, and tables made with it.

``results`` is a table or subquery with (row_id, title, primary_class, confidence, secondary_class, is_hybrid,
meta_metaphor_detected, dominant_semantic_field, artistic_transformation, status, error, description_length, answer).
Whatever is no error counts as a success, skipped rows too. Frequencies stand in descending order, ties in that of
their first row; ``position`` says so, since a table has no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.operators.index import checkpointed
from themescope.operators.lexical import real
from themescope.plans.dialects import Duck, Spark

OK = "coalesce(status, '') <> 'error'"
#: Pieces of evidence that a report shows of an item, and characters of their spans and reasons.
SHOWN, SPAN, REASON = 5, 100, 150


def pct(n: str, total: str) -> str:
    return f"CAST({n} AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(nullif({total}, 0) AS DOUBLE)"


def frequencies(counted: str, name: str, more: str = "") -> str:
    return f"SELECT {name}, n{more}, row_number() OVER (ORDER BY n DESC, first_row, {name}) AS position FROM ({counted})"


def class_distribution(results: str) -> str:
    counted = f"SELECT primary_class, count(*) AS n, min(row_id) AS first_row FROM {results} WHERE {OK} GROUP BY primary_class"
    return frequencies(counted, "primary_class", f", {pct('n', 'sum(n) OVER ()')} AS percent")


def histogram(results: str, column: str) -> str:
    return frequencies(f"SELECT {column}, count(*) AS n, min(row_id) AS first_row FROM {results} WHERE {column} IS NOT NULL AND {OK} GROUP BY {column}", column)


def evidence_histogram(d: Duck, results: str, column: str) -> str:
    rows = d.evidence(f"(SELECT * FROM {results} WHERE {OK})", "row_id")
    return frequencies(f"SELECT {column}, count(*) AS n, min(row_id) AS first_row FROM {rows} WHERE {column} IS NOT NULL GROUP BY {column}", column)


def split_of(results: str, flag: str) -> str:
    """Rows with and without a flag; a missing one counts as none."""
    return f"SELECT coalesce({flag}, FALSE) AS {flag}, count(*) AS n FROM {results} WHERE {OK} GROUP BY coalesce({flag}, FALSE)"


def run_totals(results: str) -> str:
    """The rate of patterns is null where nothing succeeded."""
    count = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    meta = f"{OK} AND coalesce(meta_metaphor_detected, FALSE)"
    return f"SELECT count(*) AS processed, {count(OK)} AS successful, {count('''status = 'error' ''')} AS errors, {count(meta)} AS meta_metaphors, {pct(count(meta), count(OK))} AS meta_percent FROM {results}"


def totals_metrics() -> list[Column]:
    """The counts of ``run_totals()`` as metrics, for ``DataFrame.observe``: they are taken while the results are written."""
    ok, meta = F.expr(OK), F.coalesce(F.col("meta_metaphor_detected"), F.lit(False))
    return [F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("successful"), F.count_if(F.coalesce(F.col("status") == "error", F.lit(False))).alias("errors"), F.count_if(ok & meta).alias("meta_metaphors")]


def with_percent(counts: dict[str, int]) -> dict[str, int | float | None]:
    """The metrics as a row of ``run_totals()``."""
    n = counts["successful"]
    return counts | {"meta_percent": counts["meta_metaphors"] * 100.0 / n if n else None}


def pie_shares(results: str) -> str:
    """Shares of confidence, pattern and hybrid, in one pass over the results."""
    parts = "(0, 'confidence'), (1, 'meta'), (2, 'hybrid')"
    label = "CASE v.chart WHEN 'confidence' THEN confidence WHEN 'meta' THEN CASE WHEN meta_metaphor_detected THEN 'Meta-Metaphor' ELSE 'Standard' END ELSE CASE WHEN is_hybrid THEN 'Hybrid' ELSE 'Single Theory' END END"
    counted = f"SELECT v.chart, {label} AS label, count(*) AS n FROM {results} CROSS JOIN (VALUES {parts}) AS v(ord, chart) WHERE {OK} GROUP BY v.chart, {label}"
    return f"SELECT chart, label, n, {pct('n', 'sum(n) OVER (PARTITION BY chart)')} AS percent FROM ({counted}) WHERE label IS NOT NULL"


def _means(d: Duck, results: str) -> str:
    rows = d.scores(f"(SELECT * FROM {results} WHERE {OK})", "row_id")
    return f"(SELECT theory, round(avg(score), 9) AS avg_score FROM {rows} GROUP BY theory)"


def avg_scores(d: Duck, results: str) -> str:
    return f"SELECT theory, avg_score, row_number() OVER (ORDER BY avg_score DESC, theory) AS position FROM {_means(d, results)}"


def score_pivot(d: Duck, results: str) -> str:
    """Means of the classes that occur, in the order of their names."""
    return f"SELECT theory, avg_score, row_number() OVER (ORDER BY theory) AS position FROM {_means(d, results)}"


def score_vector(d: Duck, results: str, classes: list[str]) -> str:
    """Means in the fixed order of the classes; 0 for one that doesn't occur."""
    values = ", ".join(f"({k}, '{t}')" for k, t in enumerate(classes))
    return f"SELECT v.ord, v.theory, coalesce(m.avg_score, {real(0.0)}) AS avg_score FROM (VALUES {values}) AS v(ord, theory) LEFT JOIN {_means(d, results)} m ON m.theory = v.theory"


def score_matrix(d: Duck, results: str, classes: list[str]) -> str:
    """Mean scores by primary class, a column for each class scored."""
    rows = d.scores(f"(SELECT * FROM {results} WHERE {OK})", "primary_class")
    return "SELECT primary_class, " + ", ".join(f"round(avg(CASE WHEN theory = '{t}' THEN score END), 9) AS {t.lower()}" for t in classes) + f" FROM {rows} GROUP BY primary_class"


def avg_length(results: str) -> str:
    return f"SELECT primary_class, round(avg(description_length), 6) AS avg_length FROM {results} WHERE {OK} GROUP BY primary_class"


def length_boxplot(d: Duck, results: str) -> str:
    """Quartiles, the outermost lengths within 1.5 times their distance, and how many lie beyond.

    Results are reduced to counts of equal lengths first, which both the quartiles and the whiskers read.
    """
    return _boxes(d, f"(SELECT primary_class, CAST(description_length AS DOUBLE) AS x, count(*) AS n FROM {results} WHERE {OK} AND description_length IS NOT NULL GROUP BY primary_class, CAST(description_length AS DOUBLE))")


def _boxes(d: Duck, counted: str) -> str:
    inside = f"x >= q1 - {real(1.5)} * (q3 - q1) AND x <= q3 + {real(1.5)} * (q3 - q1)"
    return (
        f"SELECT primary_class, min(q1) AS q1, min(median) AS median, min(q3) AS q3, min(CASE WHEN {inside} THEN x END) AS whisker_low, max(CASE WHEN {inside} THEN x END) AS whisker_high, "
        f"CAST(sum(CASE WHEN {inside} THEN 0 ELSE n END) AS BIGINT) AS outliers FROM {d.with_quantiles('x', 'n', (0.25, 0.5, 0.75), ('q1', 'median', 'q3'), counted, 'primary_class')} GROUP BY primary_class"
    )


def details(d: Duck, results: str, more: str = "") -> str:
    """The head of each successful item's block: class, confidence, secondary class of a hybrid, and what the pattern is; ``more``: further columns."""
    or_na = lambda c: f"coalesce({c}, 'N/A')"
    return (
        f"SELECT row_id, {or_na('title')} AS title, {or_na('primary_class')} AS primary_class, {or_na('confidence')} AS confidence, CASE WHEN is_hybrid THEN {or_na('secondary_class')} END AS secondary_class, "
        f"CASE WHEN is_hybrid THEN 'hybrid' ELSE '' END AS hybrid, CASE WHEN meta_metaphor_detected THEN {or_na('dominant_semantic_field')} END AS meta_semantic_field, "
        f"CASE WHEN meta_metaphor_detected THEN {or_na('artistic_transformation')} END AS meta_transformation{more} FROM {results} WHERE {OK}"
    )


def detail_scores(d: Duck, results: str) -> str:
    rows = d.scores(f"(SELECT * FROM {results} WHERE {OK})", "row_id")
    return f"SELECT row_id, theory, round(score, 2) AS score FROM {rows}"


def detail_evidence(d: Duck, results: str, shown: int = SHOWN) -> str:
    """The first pieces of evidence of each item, spans and reasons cut."""
    rows = d.evidence(f"(SELECT * FROM {results} WHERE {OK})", "row_id")
    or_na = lambda c: f"coalesce({c}, 'N/A')"
    return (
        f"SELECT row_id, position, {or_na('class')} AS class, {or_na('metaphor_level')} AS metaphor_level, {or_na('metaphor_type')} AS metaphor_type, coalesce(weight, {real(0.0)}) AS weight, "
        f"concat(substring({or_na('span')}, 1, {SPAN}), '...') AS span, concat(substring({or_na('reasoning')}, 1, {REASON}), '...') AS reasoning FROM {rows} WHERE position < {shown}"
    )


# Colours of confidences in a chart; any other is gray.
CONFIDENCE_COLOURS = {"high": "lightgreen", "medium": "orange", "low": "lightcoral"}


def summary(results: DataFrame) -> DataFrame:
    """(measure, key, x, n, first_row, total, filled): all that the charts count, from one pass over the results.

    Every successful result becomes a row for each thing it counts in: its class, flags, confidence and length, each of
    its scores and pieces of evidence. ``x`` tells lengths apart; ``total`` and ``filled`` are sum and number of values.
    """
    d = Spark()
    fact = lambda m, k, x="NULL", v="NULL": f"struct('{m}' AS measure, CAST({k} AS STRING) AS key, CAST({x} AS DOUBLE) AS x, CAST({v} AS DOUBLE) AS v)"
    own = ", ".join([
        fact("class", "primary_class"), fact("meta", "coalesce(meta_metaphor_detected, FALSE)"), fact("hybrid", "coalesce(is_hybrid, FALSE)"),
        fact("confidence", "confidence"), fact("length", "primary_class", "description_length"),
    ])
    nested = [f"transform(coalesce(map_entries(scores), array()), s -> {fact('score', 's.key', v='s.value')})"]
    nested += [f"transform(coalesce(pieces, array()), e -> {fact(m, f'e.metaphor_{m}')})" for m in ("level", "type")]
    parsed = f"SELECT *, {d.score_map('answer')} AS scores, {d.pieces('answer')} AS pieces FROM {{results}} WHERE {OK}"
    facts = f"SELECT row_id, inline(concat(array({own}), {', '.join(nested)})) FROM ({parsed})"
    return results.sparkSession.sql(f"SELECT measure, key, x, count(*) AS n, min(row_id) AS first_row, sum(v) AS total, count(v) AS filled FROM ({facts}) GROUP BY measure, key, x", results=results)


def charts_of(counted: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """The tables behind the panels of a dashboard, by name, from ``summary()``: the rows of the reports of the same things."""
    d = Spark()
    of = lambda m: f"(SELECT * FROM {{s}} WHERE measure = '{m}' AND key IS NOT NULL)"
    named = lambda m, name: frequencies(f"SELECT key AS {name}, n, first_row FROM {of(m)}", name)
    flag = lambda m, name: f"SELECT CAST(key AS BOOLEAN) AS {name}, n FROM {of(m)}"
    means = f"(SELECT key AS theory, round(total / filled, 9) AS avg_score FROM {of('score')})"
    colour = "CASE confidence " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONFIDENCE_COLOURS.items()) + " ELSE 'gray' END"
    label = "CASE measure WHEN 'confidence' THEN key WHEN 'meta' THEN if(key = 'true', 'Meta-Metaphor', 'Standard') ELSE if(key = 'true', 'Hybrid', 'Single Theory') END"
    lengths = "(SELECT key AS primary_class, x, n FROM {s} WHERE measure = 'length')"
    values = ", ".join(f"({k}, '{t}')" for k, t in enumerate(classes))
    sql = {
        "classes": named("class", "primary_class"),
        "meta": flag("meta", "meta_metaphor_detected"),
        "hybrid": flag("hybrid", "is_hybrid"),
        "scores": f"SELECT theory, avg_score, row_number() OVER (ORDER BY avg_score DESC, theory) AS position FROM {means}",
        "levels": named("level", "metaphor_level"),
        "types": named("type", "metaphor_type"),
        "confidence": f"SELECT *, {colour} AS colour FROM ({named('confidence', 'confidence')})",
        "lengths": f"SELECT primary_class, round(sum(x * n) / sum(CASE WHEN x IS NOT NULL THEN n END), 6) AS avg_length FROM {lengths} GROUP BY primary_class",
        "boxes": _boxes(d, f"(SELECT * FROM {lengths} WHERE x IS NOT NULL)"),
        "heatmap": f"SELECT v.ord, v.theory, coalesce(m.avg_score, {real(0.0)}) AS avg_score FROM (VALUES {values}) AS v(ord, theory) LEFT JOIN {means} m ON m.theory = v.theory",
        "shares": f"SELECT measure AS chart, {label} AS label, n, {pct('n', 'sum(n) OVER (PARTITION BY measure)')} AS percent FROM {{s}} WHERE measure IN ('confidence', 'meta', 'hybrid') AND key IS NOT NULL",
    }
    return {name: counted.sparkSession.sql(q, s=counted) for name, q in sql.items()}


def charts(results: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """``charts_of()`` the results, which are read once: their summary is checkpointed."""
    return charts_of(checkpointed(summary(results)), classes)
