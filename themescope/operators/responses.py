"""Answers of a classifier: fences, strict JSON, the state machine of retries, results and the contract they keep.

Attempts are a table (row_id, attempt from 0 on, http_status, body, exception). A good answer is a status of 200
whose body, without its fence, is one JSON object; anything else leads to the next attempt, the last one to an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themescope.operators.lexical import real
from themescope.plans.dialects import Duck, Spark


def stripped_sql(d: Duck, source: str) -> str:
    bare = f"CASE WHEN {d.starts('body', '```json')} THEN replace(replace(body, '```json', ''), '```', '') ELSE body END"
    return f"(SELECT *, {d.strip(bare)} AS clean FROM {source})"


def parsed_sql(d: Duck, source: str) -> str:
    """Attempts with ``parsed``: the answer of a good one, null for any other."""
    return f"(SELECT *, CASE WHEN exception IS NULL AND http_status = 200 THEN {d.parsed('clean')} END AS parsed FROM {stripped_sql(d, source)})"


def resolved_sql(d: Duck, source: str) -> str:
    """The first good answer of each row, as text and parsed, else the error of its last attempt."""
    good = "parsed IS NOT NULL"
    return (
        f"(SELECT row_id, min(attempt) FILTER (WHERE {good}) AS used, min_by(clean, attempt) FILTER (WHERE {good}) AS body, min_by(parsed, attempt) FILTER (WHERE {good}) AS answer, "
        "max_by(CASE WHEN exception IS NOT NULL THEN exception WHEN http_status = 200 THEN 'invalid JSON' ELSE 'Max retries exceeded' END, attempt) AS last_error "
        f"FROM {parsed_sql(d, source)} GROUP BY row_id)"
    )


def backoff_sql(d: Duck, source: str) -> str:
    """Seconds slept: 2^attempt after a 429 and after an exception or invalid body that isn't the row's last; none otherwise."""
    slept = (
        "CASE WHEN used IS NOT NULL AND attempt >= used THEN 0 WHEN exception IS NULL AND http_status = 429 THEN power(2, attempt) "
        "WHEN exception IS NULL AND http_status <> 200 THEN 0 WHEN attempt < last THEN power(2, attempt) ELSE 0 END"
    )
    judged = f"SELECT row_id, attempt, http_status, exception, parsed IS NOT NULL AS good FROM {parsed_sql(d, source)}"
    marked = f"SELECT *, max(attempt) OVER (PARTITION BY row_id) AS last, min(CASE WHEN good THEN attempt END) OVER (PARTITION BY row_id) AS used FROM ({judged})"
    return f"SELECT row_id, CAST(sum({slept}) AS DOUBLE) AS seconds FROM ({marked}) GROUP BY row_id"


def session(spark: SparkSession) -> SparkSession:
    """Has the parser take the last of equal keys, as JSON parsers do, instead of refusing the body."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def resolve(attempts: DataFrame) -> DataFrame:
    """(row_id, attempt_used, answer, error): ``answer`` is the JSON text, ``error`` is null where there is one."""
    sql = f"SELECT row_id, used AS attempt_used, body AS answer, CASE WHEN used IS NULL THEN last_error END AS error FROM {resolved_sql(Spark(), '{attempts}')}"
    return session(attempts.sparkSession).sql(sql, attempts=attempts)


#: Fields of an answer that become columns of a result.
TOP = {"primary_class": "primary_class", "confidence": "confidence", "secondary_class": "secondary_class", "notes": "notes"}
META = {"dominant_semantic_field": "dominant_semantic_field", "artistic_transformation": "artistic_transformation", "theoretical_grounding": "theoretical_grounding"}


def results_sql(d: Duck, rows: str, attempts: str) -> str:
    """Results by row_id of ``rows`` (row_id, title, combined_description): classified, failed or skipped rows.

    A blank description is skipped whatever its attempts say; a row without attempts has run out of them.
    """
    # what is needed of a description is made before the join: texts don't pass the shuffle
    sized = f"SELECT row_id, title, {d.blank('combined_description')} AS blank, CAST(length(combined_description) AS BIGINT) AS n FROM {rows}"
    joined = (
        "SELECT i.row_id, i.title, i.blank, CASE WHEN NOT i.blank THEN r.answer END AS answer, r.last_error, CASE WHEN NOT i.blank THEN i.n END AS description_length "
        f"FROM ({sized}) i LEFT JOIN {resolved_sql(d, attempts)} r ON i.row_id = r.row_id"
    )
    flag = lambda path: f"CASE WHEN answer IS NOT NULL THEN coalesce({d.json('answer', path)}, '') = 'true' END"
    columns = [f"{d.json('answer', k)} AS {v}" for k, v in TOP.items() if k != "primary_class"] + [f"{d.json('answer', f'metaphor_analysis.{k}')} AS {v}" for k, v in META.items()]
    return (
        f"(SELECT row_id, title, CASE WHEN answer IS NOT NULL THEN {d.json('answer', 'primary_class')} ELSE 'UND' END AS primary_class, {', '.join(columns)}, "
        f"{flag('is_hybrid')} AS is_hybrid, {flag('metaphor_analysis.meta_metaphor_detected')} AS meta_metaphor_detected, "
        "CASE WHEN blank THEN 'skipped' WHEN answer IS NULL THEN 'error' END AS status, CASE WHEN blank THEN 'Empty description' WHEN answer IS NULL THEN coalesce(last_error, 'Max retries exceeded') END AS error, "
        f"description_length, answer FROM ({joined}))"
    )


def guards_sql(d: Duck, answers: str) -> str:
    """Which nested fields of each answer have the kind that reports read, and how many entries; a field of another kind, or a missing one, has none.

    Rows without an answer stay: a filter on the parsed answer would go down to where its text is made, and repeat that.
    """
    kinds = ", ".join(f"{d.is_kind('answer', k, kind)} AS has_{k}" for k, kind in (("scores", "OBJECT"), ("evidence", "ARRAY"), ("metaphor_analysis", "OBJECT")))
    flag = d.json("answer", "metaphor_analysis.meta_metaphor_detected")
    return f"SELECT row_id, attempt, answer IS NOT NULL AS answered, {kinds}, {d.entries('answer')}, coalesce({flag}, '') = 'true' AS meta_metaphor_detected FROM {answers}"


def classified(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Results of ``rows`` (row_id, title, combined_description); the answer stays beside the columns made from it, as a variant."""
    return session(rows.sparkSession).sql(f"SELECT * FROM {results_sql(Spark(), '{rows}', '{attempts}')}", rows=rows, attempts=attempts)


def tagged(results: DataFrame, analysis: DataFrame, key: str = "row_id") -> DataFrame:
    """Results with their row number as ``index`` and the columns of the pre-analysis (doc_id, ...) of the same row."""
    spark = results.sparkSession
    return spark.sql(f"SELECT r.*, r.{key} AS index, a.* EXCEPT (doc_id) FROM {{r}} r LEFT JOIN {{a}} a ON r.{key} = a.doc_id", r=results, a=analysis)


def contract_sql(d: Duck, results: str, texts: str) -> str:
    """Which rules each answer keeps: the class is UND if no score reaches 0.5; a secondary class has 0.5; hybrid says whether
    two classes have; a score over 0.3 has evidence; spans stand in the text, case aside. texts: (row_id, text)."""
    half = f"score >= {real(0.5)}"
    scores = f"(SELECT row_id, max(score) AS top, sum(CASE WHEN {half} THEN 1 ELSE 0 END) AS halves FROM {d.scores(results, 'row_id')} GROUP BY row_id)"
    second = f"(SELECT s.row_id, max(CASE WHEN s.theory = s.secondary_class THEN s.score END) AS second FROM {d.scores(results, 'row_id, secondary_class')} s GROUP BY s.row_id)"
    named = f"(SELECT DISTINCT row_id, class FROM {d.evidence(results, 'row_id')})"
    bare = f"(SELECT s.row_id, sum(CASE WHEN s.score > {real(0.3)} AND e.class IS NULL THEN 1 ELSE 0 END) AS bare FROM {d.scores(results, 'row_id')} s LEFT JOIN {named} e ON s.row_id = e.row_id AND s.theory = e.class GROUP BY s.row_id)"
    loose = f"(SELECT e.row_id, sum(CASE WHEN contains(lower(coalesce(t.text, '')), lower(e.span)) THEN 0 ELSE 1 END) AS loose FROM {d.evidence(results, 'row_id')} e LEFT JOIN {texts} t ON e.row_id = t.row_id GROUP BY e.row_id)"
    return (
        f"SELECT r.row_id, (coalesce(s.top, 0) >= {real(0.5)} OR r.primary_class = 'UND') AS und_rule, (r.secondary_class IS NULL OR coalesce(x.second, 0) >= {real(0.5)}) AS secondary_rule, "
        "(coalesce(r.is_hybrid, FALSE) = (coalesce(s.halves, 0) >= 2)) AS hybrid_rule, (coalesce(b.bare, 0) = 0) AS evidence_rule, (coalesce(l.loose, 0) = 0) AS verbatim_rule "
        f"FROM (SELECT * FROM {results} WHERE answer IS NOT NULL) r LEFT JOIN {scores} s ON r.row_id = s.row_id LEFT JOIN {second} x ON r.row_id = x.row_id LEFT JOIN {bare} b ON r.row_id = b.row_id LEFT JOIN {loose} l ON r.row_id = l.row_id"
    )


def contract(results: DataFrame, texts: DataFrame) -> DataFrame:
    """The same rules, row by row: scores and evidence are in the row of their answer, so only the texts are joined."""
    d, half = Spark(), real(0.5)
    answered = f"SELECT row_id, primary_class, secondary_class, is_hybrid, coalesce({d.score_map('answer')}, map()) AS scores, coalesce({d.pieces('answer')}, array()) AS evidence FROM {{results}} WHERE answer IS NOT NULL"
    whole = "lower(coalesce(t.text, ''))"
    return results.sparkSession.sql(
        f"SELECT r.row_id, (coalesce(array_max(map_values(scores)), 0) >= {half} OR primary_class = 'UND') AS und_rule, "
        f"(secondary_class IS NULL OR coalesce(scores[secondary_class], 0) >= {half}) AS secondary_rule, "
        f"(coalesce(is_hybrid, FALSE) = (size(filter(map_values(scores), s -> s >= {half})) >= 2)) AS hybrid_rule, "
        f"coalesce(forall(map_entries(scores), s -> coalesce(s.value, 0) <= {real(0.3)} OR coalesce(exists(evidence, e -> e.class = s.key), FALSE)), TRUE) AS evidence_rule, "
        f"forall(evidence, e -> coalesce(contains({whole}, lower(e.span)), FALSE)) AS verbatim_rule "
        f"FROM ({answered}) r LEFT JOIN {{texts}} t ON r.row_id = t.row_id",
        results=results, texts=texts,
    )
