"""The queries of the engine, each with the DuckDB SQL that gives the same rows.

A query is SQL over named inputs in braces. In Spark the inputs are DataFrames (``operators.lexical`` builds the
evidence in one scan, without a shuffle); for DuckDB they are subqueries made from the same expressions. Where the
dialects differ, ``Spark`` and ``Duck`` say how. Reports aggregate parsed answers: the answers of a classifier that
says of each document what the lexical network found in it, and fails now and then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope.functions.numbers import fixed
from themescope.functions.text import TEXT_COLUMNS, text_columns
from themescope.operators import lexical, reports
from themescope.operators.automaton import term_hits
from themescope.operators.index import checkpointed, new_folder, row_index
from themescope.operators.network import clusters_sql, in_row, network_sql, pre_analysis_in_rows, pre_analysis_sql
from themescope.operators.responses import backoff_sql, contract, contract_sql, guards_sql, resolved_sql, results_sql, session, stripped_sql
from themescope.plans import prompts
from themescope.plans.dialects import Duck, Spark
from themescope.plans.ontology import PROXY, SHIPPED
from themescope.sources.results import attached, report, write_csv, write_json, zipped
from themescope.sources.tables import read_csv

#: Sentences for the shipped ontology, whose terms the synthetic tables don't contain: each document gets one before its text.
TEXTS = [
    "Алгоритм и код рисуют; сознание здесь не вычисление, а движение и действие тела.",
    "Эмерджентность и самоорганизация: рой, синергия, фазовый переход; природа целого.",
    "Внимание зрителя, театр и рабочее пространство сцены.",
    "Роевой разум без центра.",
    "Протоопыт и панпсихизм: живая материя, одушевлённые объекты.",
    "Предсказание, ошибка и прогноз: мозг как байесовский предсказатель.",
    "Просто холст и краска.",
    "",
    "Coupling of bodies, swarm and collective emergence.",
    "Код кодирует код: input, output, function.",
]


Query = Callable[[Duck], str]

CLASSES = [*PROXY.themes, "UND"]
_values = ", ".join(f"({k}, '{t}')" for k, t in enumerate(CLASSES))

#: Expressions of the input columns, made from documents, with holes; a table need not have all of them.
INPUT = {
    "title": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('T', CAST(doc_id AS STRING)) END",
    "descr": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END",
    "descr_en": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '  ' ELSE replace(text, ' ', '_') END",
    "descr_clean": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END",
}


def rows_(d: Duck) -> str:
    """Input rows with holes: title and three of the four text columns, made from documents."""
    return f"(SELECT doc_id AS row_id, {', '.join(f'{e} AS {c}' for c, e in INPUT.items())} FROM {{documents}})"


def combined(d: Duck) -> str:
    text = "concat(coalesce(descr, ''), ' ', coalesce(descr_en, ''), ' ', coalesce(descr_clean, ''))"
    return f"(SELECT row_id, title, {d.strip(text)} AS combined_description FROM {rows_(d)})"


def blank(d: Duck) -> str:
    return f"{d.strip('combined_description')} = ''"


#: Several pieces of evidence a theme, as a caller may build them: the only input on which a pattern can hold.
MANY = "(SELECT doc_id, theory, theory_ord * 2 + v.k AS rank, semantic_field, CASE WHEN v.k = 0 THEN level WHEN doc_id % 2 = 0 THEN 'meta_metaphor' ELSE 'scientific_metaphor' END AS level, type, weight FROM {evidence} CROSS JOIN (VALUES (0), (1)) AS v(k))"


def number(x: str) -> str:
    """A number with three digits after the point, in the same characters everywhere."""
    n = f"CAST(floor({x} * {lexical.real(1000.0)} + {lexical.real(0.5)}) AS INT)"
    return f"concat(CAST(CAST(floor({n} / CAST(1000 AS DOUBLE)) AS INT) AS STRING), '.', lpad(CAST({n} % 1000 AS STRING), 3, '0'))"


def answers_sql(d: Duck) -> str:
    """(row_id, body): what a classifier says of each document, from its scores, evidence and network, by joins."""
    scores = f"(SELECT doc_id, {d.ordered('''concat('"', theory, '": ', ''' + number('score') + ')', 'theory_ord')} AS scores FROM {{fields}} GROUP BY doc_id)"
    piece = "concat('{{\"class\": \"', theory, '\", \"metaphor_level\": \"', level, '\", \"metaphor_type\": \"', type, '\", \"span\": \"', span, '\", \"weight\": ', " + number("weight") + ", ', \"reasoning\": \"', level, ' as ', type, ' of ', semantic_field, '\"}}')"
    pieces = f"(SELECT doc_id, count(*) AS n, min(semantic_field) AS field, {d.ordered(piece, 'theory_ord')} AS evidence FROM {{evidence}} GROUP BY doc_id)"
    second = "CASE WHEN split_part(n.hybrid_theories, ', ', 1) = n.dominant_pattern THEN split_part(n.hybrid_theories, ', ', 2) ELSE split_part(n.hybrid_theories, ', ', 1) END"
    hybrid = "coalesce(n.hybrid_theories, '') <> ''"
    return (
        "(SELECT i.doc_id AS row_id, concat('{{\"primary_class\": \"', coalesce(n.dominant_pattern, 'UND'), '\"', CASE WHEN i.doc_id % 41 = 0 THEN '' ELSE concat(', \"confidence\": \"', CASE WHEN e.n >= 3 THEN 'high' WHEN e.n = 2 THEN 'medium' ELSE 'low' END, '\"') END, "
        f"', \"scores\": {{{{', coalesce(s.scores, ''), '}}}}, \"evidence\": [', coalesce(e.evidence, ''), '], \"secondary_class\": ', CASE WHEN {hybrid} THEN concat('\"', {second}, '\"') ELSE 'null' END, "
        f"CASE WHEN i.doc_id % 43 = 0 THEN '' ELSE concat(', \"is_hybrid\": ', CASE WHEN {hybrid} THEN 'true' ELSE 'false' END) END, "
        "', \"metaphor_analysis\": {{\"meta_metaphor_detected\": ', CASE WHEN coalesce(n.meta_metaphor_detected, FALSE) THEN 'true' ELSE 'false' END, ', \"dominant_semantic_field\": \"', coalesce(e.field, ''), '\", \"artistic_transformation\": \"', coalesce(n.dominant_pattern, 'none'), ' as image\"}}, \"notes\": \"\"}}') AS body "
        f"FROM {{documents}} i LEFT JOIN {scores} s ON i.doc_id = s.doc_id LEFT JOIN {pieces} e ON i.doc_id = e.doc_id LEFT JOIN ({network_sql(d, MANY, 'rank')}) n ON i.doc_id = n.doc_id)"
    )


def answers(docs: DataFrame) -> DataFrame:
    """The rows of ``answers_sql()``, each made where its document is read."""
    rows = lexical.analysed(docs, PROXY)
    many = "flatten(transform(evidence, e -> array(struct(e.theory AS theory, e.theory_ord * 2 AS rank, e.level AS level, e.weight AS weight), struct(e.theory AS theory, e.theory_ord * 2 + 1 AS rank, CASE WHEN doc_id % 2 = 0 THEN 'meta_metaphor' ELSE 'scientific_metaphor' END AS level, e.weight AS weight))))"
    rows = rows.withColumn("n", F.expr(in_row(many)))
    scores = "array_join(transform(fields, f -> concat('\"', f.theory, '\": ', " + number("f.score") + ")), ', ')"
    piece = "concat('{\"class\": \"', e.theory, '\", \"metaphor_level\": \"', e.level, '\", \"metaphor_type\": \"', e.type, '\", \"span\": \"', e.span, '\", \"weight\": ', " + number("e.weight") + ", ', \"reasoning\": \"', e.level, ' as ', e.type, ' of ', e.semantic_field, '\"}')"
    second = "CASE WHEN split_part(n.hybrid_theories, ', ', 1) = n.dominant_pattern THEN split_part(n.hybrid_theories, ', ', 2) ELSE split_part(n.hybrid_theories, ', ', 1) END"
    parts = [
        "'{\"primary_class\": \"'", "coalesce(n.dominant_pattern, 'UND')", "'\"'", "CASE WHEN doc_id % 41 = 0 THEN '' ELSE concat(', \"confidence\": \"', CASE WHEN size(evidence) >= 3 THEN 'high' WHEN size(evidence) = 2 THEN 'medium' ELSE 'low' END, '\"') END",
        "', \"scores\": {'", scores, "'}, \"evidence\": ['", f"array_join(transform(evidence, e -> {piece}), ', ')", "'], \"secondary_class\": '", f"CASE WHEN n.hybrid_theories <> '' THEN concat('\"', {second}, '\"') ELSE 'null' END",
        "CASE WHEN doc_id % 43 = 0 THEN '' ELSE concat(', \"is_hybrid\": ', CASE WHEN n.hybrid_theories <> '' THEN 'true' ELSE 'false' END) END",
        "', \"metaphor_analysis\": {\"meta_metaphor_detected\": '", "CASE WHEN n.meta_metaphor_detected THEN 'true' ELSE 'false' END", "', \"dominant_semantic_field\": \"'", "coalesce(array_min(transform(evidence, e -> e.semantic_field)), '')",
        "'\", \"artistic_transformation\": \"'", "coalesce(n.dominant_pattern, 'none')", "' as image\"}, \"notes\": \"\"}'",
    ]
    return rows.select(F.col("doc_id").alias("row_id"), F.expr(f"concat({', '.join(parts)})").alias("body"))


def attempts(d: Duck) -> str:
    """Up to three answers of the classifier for each document: HTTP status, body, exception."""
    bad = "CASE WHEN row_id % 13 = 0 THEN '[1]' WHEN row_id % 17 = 0 THEN concat(body, ' x') WHEN row_id % 18 = 0 THEN concat(body, '] [', body) WHEN row_id % 19 = 0 THEN '' ELSE body END"
    return (
        "(SELECT row_id, a.attempt, CASE WHEN row_id % 23 = 0 THEN 429 WHEN row_id % 6 = 0 AND a.attempt = 0 THEN 429 WHEN row_id % 29 = 0 THEN 500 WHEN row_id % 10 = 0 AND a.attempt < 2 THEN 500 ELSE 200 END AS http_status, "
        f"CASE WHEN row_id % 2 = 0 THEN concat('```json\n', {bad}, '\n```') ELSE {bad} END AS body, CASE WHEN row_id % 31 = 0 THEN 'timeout' END AS exception "
        "FROM {answers} CROSS JOIN (VALUES (0), (1), (2)) AS a(attempt))"
    )


def inputs(d: Duck) -> str:
    """Rows as they are classified: some descriptions are blank."""
    return "(SELECT doc_id AS row_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('T', CAST(doc_id AS STRING)) END AS title, CASE WHEN doc_id % 37 = 0 THEN ' \n' ELSE text END AS combined_description FROM {documents})"


def results(d: Duck) -> str:
    """A result row for each document: classified, failed or skipped."""
    return results_sql(d, inputs(d), attempts(d))


OK = reports.OK


def odd_answers(d: Duck) -> str:
    """(row_id, attempt, answer): parsed answers, of which some have a nested field of another kind."""
    kinds = [("scores", "{{", "\"none\""), ("evidence", "[", "3"), ("metaphor_analysis", "{{", "null")]
    body = "CASE row_id % 7 " + " ".join(f"WHEN {k} THEN replace(clean, '\"{name}\": {opens}', '\"{name}\": {other}, \"more\": {opens}')" for k, (name, opens, other) in enumerate(kinds)) + " ELSE clean END"
    return f"(SELECT row_id, attempt, {d.parsed('body')} AS answer FROM (SELECT row_id, attempt, {body} AS body FROM {stripped_sql(d, attempts(d))}))"


def report_lines(d: Duck) -> str:
    """The lines of the report, each kind by a query of its own."""
    part = lambda k, row_id, place, line, source: f"SELECT {k} AS part, {row_id} AS row_id, {place} AS place, {line} AS line FROM {source}"
    ok, none = f"(SELECT * FROM {results(d)} WHERE {OK})", "CAST(NULL AS BIGINT)"
    totals, items = f"({reports.run_totals(results(d))})", f"({reports.details(d, results(d))})"
    share = lambda x: f"concat(' (', {d.fixed(x, 1)}, '%)')"
    second = "CASE WHEN secondary_class IS NULL THEN '' ELSE concat(', hybrid, secondary class ', secondary_class) END"
    piece = f"concat('  - ', class, ', ', metaphor_level, ', ', metaphor_type, ', ', {d.fixed('weight', 2)}, ': ', span, ' / ', reasoning)"
    return " UNION ALL ".join([
        part(0, none, "''", "concat('processed ', processed, ', successful ', successful, ', errors ', errors)", totals),
        part(0, none, "''", f"concat('patterns ', meta_metaphors, CASE WHEN meta_percent IS NULL THEN '' ELSE {share('meta_percent')} END)", totals),
        part(1, "position", "''", f"concat(coalesce(primary_class, 'N/A'), ': ', n, {share('percent')})", f"({reports.class_distribution(results(d))})"),
        part(2, "row_id", "'a0'", f"concat(title, ': ', primary_class, ', confidence ', confidence, {second})", items),
        part(2, "row_id", "'a1'", "concat('  pattern: ', meta_semantic_field, ', ', meta_transformation)", f"{items} WHERE meta_semantic_field IS NOT NULL"),
        part(2, "row_id", "concat('b', theory)", f"concat('  ', theory, ': ', {d.fixed('score', 2)})", f"{d.scores(ok, 'row_id')} WHERE score IS NOT NULL"),
        part(2, "row_id", "concat('c', lpad(CAST(position AS STRING), 3, '0'))", piece, f"({reports.detail_evidence(d, results(d))})"),
        part(3, "row_id", "''", "concat(coalesce(title, 'N/A'), ': ', coalesce(error, 'error'))", f"{results(d)} WHERE status = 'error'"),
    ])


def top(k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theory_ord) AS rn FROM {{evidence}}) WHERE rn <= {k}"


def _kind(kind: str) -> Query:
    cols = ", ".join(f"{lexical.kind_score(PROXY, t, kind)} AS {t.lower()}_score" for t in PROXY.themes)
    return lambda d: f"SELECT doc_id, {cols} FROM (SELECT doc_id, lower(coalesce(text, '')) AS text_lc FROM {{documents}})"


_hits = " + ".join(f"CAST({lexical.TEXT.has(t.term.lower())} AS INT)" for t in PROXY.terms if t.kind == "keyword")
_dim = ", ".join(f"('{t.theme}', {t.term_ord}, {lexical.quoted(t.term.lower())})" for t in PROXY.terms if t.kind == "keyword")


#: A larger ontology, from the items of the benchmark: their words and the pairs that stand side by side, by the item's number.
LARGE = (
    "(SELECT concat('T', CAST(item_id % 5 AS STRING)) AS theory, lower(term) AS term FROM (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term "
    "FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)) WHERE term <> '')"
)


def large_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of LARGE."""
    words = F.split("text", " ", -1)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", words.alias("w"))
    pairs = F.expr("transform(slice(w, 1, size(w) - 1), (x, k) -> concat(x, ' ', w[k + 1]))")
    return items.select(F.concat(F.lit("T"), (F.col("item_id") % 5).cast("string")).alias("theory"), F.explode(F.concat("w", pairs)).alias("term")).where("term <> ''")


def prompt(d: Duck) -> str:
    """The combined description behind the request, with a hint where the network of the document has a pattern."""
    asked = f"concat({lexical.quoted(prompts.PROMPT)}, ' Description: ', c.combined_description, {prompts.hint_sql('n.meta_metaphor_detected', 'n.dominant_pattern')})"
    return f"SELECT c.row_id, {asked} AS prompt FROM {combined(d)} c LEFT JOIN ({network_sql(d, MANY, 'rank')}) n ON c.row_id = n.doc_id"


#: Columns of a result besides its number and its answer.
KEPT = ("title", "primary_class", "confidence", "secondary_class", "notes", "dominant_semantic_field", "artistic_transformation", "theoretical_grounding", "is_hybrid", "meta_metaphor_detected", "status", "error", "description_length")

_long = "CAST(length(combined_description) AS BIGINT)"

QUERIES_SQL: dict[str, Query] = {
    # sources, projections, filters
    "scan_documents": lambda d: "SELECT doc_id, text, lang, source, n_chars FROM {documents}",
    "text_column_selection": lambda d: f"SELECT row_id, {', '.join(c for c in TEXT_COLUMNS if c in INPUT)} FROM {rows_(d)}",
    "combine_text": lambda d: f"SELECT row_id, combined_description FROM {combined(d)}",
    "skip_empty": lambda d: f"SELECT row_id, CASE WHEN {blank(d)} THEN 'skipped' END AS status, CASE WHEN {blank(d)} THEN 'UND' END AS primary_class, CASE WHEN {blank(d)} THEN 'Empty description' END AS error FROM {combined(d)}",
    "default_title": lambda d: "SELECT row_id, coalesce(title, concat('Item_', CAST(idx AS STRING))) AS title FROM {indexed}",
    "row_index": lambda d: "SELECT row_id, CAST(idx AS BIGINT) AS idx FROM {indexed}",
    "description_length": lambda d: f"SELECT row_id, CASE WHEN NOT ({blank(d)}) THEN {_long} END AS description_length FROM {combined(d)}",
    "success_filter": lambda d: f"SELECT row_id, primary_class, status FROM {results(d)} WHERE {OK}",
    "error_filter": lambda d: f"SELECT row_id, primary_class, error FROM {results(d)} WHERE status = 'error'",
    "prune_weak": lambda d: "SELECT doc_id, theory, score FROM {fields} WHERE score >= CAST(0.2 AS DOUBLE)",
    "source_domain": lambda d: f"SELECT doc_id, theory, {d.split1('semantic_field')} AS source_domain, 'consciousness' AS target_domain, concat(level, ' в ', type, ' контексте') AS reasoning FROM {{evidence}}",
    "semantic_label": lambda d: "SELECT doc_id, theory, semantic_field FROM {fields}",
    "truncate_span": lambda d: "SELECT doc_id, concat(substring(text, 1, 100), '...') AS span_100, concat(substring(text, 1, 150), '...') AS span_150 FROM {documents}",
    # lexical scoring
    "keyword_hits": lambda d: f"SELECT doc_id, {_hits} AS keyword_hits FROM (SELECT doc_id, lower(coalesce(text, '')) AS text_lc FROM {{documents}})",
    "scientific_phrase_score": _kind("scientific"),
    "artistic_phrase_score": _kind("artistic"),
    "semantic_fields": lambda d: "SELECT doc_id, theory, score, semantic_field, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theory_ord) AS position FROM {fields}",
    "level_detection": lambda d: "SELECT doc_id, theory, level, span FROM {fields}",
    "type_detection": lambda d: "SELECT doc_id, theory, span, type FROM {evidence}",
    "evidence_weight": lambda d: "SELECT doc_id, theory, level, type, score, weight FROM {evidence}",
    "extract_evidence": lambda d: "SELECT doc_id, theory, score, semantic_field, level, span, type, weight FROM {evidence}",
    "shipped_evidence": lambda d: "SELECT doc_id, theory, score, semantic_field, level, span, type, weight FROM {shipped}",
    "evidence_preview": lambda d: f"SELECT doc_id, rn AS position, theory, level, type, substring(span, 1, 100) AS span FROM {top(3)}",
    "field_preview": lambda d: f"SELECT doc_id, rn AS position, semantic_field FROM {top(5)}",
    "topk_evidence": lambda d: f"SELECT doc_id, rn AS position, theory, weight FROM {top(5)}",
    "theory_clusters": lambda d: f"SELECT doc_id, theory, total_evidence, meta_metaphor_count, scientific_metaphor_count, ontological_count, total_weight, semantic_fields FROM {clusters_sql(d, '{evidence}', 'theory_ord')}",
    "meta_pattern": lambda d: f"SELECT doc_id, max(CASE WHEN meta_metaphor_count >= 1 AND scientific_metaphor_count >= 1 THEN 1 ELSE 0 END) = 1 AS meta_metaphor_detected FROM {clusters_sql(d, MANY, 'rank')} GROUP BY doc_id",
    "dominant_theory": lambda d: f"SELECT doc_id, dominant_pattern FROM ({network_sql(d, '{evidence}', 'theory_ord')})",
    "hybrid_theories": lambda d: f"SELECT doc_id, hybrid_theories FROM ({network_sql(d, MANY, 'rank')})",
    "network_summary": lambda d: network_sql(d, MANY, "rank"),
    "shipped_network": lambda d: network_sql(d, "{shipped}", "theory_ord"),
    "pre_analysis": lambda d: pre_analysis_sql(d, "{documents}", "{evidence}"),
    "shipped_pre_analysis": lambda d: pre_analysis_sql(d, "{texts}", "{shipped}"),
    "ontology_theta_join": lambda d: f"SELECT t.doc_id, o.theory, count(*) AS hits FROM (SELECT doc_id, lower(coalesce(text, '')) AS text_lc FROM {{documents}}) t JOIN (VALUES {_dim}) AS o(theory, term_ord, term) ON contains(t.text_lc, o.term) GROUP BY t.doc_id, o.theory",
    "ontology_automaton": lambda d: f"SELECT t.doc_id, o.theory, count(*) AS hits FROM (SELECT doc_id, lower(text) AS text_lc FROM {{documents}}) t JOIN {LARGE} o ON contains(t.text_lc, o.term) GROUP BY t.doc_id, o.theory",
    # requests and responses
    "build_prompt": prompt,
    "prompt_extension": lambda d: f"SELECT doc_id, replace(concat('Task of ', source, '. {prompts.MARKER} JSON'), '{prompts.MARKER}', concat({lexical.quoted(prompts.section(PROXY))}, '\n\n{prompts.MARKER}')) AS prompt FROM {{documents}}",
    "prompt_section": lambda d: f"SELECT lang, count(*) AS prompts, {lexical.quoted(prompts.system_prompt())} AS system_prompt, {lexical.quoted(prompts.section())} AS section FROM {{documents}} GROUP BY lang",
    "indicator_taxonomy": lambda d: "SELECT t.indicator, t.weight, count(e.doc_id) AS pieces FROM (VALUES " + ", ".join(f"('{k}', {lexical.real(w)})" for k, w in prompts.INDICATORS.items()) + f") AS t(indicator, weight) LEFT JOIN (SELECT doc_id, {prompts.indicator_sql('level')} AS indicator FROM {{evidence}}) e ON t.indicator = e.indicator GROUP BY t.indicator, t.weight",
    "strip_fence": lambda d: f"SELECT row_id, attempt, clean FROM {stripped_sql(d, attempts(d))}",
    "parse_classification": lambda d: f"SELECT row_id, attempt, parsed IS NOT NULL AS valid, {d.json('parsed', 'primary_class')} AS primary_class, {d.json('parsed', 'confidence')} AS confidence FROM (SELECT *, {d.parsed('clean')} AS parsed FROM {stripped_sql(d, attempts(d))})",
    "type_guards": lambda d: guards_sql(d, odd_answers(d)),
    "retry_resolution": lambda d: f"SELECT row_id, CAST(used AS INT) AS attempt_used, CASE WHEN used IS NULL THEN last_error END AS error FROM {resolved_sql(d, attempts(d))}",
    "backoff_seconds": lambda d: backoff_sql(d, attempts(d)),
    "classified_results": lambda d: f"SELECT row_id, title, primary_class, confidence, secondary_class, is_hybrid, meta_metaphor_detected, dominant_semantic_field, artistic_transformation, status, error, description_length FROM {results(d)}",
    "contract_check": lambda d: contract_sql(d, results(d), "(SELECT doc_id AS row_id, text FROM {documents})"),
    "attach_results": lambda d: f"SELECT i.row_id, i.title, r.primary_class AS result_primary_class, r.status AS result_status FROM {rows_(d)} i JOIN {results(d)} r ON i.row_id = r.row_id",
    "zip_results": lambda d: "SELECT row_number() OVER () - 1 AS position, doc_id, lang, n_chars, source FROM {documents}",
    # aggregations and reports
    "class_distribution": lambda d: reports.class_distribution(results(d)),
    "class_shares_text": lambda d: f"SELECT primary_class, concat({d.fixed('percent', 1)}, '%') AS share, {d.fixed('percent / CAST(100 AS DOUBLE)', 2)} AS part FROM ({reports.class_distribution(results(d))})",
    "run_totals": lambda d: reports.run_totals(results(d)),
    "primary_class_hist": lambda d: reports.histogram(results(d), "primary_class"),
    "confidence_hist": lambda d: reports.histogram(results(d), "confidence"),
    "meta_rate": lambda d: reports.split_of(results(d), "meta_metaphor_detected"),
    "hybrid_rate": lambda d: reports.split_of(results(d), "is_hybrid"),
    "pie_shares": lambda d: reports.pie_shares(results(d)),
    "explode_scores": lambda d: f"SELECT row_id, theory, score FROM {d.scores(results(d), 'row_id')}",
    "explode_evidence": lambda d: f"SELECT row_id, position, class, metaphor_level, metaphor_type, span, weight, reasoning FROM {d.evidence(results(d), 'row_id')}",
    "avg_scores": lambda d: reports.avg_scores(d, results(d)),
    "level_hist": lambda d: reports.evidence_histogram(d, results(d), "metaphor_level"),
    "type_hist": lambda d: reports.evidence_histogram(d, results(d), "metaphor_type"),
    "avg_length_by_class": lambda d: reports.avg_length(results(d)),
    "length_boxplot": lambda d: reports.length_boxplot(d, results(d)),
    "score_vector": lambda d: reports.score_vector(d, results(d), CLASSES),
    "score_pivot": lambda d: reports.score_pivot(d, results(d)),
    "score_matrix": lambda d: reports.score_matrix(d, results(d), CLASSES),
    "chart_scores": lambda d: reports.avg_scores(d, results(d)),
    "chart_levels": lambda d: reports.evidence_histogram(d, results(d), "metaphor_level"),
    "chart_boxes": lambda d: reports.length_boxplot(d, results(d)),
    "chart_heatmap": lambda d: reports.score_vector(d, results(d), CLASSES),
    "chart_shares": lambda d: reports.pie_shares(results(d)),
    "text_report": report_lines,
    "csv_round_trip": lambda d: f"SELECT d.doc_id AS row_id, d.text, d.lang, d.source, {', '.join(f'r.{c}' for c in KEPT)} FROM {{documents}} d JOIN {results(d)} r ON d.doc_id = r.row_id",
    "json_round_trip": lambda d: f"SELECT row_id, {', '.join(KEPT)} FROM {results(d)}",
    "detail_report": lambda d: reports.details(d, results(d)),
    "detail_scores": lambda d: reports.detail_scores(d, results(d)),
    "detail_evidence": lambda d: reports.detail_evidence(d, results(d)),
}

#: Charts that are queries too: made from the summary of the results.
CHARTS = [n.removeprefix("chart_") for n in QUERIES_SQL if n.startswith("chart_")]

_texts = "(SELECT doc_id, concat(CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {lexical.quoted(t)}" for k, t in enumerate(TEXTS)) + " ELSE '' END, ' ', coalesce(text, '')) AS text FROM {documents})"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _query(make: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql, given = make(Spark()), {}
        documents = _documents(session(spark), sf_dir)
        texts = spark.sql(f"SELECT * FROM {_texts}", documents=documents)
        inputs_ = {
            "documents": lambda: documents,
            "indexed": lambda: row_index(spark.sql(f"SELECT row_id, title FROM {rows_(Spark())}", documents=documents), "row_id"),
            "fields": lambda: lexical.fields(documents, PROXY),
            "evidence": lambda: lexical.evidence(documents, PROXY),
            "answers": lambda: answers(documents),
            "texts": lambda: texts,
            "shipped": lambda: lexical.evidence(texts, SHIPPED),
        }
        given = {name: made() for name, made in inputs_.items() if f"{{{name}}}" in sql}
        return spark.sql(sql, **given)

    return run


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text columns are those that the table has, found when the plan is made."""
    rows = spark.sql(f"SELECT * FROM {rows_(Spark())}", documents=_documents(spark, sf_dir))
    return rows.select("row_id", *text_columns(rows))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(lambda d: f"SELECT * FROM {results(d)}")(spark, sf_dir)


def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract(_results(spark, sf_dir), _documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text"))


def _pre_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre_analysis_in_rows(lexical.analysed(_documents(spark, sf_dir), PROXY))


def _shipped_pre_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre_analysis_in_rows(lexical.analysed(_query(lambda d: "SELECT * FROM {texts}")(spark, sf_dir)))


def _shares_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = QUERIES["class_distribution"](spark, sf_dir)
    return shares.select("primary_class", F.concat(fixed("percent", 1), F.lit("%")).alias("share"), fixed(F.col("percent") / F.lit(100.0), 2).alias("part"))


def _chart(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: reports.charts_of(reports.summary(_results(spark, sf_dir)), CLASSES)[name]


def _zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return zipped(documents.select("doc_id", "lang"), documents.select("n_chars", "source"), "position")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are kept once, as the table that they are in a run: the report reads them several times."""
    return report(checkpointed(_results(spark, sf_dir)))


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and results written beside each other as CSV, and read again."""
    rows, done, path = _documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text", "lang", "source"), _results(spark, sf_dir).drop("answer"), new_folder(spark)
    write_csv(rows, done, path)
    return read_csv(spark, path, attached(rows, done).schema)


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON Lines, and read again."""
    done, path = _results(spark, sf_dir), new_folder(spark)
    write_json(done, path)
    return spark.read.schema(done.schema).json(path).drop("answer")


def _automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_hits(_documents(spark, sf_dir), large_ontology(spark, sf_dir))


QUERIES = {name: _query(make) for name, make in QUERIES_SQL.items()} | {"text_column_selection": _selection, "contract_check": _contract, "pre_analysis": _pre_analysis, "shipped_pre_analysis": _shipped_pre_analysis, "ontology_automaton": _automaton, "zip_results": _zipped, "text_report": _report, "csv_round_trip": _csv, "json_round_trip": _json, "class_shares_text": _shares_text}
QUERIES |= {f"chart_{name}": _chart(name) for name in CHARTS}


def oracle_sql() -> dict[str, str]:
    indexed = f"(SELECT row_id, title, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM {rows_(Duck()).format(documents='documents')})"
    given = {"documents": "documents", "indexed": indexed, "fields": lexical.fields_sql("documents", PROXY), "evidence": lexical.evidence_sql("documents", PROXY), "texts": _texts.format(documents="documents"), "shipped": lexical.evidence_sql(_texts.format(documents="documents"), SHIPPED)}
    given["answers"] = answers_sql(Duck()).format(**given)
    return {name: make(Duck()).format(**given) for name, make in QUERIES_SQL.items()}
