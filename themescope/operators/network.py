"""The network of a document's evidence: clusters by theme, then one row a document.

Evidence is any table with (doc_id, theory, theory_ord, level, type, weight, semantic_field), also one that a caller
built with several rows a theme. It is read once and shuffled by document; weights are rounded to nine places, so
that their sum doesn't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.operators.lexical import real
from themescope.plans.dialects import Duck, Spark
from themescope.plans.ontology import HYBRID_WEIGHT


def clusters_sql(d: Duck, source: str, rank: str) -> str:
    """Counts, weight and the different fields of each document and theme."""
    count = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    return (
        f"(SELECT doc_id, theory, count(*) AS total_evidence, {count('''level = 'meta_metaphor' ''')} AS meta_metaphor_count, {count('''level = 'scientific_metaphor' ''')} AS scientific_metaphor_count, "
        f"{count('''type = 'ontological' ''')} AS ontological_count, round(sum(weight), 9) AS total_weight, {d.distinct('semantic_field')} AS semantic_fields, min({rank}) AS first_rank FROM {source} GROUP BY doc_id, theory)"
    )


def network_sql(d: Duck, source: str, rank: str) -> str:
    """Pattern flag, dominant theme (ties: the first cluster) and hybrid themes (if several), in one pass."""
    heavy = f"CASE WHEN total_weight >= {real(HYBRID_WEIGHT)} THEN theory END"
    return (
        "SELECT doc_id, max(CASE WHEN meta_metaphor_count >= 1 AND scientific_metaphor_count >= 1 THEN 1 ELSE 0 END) = 1 AS meta_metaphor_detected, "
        f"{d.first('theory', 'total_weight', 'first_rank')} AS dominant_pattern, CASE WHEN count({heavy}) > 1 THEN {d.ordered(heavy, 'first_rank')} ELSE '' END AS hybrid_theories "
        f"FROM {clusters_sql(d, source, rank)} GROUP BY doc_id"
    )


def clusters(evidence: DataFrame, rank: str = "theory_ord") -> DataFrame:
    """One row a document and theme; semantic_fields: the different ones, as a sorted list. A null theme is a cluster too."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return evidence.groupBy("doc_id", "theory").agg(
        F.count(F.lit(1)).alias("total_evidence"), count("level", "meta_metaphor").alias("meta_metaphor_count"), count("level", "scientific_metaphor").alias("scientific_metaphor_count"),
        count("type", "ontological").alias("ontological_count"), F.round(F.sum("weight"), 9).alias("total_weight"), F.array_sort(F.collect_set("semantic_field")).alias("semantic_fields"), F.min(rank).alias("first_rank"),
    )


def in_row(pieces: str) -> str:
    """The network of a list of evidence in the row, as a struct of the columns that ``network()`` returns.

    ``pieces``: an expression for an array of structs with theory, rank, level and weight; an empty one gives false, null and ''.
    """
    own = "filter(pieces, p -> p.theory <=> t)"
    some = lambda level: f"exists({own}, p -> coalesce(p.level = '{level}', FALSE))"
    cluster = (
        f"struct(t AS theory, round(aggregate({own}, {real(0.0)}, (a, p) -> a + p.weight), 9) AS weight, array_min(transform({own}, p -> p.rank)) AS rank, "
        f"({some('meta_metaphor')} AND {some('scientific_metaphor')}) AS pattern)"
    )
    by_rank = "array_sort(clusters, (a, b) -> CASE WHEN a.rank < b.rank THEN -1 WHEN a.rank > b.rank THEN 1 ELSE 0 END)"
    first = "aggregate(slice(ordered, 2, size(ordered)), ordered[0], (a, c) -> CASE WHEN c.weight > a.weight THEN c ELSE a END)"
    heavy = f"transform(filter(ordered, c -> c.theory IS NOT NULL AND c.weight >= {real(HYBRID_WEIGHT)}), c -> c.theory)"
    let = lambda name, value, then: f"element_at(transform(array({value}), {name} -> {then}), 1)"
    row = (
        f"struct(exists(ordered, c -> c.pattern) AS meta_metaphor_detected, CASE WHEN size(ordered) > 0 THEN {first}.theory END AS dominant_pattern, "
        f"CASE WHEN size({heavy}) > 1 THEN array_join({heavy}, ', ') ELSE '' END AS hybrid_theories)"
    )
    clusters_ = f"transform(array_distinct(transform(pieces, p -> p.theory)), t -> {cluster})"
    return let("pieces", pieces, let("clusters", clusters_, let("ordered", by_rank, row)))


def network(evidence: DataFrame, rank: str = "theory_ord") -> DataFrame:
    """(doc_id, meta_metaphor_detected, dominant_pattern, hybrid_theories); documents without evidence have no row."""
    return evidence.sparkSession.sql(network_sql(Spark(), "{evidence}", rank), evidence=evidence)


def pre_analysis_sql(d: Duck, documents: str, evidence: str, fields: int = 5, previews: int = 3) -> str:
    """For every document: number of pieces, pattern flag, dominant theme, first semantic fields and first pieces, joined.

    Pieces stand in the order of their score, ties in that of the themes. Documents without any have 0, false and null.
    """
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theory_ord) AS rn FROM {evidence})"
    first = lambda value, k: d.ordered(f"CASE WHEN rn <= {k} THEN {value} END", "rn")
    piece = "concat(theory, ' ', level, ' ', type, ' ', substring(span, 1, 100))"
    counted = f"(SELECT doc_id, count(*) AS n, {first('semantic_field', fields)} AS semantic_fields, {first(piece, previews)} AS evidence_preview FROM {ranked} GROUP BY doc_id)"
    return (
        "SELECT i.doc_id, coalesce(e.n, 0) AS detected_metaphors, coalesce(n.meta_metaphor_detected, FALSE) AS meta_metaphor_present, n.dominant_pattern AS dominant_theory, "
        f"coalesce(e.semantic_fields, '') AS semantic_fields, coalesce(e.evidence_preview, '') AS evidence_preview FROM (SELECT doc_id FROM {documents}) i "
        f"LEFT JOIN {counted} e ON i.doc_id = e.doc_id LEFT JOIN ({network_sql(d, evidence, 'theory_ord')}) n ON i.doc_id = n.doc_id"
    )


def pre_analysis(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a prompt is told beforehand of every document of ``docs`` (doc_id)."""
    return docs.sparkSession.sql(pre_analysis_sql(Spark(), "{docs}", "{evidence}"), docs=docs, evidence=evidence)


def pre_analysis_in_rows(analysed: DataFrame, fields: int = 5, previews: int = 3) -> DataFrame:
    """``pre_analysis()`` from rows that hold their evidence (``lexical.analysed()``): a projection."""
    order = "array_sort(evidence, (a, b) -> CASE WHEN a.score > b.score THEN -1 WHEN a.score < b.score THEN 1 WHEN a.theory_ord < b.theory_ord THEN -1 ELSE 1 END)"
    network_ = in_row("transform(evidence, e -> struct(e.theory AS theory, e.theory_ord AS rank, e.level AS level, e.weight AS weight))")
    rows = analysed.select("doc_id", F.expr(order).alias("e"), F.expr(network_).alias("n"))
    piece = "concat(x.theory, ' ', x.level, ' ', x.type, ' ', substring(x.span, 1, 100))"
    return rows.select(
        "doc_id", F.size("e").cast("long").alias("detected_metaphors"), F.col("n.meta_metaphor_detected").alias("meta_metaphor_present"), F.col("n.dominant_pattern").alias("dominant_theory"),
        F.expr(f"array_join(transform(slice(e, 1, {fields}), x -> x.semantic_field), ', ')").alias("semantic_fields"), F.expr(f"array_join(transform(slice(e, 1, {previews}), x -> {piece}), ', ')").alias("evidence_preview"),
    )
