"""Lexical scoring: an ontology compiled into SQL expressions that Catalyst and DuckDB both read.

Scores are unrolled sums in the ontology's order, so that the floating-point result is one and the same everywhere;
nothing is joined or shuffled. In Spark a text passes an automaton of all words once, however many there are: the hits
are bits of a few long columns, and scores, labels, levels and spans test those bits. ``evidence()`` scans once: all
themes are columns of one projection, exploded after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.operators.index import dealt
from themescope.plans.ontology import KIND_SCORES, LEAST_SCORE, LEVEL_OF_KIND, LEVEL_WEIGHTS, SHIPPED, TYPE_WEIGHTS, Ontology, Term

#: Words whose hits one long column holds.
BITS = 62


def real(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Text:
    """Searches a text column for a word."""

    column: str = "text_lc"

    def has(self, word: str) -> str:
        return f"contains({self.column}, {quoted(word)})"


class Hits(Text):
    """Looks a word up in columns of bits."""

    def __init__(self, o: Ontology, column: str = "text_lc"):
        super().__init__(column)
        words = dict.fromkeys(w for t in o.terms for w in ([t.term.lower()] if t.kind == "keyword" else t.words))
        words.update(dict.fromkeys(o.marker("ontological")))
        object.__setattr__(self, "places", {w: divmod(k, BITS) for k, w in enumerate(words)})

    def has(self, word: str) -> str:
        column, bit = self.places[word]
        return f"(hits_{column} & {1 << bit}L) <> 0"

    def found(self) -> Column:
        """A struct of the columns of bits: one pass over the text finds all words."""
        places = self.places
        names = [f"hits_{k}" for k in range(max(column for column, _ in places.values()) + 1)]

        @F.arrow_udf(", ".join(f"{name} long" for name in names))
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word, (column, bit) in places.items():
                automaton.add_word(word, (column, 1 << bit))
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for text in batch.to_pylist():
                    bits = [0] * len(names)
                    for _, (column, bit) in automaton.iter(text):
                        bits[column] |= bit
                    rows.append(bits)
                yield pa.StructArray.from_arrays([pa.array([bits[k] for bits in rows], pa.int64()) for k in range(len(names))], names=names)

        return run(F.col(self.column))


TEXT = Text()


def words_hit(text: Text, t: Term) -> str:
    return "(" + " + ".join(f"CAST({text.has(w)} AS INT)" for w in t.words) + ")"


def term_score(text: Text, t: Term) -> str:
    """What a term adds: a keyword its score if it occurs, a phrase its score by the share of its words, from two on."""
    s = real(KIND_SCORES[t.kind])
    if t.kind == "keyword":
        return f"CASE WHEN {text.has(t.term.lower())} THEN {s} ELSE {real(0.0)} END"
    m = words_hit(text, t)
    return f"CASE WHEN {m} >= 2 THEN {s} * (CAST({m} AS DOUBLE) / {real(float(len(t.words)))}) ELSE {real(0.0)} END"


def scored(text: Text, t: Term) -> str:
    return text.has(t.term.lower()) if t.kind == "keyword" else f"{words_hit(text, t)} >= 2"


def level_hit(text: Text, t: Term) -> str:
    return text.has(t.term.lower()) if t.kind == "keyword" else f"{words_hit(text, t)} >= {len(t.words) // 2}"


def kind_score(o: Ontology, theme: str, kind: str, text: Text = TEXT) -> str:
    return "(" + " + ".join([real(0.0), *(term_score(text, t) for t in o.of(theme, kind))]) + ")"


def score(o: Ontology, theme: str, text: Text = TEXT) -> str:
    terms = [t for k in KIND_SCORES for t in o.of(theme, k)]
    return "least(" + " + ".join([real(0.0), *(term_score(text, t) for t in terms)]) + f", {real(1.0)})"


def label(o: Ontology, theme: str, duck: bool, text: Text = TEXT) -> str:
    """The first three terms that score, joined."""
    hits = ", ".join(f"CASE WHEN {scored(text, t)} THEN {quoted(t.term)} END" for k in KIND_SCORES for t in o.of(theme, k))
    if duck:
        return f"array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL)[1:3], ', ')"
    return f"array_join(slice(filter(array({hits}), x -> x IS NOT NULL), 1, 3), ', ')"


def level(o: Ontology, theme: str, text: Text = TEXT) -> str:
    cases = [f"WHEN {level_hit(text, t)} THEN {quoted(LEVEL_OF_KIND[k])}" for k in KIND_SCORES for t in o.of(theme, k)]
    return f"CASE {' '.join(cases)} ELSE 'nested_metaphor' END"


def span(o: Ontology, theme: str, text: Text = TEXT) -> str:
    """The entry that decided the level."""
    cases = [f"WHEN {level_hit(text, t)} THEN {quoted(t.term)}" for k in KIND_SCORES for t in o.of(theme, k)]
    return f"CASE {' '.join(cases)} ELSE '' END"


def any_of(text: Text, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(text.has(w) for w in words) + ")"


def type_of(o: Ontology, ontological: str, span_: str = "span") -> str:
    """ontological: whether the text has a marker of that kind; the other kinds are looked for in the span."""
    low = Text(f"lower({span_})")
    return f"CASE WHEN {ontological} THEN 'ontological' WHEN {any_of(low, o.marker('structural'))} THEN 'structural' WHEN {any_of(low, o.marker('orientational'))} THEN 'orientational' ELSE 'decorative' END"


def weight(level_: str = "level", type_: str = "type", context: str = "score") -> str:
    pick = lambda col, values, rest: "CASE " + " ".join(f"WHEN {col} = {quoted(k)} THEN {real(v)}" for k, v in values.items()) + f" ELSE {real(rest)} END"
    return f"least({pick(level_, LEVEL_WEIGHTS, 0.4)} * {pick(type_, TYPE_WEIGHTS, 0.5)} * {context}, {real(1.0)})"


FIELDS = ("theory", "theory_ord", "score", "semantic_field", "level", "span")


def _scored(docs: DataFrame, o: Ontology, as_list: bool) -> DataFrame:
    """(doc_id, ontological, and fields or f): whether the text has a marker of that kind; the themes that score above 0, as
    a list or a row each. The text itself ends with its hits.

    The list of all themes is no column of its own: the optimizer would take it apart and make the hits once a theme.
    """
    hits = Hits(o)
    rows = dealt(docs.select("doc_id", "text")).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text_lc"))
    rows = rows.select("doc_id", hits.found().alias("hits")).select("doc_id", "hits.*")
    found = F.array(
        *[
            F.expr(f"struct({quoted(t)} AS theory, {k} AS theory_ord, {score(o, t, hits)} AS score, {label(o, t, False, hits)} AS semantic_field, {level(o, t, hits)} AS level, {span(o, t, hits)} AS span)")
            for k, t in enumerate(o.themes)
        ]
    )
    themes = F.filter(found, lambda f: f["score"] > 0).alias("fields") if as_list else F.explode(found).alias("f")
    return rows.select("doc_id", F.expr(any_of(hits, o.marker("ontological"))).alias("ontological"), themes)


def _exploded(docs: DataFrame, o: Ontology) -> DataFrame:
    return _scored(docs, o, False).select("doc_id", "ontological", "f.*").where("score > 0")


def analysed(docs: DataFrame, o: Ontology = SHIPPED) -> DataFrame:
    """(doc_id, fields, evidence): one row a document with the lists of both, in the order of the themes; one scan, no shuffle."""
    rows = _scored(docs, o, True)
    strong = f"filter(fields, f -> f.score >= {real(LEAST_SCORE)} AND NOT (f.level = 'nested_metaphor' AND f.span = ''))"
    same = ", ".join(f"f.{c} AS {c}" for c in FIELDS)
    typed = f"transform({strong}, f -> struct({same}, {type_of(o, 'ontological', 'f.span')} AS type))"
    weighed = f"transform({typed}, f -> struct({same}, f.type AS type, {weight('f.level', 'f.type', 'f.score')} AS weight))"
    return rows.select("doc_id", "fields", F.expr(weighed).alias("evidence"))


def fields(docs: DataFrame, o: Ontology = SHIPPED) -> DataFrame:
    """A row for each document and theme that scores above 0: (doc_id, theory, theory_ord, score, semantic_field, level, span)."""
    return _exploded(docs, o).select("doc_id", *FIELDS)


def evidence(docs: DataFrame, o: Ontology = SHIPPED) -> DataFrame:
    """At most one row for each document and theme, from LEAST_SCORE on, with type and weight."""
    rows = _exploded(docs, o).where(F.col("score") >= LEAST_SCORE).where("NOT (level = 'nested_metaphor' AND span = '')")
    rows = rows.withColumn("type", F.expr(type_of(o, "ontological"))).withColumn("weight", F.expr(weight()))
    return rows.select("doc_id", *FIELDS, "type", "weight")


def fields_sql(docs: str, o: Ontology = SHIPPED) -> str:
    parts = [f"SELECT doc_id, text_lc, {quoted(t)} AS theory, {k} AS theory_ord, {score(o, t)} AS score, {label(o, t, True)} AS semantic_field, {level(o, t)} AS level, {span(o, t)} AS span FROM low" for k, t in enumerate(o.themes)]
    return f"(WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS text_lc FROM {docs}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE score > 0)"


def evidence_sql(docs: str, o: Ontology = SHIPPED) -> str:
    typed = f"SELECT *, {type_of(o, any_of(TEXT, o.marker('ontological')))} AS type FROM {fields_sql(docs, o)} WHERE score >= {real(LEAST_SCORE)} AND NOT (level = 'nested_metaphor' AND span = '')"
    return f"(SELECT doc_id, theory, theory_ord, score, semantic_field, level, span, type, {weight()} AS weight FROM ({typed}))"
