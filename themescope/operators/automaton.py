"""Ontologies of any size: all terms searched at once by an automaton, in one pass over the texts.

The compiled columns of ``operators.lexical`` look for each word of a small ontology; thousands of terms would outgrow a
generated method, and a join on ``contains`` would be a nested loop. Here terms are a table (theory, term). Blocks of
terms, bounded in number and size, go to the workers, which build an automaton of each once; a text passes it once,
however many terms there are. Larger ontologies take several blocks, each a pass over the texts.

Lower case is made by Spark for both sides, so matches are those of ``contains(lower(text), lower(term))``. Null texts
have no hits, null and empty terms none either; equal terms of a theme count as often as the table has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope.operators.index import dealt

#: Terms and their characters that one automaton holds at most.
TERMS, CHARS = 500_000, 16_000_000
#: A term's theme as a number, and how often the table has it there.
Owners = tuple[tuple[int, int], ...]


def blocks(terms: DataFrame) -> Iterator[tuple[list[str], dict[str, Owners]]]:
    """Themes and lower-cased terms with their owners, within TERMS and CHARS a block; read block by block."""
    low = F.lower(F.col("term").cast("string"))
    counted = terms.select("theory", low.alias("term")).where("term <> ''").groupBy("term", "theory").agg(F.count(F.lit(1)).alias("n"))
    owned = counted.groupBy("term").agg(F.collect_list(F.struct("theory", "n")).alias("owners"))
    themes: dict[str, int] = {}
    held: dict[str, Owners] = {}
    chars = 0
    for r in owned.toLocalIterator():
        if held and (len(held) == TERMS or chars + len(r.term) > CHARS):
            yield list(themes), held
            themes, held, chars = {}, {}, 0
        held[r.term] = tuple((themes.setdefault(o.theory, len(themes)), o.n) for o in r.owners)
        chars += len(r.term)
    if held:
        yield list(themes), held


class _Automata:
    """The automaton of a broadcast block, built once a worker."""

    @staticmethod
    @lru_cache(4)
    def of(terms: Broadcast) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, (term, owners) in enumerate(terms.value.items()):
            found.add_word(term, (k, owners))
        found.make_automaton()
        return found


def hits_of(spark: SparkSession, text: Column, terms: dict[str, Owners]) -> Column:
    """Of a lower-cased text column, the themes that it hits: an array of (theme's number, number of its terms that occur)."""
    held = spark.sparkContext.broadcast(terms)

    @F.arrow_udf("array<struct<theme: int, hits: long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _Automata.of(held)
        kind = pa.list_(pa.struct([("theme", pa.int32()), ("hits", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch:
                seen: dict[int, Owners] = {}
                for _, (k, owners) in automaton.iter(text.as_py() or ""):
                    seen[k] = owners
                counts: dict[int, int] = {}
                for owners in seen.values():
                    for theme, n in owners:
                        counts[theme] = counts.get(theme, 0) + n
                rows.append([{"theme": t, "hits": n} for t, n in counts.items()])
            yield pa.array(rows, kind)

    return run(text)


def term_hits(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, theory, hits): how many terms of each theme occur in a text of ``docs`` (doc_id, text), from 1 on.

    terms: (theory, term). The rows are those of a join on ``contains`` and a count, without the join. Rows that repeat
    a doc_id are texts of their own, whose hits are added, as the count would.
    """
    spark = docs.sparkSession
    low = dealt(docs.select("doc_id", "text")).select("doc_id", F.lower("text").alias("text_lc"))
    found = None
    for themes, held in blocks(terms):
        names = F.array(*[F.lit(t) for t in themes]) if len(themes) <= 64 else None
        rows = low.select("doc_id", F.explode(hits_of(spark, F.col("text_lc"), held)).alias("h")).select("doc_id", "h.theme", "h.hits")
        if names is not None:
            rows = rows.select("doc_id", names[F.col("theme")].alias("theory"), "hits")
        else:
            table = spark.createDataFrame(list(enumerate(themes)), "theme int, theory string")
            rows = rows.join(F.broadcast(table), "theme").select("doc_id", "theory", "hits")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
        return spark.createDataFrame([], f"doc_id {kinds['doc_id']}, theory string, hits long")
    return found.groupBy("doc_id", "theory").agg(F.sum("hits").alias("hits"))
