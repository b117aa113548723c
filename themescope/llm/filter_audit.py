"""Which filter takes which documents: an audit of filters that act together, by multilinear extension.

Every document is reduced to a mask of the filters that it fails; documents are counted by part and mask. Of a part with
counts c(mask), the removal polynomial is

    f(x) = sum over masks of c(mask) * (1 - product over the mask's filters i of (1 - x_i)),

multilinear in one variable a filter. At a corner (x_i is 1 for the filters that act) it is the number of removed
documents, so survivors, removals at a step and documents that fail one filter only are differences of corners. Along
the diagonal, the integral of its derivative by x_i from 0 to 1 is the Shapley value of filter i: with the coefficient
a_T of the monomial of T, the sum of a_T / |T| over all T with i. Fractions are exact; times n! the value is the number
of documents that the filter removes, summed over all orders.

Masks come from one pass over the texts, counts from partial aggregation: no text is shuffled, only its digest. What a
document repeats is known by digests too: rows are counted by digest and by id, then the least id of each text is
taken off the repeats, so that no row is joined with the others of its text. Polynomials see at most 32 masks a part.

Null and empty texts: no words, no characters; they fail A alone (fewer words), and E if a smaller id has such a text too.
Very long texts are taken whole. Ties: rows of one doc_id don't repeat each other. A null doc_id is neither smaller
than any nor has a smaller one. A null lang is the part '' and shares it with an empty one. Of several labels of an id,
one that says 1 is enough; documents without labels count as neither good nor toxic. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored, table, words

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
#: The bit of the filter that texts themselves don't decide: repeats.
REPEATS = 1 << LETTERS.index("E")

_not_capital = bytes(b for b in range(256) if not 65 <= b <= 90)
_symbol = re.compile(r"[#$%&*|]")


def own_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    found = words(text)
    n = len(found)
    fails = (
        n < LEAST_WORDS,
        100 * len(set(found)) < DISTINCT_PERCENT * n,
        100 * len(text.encode().translate(None, _not_capital)) > CAPITAL_PERCENT * len(text),
        _symbol.search(text) is not None,
    )
    return sum(1 << k for k, bad in enumerate(fails) if bad)


def judged(text: Column) -> Column:
    """(mask of A to D, digest) of a text column; null is the empty text."""

    @F.arrow_udf("mask int, digest binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([own_mask(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())], names=["mask", "digest"]
            )

    return run(text)


# ---- the polynomial


def polynomial(counts: dict[int, int], n: int) -> dict[int, int]:
    """Coefficients by monomial (a set of filters as bits) of the removal polynomial of ``counts`` by mask."""
    above = [counts.get(m, 0) for m in range(1 << n)]
    for i in range(n):  # sums over all masks that contain a set
        for m in range(1 << n):
            if not m >> i & 1:
                above[m] += above[m | 1 << i]
    return {t: above[t] if t.bit_count() % 2 else -above[t] for t in range(1, 1 << n)}


def corner(poly: dict[int, int], active: int) -> int:
    """The polynomial where the active filters' variables are 1, the others 0."""
    return sum(a for t, a in poly.items() if t & active == t)


def shapley(poly: dict[int, int], i: int) -> Fraction:
    """The derivative by variable i, integrated along the diagonal."""
    return sum((Fraction(a, t.bit_count()) for t, a in poly.items() if t >> i & 1), Fraction(0))


MEASURES = ("n", "good", "toxic")
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def steps(part: str, counts: dict[str, dict[int, int]], letters: str = LETTERS) -> list[tuple]:
    """A row for each order of the filters and each of its steps; counts: for each measure, by mask."""
    n = len(letters)
    every = (1 << n) - 1
    poly = {m: polynomial(counts[m], n) for m in MEASURES}
    removed = {m: [corner(poly[m], s) for s in range(1 << n)] for m in MEASURES}
    total = sum(counts["n"].values())
    values = [shapley(poly["n"], i) * math.factorial(n) for i in range(n)]
    if any(v.denominator != 1 for v in values):
        raise ArithmeticError(f"a sum over all orders is no integer: {values}")
    rows = []
    for order in permutations(range(n)):
        active = 0
        for k, i in enumerate(order):
            then = active | 1 << i
            here = {m: removed[m][then] - removed[m][active] for m in MEASURES}
            only = removed["n"][every] - removed["n"][every & ~(1 << i)]
            rows.append((part, "".join(letters[j] for j in order), k + 1, total - removed["n"][then], here["n"], removed["n"][1 << i] - here["n"], only, here["good"], here["toxic"], int(values[i])))
            active = then
    return rows


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Steps of every order for each part of ``counted`` (part, mask, n, good, toxic): one row a part and mask."""
    ship(counted.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {m: dict(zip(rows["mask"].tolist(), map(int, rows[m]), strict=True)) for m in MEASURES}
        names = [c.split()[0] for c in STEPS.split(", ")]
        return pd.DataFrame(steps(key[0], counts, letters), columns=names)

    return counted.groupBy("part").applyInPandas(run, STEPS)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``docs`` (doc_id, text, lang) with their labels (doc_id, quality, toxic)."""
    ship(docs.sparkSession)
    part = F.coalesce("lang", F.lit("")).alias("part")
    rows = docs.select("doc_id", part, judged(F.col("text")).alias("j")).select("doc_id", "part", "j.mask", "j.digest")
    # equal rows become one with a count before they meet their labels: no id, however many rows it has, is a hot key
    # (and are written, since what follows reads them several times, and the texts should be read once)
    rows = stored(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "judged")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    with_id = rows.where("doc_id IS NOT NULL").join(told, "doc_id", "left")
    # null ids have no labels, and a join would gather them in one task
    without = rows.where("doc_id IS NULL").withColumns({"quality": F.lit(0), "toxic": F.lit(0)})
    rows = with_id.unionByName(without).withColumns({"good": F.col("n") * F.coalesce("quality", F.lit(0)), "toxic": F.col("n") * F.coalesce("toxic", F.lit(0))}).drop("quality")
    rows = stored(rows, "labelled")
    # every row of a text but those of its least id repeats it: count all as repeats, then move the first ones back
    sums = [F.sum(m).alias(m) for m in MEASURES]
    least = rows.where("doc_id IS NOT NULL").groupBy("digest", "part").agg(F.min(F.struct("doc_id", "mask", *MEASURES)).alias("f"))
    least = least.groupBy("digest").agg(F.collect_list(F.struct("part", "f")).alias("parts"))
    first = least.select(F.expr("filter(parts, p -> p.f.doc_id = array_min(transform(parts, q -> q.f.doc_id)))").alias("firsts"))
    first = first.select(F.explode("firsts").alias("p")).select("p.part", "p.f.mask", *[f"p.f.{m}" for m in MEASURES])
    first = first.unionByName(rows.where("doc_id IS NULL").select("part", "mask", *MEASURES))
    back = first.withColumns({m: -F.col(m) for m in MEASURES}).withColumn("mask", F.col("mask").bitwiseOR(REPEATS))
    all_ = rows.select("part", F.col("mask").bitwiseOR(REPEATS).alias("mask"), *MEASURES)
    return all_.unionByName(back).unionByName(first).groupBy("part", "mask").agg(*sums)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT x.doc_id, x.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a,
         CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
         CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e
  FROM texts x LEFT JOIN told l ON x.doc_id = l.doc_id),
masks AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY ALL),
bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS seq
  FROM bits p, bits q, bits r, bits s, bits u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
placed AS (
  SELECT filter_order, k AS step, seq[k] AS own, CAST(coalesce(list_sum(seq[1 : k - 1]), 0) AS BIGINT) AS earlier
  FROM orders, (VALUES (1), (2), (3), (4), (5)) AS v(k)),
counted AS (
  SELECT m.part, p.filter_order, p.step, p.own,
         sum(CASE WHEN m.mask & (p.own | p.earlier) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN m.mask & p.own <> 0 AND m.mask & p.earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m.mask & p.own <> 0 AND m.mask & p.earlier <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m.mask = p.own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m.mask & p.own <> 0 AND m.mask & p.earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN m.mask & p.own <> 0 AND m.mask & p.earlier = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM masks m, placed p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
