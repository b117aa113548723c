"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue (md5 of a seed and doc_id) that may run up to ``max_epochs``
times. A copy's virtual finish time is the words its source has sent up to and with it, divided by the source's
target; the copies of all sources in the order of that time are the mix, cut where the budget is spent.

What stands before the cut is what a global range sort and a running sum would keep, but the sort itself is spared:
the queue of a source is cut into hash ranges of about PART_ROWS rows, whose sums are carried forward, so that a
source with most of the rows is spread; the cut is found by two histograms over virtual time (at most ``2 * bins``
rows reach the driver), and only the copies of the one bin that holds it are sorted. The SQL beside it does sort.
Sources are ordered by name and by what they are short of in one task, a row each: they are held to be far fewer
than documents.

Null text: size 0. Null source: a source of its own, last. Null doc_id: hashed as the empty text, first among
ties, which stand in the order of doc_id and size; equal virtual times in the order of sources. Very long texts are
counted whole. Repeated rows are separate documents. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

SEED, PART_ROWS, LEAST_PARTS, BINS, EPOCHS, WEIGHTS = "mix-1", 500_000, 256, 1024, 3, (5, 2, 1)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = EPOCHS) -> DataFrame:
    """sources(source, source_size) with target: all words shared by weight, never over max_epochs times a source's size.

    Sources are held at their cap in the order of cap / weight until what is left, shared by weight, is under every
    other cap; that is where resharing the excess again and again ends. One row for each source is ordered here.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), nth + 1).cast("long")
    s = sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * max_epochs)
    queue = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = queue.rowsBetween(W.unboundedPreceding, -1), queue.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("sharing", F.sum("weight").over(rest))
    s = s.withColumn("level", F.when(F.col("cap") * F.col("sharing") >= F.col("left") * F.col("weight"), F.col("left") / F.col("sharing")))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(queue.rowsBetween(W.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, part_rows: int = PART_ROWS, bins: int = BINS, max_epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target and epochs: how often the mix takes the document.

    Columns named in ``carry`` come along; their names must not be those of the columns made here.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("k"), *carry), "sizes")
    parts = max(LEAST_PARTS, -(-rows.count() // part_rows))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("int"))

    ranges = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    sent = F.sum("part_size").over(W.partitionBy("source").orderBy("part")) - F.col("part_size")
    ranges = ranges.select(F.col("source").alias("s"), F.col("part").alias("p"), sent.alias("sent"))
    ranges = ranges.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    queue = W.partitionBy("source", "part").orderBy("k", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("size").over(queue)).join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    rows = stored(rows.withColumn("cum", F.col("cum") + F.col("sent")).drop("s", "p", "sent", "part"), "queues")

    finish = lambda epoch: (epoch * F.col("source_size") + F.col("cum")) / F.col("target")
    copies = rows.where("size > 0").select("source", "size", F.explode(F.array(*[finish(F.lit(e)) for e in range(max_epochs)])).alias("finish"))
    # finish times at the cut are about 1: the outer bins cover 0 to 2, the last one all that is later
    outer = F.least(F.floor(F.col("finish") * (bins / 2)), F.lit(bins)).cast("int")
    inner = F.least(F.floor((F.col("finish") * (bins / 2) - F.col("outer")) * bins), F.lit(bins)).cast("int")
    copies = copies.withColumn("outer", outer).withColumn("inner", inner)
    left, at = rows.agg(F.sum("size")).first()[0] or 0, copies
    for level in ("outer", "inner"):
        here = None
        for n, w in sorted(at.groupBy(level).agg(F.sum("size")).collect()):
            if w > left:
                here = n
                break
            left -= w
        if here is None:
            at = None
            break
        at = at.where(F.col(level) == here)
    last = None
    if at is not None:
        so_far = F.sum("size").over(W.orderBy("finish", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
        last = at.withColumn("so_far", so_far).where(F.col("so_far") > left).orderBy("finish", F.col("source").asc_nulls_last()).select("finish", "source").first()

    def taken(epoch: int):
        """1 if the copy stands before the first that the budget can't pay."""
        if last is None:
            return F.lit(1)
        f = finish(F.lit(epoch))
        same = F.col("source").isNotNull() if last.source is None else F.coalesce(F.col("source") < F.lit(last.source), F.lit(False))
        return ((f < F.lit(last.finish)) | ((f == F.lit(last.finish)) & same)).cast("int")

    total = taken(0)
    for e in range(1, max_epochs):
        total = total + taken(e)
    epochs = F.when(F.col("size") > 0, total).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), *carry)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken: size times the number of copies in the mix."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


OP8_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) :: BIGINT AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized),
open_ AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sized) - coalesce(sum(cap) OVER q, 0) AS BIGINT) AS remaining,
         CAST(coalesce(sum(weight) OVER r, 0) AS BIGINT) AS sharing
  FROM weighed
  WINDOW q AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
levelled AS (
  SELECT *,
         (SELECT CAST(remaining AS DOUBLE) / CAST(sharing AS DOUBLE) FROM open_ WHERE cap * sharing >= remaining * weight
          ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST LIMIT 1) AS level
  FROM open_),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), level * weight), CAST(cap AS DOUBLE)) AS target FROM levelled),
queued AS (
  SELECT d.*, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM rows_ d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, source, size, k, cum, e.epoch,
         CAST(e.epoch * source_size + cum AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS e(epoch) WHERE size > 0),
sent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS so_far FROM copies),
counted AS (
  SELECT source, cum, CAST(count(*) AS BIGINT) AS n FROM sent
  WHERE so_far <= (SELECT sum(size) FROM rows_) GROUP BY source, cum)
SELECT q.doc_id, q.size, q.source_size, q.target, q.size * coalesce(c.n, 0) AS taken
FROM queued q LEFT JOIN counted c ON q.size > 0 AND q.cum = c.cum AND q.source IS NOT DISTINCT FROM c.source
"""
