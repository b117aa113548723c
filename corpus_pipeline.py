"""The corpus pipeline: toxicity, quality rules, near duplicates, mixing, tokens, in this order.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; run()
writes each as Parquet into the shared folder and reads it again. All stages but the last return the columns of
documents. Models learn from the rows that their stage is given and labels in sf_dir: no stage reads documents there,
which need not be there any more once the first stage is written.

Null and empty texts fail the base quality rules. Rows that repeat a doc_id with the same text are copies, of which
the join keeps one. A document that the mix takes several times comes out as often. Empty table: no rows. Columns
besides those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope.llm import bpe, chosen_path, mixing, quality_rules, toxicity
from themescope.llm.common import shared_dir, spread, table


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = _free("toxicity", docs)
    scored = spread(docs).withColumn(found, toxicity.toxicity(F.col("text"), lexicon, spark))
    return scored.where(F.col(f"{found}.score") < 0.5).select(*docs.columns)


def keep_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content lines."""
    field = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    found = _free("judged", docs)
    judged = spread(docs).withColumn(found, quality_rules.judge(F.col("text"), field, spark))
    return judged.where(f"{found}.kept").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of linked or equal texts."""
    classes = chosen_path.join(docs)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == F.col("class_copy"))).select(F.col("doc_id").alias("first_id"), F.col("copy").alias("first_copy")).distinct()
    copy = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    mark = _free("copy", docs)
    rows = docs.withColumn(mark, copy)
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col(mark) == F.col("first_copy")), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; rows that are equal in all columns share their copies."""
    mark, taken_mark, times = (_free(name, docs) for name in ("row_mark", "taken_mark", "times_taken"))
    rows = docs.withColumn(mark, F.unhex(F.md5(F.to_json(F.struct(*docs.columns)).cast("binary"))))
    taken = mixing.mix(rows, carry=(mark,)).groupBy(F.col(mark).alias(taken_mark)).agg(F.sum("epochs").cast("int").alias(times)).where(F.col(times) > 0)
    joined = rows.dropDuplicates([mark]).join(taken, F.col(mark) == F.col(taken_mark))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(mark)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy."""
    return bpe.digests(spread(docs.select("doc_id", "text")), *bpe.public())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_content),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]
#: SQL can't express the trained stages; tests/llm/test_pipeline.py holds run() against the same steps in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
