"""Rows dealt out over cores, and row numbers over a whole table without a window in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the partition above this bit and the position in it below.
POSITION_BITS = 33


def dealt(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores (one small file) is dealt out; larger ones and streams stay as read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return shared or tempfile.mkdtemp()


def new_folder(spark: SparkSession) -> str:
    """A path that doesn't exist yet, in the folder that the cluster shares."""
    return f"{_shared(spark).rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the folder that the cluster shares, read again."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def row_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``df`` with its rows counted from 0 in the order of ``key``, which is unique.

    Ranges of the key are sorted apart and checkpointed, since a second run of a range partitioning may cut elsewhere.
    Only the row count of each partition reaches the driver, and goes back as a table of as many rows.
    """
    spark = df.sparkSession
    ranged = checkpointed(df.repartitionByRange(key).sortWithinPartitions(key))
    ranged = ranged.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, POSITION_BITS)
    before, offsets = 0, []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        # what a position in this partition lacks to the number of its row
        offsets.append((r.part, before - (r.part << POSITION_BITS)))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "part_ long, offset_ long")
    joined = ranged.join(F.broadcast(starts), part == F.col("part_"))
    return joined.select(*df.columns, (F.col(name) + F.col("offset_")).alias(name))


def numbered(df: DataFrame, name: str = "position") -> tuple[DataFrame, int]:
    """``df`` with its rows counted from 0 in the order of its files, and their number: no key, no sort, no shuffle.

    Files count in the order of their names, rows as they stand in them; rows that come from no file in the order of
    their partitions. Spark reads files in pieces, in an order of its own: the first row and the count of each piece reach the
    driver, and go back as a table of as many rows. Reading again must give the same pieces, as it does for files that
    stay as they are.
    """
    spark = df.sparkSession
    marks = {"file_": F.input_file_name(), "start_": F.input_file_block_start(), "part_": F.spark_partition_id(), name: F.monotonically_increasing_id()}
    marked = df.withColumns(marks)
    pieces = df.select(*[c.alias(n) for n, c in marks.items()]).groupBy("file_", "start_", "part_").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    before, offsets = 0, []
    for r in sorted(pieces, key=lambda r: (r.file_, r.start_, r.part_)):
        offsets.append((r.file_, r.start_, r.part_, before - r["first"]))
        before += r.n
    starts = spark.createDataFrame(offsets, "file_ string, start_ long, part_ int, offset_ long")
    joined = marked.join(F.broadcast(starts), ["file_", "start_", "part_"])
    return joined.select(*df.columns, (F.col(name) + F.col("offset_")).alias(name)), before
