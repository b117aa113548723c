"""Input tables with a row_id, a title and a combined description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from themescope.functions.text import combined
from themescope.operators.index import numbered, row_index


#: What an empty field without quotes is read as on its way to null; without it a quoted one would be null too.
NO_FIELD = "\u0001no field\u0001"


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A CSV file in UTF-8 with a header line; quoted fields may hold line ends, and quotes are doubled.

    White space at the ends of a field stays; an empty field is null unless it is quoted. Without a schema all columns are texts.
    """
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", **({"nullValue": NO_FIELD} | options))
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def prepare(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``df`` with combined_description, and with title ``Item_<number>`` where it is null or no column.

    ``key`` orders the rows; a table without it is numbered in the order of its files and lines.
    """
    if key not in df.columns:
        df, _ = numbered(df, key)
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    rows = row_index(df.withColumns({"combined_description": combined(df), "title": title}), key, "item_number")
    return rows.withColumn("title", F.coalesce("title", F.concat(F.lit("Item_"), F.col("item_number").cast("string")))).drop("item_number")
