"""Column functions on texts; lengths and cuts are in code points, white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The text columns of an input table, in the order in which they are joined.
TEXT_COLUMNS = ["descr", "descr_en", "descr_clean", "descr_lemmas"]


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_columns(df: DataFrame) -> list[str]:
    """The text columns that ``df`` has; none is an error."""
    found = [c for c in TEXT_COLUMNS if c in df.columns]
    if not found:
        raise ValueError(f"none of the text columns {TEXT_COLUMNS} is there")
    return found


def combined(df: DataFrame) -> Column:
    """The text columns joined by one space and stripped; a null is an empty text, whose space stays."""
    return strip(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns(df))))


def blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def truncated(c: Column | str, n: int = 100) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))
