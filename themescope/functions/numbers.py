"""Numbers as text, rounded from their binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column | str, digits: int) -> Column:
    """A double with ``digits`` (0 to 6) after the point: its exact binary value rounded, ties to even; nan, inf and -inf by name.

    ``format_string`` rounds the shortest decimal that prints the double, and ties up. Here the value is compared
    with the middle of two candidates without an error: the part behind the point is split in two halves of 26 bits,
    whose products with 2 * 10^digits are exact, and so is their difference from an odd whole number near by.
    From 2^53 on doubles are whole; those from 2^63 on print as Spark prints them.
    """
    x = F.col(c) if isinstance(c, str) else c
    scale = 10**digits
    # each step is bound to a name, so that it is made once
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)

    def parts(size: Column) -> Column:
        whole = F.floor(size)  # a long, so exact below 2^63
        return F.struct(whole.alias("whole"), (size - whole.cast("double")).alias("rest"))

    def halves(p: Column) -> Column:
        mixed = p["rest"] * F.lit(float((1 << 27) + 1))
        return F.struct(p["whole"].alias("whole"), p["rest"].alias("rest"), (mixed - (mixed - p["rest"])).alias("high"), F.floor(p["rest"] * F.lit(float(scale))).alias("about"))

    def beyond(h: Column, m: int, k: Column) -> Column:
        """Its sign is that of rest * m - k."""
        return (h["high"] * F.lit(float(m)) - k.cast("double")) + (h["rest"] - h["high"]) * F.lit(float(m))

    def under(h: Column) -> Column:
        k = h["about"] + F.when(beyond(h, scale, h["about"]) < 0, -1).when(beyond(h, scale, h["about"] + 1) >= 0, 1).otherwise(0)
        return F.struct(h.alias("h"), k.alias("k"))

    def rounded(u: Column) -> Column:
        tie = beyond(u["h"], 2 * scale, u["k"] * 2 + 1)
        odd = (u["k"] if digits else u["h"]["whole"]) % 2 == 1
        up = F.when(tie > 0, 1).when((tie == 0) & odd, 1).otherwise(0)
        return F.struct(u["h"]["whole"].alias("whole"), (u["k"] + up).alias("k"))

    def written(r: Column) -> Column:
        whole = (r["whole"] + F.when(r["k"] >= scale, 1).otherwise(0)).cast("string")
        return F.concat(whole, F.lit("."), F.lpad((r["k"] % scale).cast("string"), digits, "0")) if digits else whole

    size = F.abs(x)
    text = let(parts(size), lambda p: let(halves(p), lambda h: let(under(h), lambda u: let(rounded(u), written))))
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(size >= F.lit(2.0**63), F.format_string(f"%.{digits}f", x))
    return F.when(x.isNotNull(), F.coalesce(odd, F.concat(sign, text)))
