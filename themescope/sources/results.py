"""Writes results: JSON Lines, CSV and workbooks beside the input, chart tables and a text report."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from themescope.functions.numbers import fixed
from themescope.operators import reports
from themescope.operators.index import numbered
from themescope.plans.dialects import Spark
from themescope.sources import drawing
from themescope.sources.xlsx import write_xlsx

log = logging.getLogger("themescope")


def run_directory(base: str, when: datetime) -> str:
    """A folder for one run, named by its time."""
    return f"{base.rstrip('/')}/analysis_{when.strftime('%Y%m%d_%H%M%S')}"


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def zipped(rows: DataFrame, results: DataFrame, position: str | None = None) -> DataFrame:
    """Input and results side by side by their places in their files, without a key; unequal lengths are an error.

    Names that both have get ``result_`` before those of the results; ``position``: a column to hold the place, if any.
    """
    place = position or "place_"
    (left, n), (right, m) = numbered(rows, place), numbered(results, place)
    if n != m:
        raise ValueError(f"{n} rows can't be paired with {m} results")
    taken = {c.lower() for c in rows.columns}
    right = right.select(F.col(place), *(F.col(c).alias(f"result_{c}" if c.lower() in taken else c) for c in results.columns))
    joined = left.join(right, place)
    return joined if position else joined.drop(place)


def attached(rows: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """Input and results side by side by ``key``; names that both have get ``result_`` before those of the results.

    A key that only one of them has is an error when the rows are read: both are read once.
    """
    taken = {c.lower() for c in rows.columns}
    renamed = results.select(F.col(key).alias("other_key_"), *(F.col(c).alias(f"result_{c}" if c.lower() in taken else c) for c in results.columns if c != key))
    joined = rows.join(renamed, F.col(key).eqNullSafe(F.col("other_key_")) & F.col(key).isNotNull(), "full_outer")
    paired = F.assert_true(F.col(key).isNotNull() & F.col("other_key_").isNotNull(), F.concat(F.lit("no pair for "), F.coalesce(F.col(key), F.col("other_key_")).cast("string")))
    return joined.where(paired.isNull()).drop("other_key_")


class Totals(StreamingQueryListener):
    """Adds up the totals of a stream's batches, by the name under which they are observed; restarts go on from 0."""

    def __init__(self, name: str = "totals"):
        self.name, self.counts = name, dict.fromkeys(("processed", "successful", "errors", "meta_metaphors"), 0)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        log.info("stream %s began", event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            for name in self.counts:
                self.counts[name] += found[name]
            log.info("batch %s: %s", event.progress.batchId, self.counts)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        log.info("stream %s ended", event.runId)

    def totals(self) -> dict[str, int | float | None]:
        return reports.with_percent(self.counts)


def observed(results: DataFrame, name: str = "totals") -> tuple[DataFrame, Observation | None]:
    """The results, and the totals of what is written of them: no scan of their own. A stream has no observation but its ``Totals`` listener."""
    if results.isStreaming:
        return results.observe(name, *reports.totals_metrics()), None
    seen = Observation(name)
    return results.observe(seen, *reports.totals_metrics()), seen


def write_json(results: DataFrame, path: str) -> None:
    """One object a line; null fields are kept."""
    results.write.option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, results: DataFrame, path: str, key: str | None = "row_id") -> None:
    """The attached tables as CSV, without a key the zipped ones; nested columns become JSON. An empty text is quoted, a null isn't."""
    joined = attached(rows, results, key) if key else zipped(rows, results)
    nested = {f.name: F.to_json(f.name) for f in joined.schema if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))}
    joined.withColumns(nested).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_charts(results: DataFrame, classes: list[str], path: str) -> None:
    """The tables behind a dashboard, each a folder of JSON Lines, and two dashboards drawn from them, each a line of SVG in a folder of text."""
    charts = reports.charts(results, classes)
    for name, table in charts.items():
        write_json(table, f"{path}/{name}")
    for name, drawn in (("dashboard", drawing.dashboard(charts)), ("plain_dashboard", drawing.plain_dashboard(charts))):
        results.sparkSession.createDataFrame([(drawn,)], "value string").coalesce(1).write.text(f"{path}/{name}.svg")


def report(results: DataFrame, model: str = "", when: datetime | None = None) -> DataFrame:
    """Lines (part, row_id, place, line) of the report: totals, classes with their share, a block an item, errors.

    Totals and classes come from one count of the results, an item's block is made in its row. A score that is no
    number has no line; a row without a class counts as N/A.
    """
    spark, d = results.sparkSession, Spark()
    line = lambda place, text: F.struct(F.lit(place).alias("place") if isinstance(place, str) else place.alias("place"), text.alias("line"))
    counted = spark.sql(
        f"SELECT coalesce(primary_class, 'N/A') AS primary_class, {reports.OK} AS ok, coalesce(status = 'error', FALSE) AS failed, coalesce(meta_metaphor_detected, FALSE) AS meta, count(*) AS n, min(row_id) AS first_row "
        "FROM {r} GROUP BY 1, 2, 3, 4",
        r=results,
    )
    of = lambda c: f"coalesce(sum(CASE WHEN {c} THEN n END), 0)"
    totals = counted.selectExpr(f"{of('TRUE')} AS processed", f"{of('ok')} AS successful", f"{of('failed')} AS errors", f"{of('ok AND meta')} AS meta_metaphors", f"{reports.pct(of('ok AND meta'), of('ok'))} AS meta_percent")
    head = F.array(
        F.lit(f"Date: {when:%Y-%m-%d %H:%M:%S}" if when else None), F.lit(f"Model: {model}" if model else None),
        F.concat(F.lit("processed "), "processed", F.lit(", successful "), "successful", F.lit(", errors "), "errors"),
        F.concat(F.lit("patterns "), "meta_metaphors", F.coalesce(F.concat(F.lit(" ("), fixed("meta_percent", 1), F.lit("%)")), F.lit(""))),
    )
    first = totals.select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("row_id"), F.lit("").alias("place"), F.explode(head).alias("line"))
    classes = spark.sql(reports.frequencies("SELECT primary_class, sum(n) AS n, min(first_row) AS first_row FROM {c} WHERE ok GROUP BY primary_class", "primary_class", f", {reports.pct('n', 'sum(n) OVER ()')} AS percent"), c=counted)
    classes = classes.select(F.lit(1).alias("part"), F.col("position").cast("long").alias("row_id"), F.lit("").alias("place"), F.concat("primary_class", F.lit(": "), "n", F.lit(" ("), fixed("percent", 1), F.lit("%)")).alias("line"))

    named = F.concat("title", F.lit(": "), "primary_class", F.lit(", confidence "), "confidence", F.coalesce(F.concat(F.lit(", hybrid, secondary class "), "secondary_class"), F.lit("")))
    pattern = F.concat(F.lit("  pattern: "), "meta_semantic_field", F.lit(", "), "meta_transformation")

    def score(s: Column) -> Column:
        return line(F.concat(F.lit("b"), s["key"]), F.concat(F.lit("  "), s["key"], F.lit(": "), fixed(s["value"], 2)))

    def piece(e: Column, k: Column) -> Column:
        known = lambda c: F.coalesce(e[c], F.lit("N/A"))
        cut = lambda c, n: F.concat(F.substring(known(c), 1, n), F.lit("..."))
        parts = [F.lit("  - "), known("class"), F.lit(", "), known("metaphor_level"), F.lit(", "), known("metaphor_type"), F.lit(", "), fixed(F.coalesce(e["weight"], F.lit(0.0)), 2), F.lit(": ")]
        return line(F.concat(F.lit("c"), F.lpad(k.cast("string"), 3, "0")), F.concat(*parts, cut("span", reports.SPAN), F.lit(" / "), cut("reasoning", reports.REASON)))

    items = spark.sql(reports.details(d, "{r}", f", coalesce(map_entries({d.score_map('answer')}), array()) AS scores, slice(coalesce({d.pieces('answer')}, array()), 1, {reports.SHOWN}) AS pieces"), r=results)
    lines = F.concat(F.array(line("a0", named), line("a1", pattern)), F.transform("scores", score), F.transform("pieces", piece))
    items = items.select(F.lit(2).alias("part"), "row_id", F.inline(lines))
    errors = results.where("status = 'error'").select(F.lit(3).alias("part"), "row_id", F.lit("").alias("place"), F.concat(F.coalesce("title", F.lit("N/A")), F.lit(": "), F.coalesce("error", F.lit("error"))).alias("line"))
    return first.unionByName(classes).unionByName(items).unionByName(errors).where("line IS NOT NULL")


def write_report(results: DataFrame, path: str, model: str = "", when: datetime | None = None) -> None:
    """The report as text files in order."""
    report(results, model, when).orderBy("part", "row_id", "place").select("line").write.text(path)


def save(rows: DataFrame, results: DataFrame, classes: list[str], base: str, when: datetime, model: str = "", workbook: bool = False) -> str:
    """All outputs of a run in a folder of its own; returns the folder. The totals are taken while the results are written."""
    path = run_directory(base, when)
    watched, seen = observed(results)
    write_json(watched, f"{path}/results")
    log.info("totals: %s", reports.with_percent(seen.get))
    write_csv(rows, results, f"{path}/data")
    write_report(results, f"{path}/report", model, when)
    write_charts(results, classes, f"{path}/charts")
    if workbook:
        write_xlsx(attached(rows, results), f"{path}/data.xlsx")
    log.info("results of %s in %s", model or "the run", path)
    return path
