"""Evidence of a stream of documents, and networks of a stream of evidence: extensions, the original has no streams.

The scorer keeps no state, so its plan is that of a table. A network needs all evidence of its document: pieces that
come in several batches are held until the watermark says that the document's session is over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from themescope.operators import lexical
from themescope.operators.network import in_row
from themescope.plans.ontology import SHIPPED, Ontology


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def write_evidence(docs: DataFrame, path: str, checkpoint: str, o: Ontology = SHIPPED) -> StreamingQuery:
    """Appends the evidence of all documents that are there to Parquet, then ends; the checkpoint carries on from there."""
    return lexical.evidence(docs, o).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def network_stream(evidence: DataFrame, seen: str = "seen", late: str = "10 minutes", gap: str = "10 minutes", rank: str = "theory_ord") -> DataFrame:
    """``network()`` for a stream of evidence (doc_id, theory, level, weight, rank, and the time at which it was seen).

    A document's evidence ends when none has come for ``gap``; its row is out once, when the watermark, ``late`` behind
    the latest time, has passed that. State: the pieces of the documents that are still open. Evidence later than the
    watermark is dropped, as in any aggregation over event time.
    """
    pieces = F.collect_list(F.struct("theory", F.col(rank).alias("rank"), "level", "weight")).alias("found")
    held = evidence.withWatermark(seen, late).groupBy(F.session_window(seen, gap), "doc_id").agg(pieces)
    return held.select("doc_id", F.expr(in_row("found")).alias("n")).select("doc_id", "n.*")
