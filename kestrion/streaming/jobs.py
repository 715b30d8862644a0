"""Streams: documents into a store, telemetry into windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kestrion.functions import models, text
from kestrion.operators.windows import window_documents
from kestrion.sources.scratch import Scratch
from kestrion.store import Store

TELEMETRY = "ts timestamp, outcome string, reason string, stage string, error string, backend string, router_ms long, embed_ms long, query_ms long, total_ms long, chunks int, tokens long"


def outcome_counts(records: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and mean latency by outcome in event-time windows of a (streaming) table of telemetry."""
    return (
        records.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "outcome")
        .agg(F.count("*").alias("n"), F.avg("total_ms").alias("mean_ms"))
        .select(F.col("window.start").alias("start"), "outcome", "n", "mean_ms")
    )


class EmbedFailed(RuntimeError):
    """Some documents of a batch got no vectors; the batch has to be run again."""


def index_documents(store: Store, project_id: int, embedder):
    """A foreachBatch function that upserts (source_path, text): unchanged texts are left alone; of a path twice in a batch the greater text counts.

    Documents without a vector for each of their chunks are not stored. When the others are, the batch fails, so that the stream takes it up
    again, where only these are still new. Each text is embedded once an attempt.
    """

    def run(batch: DataFrame, _: int) -> None:
        from kestrion.operators.index import changed

        scratch = Scratch(batch.sparkSession, "stream")
        rows = batch.groupBy("source_path").agg(F.max("text").alias("text")).withColumn("content_hash", text.content_hash(F.col("text")))
        fresh = scratch.keep(changed(rows, store.document_hashes(project_id), ["source_path"]), "fresh")
        if not fresh.isEmpty():
            documents = fresh.select(F.lit("convention").alias("doc_type"), "source_path", text.title(F.col("source_path")).alias("title"), "content_hash")
            chunks = window_documents(fresh.select("source_path", text.title(F.col("source_path")).alias("label"), "text"), ["source_path"])
            chunks = chunks.withColumn("doc_type", F.lit("convention")).withColumn("language", text.fallback_language(F.col("source_path")))
            chunks = chunks.withColumn("content_hash", text.content_hash(F.col("content"))).withColumn("embedding", models.embed_column(embedder)("content"))
            chunks = scratch.keep(chunks, "chunks")
            failed = scratch.keep(chunks.where("embedding is null").select("source_path").distinct(), "failed")
            store.replace(project_id, documents.join(failed, "source_path", "left_anti").select(documents.columns), chunks.join(failed, "source_path", "left_anti").select(chunks.columns))
            n = failed.count()
            if n:
                raise EmbedFailed(f"no vectors for {n} documents")
            scratch.drop(chunks, failed)
        scratch.drop(fresh)

    return run
