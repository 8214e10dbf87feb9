"""Keeping the chunk table up to date: a stream of files, with batch-wise replacement, and the batch diff for deletions.

File sources do not report deletions; sweep() finds those by the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources import chunker, corpus
from lodestone.sources.sinks import ChunkTable

SUBMISSION = "document_id string, source_file string, text string, submitted timestamp"


def submissions(spark: SparkSession, path: str, schema: str = SUBMISSION) -> DataFrame:
    """A stream of submitted documents from JSON files."""
    return spark.readStream.schema(schema).json(path)


def latest(batch: DataFrame) -> DataFrame:
    """Of several submissions of a document the last."""
    w = Window.partitionBy("document_id").orderBy(F.desc("submitted"), F.desc("text"))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def apply(table: ChunkTable, batch: DataFrame, options: chunker.Options = chunker.Options()) -> int:
    """Put a batch of submissions in the table: a document's earlier chunks go, its new ones come. Doing it twice changes nothing."""
    docs = latest(batch)
    made = chunker.enriched(chunker.split(docs, options))
    return table.change(made, lambda old: old.join(docs.select("document_id"), "document_id", "left_semi"))


def sync(stream: DataFrame, table: ChunkTable, checkpoint: str, options: chunker.Options = chunker.Options(), trigger: dict | None = None):
    """Start the stream into the table; the stream's checkpoint is what remembers which files are done."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            apply(table, batch, options)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sweep(table: ChunkTable, current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Take the chunks of removed and changed sources out of the table; gives the diff. The caller indexes the changed ones and writes
    the manifest last, so that a run that dies can be repeated."""
    diff = corpus.manifest_diff(current, manifest)
    table.delete_sources(diff)
    return diff


def turns_with_memory(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of conversation turns (conv_id, ts, question) counted by conversation and hour, late ones up to `delay` included."""
    return stream.withWatermark("ts", delay).groupBy("conv_id", F.window("ts", "1 hour")).agg(F.count("*").alias("turns"), F.max_by("question", "ts").alias("last_question"))
