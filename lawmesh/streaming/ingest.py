"""Documents as they come: an addition to what batch jobs do, with the same operators on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.operators.ingest import chunks


def chunk_stream(docs: DataFrame, size: int = 1000) -> DataFrame:
    """Chunks of a stream of documents (doc_id, text, source); no state, so no watermark."""
    parts = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", F.lit("section_1").alias("section_id"), F.lit("Full Document").alias("heading"), F.col("text").alias("content")
    )
    return chunks(parts, size)


def start(stream: DataFrame, path: str, checkpoint: str, log: str):
    """Writes chunks and logs their documents batch by batch; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.select("doc_id").distinct().write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
