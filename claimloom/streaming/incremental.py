"""Incremental ingest: a stream of documents, each micro-batch appended without what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from claimloom.sources.ingest import new_documents


def ingest_stream(documents: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends the new contents of a stream to a Parquet store. A batch that is run again finds its contents stored."""
    spark = documents.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        try:
            stored = spark.read.parquet(store).select("sha256")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], "sha256 string")
        new_documents(batch, stored).write.mode("append").parquet(store)

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
