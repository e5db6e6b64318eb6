"""Extraction and events as streams. Extraction is per document, so each micro-batch runs the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specloom.operators import extract


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def extract_to(pages: DataFrame, path: str, checkpoint: str):
    """Line items of whole documents as they arrive, appended under path with the batch's id, so a batch that runs again
    replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        extract.line_items(extract.normalize_pages(df)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
