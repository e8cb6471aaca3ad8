"""Continuous intake: arriving folders' files checked as they come.

An extension; a batch run over the same files gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom.plans.extraction import found_invoices


def stream_invoices(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Follow Parquet files of (scope_id, filename, text) below ``source`` and
    append their invoice fields to Parquet below ``target``."""
    schema = "scope_id string, filename string, text string"
    files = spark.readStream.schema(schema).parquet(source)

    def each(batch: DataFrame, _: int) -> None:
        found_invoices(batch).write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
