"""A folder of manifests as a stream: an extension, since records then have no event time and no total order.

Every micro-batch is parsed like a manifest file; batches are numbered within it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import with_row_index


def record_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Record lines of the manifests that appear in a folder: source file and elements."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("source"))
    lead = F.substring("value", 1, 1)
    return lines.where((F.col("value") != "") & ~lead.isin("@", "#")).select("source", F.split("value", "\t", -1).alias("e"))


def for_each_batch(stream: DataFrame, batch_size: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives ``sink`` each micro-batch with row_idx, batch_id and slot."""

    def deal(df: DataFrame, epoch: int) -> None:
        df = with_row_index(df.withColumn("_id", F.monotonically_increasing_id()), "_id").drop("_id")
        sink(df.withColumns({"batch_id": F.floor(F.col("row_idx") / batch_size).cast("long"), "slot": (F.col("row_idx") % batch_size).cast("long")}), epoch)

    return stream.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_source(stream: DataFrame) -> DataFrame:
    """Running number of records per manifest."""
    return stream.groupBy("source").agg(F.count("*").alias("records"))
