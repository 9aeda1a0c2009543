"""Extension: a drop folder of archives as a stream of files (the audit itself is batch)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit
from ..sources.archives import SCHEMA, SubmissionSource


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parse each new archive of a folder into the files table; a batch that is run again replaces its own rows."""
    spark.dataSource.register(SubmissionSource)
    arrivals = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.zip").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def merge(batch: DataFrame, number: int) -> None:
        # file names of one batch; their contents are read by the tasks
        paths = [r["path"] for r in batch.toLocalIterator()]
        if paths:
            own = batch.sparkSession.read.format("submissions").option("paths", json.dumps(paths)).option("on_error", "quarantine").load()
            own.withColumn("ord", F.col("ord") + F.lit(number).cast("long") * (1 << 40)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def current_files(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(table).where(F.col("archive_error").isNull())


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and type of a stream with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def current_groups(spark: SparkSession, table: str) -> tuple[DataFrame, DataFrame]:
    files = current_files(spark, table)
    return audit.exact_groups(files), audit.attribute_groups(files)
