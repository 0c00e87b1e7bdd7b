"""Incremental ingest: new GFA files become segment and link rows as they arrive.

Records are independent, so the stream is stateless. `ingest_segments` also numbers
the segments, batch after batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqbraid.sources.gfa import (
    is_link,
    is_segment,
    link_columns,
    numbered_segments,
    scan_schema,
    segment_columns,
    split_records,
)


def stream_records(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return split_records(
        spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    )


def stream_segments(records: DataFrame) -> DataFrame:
    kind, fields = F.col("kind"), F.col("fields")
    return records.filter(is_segment(kind, fields)).select(*segment_columns(fields))


def stream_links(records: DataFrame) -> DataFrame:
    kind, fields = F.col("kind"), F.col("fields")
    return records.filter(is_link(kind, fields)).select(*link_columns(fields))


def append_parquet(table: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available now; restartable from its checkpoint."""
    return (
        table.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def ingest_segments(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Append the segments of all files under `folder` that are new since the last call.

    The segment table in `out` has the ids of one parse of all files, call after call: what is
    new at a call is one batch, numbered along the paths and continued after the rows of the
    batches before it. A limit on the files of a batch would cut them by modification time,
    which says nothing about the order of files that were written together. Every batch is
    written under its own number, in place of what an interrupted run may have left there, so
    a batch that is run again leaves no row twice.
    """
    source = spark.readStream.option("recursiveFileLookup", "true")
    lines = scan_schema(source.text(folder))

    def write(batch: DataFrame, number: int) -> None:
        done = 0
        if number:
            earlier = batch.sparkSession.read.parquet(out).filter(F.col("batch") < number)
            done = earlier.count()  # read from the footers
        rows = numbered_segments(batch).withColumn("id", F.col("id") + done)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
