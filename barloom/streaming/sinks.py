"""Sinks of streams that bear replays, with a bound on what a micro-batch takes and a report on each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.sources import reports


def limited(spark: SparkSession, path: str, schema: str, *, files: int = 100, kind: str = "parquet", pattern: str | None = None) -> DataFrame:
    """The files of a folder as a stream that takes up to `files` of them in a micro-batch; the others wait where they are, so nothing is dropped when they come faster than they are
    worked off. (Of Kafka, maxOffsetsPerTrigger says the same.)"""
    read = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files)
    return (read.option("pathGlobFilter", pattern) if pattern else read).load(path)


def write_batch(batch: DataFrame, batch_id: int, table: str, report_root: str | None = None, *, at: str | None = None) -> None:
    """Writes a micro-batch below `table` in the folder of its number, and its validation reports likewise. A batch that is replayed after a failure replaces itself, so its rows
    never stand twice."""
    batch = batch.persist()
    try:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if report_root is not None:
            stamp = at or str(batch.sparkSession.sql("SELECT current_timestamp()").first()[0])
            reports.save_reports(reports.validation_reports(batch, stamp), report_root, str(batch_id))
    finally:
        batch.unpersist()


def start(stream: DataFrame, table: str, checkpoint: str, report_root: str | None = None, *, at: str | None = None, continuous: str | None = None) -> StreamingQuery:
    """Runs the stream into `table` with a report on each micro-batch: to the end of what there is, or every `continuous` interval."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, table, report_root, at=at)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def stored(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of all micro-batches, with batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(table)


def tick_bars(ticks: DataFrame) -> DataFrame:
    """Every tick(symbol, ts, value) as a bar of its own."""
    return ticks.select("symbol", "ts", *(F.col("value").alias(c) for c in reports.PRICES), F.lit(1.0).alias("volume"))
