"""Streams of bars: late rows per symbol, deduplication, windows and staleness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the stream: symbol, ts and what a bar holds.
TICK = "symbol string, ts timestamp, value double"
NEWEST = "symbol string, newest timestamp"


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (symbol, ts, value); a file is read once, new files as they come."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")


@dataclass(frozen=True)
class Timely:
    """A stream of rows of which `run_once` lets through those that are later than all rows of their symbol in earlier micro-batches."""

    ticks: DataFrame
    once: bool

    def write(self, batch: DataFrame, number: int, out: str) -> None:
        """Writes what a micro-batch lets through and the newest time of each symbol after it, both in folders of its number, so a micro-batch that is replayed replaces itself.
        Rows meet the newest times in a join and are told apart by symbol and time, so a symbol's rows are dealt over all tasks."""
        spark = batch.sparkSession
        kept, past = batch, None
        if number:
            past = spark.read.schema(NEWEST).parquet(f"{out}/newest-{number - 1}")
            late = past.select(F.col("symbol").alias("of"), "newest")
            kept = batch.join(F.broadcast(late), F.col("symbol").eqNullSafe(F.col("of")), "left").where("ts > newest or newest is null or ts is null").select(*batch.columns)
        kept = kept.dropDuplicates(["symbol", "ts"]) if self.once else kept
        kept.write.mode("overwrite").parquet(f"{out}/rows-{number}")
        newest = spark.read.schema(batch.schema).parquet(f"{out}/rows-{number}").select("symbol", F.col("ts").alias("newest"))
        newest = newest.unionByName(past) if past is not None else newest
        newest.groupBy("symbol").agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{out}/newest-{number}")


def timely(ticks: DataFrame, once: bool = True) -> Timely:
    """Rows later than all rows of their symbol in earlier micro-batches, one for each (symbol, ts) of a micro-batch (once=False: all). The cutoff moves at the end of a micro-batch, so rows
    out of order within it stay; rows without a time are never late.

    A watermark would cut all symbols at one time; here every symbol has its own cutoff. The output keeps it over restarts.
    """
    return Timely(ticks, once)


def window_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Bars of tumbling (or sliding) windows, emitted once the watermark has passed them."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    b = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w"))
    out = b.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """symbol, start, stop, n of runs of rows with no gap of `gap`."""
    b = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return b.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def staleness(newest: DataFrame, expected: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """symbol, status: LIVE, STALE (no row for `seconds`) or WAITING (none at all) of the expected symbols; newest(symbol, ts)."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    status = F.when(F.col("ts").isNull(), "WAITING").when(age > seconds, "STALE").otherwise("LIVE")
    return expected.join(newest, "symbol", "left").select("symbol", status.alias("status"))


def run_once(stream: DataFrame | Timely, out: str, checkpoint: str) -> DataFrame:
    """Everything there is so far, appended to Parquet at `out` exactly once; returns the table."""
    if isinstance(stream, Timely):
        ticks = stream.ticks
        ticks.writeStream.foreachBatch(lambda batch, number: stream.write(batch, number, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return ticks.sparkSession.read.schema(ticks.schema).parquet(f"{out}/rows-*")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
