"""Bars (symbol, ts, open, high, low, close, volume) from the tables at hand, and the stored form of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))]
)


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of events.value by event_type; volume is the number of events. ts is unique in events, so open and close are definite."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    by = e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts_bar"))
    b = by.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
    return b.withColumnRenamed("ts_bar", "ts")


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by l_returnflag; aggregates that no order of rows changes."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    by = li.groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"))
    return by.agg(F.min(price).alias("low"), F.max(price).alias("high"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


class BarStore:
    """Bars as Parquet by symbol and year. Scans prune both and push the range of ts down."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, bars: DataFrame, *, overwrite: bool = True) -> None:
        """overwrite: replaces the partitions that bars has rows for. Else rows are merged; of equal (symbol, ts) the stored row stays."""
        if overwrite:
            out = bars
        else:
            both = bars.withColumn("_new", F.lit(1))
            if self.exists():
                touched = bars.select("symbol", F.year("ts").alias("year")).distinct()
                old = self.scan().join(touched, ["symbol", "year"], "left_semi")
                both = both.unionByName(old.drop("year").withColumn("_new", F.lit(0)), allowMissingColumns=True)
            w = Window.partitionBy("symbol", "ts").orderBy("_new", *(c for c in bars.columns if c not in ("symbol", "ts")))
            out = both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")
        out = out.withColumn("year", F.year("ts")).repartition("symbol", "year").sortWithinPartitions("ts")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year").parquet(self.root)

    def exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def scan(self) -> DataFrame:
        return self.spark.read.parquet(self.root)

    def query(self, symbol: str | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a symbol with start <= ts <= end, in order; the filters on year prune folders."""
        ts = F.col("ts")
        out = self.scan()
        if symbol is not None:
            out = out.where(F.col("symbol") == symbol)
        if start is not None:
            at = F.lit(start).cast("timestamp_ntz")
            out = out.where((F.col("year") >= F.year(at)) & (ts >= at))
        if end is not None:
            at = F.lit(end).cast("timestamp_ntz")
            out = out.where((F.col("year") <= F.year(at)) & (ts <= at))
        return out.select(*(columns or [c for c in out.columns if c != "year"])).orderBy(*(["ts"] if not columns or "ts" in columns else []))

    def read(self, symbol: str) -> DataFrame:
        """All rows of a symbol; an error if there is none."""
        out = self.query(symbol)
        if out.isEmpty():
            raise KeyError(f"no bars of {symbol}")
        return out

    def delete(self, symbol: str) -> bool:
        """Deletes all rows of a symbol; whether there were any."""
        jvm = self.spark._jvm
        # special characters stand escaped in the names of folders
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/symbol={name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def latest(self, n: int, skip: int = 0) -> DataFrame:
        """The last n rows of each symbol, after the `skip` last ones."""
        nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
        return self.scan().withColumn("_n", nth).where((F.col("_n") > skip) & (F.col("_n") <= skip + n)).drop("_n", "year")

    def symbols(self, prefix: str = "") -> DataFrame:
        return self.scan().select("symbol").where(F.col("symbol").startswith(prefix)).distinct().orderBy("symbol")


def merge_news(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """News rows with one row for each (ticker, headline): the earliest published."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("ticker", "headline").orderBy("published_at", *(c for c in new.columns if c not in ("ticker", "headline", "published_at")))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def manifest(df: DataFrame, date: str) -> DataFrame:
    """One row: rows, columns, first and last date; dates that can't be read count as missing."""
    at: Column = F.try_to_timestamp(F.col(date).cast("string"))
    return df.agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")).withColumn("columns", F.lit(",".join(df.columns)))
