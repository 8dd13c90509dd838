"""News, lists of members and delistings, and the audit log, as stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.bars import merge_news

C = F.col
EVENT = "timestamp string, kind string, severity string, message string, data string"


class NewsStore:
    """Headlines as Parquet by ticker; one row for each (ticker, headline)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def save(self, news: DataFrame) -> None:
        """Adds news(ticker, published_at, headline, ..) to the tickers that it has rows for; of equal headlines the earliest stays."""
        own = news.withColumn("ticker", F.upper("ticker"))
        old = self._all()
        if old is not None:
            # only the tickers at hand are read and written anew
            old = old.join(own.select("ticker").distinct(), "ticker", "left_semi")
        merged = merge_news(old, own)
        merged.repartition("ticker").sortWithinPartitions("published_at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(self.root)

    def _all(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.root) if there else None

    def query(self, ticker: str | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of one ticker or of all with start <= published_at <= end, oldest first."""
        out = self._all()
        if out is None:
            raise FileNotFoundError(self.root)
        if ticker is not None:
            out = out.where(C("ticker") == ticker.upper())
        if start is not None:
            out = out.where(C("published_at") >= F.lit(start).cast("timestamp"))
        if end is not None:
            out = out.where(C("published_at") <= F.lit(end).cast("timestamp"))
        return out.orderBy("published_at", "ticker", "headline").select(*(columns or out.columns))


def ticker_list(spark: SparkSession, path: str, schema: str, tickers: list[str], dates: list[str] = ()) -> DataFrame:
    """A CSV file with a header: tickers trimmed and in upper case, other texts trimmed, dates read (null if they can't be); empty values and `none` are null."""
    fields = T.StructType.fromDDL(schema)
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in fields])).option("header", True).csv(path)
    clean = {f.name: F.when(~F.lower(F.trim(f.name)).isin("", "none", "nan"), F.trim(f.name)) for f in fields}
    clean |= {c: F.upper(clean[c]) for c in tickers}
    clean |= {c: F.try_to_timestamp(clean[c]).cast("date") for c in dates}
    return raw.select(*(clean[f.name].cast(f.dataType).alias(f.name) for f in fields))


def delisted(spark: SparkSession, path: str) -> DataFrame:
    """ticker, delisting_date, reason of a CSV list; of rows of one ticker the latest counts."""
    rows = ticker_list(spark, path, "ticker string, delisting_date date, reason string", ["ticker"], ["delisting_date"]).where("ticker is not null")
    return rows.groupBy("ticker").agg(F.max_by(F.struct("delisting_date", "reason"), F.struct("delisting_date", "reason")).alias("r")).select("ticker", "r.*").orderBy("ticker")


def add_delistings(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with the rows of new; a ticker that both have takes those of new."""
    fresh = new.withColumn("ticker", F.upper(F.trim("ticker")))
    return known.join(fresh, "ticker", "left_anti").unionByName(fresh).orderBy("ticker")


def split_text(factor: Column) -> Column:
    """`k:1` of a split, `1:k` of a reverse one; two decimals where k is no whole number."""
    k = F.when(factor >= 1, factor).otherwise(1 / factor)
    text = F.when(k == F.floor(k), F.floor(k).cast("string")).otherwise(F.format_string("%.2f", k))
    return F.when(factor >= 1, F.concat(text, F.lit(":1"))).otherwise(F.concat(F.lit("1:"), text))


def known_splits(rows: DataFrame) -> DataFrame:
    """symbol, ts, factor, ratio of rows(symbol, ts, factor) that change the price: factors above 0 but 1."""
    return rows.where("factor > 0 and factor <> 1").withColumn("ratio", split_text(C("factor")))


def log_events(events: DataFrame, root: str) -> None:
    """Appends events(timestamp, kind, severity, message, data) as JSON lines, by date."""
    events.withColumn("date", F.to_date(F.try_to_timestamp("timestamp"))).write.mode("append").partitionBy("date").json(root)


def read_events(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """Events of the log, or of one date; blank lines and such that are no JSON are left out."""
    rows = spark.read.schema(EVENT + ", date date").option("mode", "DROPMALFORMED").json(root)
    return rows if date is None else rows.where(C("date") == F.lit(date).cast("date"))


def event_page(events: DataFrame, kind: str | None = None, ticker: str | None = None, *, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    """(a page of the events of a kind and ticker, oldest first, their number before paging). The ticker stands in the events' data."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit from 1 to 500, offset from 0")
    rows = events
    if kind is not None:
        rows = rows.where(C("kind") == kind.upper())
    if ticker is not None:
        rows = rows.where(F.upper(F.get_json_object("data", "$.ticker")) == ticker.upper())
    return rows.orderBy("timestamp", "kind", "message", "data").offset(offset).limit(limit), rows.count()


def decision_summary(events: DataFrame) -> DataFrame:
    """kind, status, direction, ticker, rule and n of the log, with the totals over every one of them alone (the others null); what an event's data do not tell is 'none'."""
    told = {"status": "$.status", "direction": "$.direction", "ticker": "$.ticker", "rule": "$.rule"}
    rows = events.select("kind", *(F.coalesce(F.upper(F.get_json_object("data", p)), F.lit("none")).alias(c) for c, p in told.items()))
    sets = [[C(c)] for c in ("kind", *told)] + [[C(c) for c in ("kind", *told)]]
    return rows.groupingSets(sets, C("kind"), *(C(c) for c in told)).agg(F.count("*").alias("n"))


def event_summary(events: DataFrame) -> DataFrame:
    """date, kind, severity and n of the log."""
    return events.groupBy("date", "kind", "severity").agg(F.count("*").alias("n"))
