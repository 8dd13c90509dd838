"""Benchmark decontamination (operator 4) by winnowing, with DataFrame operations only.

Words are lower-cased runs of letters, digits and non-ASCII characters. Of every text and every benchmark item the k-gram hashes are winnowed:
the minimum of each window of `span - k + 1` consecutive k-grams is a fingerprint, so any shared run of `span` words leaves a common one.
Fingerprints of the texts are joined with those of the benchmark; texts with a common fingerprint are read again and their hits are extended to
all words inside an occurrence of a `span`-word window of an item. Items with fewer words than `span` are one window each and are looked up
whole. Windows meet by two 64-bit hashes of their words.

Edge cases: null texts and items have no words. An empty benchmark contaminates nothing. Rows with the same doc_id are judged each by its
own text and all are returned, also those without a doc_id; repeated rows are read once and returned as often as they stand. Ties: none arise.
Very long texts are rows like others. Items with the same item_id count as one. Further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import text as tx

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str = "text") -> Column:
    lowered = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAPS, -1), "")


def text_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The same for rows with the same doc_id and text, null or not."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull(), F.col(doc_id), F.col(doc_id).isNull())


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def _grams(w: Column, n: Column, k: int) -> Column:
    """Hash of the k words at each place."""
    return F.transform(F.slice(w, F.lit(1), n - (k - 1)), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))


def _minima(g: Column, n: Column, window: int) -> Column:
    """Distinct minima of the windows over n hashes."""
    return F.array_distinct(F.transform(F.slice(g, F.lit(1), n - (window - 1)), lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, window)))))


def fingerprints(df: DataFrame, span: int, k: int) -> DataFrame:
    """df(words, n_words) with the column fingerprints: the winnowed k-gram hashes; none below `span` words."""
    grams = df.withColumn("grams", F.when(F.col("n_words") >= span, _grams(F.col("words"), F.col("n_words"), k)).otherwise(_empty()))
    minima = F.when(F.col("n_words") >= span, _minima(F.col("grams"), F.col("n_words") - (k - 1), span - k + 1)).otherwise(_empty())
    return grams.withColumn("fingerprints", minima).drop("grams")


def _maybe_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most_rows else df


def _windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """A row (.., at, width, window, check) for each place of so many words of each width; window, check: two hashes of them."""
    w, n = F.col("words"), F.col("n_words")

    def of(width: int) -> Column:
        each = lambda x, i: F.struct(i.alias("at"), F.lit(width).alias("width"), F.xxhash64(F.slice(w, i + 1, F.lit(width))).alias("window"), F.xxhash64(F.lit(width), F.slice(w, i + 1, F.lit(width))).alias("check"))
        return F.when(n >= width, F.transform(F.slice(w, F.lit(1), n - (width - 1)), each)).otherwise(F.array().cast("array<struct<at:int,width:int,window:bigint,check:bigint>>"))

    found = of(widths[0]) if len(widths) == 1 else F.concat(*map(of, widths))
    return df.select(*(c for c in df.columns if c not in ("words", "n_words")), F.explode(found).alias("x")).select(*(c for c in df.columns if c not in ("words", "n_words")), "x.*")


def occurrences(docs: DataFrame, benchmark: DataFrame, *, span: int = 13, k: int = 5, most_broadcast: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(texts, hits). texts: doc_id, text_key, copies (equal rows), n_words. hits: text_key, item_id, at, width for each occurrence of a window.

    most_broadcast: tables of up to so many rows are broadcast, larger ones are shuffled.
    """
    items = benchmark.select("item_id", words().alias("words")).withColumn("n_words", F.size("words")).where("n_words > 0")
    items = tx.stored(items, "items")
    item_prints = fingerprints(items, span, k).select(F.explode("fingerprints").alias("fingerprint")).distinct()
    short = sorted(r[0] for r in items.where(F.col("n_words") < span).select("n_words").distinct().collect())  # fewer than `span` numbers
    read = docs.select("doc_id", text_key().alias("text_key"), words().alias("words")).withColumn("n_words", F.size("words"))
    prints = fingerprints(read, span, k)
    rows = prints.select("doc_id", "text_key", "n_words", F.posexplode_outer("fingerprints").alias("nth", "fingerprint"))
    marked = rows.join(_maybe_broadcast(item_prints.withColumn("found", F.lit(1)), most_broadcast), "fingerprint", "left")
    texts = marked.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.count(F.when(F.coalesce("nth", F.lit(0)) == 0, 1)).alias("copies"), F.max("found").alias("found"))
    texts = tx.stored(texts, "texts")
    parts = []
    if short:
        of = [_windows(items.where(F.col("n_words") == width), [width]) for width in short]
        parts.append((read.select("text_key", "words", "n_words"), short, reduce(DataFrame.union, of)))
    some = texts.where("found = 1").select("text_key")
    again = read.select("text_key", "words", "n_words").join(_maybe_broadcast(some, most_broadcast), "text_key", "left_semi")
    parts.append((again, [span], _windows(items.where(F.col("n_words") >= span), [span])))
    hits = []
    for texts_read, widths, of in parts:
        of = of.select("item_id", "width", "window", "check").distinct()
        hits.append(_windows(texts_read, widths).join(_maybe_broadcast(of, most_broadcast), ["width", "window", "check"]).select("text_key", "item_id", "at", "width"))
    # rows that stand twice give the same hits
    return texts, reduce(DataFrame.union, hits).distinct()


def matches(hits: DataFrame) -> DataFrame:
    """Hits on one diagonal joined to the longest runs: text_key, item_id, start, stop (words, stop exclusive)."""
    by = Window.partitionBy("text_key", "item_id").orderBy("at", "width")
    end = F.col("at") + F.col("width")
    run = hits.withColumn("new", (F.col("at") > F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    run = run.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("text_key", "item_id", "run").agg(F.min("at").alias("start"), F.max(end).alias("stop")).drop("run")


def contamination(docs: DataFrame, benchmark: DataFrame, *, percent: int = 5, **how) -> DataFrame:
    """doc_id, text_key, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 and contaminated (n_hit > 0 and
    100 * n_hit >= percent * n_words) of every row of docs."""
    texts, hits = occurrences(docs, benchmark, **how)
    hits = tx.stored(hits, "hits")
    by = Window.partitionBy("text_key").orderBy("at", "width").rowsBetween(Window.unboundedPreceding, -1)
    places = hits.select("text_key", "at", "width").distinct()
    end = F.col("at") + F.col("width")
    added = places.withColumn("add", F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(by), F.lit(0)))))
    covered = added.groupBy("text_key").agg(F.sum("add").cast("long").alias("n_hit"))
    named = hits.groupBy("text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = covered.join(named, "text_key")
    out = texts.join(found, "text_key", "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    hit, n = F.coalesce("n_hit", F.lit(0).cast("long")), F.col("n_words").cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", n.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (100 * hit >= percent * n)).alias("contaminated"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(tx.documents(spark, sf_dir), tx.table(spark, sf_dir, "benchmark")).drop("text_key")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM p),
widths AS (SELECT DISTINCT m FROM items),
q AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM d, widths WHERE len(w) >= m),
hits AS (SELECT doc_id, pos, q.m AS m, item_id FROM (SELECT doc_id, pos, m, array_to_string(w[pos:pos + m - 1], ' ') AS win FROM q) q JOIN items USING (win) WHERE q.m = items.m),
places AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS x FROM (SELECT DISTINCT doc_id, pos, m FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""
