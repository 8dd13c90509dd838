"""Queries on headlines and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import nlp
from barloom.plans.registry import query, rounded

_LISTS = [", ".join(f"'{w}'" for w in words) for words in (nlp.POSITIVE, nlp.NEGATIVE)]
#: Frequent words of the test texts, in which words of the finance lexicon are rare.
UP, DOWN = ["the", "with", "good"], ["of", "that", "bad"]


def _scores_sql(up: str, down: str) -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({up}))) AS p, len(list_filter(w, lambda x: x IN ({down}))) AS n FROM w),
u AS (SELECT *, (p + 0.1) / (p + n + 0.3) AS up, (n + 0.1) / (p + n + 0.3) AS down FROM c), r AS (SELECT *, greatest(0.05, 1 - up - down) AS rest FROM u),
s AS (SELECT doc_id, CASE WHEN p + n = 0 THEN 0.075 ELSE up / (up + down + rest) END AS up, CASE WHEN p + n = 0 THEN 0.075 ELSE down / (up + down + rest) END AS down, CASE WHEN p + n = 0 THEN 0.85 ELSE rest / (up + down + rest) END AS rest FROM r)
SELECT doc_id, CASE WHEN up > down AND up > rest THEN 'positive' WHEN down > up AND down > rest THEN 'negative' ELSE 'neutral' END AS label, round(CAST(up - down AS DOUBLE), 6) AS score,
  round(CAST(CASE WHEN up > down AND up > rest THEN up WHEN down > up AND down > rest THEN down ELSE rest END AS DOUBLE), 6) AS confidence, round(CAST(rest AS DOUBLE), 6) AS neutral FROM s"""


def _scored(spark: SparkSession, sf_dir: str, *lists: list[str]) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rounded(nlp.lexicon_scores(docs, "text", *lists).select("doc_id", "label", "score", "confidence", "neutral"))


@query("lexicon_scores", _scores_sql(*_LISTS))
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query("word_list_scores", _scores_sql("'the', 'with', 'good'", "'of', 'that', 'bad'"))
def word_list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lexicon_scores with lists of words that the texts have often."""
    return _scored(spark, sf_dir, UP, DOWN)


@query(
    "page_headlines",
    """SELECT page_id, sha256(trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(url, 'https?://', '', 'g'), 'www\\.[^ \\t\\r\\n]+', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))), '[^\\p{L}\\p{N}_ \\t\\r\\n]', '', 'g'))) AS hash FROM pages""",
)
def page_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of each page without its scheme as a headline, and its hash."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", nlp.headline_hash(nlp.normalise(F.regexp_replace("url", "https?://", ""))).alias("hash"))


@query("turn_sections")
def turn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of up to 20 words of each conversation turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.posexplode(nlp.chunks(F.col("text"), 20)).alias("nth", "chunk"))
