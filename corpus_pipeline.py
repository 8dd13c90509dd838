"""A corpus pipeline of five operators: quality rules, near duplicates, benchmark decontamination, personal data, pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it has kept. All but the last return the columns of
`documents`.

Edge cases: null and empty texts fail the quality rules. Rows are told apart by doc_id and text, so rows with one doc_id, or with none, are
judged each by its text; of repeated rows one stays. Ties: of near duplicates the smallest doc_id stays (none counts as smallest), of its texts the one
with the smallest hash. Very long texts are rows like others. An empty table passes through all stages as an empty table; further columns of the input, whatever
their names but `row_key`, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, jaccard, pieces, pii, quality
from barloom.llm import text as tx

MOST_BROADCAST = 300_000


def _sent(keys: DataFrame) -> DataFrame:
    """Keys (eight bytes a row) that are broadcast up to MOST_BROADCAST rows, and shuffled beyond."""
    keys = tx.stored(keys.distinct(), "keys")
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("shuffle_hash")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned decision list."""
    return quality.keep_good(docs, quality.fit_rules(docs, tx.table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id; of rows that stand twice, one."""
    found = jaccard.near_duplicates(docs)
    # texts without a shingle are linked with nothing, so each is a group of its own
    sets = found.where("n_shingles > 0")
    # groups are told by their root: texts under one doc_id can lie in several groups
    stays = sets.groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("first")).select("root", F.col("first.row_key").alias("stays"))
    both = sets.join(stays, "root")
    gone = both.where("row_key <> stays").select("row_key")
    twice = found.groupBy("row_key").count().where("count > 1").select("row_key")
    left = docs.withColumn("row_key", jaccard.row_key()).join(_sent(gone), "row_key", "left_anti")
    twice = _sent(twice)
    once = left.join(twice, "row_key", "left_anti").unionByName(left.join(twice, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return once.select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages."""
    found = decontam.contamination(docs, tx.table(spark, sf_dir, "benchmark")).where("contaminated")
    keyed = docs.withColumn("row_key", decontam.text_key())
    return keyed.join(_sent(found.select(F.col("text_key").alias("row_key"))), "row_key", "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the names of their kinds."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids (best segmentation), scores (of the three best) and round_trip (its pieces give the text again) of every document."""
    import public_tokenizers

    got = pieces.segment_ids(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores", "round_trip")


STAGES = [("quality rules", good_quality), ("near duplicates", one_of_each), ("decontamination", uncontaminated), ("personal data", redacted), ("pieces", encoded)]

#: SQL cannot express the learned rules, votes and segmentations; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`, each written as Parquet and read again as the next one's input."""
    docs = tx.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tx.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
