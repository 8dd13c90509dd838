import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import jaccard, pieces, quality
from barloom.llm import text as tx

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def largest_batch(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]}, schema=pa.schema([("n", pa.int64())]))

    return max(r["n"] for r in docs.mapInArrow(run, "n long").collect())


@pytest.mark.parametrize("stage", [lambda d: quality.keep_good(d, []), quality.text_counts, jaccard.near_duplicates, lambda d: pieces.segment_ids(d, MODEL), lambda d: pieces.segment_texts(d, MODEL)])
def test_batches_are_bounded_by_bytes(spark, stage):
    spark.conf.unset(BYTES)
    try:
        stage(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
        assert largest_batch(spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))) < 2 * tx.BATCH_BYTES  # the limit is coarse
    finally:
        spark.conf.unset(BYTES)


def test_smaller_batches_stay(spark):
    for given in ("65536", "64k", "1mb"):
        spark.conf.set(BYTES, given)
        tx.small_batches(spark)
        assert spark.conf.get(BYTES) == given
    spark.conf.set(BYTES, "5m")
    tx.small_batches(spark)
    assert spark.conf.get(BYTES) == str(tx.BATCH_BYTES)
    spark.conf.unset(BYTES)


class Tasks:
    """Stands for a DataFrame and gives the function that its tasks run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_a_worker_lets_the_segmenter_go(spark):
    """The words that the segmenter keeps stay for the next tasks of its stage, and go when the worker is used by another one."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [b"some words here"], "row_key": [1]})
    both = batch.select(["doc_id", "text"])
    for _ in range(2):
        list(pieces.segment_ids(Tasks(spark), MODEL)(iter([both])))
        assert [k[0] for k in tx._kept] == ["segmenter"]
        first = next(iter(tx._kept.values()))
        list(pieces.segment_ids(Tasks(spark), MODEL)(iter([both])))
        assert next(iter(tx._kept.values())) is first
        list(jaccard._summaries(Tasks(spark), 5, 1 << 10)(iter([batch])))
        assert not tx._kept
        list(pieces.segment_ids(Tasks(spark), MODEL)(iter([both])))
        list(quality.text_counts(Tasks(spark))(iter([both])))
        assert not tx._kept
    spark.conf.unset(BYTES)
