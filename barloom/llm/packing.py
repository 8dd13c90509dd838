"""Packing of tokenized documents into sequences of one size (operator 13).

Every document is encoded once, with an end id, and gives its whole sequences and a rest of 1 to size - 1 tokens. The histogram of the rests has at most
`size` - 1 rows, however large the corpus, and is packed on the driver: lengths go longest first into the shortest pack that is open, whole groups of packs
with one pattern at a time; a pattern is split where fewer documents than packs are left, so what is kept are patterns and their counts. There are just as many
packs as the tokens fill, and for what is left over packs of powers of two; documents that no longer fit when all packs are open are cut over the
gaps at the end. So no sequence has padding: each has `size` tokens or a power of two.

The plan says for each length which ranks of its documents go to which sequences. Documents get their rank within their length without a sort: by task and place, and
a running sum over the tasks. The plan, joined back by length and rank, gives the pieces.

Edge cases: a null or empty text has the end id alone. Very long texts become whole sequences and one rest. Ties: documents of one length take its places in the
order in which they are read. Repeated rows are documents of their own; a null doc_id stays null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import text as tx
from barloom.llm.sstable import WordEncoder

#: Counts of (task, length) that are broadcast (32 bytes each); more are joined by shuffle.
MOST_CELLS = 1_000_000


class Place(NamedTuple):
    """The documents low <= rank < high of a length put `take` tokens from `start` on at `offset` of the sequences sequence, sequence + 1, .."""

    length: int
    low: int
    high: int
    start: int
    take: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], size: int) -> tuple[list[Place], int]:
    """Places for all documents, and the number of sequences, of a histogram of lengths from 1 to `size`."""
    full, over = divmod(sum(n * c for n, c in counts.items()), size)
    powers = [b for b in reversed(range(over.bit_length())) if over >> b & 1]
    #: Groups of open packs with one pattern: (-space, first sequence, sequence after the last, tokens so far).
    open_ = [(-(1 << b), full + k, full + k + 1, 0) for k, b in enumerate(powers)]
    heapq.heapify(open_)
    places: list[Place] = []
    opened, cut = 0, []

    def put(length: int, low: int, n: int, start: int, most: int) -> tuple[int, int]:
        """Up to n documents into the shortest packs: (documents placed, tokens of each)."""
        space, first, end, at = heapq.heappop(open_)
        m, take = min(n, end - first), min(most, -space)
        places.append(Place(length, low, low + m, start, take, first, at))
        if first + m < end:
            heapq.heappush(open_, (space, first + m, end, at))
        if -space > take:
            heapq.heappush(open_, (space + take, first, first + m, at + take))
        return m, take

    for length in sorted(counts, reverse=True):
        low, n = 0, counts[length]
        while n:
            if open_ and -open_[0][0] >= length:
                m, _ = put(length, low, n, 0, length)
                low, n = low + m, n - m
            elif opened < full:
                more = min(n, full - opened)
                heapq.heappush(open_, (-size, opened, opened + more, 0))
                opened += more
            else:
                cut.append((length, low, n, 0))
                break
    if opened < full:
        heapq.heappush(open_, (-size, opened, full, 0))
    while cut:
        length, low, n, start = cut.pop()
        m, take = put(length, low, n, start, length - start)
        if m < n:
            cut.append((length, low + m, n - m, start))
        if start + take < length:
            cut.append((length, low, m, start + take))
    return places, full + len(powers)


_encoders: dict[str, WordEncoder] = {}


def encoded(docs: DataFrame, tokenizer: str, size: int, *, end_id: int) -> DataFrame:
    """doc_id, ids (with the end id, as little-endian 32-bit numbers), n, and: part (task), rest (n % size), nth (of its rest in the task) and whole (whole sequences before it in the task)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("rest", pa.int32()), ("nth", pa.int64()), ("whole", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))
        part, seen, whole = TaskContext.get().partitionId(), np.zeros(size, np.int64), 0
        for batch in batches:
            _, off = tx.blobs(batch.column(1))
            for lo, hi in tx.slices(off, 1 << 20):
                ids = [encoder.encode(b).astype("<u4").tobytes() + end for b in batch.column(1).slice(lo, hi - lo).to_pylist()]
                n = np.array([len(b) // 4 for b in ids])
                rest = n % size
                order = np.argsort(rest, kind="stable")
                first = np.searchsorted(rest[order], rest[order])
                nth = np.zeros(len(n), np.int64)
                nth[order] = seen[rest[order]] + np.arange(len(n)) - first
                seen += np.bincount(rest, minlength=size)
                before = whole + np.cumsum(n // size) - n // size
                whole += int((n // size).sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(rest.astype(np.int32)), pa.array(nth), pa.array(before)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n long, part int, rest int, nth long, whole long")


def ranked(found: DataFrame, size: int, *, most_cells: int = MOST_CELLS) -> tuple[DataFrame, dict[int, int]]:
    """encoded()'s rows with rank (of its rest among all) and whole (whole sequences before it among all), and how many documents each rest has."""
    cells = tx.stored(found.groupBy("part", "rest").agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {size}")).alias("full")), "cells")
    counts = {r["rest"]: r["docs"] for r in cells.where("rest > 0").groupBy("rest").agg(F.sum("docs").alias("docs")).collect()}
    before = lambda w: w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task stands in the second window
    parts = cells.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(before(Window.partitionBy(F.lit(0)))), F.lit(0)).alias("whole_before"))
    starts = cells.select("part", "rest", F.coalesce(F.sum("docs").over(before(Window.partitionBy("rest"))), F.lit(0)).alias("rank_before")).join(parts, "part")
    starts = F.broadcast(starts) if cells.count() <= most_cells else starts
    joined = found.join(starts, ["part", "rest"])
    return joined.select("doc_id", "ids", "n", "rest", (F.col("nth") + F.col("rank_before")).alias("rank"), (F.col("whole") + F.col("whole_before")).alias("whole")), counts


def pack(docs: DataFrame, tokenizer: str, *, size: int = 4096, end_id: int = 2, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id and offset of every piece. Sequences with one document's tokens alone
    are numbered after those that the plan fills."""
    found = tx.stored(encoded(docs, tokenizer, size, end_id=end_id), "encoded")
    rows, counts = ranked(found, size, most_cells=most_cells)
    places, sequences = plan(counts, size)
    table = docs.sparkSession.createDataFrame(places, "length int, low long, high long, start long, take long, sequence long, offset long")
    rest = rows.withColumnRenamed("rest", "length").join(F.broadcast(table), "length").where("rank >= low AND rank < high")
    rest = rest.select("doc_id", "ids", "n", (F.expr(f"n div {size} * {size}") + F.col("start")).alias("start"), F.col("take").alias("length"), (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
    full = rows.where(f"n >= {size}").select("doc_id", "ids", "n", "whole", F.explode(F.expr(f"sequence(0L, n div {size} - 1)")).alias("k"))
    full = full.select("doc_id", "ids", "n", (F.col("k") * size).alias("start"), F.lit(size).cast("long").alias("length"), (F.col("whole") + F.col("k") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    piece = F.expr("substring(ids, cast(4 * start + 1 AS int), cast(4 * length AS int))").alias("ids")
    return rest.unionByName(full).select("doc_id", "start", "length", piece, F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian 32-bit numbers) of every sequence of pack()'s pieces; a sequence is bounded by its size."""
    joined = F.reduce(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b""), lambda sofar, piece: F.concat(sofar, piece["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(tx.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
