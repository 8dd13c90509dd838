"""Near-duplicate join on word shingles (operator 8) by vertical partitioning of the global shingle order.

Every text becomes the set of its distinct 5-word shingles (64-bit hashes); texts with equal sets are one class. All shingles stand in one
global order, rare ones first (by a count sketch of fixed size; any order gives the same result). The order is cut into fragments. Two sets
that overlap enough share a shingle within the first fragment of each, its prefix; these postings are shuffled once. First every class is held
against the classes that share most postings with it, as the first of their posting lists. Components of these links are then cut away, and
only pairs of classes in different components are left. A pair needs a shared shingle early enough in both orders, and parity bitmaps of the
sets (a bit flips for each differing shingle, so they bound the difference) that are near enough; both tests are exact. Whether a pair links is decided exactly: overlaps
are counted fragment by fragment and summed per pair. No pairs are made within a component that is already known, nor among copies.

Edge cases: null, empty and blank texts have no shingles and stand alone; 1 to 4 words are one shingle. Rows with the same doc_id give one row
each; their component is the smallest doc_id as for any others. An empty table gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import text as tx
from barloom.llm.components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 14
_PART = 500
#: Longs of a set's parity bitmap, a power of two.
BITMAP = 16


class ShingleHasher:
    """64-bit hashes of the distinct k-word shingles of a text; the words' hashes are kept in a bounded cache."""

    def __init__(self, k: int = 5, most_words: int = 100_000):
        self.k, self.most, self.cache = k, most_words, {}

    def _word(self, w: bytes) -> int:
        if len(self.cache) >= self.most:
            self.cache.clear()
        h = self.cache[w] = xxhash.xxh3_64_intdigest(w) or 1
        return h

    def shingles(self, b: bytes) -> np.ndarray:
        """Ascending; a text of fewer than k words has one, made of its whole sequence."""
        get, words = self.cache.get, b.lower().split()
        w = np.fromiter((get(x) or self._word(x) for x in words), np.uint64, len(words))
        k = min(self.k, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h ^= h >> np.uint64(29)
            h *= _MIX
            h += w[j : len(w) - k + 1 + j]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return np.unique(h ^ (h >> np.uint64(29)))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of the set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def parity(shingles: np.ndarray) -> np.ndarray:
    """BITMAP longs: of each cell, whether an odd number of shingles falls into it. Two sets differ in as many shingles as bits at least."""
    cell = (shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 6 - (BITMAP.bit_length() - 1))
    return np.packbits(np.bincount(cell.astype(np.intp), minlength=64 * BITMAP).astype(np.uint8) & 1).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text"), row_key().alias("row_key"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The same for rows with the same doc_id and text, null or not."""
    return F.xxhash64(F.col(doc_id), F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def _summaries(docs: DataFrame, k: int, cells: int) -> DataFrame:
    """A row (doc_id, n, set) for each document, and of each task rows (chunk, counts) with its part of the sketch of shingle counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int32()), ("set", pa.int64()), ("bits", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        hasher, sketch, none = ShingleHasher(k), None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, _PART):
                sets = [hasher.shingles(b) for b in batch.column(1).slice(lo, _PART).to_pylist()]
                sketch = np.zeros(cells, np.uint32) if sketch is None else sketch
                np.add.at(sketch, (np.concatenate(sets) >> shift).astype(np.intp), 1)
                none = [None] * len(sets)
                yield tx.rows(schema, batch.column(0).slice(lo, _PART), batch.column(2).slice(lo, _PART), [len(s) for s in sets], [set_key(s) for s in sets], [parity(s) for s in sets], none, none)
        if sketch is not None:
            parts = np.minimum(sketch, 0xFFFF).astype("<u2").reshape(-1, min(_CHUNK, cells))
            none = [None] * len(parts)
            yield tx.rows(schema, none, none, none, none, none, list(range(len(parts))), [zlib.compress(p.tobytes(), 1) for p in parts])

    return _texts(docs).mapInArrow(run, "doc_id long, row_key long, n int, set long, bits array<long>, chunk int, counts binary")


def _sketch(parts: DataFrame, cells: int) -> np.ndarray:
    """The sum of the tasks' sketches: `cells` numbers, however large the input."""
    schema, width = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), min(_CHUNK, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(chunk, np.zeros(width, np.int64))
                total[chunk] += np.frombuffer(zlib.decompress(b), "<u2")
        if total:
            yield tx.rows(schema, list(total), [np.minimum(v, 0x7FFFFFFF).astype("<i4").tobytes() for v in total.values()])

    out = np.zeros(cells, np.int32)
    for r in parts.repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], "<i4")
    return out


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of a set of n shingles with one that it links with."""
    return (percent * n + 99) // 100


def _postings(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(shingle, set, n, at) for the prefix of every set: its n - needed(n) + 1 first shingles in the global order, at: their places there.
    A task emits equal sets once."""
    schema = pa.schema([("shingle", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])
    shift, sent = np.uint64(64 - (len(sketch).bit_length() - 1)), docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        hasher, seen, counts = ShingleHasher(k), set(), sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _PART):
                out: list[tuple[np.ndarray, int, int]] = []
                for b in batch.column(1).slice(lo, _PART).to_pylist():
                    s = hasher.shingles(b)
                    if len(s) and (key := set_key(s)) not in seen:
                        seen.add(key)
                        order = np.argsort(counts[(s >> shift).astype(np.intp)], kind="stable")
                        out.append((s[order[: len(s) - needed(len(s), percent) + 1]], key, len(s)))
                if out:
                    size = [len(p) for p, _, _ in out]
                    yield tx.rows(schema, np.concatenate([p for p, _, _ in out]).view(np.int64), np.repeat([x for _, x, _ in out], size), np.repeat([x for _, _, x in out], size).astype(np.int32), np.concatenate([np.arange(x, dtype=np.int32) for x in size]))

    return _texts(docs).mapInArrow(run, "shingle long, set long, n int, at int")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (and first, first_n, first_at) whose shingle is in two sets at least; first: the least of these sets.
    The rows come sorted, so a task holds one batch however many sets a shingle has."""
    schema = pa.schema([(c, pa.int64() if c in ("shingle", "set", "first") else pa.int32()) for c in ("shingle", "set", "n", "at", "first", "first_n", "first_at")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        held: list[int] | None = None  # the first posting of the last shingle so far
        sent = False  # it has been emitted
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in range(4)]
            if held is not None:
                columns = [np.insert(c, 0, h) for c, h in zip(columns, held, strict=True)]
            key, of = columns[:2]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])  # without repeated rows
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            group = np.cumsum(start) - 1
            first = [c[start][group] for c in columns[1:]]
            many = np.bincount(group, new) > 1
            out = many[group] & new
            if held is not None and sent:
                out[0] = False
                out |= (group == 0) & (of != first[0]) & new
            last = int(np.flatnonzero(start)[-1])
            again = held is not None and held[0] == key[last]
            held, sent = [int(c[last]) for c in columns], bool(many[-1]) or (sent and again)
            if out.any():
                yield tx.rows(schema, *(c[out] for c in (*columns, *first)))

    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)
    return postings.repartition("shingle").sortWithinPartitions("shingle", "set").mapInArrow(run, kinds)


def _can_link(percent: int):
    """Of two postings of one shingle: what stands from there on in both sets can still reach the overlap of a linked pair. For the first
    shingle that two sets share, in the global order, this holds if they link."""
    least = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent) - 1e-9)
    return (F.col("a_n") - F.col("a_at") >= least) & (F.col("b_n") - F.col("b_at") >= least)


def _near_bits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, a_n, b_n, ..) whose bitmaps are near enough for a link."""
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("bits").alias("a_bits")), "a").join(sets.select(F.col("set").alias("b"), F.col("bits").alias("b_bits")), "b")
    return both.where(_bits_fit(percent)).drop("a_bits", "b_bits")


def _bits_fit(percent: int):
    apart = sum((F.bit_count(F.col("a_bits")[k].bitwiseXOR(F.col("b_bits")[k])) for k in range(1, BITMAP)), F.bit_count(F.col("a_bits")[0].bitwiseXOR(F.col("b_bits")[0])))
    return apart <= F.col("a_n") + F.col("b_n") - 2 * F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent) - 1e-9)


def _fragments(docs: DataFrame, summaries: DataFrame, pairs: DataFrame, k: int, fragment: int, most_broadcast: int) -> DataFrame:
    """(set, part, shingles) of the sets in `pairs`: each set cut by ranges of the hash into parts of about `fragment` shingles."""
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    one = summaries.join(wanted, "set").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    one = tx.stored(one, "wanted")
    small = one.count() <= most_broadcast
    schema = pa.schema([("set", pa.int64()), ("part", pa.int32()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        hasher = ShingleHasher(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, _PART):
                keys, parts, blobs = [], [], []
                for b, want in zip(batch.column(0).slice(lo, _PART).to_pylist(), batch.column(1).slice(lo, _PART).to_pylist(), strict=True):
                    s = hasher.shingles(b)
                    if (key := set_key(s)) != want:  # another row with the same doc_id
                        continue
                    # sets of like size have the same parts: parts are powers of two, and the pairs' sizes differ by less than two
                    depth = _depth(len(s), fragment)
                    cut = np.searchsorted(s, (np.arange(1, 1 << depth, dtype=np.uint64) << np.uint64(64 - depth))) if depth else []
                    for p, piece in enumerate(np.split(s, cut)):
                        keys.append(key)
                        parts.append(p)
                        blobs.append(piece.tobytes())
                if keys:
                    yield tx.rows(schema, keys, parts, blobs)

    texts = _texts(docs).join(F.broadcast(one) if small else one.hint("shuffle_hash"), "doc_id").select("text", "set")
    return texts.mapInArrow(run, "set long, part int, shingles binary")


def _depth(n: int, fragment: int) -> int:
    return max(0, (n // fragment).bit_length() - 1) if n >= fragment else 0


def _linked(docs: DataFrame, summaries: DataFrame, pairs: DataFrame, k: int, percent: int, fragment: int, most_broadcast: int) -> DataFrame:
    """Of pairs (a, b, a_n, b_n), those (a, b) that link, stored: overlaps are counted part by part and summed per pair."""
    cut = tx.stored(_fragments(docs, summaries, pairs, k, fragment, most_broadcast), "fragments")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a_n", pa.int32()), ("b_n", pa.int32()), ("nth", pa.int32()), ("shared", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        for batch in batches:
            shared = []
            for p, q, deep in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if deep:  # b has twice as many parts: its two halves of this part came apart, and each is held against all of a's
                    y = y[np.isin(y, x, assume_unique=True)]
                    shared.append(len(y))
                else:
                    shared.append(len(np.intersect1d(x, y, assume_unique=True)))
            yield tx.rows(schema, *(batch.column(c) for c in range(5)), shared)

    level = lambda c: F.floor(F.log2(F.greatest(F.col(c) / fragment, F.lit(1.0)))).cast("int")
    # a is the smaller set, so it has as many parts as b or half as many
    ordered = pairs.select(F.when(F.col("a_n") <= F.col("b_n"), F.struct("a", "b", "a_n", "b_n")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n"))).alias("p")).select("p.*").distinct()
    ordered = ordered.withColumn("deep", level("b_n") - level("a_n"))
    few = ordered.count() <= most_broadcast
    left = cut.select(F.col("set").alias("b"), "part", F.col("part").alias("nth"), F.col("shingles").alias("y")).join(F.broadcast(ordered) if few else ordered, "b")
    left = left.withColumn("part", F.shiftright("part", 1) * F.col("deep") + F.col("part") * (1 - F.col("deep")))
    met = left.join(cut.select(F.col("set").alias("a"), "part", F.col("shingles").alias("x")), ["a", "part"]).select("a", "b", "a_n", "b_n", "nth", "x", "y", "deep")
    parts = met.mapInArrow(run, "a long, b long, a_n int, b_n int, nth int, shared long")
    # equal rows of a text give equal parts: each counts once
    once = parts.groupBy("a", "b", "a_n", "b_n", "nth").agg(F.max("shared").alias("shared"))
    total = once.groupBy("a", "b", "a_n", "b_n").agg(F.sum("shared").alias("shared"))
    out = tx.stored(total.where(100 * F.col("shared") >= percent * (F.col("a_n") + F.col("b_n") - F.col("shared"))).select("a", "b"), "links")
    tx.discard(cut)
    return out


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, cells: int = 1 << 20, tries: int = 2, rounds: int = 3, fragment: int = 4096, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, row_key (the same for rows with the same doc_id and text), n_shingles, set (class of equal sets), root (the same for sets that
    links join; null without shingles) and component_id (the smallest doc_id reachable by links) of every row. Where texts share a doc_id,
    several roots can have one component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B|. cells: size of the count sketch (4 bytes each, sent to every task).
    tries, rounds: how many classes a class is held against in each round before the last, exact step; they change the work, not the result.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50")
    tx.small_batches(docs.sparkSession)
    told = tx.stored(_summaries(docs, k, cells), "shingles")
    sketch = _sketch(told.where(F.col("chunk").isNotNull()).select("chunk", "counts"), cells)
    summaries = told.where(F.col("n").isNotNull()).select("doc_id", "row_key", "n", "set")
    members = tx.stored(_shared(_postings(docs, k, percent, sketch)), "postings")
    sets = tx.stored(told.where(F.col("n").isNotNull()).select("set", "bits").join(members.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"]), "sets")
    links = label = None
    scratch = [told, members, sets]
    for turn in range(rounds):
        if turn == 0:
            near = members.where("set <> first").select(F.col("set").alias("a"), F.col("first").alias("b"), F.col("n").alias("a_n"), F.col("first_n").alias("b_n"), F.col("at").alias("a_at"), F.col("first_at").alias("b_at"))
        else:
            # every set against its next ones on each posting list, in an order drawn anew in every round
            now = members.select("shingle", "set", "n", "at").join(label, "set", "left").withColumn("root", F.coalesce("root", "set"))
            drawn = Window.partitionBy("shingle").orderBy(F.xxhash64("set", F.lit(turn)), "set")
            beside = F.array(*(F.lag(F.struct("set", "n", "at", "root"), j).over(drawn) for j in range(1, tries + 1)))
            met = now.withColumn("other", beside).select("set", "n", "at", "root", F.explode("other").alias("o")).where("o.root <> root")
            near = met.select(F.col("set").alias("a"), F.col("o.set").alias("b"), F.col("n").alias("a_n"), F.col("o.n").alias("b_n"), F.col("at").alias("a_at"), F.col("o.at").alias("b_at"))
        best = near.where(_can_link(percent)).groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("met"))
        best = _near_bits(best, sets, percent)
        # the `tries` partners with most shared postings; the rest is left to the last step
        best = best.groupBy("a", "a_n").agg(F.expr(f"slice(array_sort(collect_list(struct(-met as met, b, b_n))), 1, {int(tries)})").alias("bs")).select("a", "a_n", F.explode("bs").alias("x")).select("a", F.col("x.b").alias("b"), "a_n", F.col("x.b_n").alias("b_n"))
        best = tx.stored(best, "pairs")
        found = _linked(docs, summaries, best, k, percent, fragment, most_broadcast)
        links = found if links is None else links.union(found)
        scratch += [best, found]
        label = tx.stored(components(links).select(F.col("node").alias("set"), "root"), "labels")
        scratch.append(label)
    if label is None:  # no rounds
        label = members.select("set", F.col("set").alias("root")).limit(0)
    now = members.select("shingle", "set", "n", "at").join(label, "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = now.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    now = tx.stored(now.join(mixed, "shingle").join(sets, "set"), "mixed")
    side = lambda c: now.select("shingle", F.col("set").alias(c), F.col("n").alias(f"{c}_n"), F.col("at").alias(f"{c}_at"), F.col("root").alias(f"{c}_root"), F.col("bits").alias(f"{c}_bits"))
    left = side("a").join(side("b"), "shingle").where((F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & _can_link(percent) & _bits_fit(percent)).select("a", "b", "a_n", "b_n").distinct()
    left = tx.stored(left, "pairs")
    found = _linked(docs, summaries, left, k, percent, fragment, most_broadcast)
    scratch += [now, left, found]
    label = components(found if links is None else links.union(found)).select(F.col("node").alias("set"), "root")
    sized = summaries.join(label, "set", "left").withColumn("root", F.coalesce("root", "set"))
    full = sized.where("n > 0")
    least_id = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = full.join(least_id, "root").select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "set", "root", "component_id")
    alone = sized.where("n = 0").select("doc_id", "row_key", F.lit(0).cast("long").alias("n_shingles"), "set", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    result = tx.stored(out.union(alone), "near-duplicates")
    for table in scratch:
        tx.discard(table)
    return result


def op8_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tx.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
