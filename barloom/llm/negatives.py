"""Hard-negative mining over inverted lists (operator 11).

K-means centroids are fitted on a bounded sample; every row then goes to the list of its label and its nearest centroid, in chunks that keep
their radius, the largest distance of a row from the centroid. For an anchor a and a row x of a chunk with centroid c and radius r, the inequality of
Cauchy and Schwarz gives a.c - |a|r <= a.x <= a.c + |a|r. Anchors travel in blocks of up to `BLOCK` rows of one label, each with the windows of scores that
it searches. A search visits, in a first round, the `visits` clusters of highest upper bound for every anchor; the k-th best score found there
closes the windows from below. The second round visits every other cluster too whose bounds reach into a window, and leaves out those outside the
window or strictly below the k-th score. So the result is exact: ties with the k-th score are always visited.

Two searches follow each other: the positives (rows of the anchor's label, a window without ends), then for every different score of a positive the
negatives (rows of other labels between `low` times that score and the score itself).

Vectors are whole numbers held as doubles, so products are exact below 2**53; beyond it they are taken with Python's integers (and cut to 64 bits).

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; an empty vector does, with the score 0.
Vectors of different length are compared as if the shorter had zeros at its end. Ties go to the smaller vec_id. Repeated rows count as often as they stand,
as candidates and as anchors, but no row is a positive of an anchor with its own vec_id. An anchor without positives, or a positive without negatives in
its window, has no rows; as an upper end below 0 leaves no room, negative scores have no negatives. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import text as tx

#: Anchors in a block and rows in a chunk, about: rows are dealt by hash, and none is dropped.
BLOCK, CHUNK = 256, 1024
#: Bounds of the fit: rows of its sample, and clusters.
MOST_SAMPLE, MOST_CLUSTERS = 20_000, 1024
#: Bytes of anchors that are broadcast; more are shuffled to the chunks.
MOST_BROADCAST = 32 << 20
#: Lists whose counts are broadcast; more are joined by shuffle.
MOST_KEYS = 100_000
_END = (1 << 63) - 1
_EXACT = float(1 << 53)


def whole_numbers(vectors: DataFrame, vector: str = "embedding", *, scale: float = 256.0) -> DataFrame:
    """vec_id, label and vector (floor(scale * x) as doubles) of the rows that take part."""
    fits = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    got = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("vector")).where(fits)
    return got.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros up to `width` or to the longest row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(width, int(size.max(initial=0)))))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass(frozen=True)
class Lists:
    """An index: chunks (written to the shared folder) and their list without rows; centroids and the radius of each cluster."""

    chunks: DataFrame
    heads: DataFrame
    centroids: np.ndarray
    radius: np.ndarray


def fit_centroids(rows: DataFrame, total: int, *, most_sample: int = MOST_SAMPLE, clusters: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids in whole numbers, of at most `most_sample` rows chosen by a hash of their ids. There are sqrt(rows) / 8 of them, up to MOST_CLUSTERS."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = tx.sampled(rows, F.col("vec_id"), most_sample, total).select("vector")
    width = some.agg(F.max(F.size("vector"))).first()[0] or 0
    if not width:
        return np.zeros((1, 0))
    some = tx.stored(some.select(F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))).alias("vector")), "sample")
    k = clusters or min(MOST_CLUSTERS, max(1, round(total**0.5 / 8)))
    found = KMeans(k=max(2, k), maxIter=8, seed=seed, initMode="random", featuresCol="features").fit(some.select(array_to_vector("vector").alias("features")))
    out = np.unique(np.rint(np.stack(found.clusterCenters())), axis=0)
    tx.discard(some)
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """label, vec_id, vector (doubles as bytes), cluster (the nearest centroid) and distance of every row."""
    kind = rows.schema["label"].dataType
    norms = (centroids**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), centroids.shape[1])
            size = np.diff(batch.column(2).offsets.to_numpy())
            head = x[:, : centroids.shape[1]]
            near = np.argmin(norms - 2 * (head @ centroids.T), axis=1)
            far = np.sqrt(((head - centroids[near]) ** 2).sum(1) + (x[:, centroids.shape[1] :] ** 2).sum(1))
            vectors = pa.array([v[:n].tobytes() for v, n in zip(x, size, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, pa.array(near, pa.int32()), pa.array(far)], ["label", "vec_id", "vector", "cluster", "distance"])

    return rows.select("label", "vec_id", "vector").mapInArrow(run, f"label {kind.simpleString()}, vec_id long, vector binary, cluster int, distance double")


def _packed(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """key, part, n, size (bytes of a vector), ids, vectors and radius: rows of one key and one vector length in parts of about `most` rows. Parts are dealt by hash, so
    a key that holds a third of all rows is spread like the others."""
    rows = rows.withColumn("size", F.length("vector"))
    key = [*key, "size"]
    count = tx.stored(rows.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "parts")
    count = F.broadcast(count) if count.count() <= MOST_KEYS else count
    dealt = rows.join(count, key).withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "parts").cast("int"))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in key]
    names = [*key, "part", "n", "ids", "vectors", "radius"]

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id").combine_chunks()
        first = [group.column(c).combine_chunks().slice(0, 1) for c in [*key, "part"]]
        ids = group.column("vec_id").to_numpy().astype("<i8").tobytes()
        made = [pa.array([group.num_rows]), pa.array([ids], pa.binary()), pa.array([b"".join(group.column("vector").to_pylist())], pa.binary()), pa.array([max(group.column("distance").to_pylist())])]
        return pa.table([*first, *made], names)

    return dealt.groupBy(*key, "part").applyInArrow(pack, ", ".join([*kinds, "part int", "n long", "ids binary", "vectors binary", "radius double"]))


def build_lists(rows: DataFrame, centroids: np.ndarray, *, chunk: int = CHUNK) -> Lists:
    """Inverted lists of whole_numbers()' rows by label and nearest centroid, in chunks with their radii."""
    chunks = tx.stored(_packed(assigned(rows, centroids), ["label", "cluster"], chunk), "lists")
    heads = chunks.select("label", "cluster", "size", "part")
    radius = np.zeros(len(centroids))
    for cluster, far in chunks.groupBy("cluster").agg(F.max("radius")).collect():
        radius[cluster] = far
    return Lists(chunks, heads, centroids, radius)


def _unpacked(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, "<i8")
    return numbers, np.frombuffer(vectors, np.float64).reshape(len(numbers), -1)


def _bounds(a: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of every anchor with the rows of every cluster, with room for rounding."""
    m = min(a.shape[1], centroids.shape[1])
    centre, reach = a[:, :m] @ centroids[:, :m].T, np.sqrt((a**2).sum(1))[:, None] * radius
    room = 1 + 1e-9 * (np.abs(centre) + reach)
    return centre - reach - room, centre + reach + room


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; the longer vectors' ends meet zeros."""
    m = min(a.shape[1], x.shape[1])
    a, x = a[:, :m], x[:, :m]
    if m * np.abs(a).max(initial=0) * np.abs(x).max(initial=0) < _EXACT:
        return (a @ x.T).astype(np.int64)
    big = [[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in x] for u in a]
    return np.array([[min(max(s, -_END), _END) for s in line] for line in big], np.int64).reshape(len(a), len(x))


def best_in_windows(scores: np.ndarray, ids: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, column) of the k best columns of every window: scores[which] within low and high, ties by smaller id, none with the id `own`."""
    inside = scores[which]
    inside = (inside >= low[:, None]) & (inside <= high[:, None]) & (ids != own[which][:, None])
    w, c = np.nonzero(inside)
    order = np.lexsort((ids[c], -scores[which[w], c], w))
    w, c = w[order], c[order]
    first = np.searchsorted(w, w)
    keep = np.arange(len(w)) - first < k
    return w[keep], c[keep]


def _items(blocks: DataFrame, lists: Lists, visits: int | None) -> DataFrame:
    """(block, cluster) to visit: for every anchor the clusters whose bounds reach into one of its windows, or of these the `visits` of highest bound."""
    centroids, radius = lists.centroids, lists.radius
    schema = pa.schema([("block", pa.int64()), ("cluster", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, vectors, which, low, high in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                _, a = _unpacked(ids, vectors)
                least, most = _bounds(a, centroids, radius)
                which, low, high = np.array(which), np.array(low, np.float64)[:, None], np.array(high, np.float64)[:, None]
                wanted = ~(most[which] < low) & ~(least[which] > high)
                if visits is not None:
                    by_bound = np.where(wanted, most[which], -np.inf)
                    kth = np.sort(by_bound, axis=1)[:, -min(visits, by_bound.shape[1])][:, None]
                    wanted &= by_bound >= kth
                clusters = np.flatnonzero(wanted.any(axis=0))
                yield tx.rows(schema, np.full(len(clusters), block), clusters.astype(np.int32))

    return blocks.select("block", "ids", "vectors", "which", "low", "high").mapInArrow(run, "block long, cluster int")


def _round(anchors: DataFrame, windows: DataFrame, lists: Lists, same: bool, k: int, visits: int | None, sent: bool) -> DataFrame:
    """slot, anchor_id, high, score and other_id of the k best rows of every window (slot, low, high) that one round finds."""
    centroids = lists.centroids
    grouped = windows.groupBy(F.expr(f"slot div {BLOCK * 64}").alias("block")).agg(F.collect_list(F.struct(F.expr(f"slot % {BLOCK * 64}").cast("int").alias("which"), "low", "high")).alias("w"))
    blocks = tx.stored(anchors.join(grouped.select("block", F.col("w.which").alias("which"), F.col("w.low").alias("low"), F.col("w.high").alias("high")), "block"), "blocks")
    of_label = F.col("b.label") == F.col("h.label") if same else F.col("b.label") != F.col("h.label")
    told = _items(blocks, lists, visits).join(blocks.select("block", "label"), "block")
    todo = told.alias("b").join(lists.heads.alias("h"), (F.col("b.cluster") == F.col("h.cluster")) & of_label).select("block", "h.label", "h.cluster", "h.size", "h.part")
    parts = ["label", "cluster", "size", "part"]
    mine = blocks.select("block", F.col("ids").alias("a_ids"), F.col("vectors").alias("a_vectors"), "which", "low", "high")
    if sent:
        both = todo.join(lists.chunks, parts).join(F.broadcast(mine), "block")
    else:
        both = todo.join(mine, "block").join(lists.chunks, parts)
    schema = pa.schema([("slot", pa.int64()), ("anchor_id", pa.int64()), ("high", pa.int64()), ("score", pa.int64()), ("other_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block, a_ids, a_vectors, which, low, high, cluster, radius, ids, vectors = (batch.column(c)[n].as_py() for c in range(10))
                own, a = _unpacked(a_ids, a_vectors)
                which, low, high = np.array(which), np.array(low), np.array(high)
                least, most = (b[:, 0] for b in _bounds(a, centroids[cluster : cluster + 1], np.array([radius])))
                open_ = ~(most[which] < low) & ~(least[which] > high)
                if not open_.any():
                    continue
                which, low, high = which[open_], low[open_], high[open_]
                used, place = np.unique(which, return_inverse=True)
                others, x = _unpacked(ids, vectors)
                scores = products(a[used], x)
                w, c = best_in_windows(scores, others, place, low, high, k, own[used])
                if len(w):
                    yield tx.rows(schema, block * BLOCK * 64 + which[w], own[which[w]], high[w], scores[place[w], c], others[c])

    found = both.select("block", "a_ids", "a_vectors", "which", "low", "high", "cluster", "radius", "ids", "vectors").mapInArrow(run, "slot long, anchor_id long, high long, score long, other_id long")
    best = Window.partitionBy("slot", "high").orderBy(F.desc("score"), "other_id")
    return tx.stored(found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}"), "found")


def search(anchors: DataFrame, windows: DataFrame, lists: Lists, *, same: bool, k: int, visits: int = 2, sent: bool = True) -> DataFrame:
    """slot, anchor_id, high, score, other_id and rank of the k best rows, of the anchor's label (same) or of the others, in every window (slot, low, high).
    sent: blocks of anchors are broadcast; otherwise they are shuffled to the chunks."""
    early = _round(anchors, windows, lists, same, k, visits, sent)
    kth = early.where(f"rank = {k}").select("slot", "high", F.col("score").alias("kth"))
    closed = windows.join(kth, ["slot", "high"], "left").select("slot", F.greatest("low", F.coalesce("kth", "low")).alias("low"), "high")
    return _round(anchors, closed, lists, same, k, None, sent)


def anchor_blocks(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """block, label, ids and vectors: anchors of one label in blocks; an anchor's slot is its block's number and its place there."""
    made = _packed(assigned(rows, centroids), ["label"], BLOCK)
    return tx.stored(made.select(F.monotonically_increasing_id().alias("block"), "label", "n", "ids", "vectors"), "anchors")


def open_windows(blocks: DataFrame) -> DataFrame:
    """slot, low and high of every anchor, without ends."""
    return blocks.select("block", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("at")).select((F.col("block") * (BLOCK * 64) + F.col("at")).alias("slot"), F.lit(-_END).alias("low"), F.lit(_END).alias("high"))


def hard_negatives(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5), visits: int = 2, clusters: int | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor its first `positives` rows of the same label, and for each of these the
    first `negatives` rows of other labels with a score between low[0] / low[1] of the positive's and the positive's. `vectors` has vec_id, label and vector, in
    whole numbers."""
    total, count, size = vectors.agg(F.count("*"), F.count_if(anchor), F.coalesce(F.sum(F.when(anchor, 8 * F.size("vector") + 8)), F.lit(0))).first()
    nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return vectors.sparkSession.createDataFrame([], nothing)
    centroids = fit_centroids(vectors, total, clusters=clusters)
    lists = build_lists(vectors, centroids)
    blocks = anchor_blocks(vectors.where(anchor), centroids)
    sent = size + 24 * positives * count <= most_broadcast
    liked = search(blocks, open_windows(blocks), lists, same=True, k=positives, visits=visits, sent=sent).select("slot", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    least = f"positive_score - (positive_score div {low[1]}) * {low[1] - low[0]} - ((positive_score % {low[1]}) * {low[1] - low[0]}) div {low[1]}"
    windows = liked.where("positive_score >= 0").select("slot", F.expr(least).alias("low"), F.col("positive_score").alias("high")).distinct()
    other = search(blocks, windows, lists, same=False, k=negatives, visits=visits, sent=sent)
    other = other.select("slot", F.col("high").alias("positive_score"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    return liked.join(other, ["slot", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(tx.table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM whole a JOIN whole x ON a.vec_id <> x.vec_id
  WHERE a.vec_id % 100 = 0
), liked AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM liked JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5
"""
