"""Toxic spans and documents (operator 1) by a linear-chain conditional random field.

Words of labelled documents get token labels: a word is toxic where it stands in a toxic document and its document frequencies (counted in
Spark over the labelled rows) tie it to toxic documents. A two-state CRF with features of the word and of its neighbours learns from them.
Forward-backward marginals give the toxic spans; their sums give the document score, calibrated on the same labelled rows.

Edge cases: null and empty texts have no words and get the score of a text without toxic words. Without labels of both kinds every score is
0. Repeated rows give one row each. Further columns of the input are ignored. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

_PART = 1 << 20
#: Lower-cases A-Z and makes a space of every other ASCII character that is no letter.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(b: bytes) -> list[bytes]:
    return b.translate(_FOLD).split()


@dataclass(frozen=True)
class ToxicModel:
    """Log-potentials of the state "toxic" against "clean" for a word and its neighbours, and of the transitions."""

    number: dict[bytes, int]  # word to row of `weights`; row 0 is any other word
    weights: np.ndarray  # (words + 1, 3): as the word itself, as the one before, as the one after
    bias: float
    moves: np.ndarray  # (2, 2) log-potentials
    doc: np.ndarray  # calibration: intercept, weight of log(1 + expected toxic words), weight of the largest marginal

    def emissions(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Log-odds of each word; start: offsets of the documents' words."""
        e = self.weights[ids, 0] + self.bias
        if len(ids) > 1:
            inner = np.ones(len(ids), bool)
            inner[start[:-1][start[:-1] < len(ids)]] = False
            e[1:] += np.where(inner[1:], self.weights[ids[:-1], 1], 0)
            e[:-1] += np.where(inner[1:], self.weights[ids[1:], 2], 0)
        return e

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.doc[0] + features @ self.doc[1:], -50, 50)))


def messages(e: np.ndarray, start: np.ndarray, moves: np.ndarray, width: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic : clean of the forward messages (with the word's own potential) and of the backward ones (without), over many documents at once.

    With r the ratio of the two forward messages, each word maps r to exp(e) * (m01 + r * m11) / (m00 + r * m10). The words stand in lines
    of `width`; the maps of each line are multiplied first, so that all lines can then be run side by side from their true start.
    """
    n = len(e)
    if not n:
        return np.zeros(0), np.zeros(0)
    first = np.zeros(n, bool)
    first[start[:-1][start[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    m = np.exp(moves)
    lines = -(-n // width)
    pad = lambda v, fill: np.concatenate([v, np.full(lines * width - n, fill)]).reshape(lines, width)
    w = np.exp(np.clip(e, -40, 40))

    def ratios(w: np.ndarray, first: np.ndarray, m: np.ndarray, emit_after: bool) -> np.ndarray:
        """r at each word. emit_after: r holds the word's own potential (forward); else it does not (backward)."""
        ww, ff = pad(w, 1.0), pad(first, False)
        a, b, c, d = (np.full(lines, x) for x in (1.0, 0.0, 0.0, 1.0))  # r -> (a r + b) / (c r + d) of the line so far
        runs = []
        for k in range(width):
            x, f = ww[:, k], ff[:, k]
            runs.append((np.where(f, 0.0, x * m[1, 1]), np.where(f, x, x * m[0, 1]), np.where(f, 0.0, m[1, 0]), np.where(f, 1.0, m[0, 0])))
            p, q, s, t = runs[-1]
            a, b, c, d = p * a + q * c, p * b + q * d, s * a + t * c, s * b + t * d
            size = np.maximum(np.maximum(np.abs(a), np.abs(b)), np.maximum(np.abs(c), np.abs(d)))
            a, b, c, d = a / size, b / size, c / size, d / size
        r = np.empty(lines)
        now = 1.0
        for k in range(lines):
            r[k] = now
            now = (a[k] * now + b[k]) / max(c[k] * now + d[k], 1e-300)
        out = np.empty((lines, width))
        for k, (p, q, s, t) in enumerate(runs):
            r = (p * r + q) / np.maximum(s * r + t, 1e-300)
            out[:, k] = r if emit_after else r / ww[:, k]
        return out.reshape(-1)[:n]

    return ratios(w, first, m, True), ratios(w[::-1], last[::-1], m.T, False)[::-1]


def marginals(e: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of each word."""
    forward, backward = messages(e, start, moves)
    odds = forward * backward
    return odds / (1 + odds)


def _sample_crf(model: ToxicModel, ids: list[np.ndarray], tags: list[np.ndarray], rounds: int, l2: float) -> ToxicModel:
    """Maximum likelihood by Adam; gradients are observed minus expected counts."""
    x, y = np.concatenate(ids), np.concatenate(tags).astype(float)
    start = np.concatenate([[0], np.cumsum([len(v) for v in ids])])
    inner = np.ones(len(x), bool)
    inner[start[:-1][start[:-1] < len(x)]] = False
    before, after = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    theta = [model.weights.copy(), np.array([model.bias]), model.moves.copy()]
    state = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    rows = len(model.weights)
    for step in range(1, rounds + 1):
        now = ToxicModel(model.number, theta[0], float(theta[1][0]), theta[2], model.doc)
        e = now.emissions(x, start)
        forward, backward = messages(e, start, theta[2])
        p = forward * backward / (1 + forward * backward)
        err = y - p
        g = np.stack([np.bincount(x, err, rows), np.bincount(x[before], err[after], rows), np.bincount(x[after], err[before], rows)], 1) - l2 * theta[0]
        y0, y1 = y[before], y[after]
        seen = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
        reach = np.exp(np.clip(e[after], -40, 40)) * backward[after]
        pair = np.exp(theta[2])[:, :, None] * np.stack([np.ones(len(before)), forward[before]])[:, None] * np.stack([np.ones(len(after)), reach])[None]
        told = (pair / pair.sum((0, 1))).sum(2)
        for k, grad in enumerate((g, np.array([err.sum()]), seen - told - 0.1 * theta[2])):
            m, v = state[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            theta[k] += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta[0][0] = 0
    return ToxicModel(model.number, theta[0], float(theta[1][0]), np.clip(theta[2], -6, 6), model.doc)


def _doc_features(p: np.ndarray, start: np.ndarray, floor: float = 0.3) -> np.ndarray:
    """log(1 + sum) and maximum of the marginals of each document; those below `floor` don't add up, however many words there are."""
    p = np.where(p >= floor, p, 0)
    n = len(start) - 1
    total, most = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(np.diff(start) > 0)
    if len(full):
        total[full] = np.add.reduceat(p, start[:-1][full])
        most[full] = np.maximum.reduceat(p, start[:-1][full])
    return np.stack([np.log1p(total), most], 1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most_labels: int = 20_000, most_texts: int = 2_000, most_words: int = 2_000, least_docs: int = 4, odds: float = 8.0, rounds: int = 60) -> ToxicModel:
    """Learn from labels.toxic. Bounds: about `most_labels` labelled rows give word frequencies, about `most_texts` of them the CRF, and
    `most_words` words have weights of their own. A word is a toxic token if it is in `least_docs` toxic documents at least and `odds`
    times as frequent there as in others."""
    key = F.col("doc_id").cast("long")
    lab = labels.where(F.col("toxic").isNotNull()).groupBy(key.alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    total = lab.count()
    none = ToxicModel({}, np.zeros((1, 3)), 0.0, np.zeros((2, 2)), np.array([-50.0, 0, 0]))
    if not total:
        return none
    some = tx.sampled(lab, key, most_labels, total)
    known = tx.sampled(docs.select(key.alias("doc_id"), tx.as_bytes().alias("text")), F.col("doc_id"), most_labels, total).join(F.broadcast(some), "doc_id")  # about most_labels rows of 12 bytes

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch, (word, toxic, documents with it); the key b"" counts the documents."""
        schema = pa.schema([("word", pa.binary()), ("toxic", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            seen: dict[tuple[bytes, int], int] = {}
            for b, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {b"", *words_of(b)}:
                    seen[w, y] = seen.get((w, y), 0) + 1
            yield tx.rows(schema, [k[0] for k in seen], [k[1] for k in seen], list(seen.values()))

    counts = tx.stored(known.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(distinct, "word binary, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n")), "words")
    sizes = counts.where(F.col("word") == F.lit(b"")).first()
    if not sizes or not 0 < sizes["bad"] < sizes["n"]:
        return none
    rate = ((F.col("bad") + 0.5) / sizes["bad"]) / ((F.col("n") - F.col("bad") + 0.5) / (sizes["n"] - sizes["bad"]))
    words = counts.where(F.col("word") != F.lit(b"")).withColumn("rate", rate)
    toxic = {r["word"] for r in words.where((F.col("bad") >= least_docs) & (F.col("rate") >= odds)).orderBy(F.desc("bad"), "word").limit(most_words // 4).collect()}
    common = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(most_words - len(toxic)).collect()]
    common = [w for k, w in enumerate(common) if k % 4 != 3 or w in toxic]  # the others teach how a word without weights behaves
    number = {bytes(w): k for k, w in enumerate(dict.fromkeys([*sorted(map(bytes, toxic)), *map(bytes, common)]), 1)}
    toxic = {number[bytes(w)] for w in toxic}
    # as many clean texts as toxic ones
    bad_share, good_share = (min(1.0, most_texts / 2 / max(1, n)) for n in (sizes["bad"], sizes["n"] - sizes["bad"]))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) / 1e6
    got = known.where(draw < F.when(F.col("toxic") == 1, bad_share).otherwise(good_share)).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            for k, b in enumerate(batch.column(2).to_pylist()):
                yield tx.rows(schema, batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), [np.array([number.get(w, 0) for w in words_of(b)], np.int32).tobytes()])

    rows = got.mapInArrow(numbered, "doc_id long, toxic int, ids binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    y = np.array(rows["toxic"].to_pylist())
    ids = [np.frombuffer(b, np.int32) for b in rows["ids"].to_pylist()]
    lexicon = np.zeros(len(number) + 1, bool)
    lexicon[list(toxic)] = True
    tags = [lexicon[v] & (t == 1) for v, t in zip(ids, y, strict=True)]
    model = _sample_crf(ToxicModel(number, np.zeros((len(number) + 1, 3)), 0.0, np.zeros((2, 2)), none.doc), ids, tags, rounds, 0.2)
    start = np.concatenate([[0], np.cumsum([len(v) for v in ids])])
    x = _doc_features(marginals(model.emissions(np.concatenate(ids), start), start, model.moves), start)
    prior = np.log(sizes["bad"] / (sizes["n"] - sizes["bad"])) - np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
    w = _calibrate(x, y.astype(float))
    return ToxicModel(number, model.weights, model.bias, model.moves, np.array([w[0] + prior, *w[1:]]))


def _spans(b: bytes, hot: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in code points of the runs of words whose numbers are in `hot`."""
    folded = np.frombuffer(b.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], folded.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80)])
    out: list[tuple[int, int]] = []
    for k, run in zip(hot, np.diff(hot, prepend=-9) == 1, strict=True):
        s, e = int(chars[begin[k]]), int(chars[end[k]])
        out.append((out.pop()[0], e) if run else (s, e))
    return out


def score_toxicity(docs: DataFrame, model: ToxicModel, *, least: float = 0.5) -> DataFrame:
    """doc_id, score, toxic_words (expected number) and spans ("start:end" of runs of words with a marginal of at least `least`) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic_words", pa.float64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = model.number.get
        for batch in batches:
            off = tx.blobs(batch.column(1))[1]
            for lo, hi in tx.slices(off, _PART):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                ids = [[get(w, 0) for w in words_of(b)] for b in texts]
                start = np.concatenate([[0], np.cumsum([len(v) for v in ids])]).astype(np.int64)
                flat = np.fromiter((k for v in ids for k in v), np.int32, int(start[-1]))
                p = marginals(model.emissions(flat, start), start, model.moves)
                x = _doc_features(p, start)
                spans = []
                for k, b in enumerate(texts):
                    hot = np.flatnonzero(p[start[k] : start[k + 1]] >= least) if x[k, 1] >= least else ()
                    spans.append(",".join(f"{s}:{e}" for s, e in _spans(b, hot)) if len(hot) else "")
                yield tx.rows(schema, batch.column(0).slice(lo, hi - lo), model.scores(x), np.expm1(x[:, 0]), spans)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text")).mapInArrow(run, "doc_id long, score double, toxic_words double, spans string")


def op1_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tx.documents(spark, sf_dir), tx.table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(tx.id_crc("doc_id") % 4 != 2))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (tx.id_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_words", "spans")
