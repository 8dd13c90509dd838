"""Language identification (operator 9) by error-correcting output codes.

Every language gets a codeword; one logistic classifier on hashed byte n-grams (1 to 3 bytes, letters only, lower case) predicts each bit.
The codeword with the least loss over the bits, each weighted by how well its classifier does on training rows, is the prediction; a small
gap to the next codeword flags the text as ambiguous.

Edge cases: null, empty and letterless texts give `und` with score 0. With one learned language every text with letters gets it; with none,
all texts get `und`. Of languages with equal losses the first by name is predicted. Repeated rows give one row each, and very long texts are rows like others. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

BINS = 4096
_PART = 1 << 20

# ASCII letters in lower case, bytes of other characters as they are, all else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(flat: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Bins of the 1-, 2- and 3-grams that end at each byte. A space stands before each row, and runs of spaces count as they are."""
    a = _FOLD[flat].astype(np.uint32)
    b = np.empty_like(a)
    b[1:] = a[:-1]
    b[off[:-1][off[:-1] < len(a)]] = 32
    c = np.empty_like(b)
    c[1:] = b[:-1]
    c[off[:-1][off[:-1] < len(a)]] = 32
    shift = np.uint32(32 - 12)
    two = ((a + b * np.uint32(263)) * np.uint32(2654435761)) >> shift
    three = ((a + b * np.uint32(263) + c * np.uint32(70657)) * np.uint32(2246822519)) >> shift
    return [a, two.astype(np.intp), three.astype(np.intp)]


def codewords(n: int, most: int = 15, seed: int = 9) -> np.ndarray:
    """(n, bits) of 0 and 1: all splits of the classes if there are at most `most`, else random ones with far codewords."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if 2 ** (n - 1) - 1 <= most:
        m = np.arange(1, 2 ** (n - 1))
        return np.array([np.ones(len(m), np.int64) if k == 0 else 1 - (m >> (k - 1) & 1) for k in range(n)]).astype(np.int8)
    rng = np.random.default_rng(seed)
    bits = max(most, 4 * int(np.ceil(np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        code[rng.integers(0, n, bits), np.arange(bits)] ^= 1
        gaps = (code[:, None] != code[None]).sum(2) + bits * np.eye(n, dtype=int)
        if gaps.min() > far and (code.any(0) & ~code.all(0)).all():
            best, far = code, int(gaps.min())
    return best if best is not None else rng.integers(0, 2, (n, bits), dtype=np.int8)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    code: np.ndarray  # (languages, bits), 0 or 1
    weights: np.ndarray  # (3, BINS, bits)
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    sharp: float  # losses to scores

    def margins(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = 0
        for w, g in zip(self.weights, grams(flat, off), strict=True):
            total = total + tx.per_row(w[g], off)
        return total / np.maximum(np.diff(off), 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) by the least weighted logistic loss."""
        sign = 2.0 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -margins * s) * self.trust).sum(1) for s in sign], 1)
        p = np.exp(-self.sharp * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = p[np.arange(len(p)), best]
        return best, score, score < 0.75


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("bins", pa.binary())])
    for batch in batches:
        flat, off = tx.blobs(batch.column(2))
        for lo, hi in tx.slices(off, _PART):
            part, o = flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            g = grams(part, o)
            out = []
            for k in range(hi - lo):
                x = np.concatenate([np.bincount(v[o[k] : o[k + 1]], minlength=BINS) for v in g]).astype(np.float32) / max(1, o[k + 1] - o[k])
                out.append(x.astype(np.float16).tobytes())
            yield tx.rows(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), out)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of one logistic regression for each column of y, by Adam on all rows."""
    scale = 1 / np.maximum(np.sqrt((x**2).mean(0)), 1e-3)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    x = x * scale / 30
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = ((p - y) / len(x)).astype(np.float32)
        for k, (value, grad) in enumerate(((w, x.T @ err + l2 * w), (b, err.sum(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w * (scale / 30)[:, None], b


def fit_languages(docs: DataFrame, *, most_rows: int = 3_000) -> LanguageModel:
    """Learn from docs(doc_id, text, lang). `most_rows` bounds the rows that the classifiers are fitted on (about so many, spread evenly
    over the languages by a hash of doc_id)."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if len(langs) < 2:
        code = codewords(len(langs))
        return LanguageModel(langs, code, np.zeros((3, BINS, code.shape[1] if langs else 1), np.float32), np.zeros(1), np.ones(1), 1.0)
    each = most_rows // len(langs)
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, int(min(1, each / sizes[k]) * 1_000_000))])
    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < share[F.col("lang")])
    got = some.select("lang", F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text")).mapInArrow(_count_batches, "lang string, doc_id long, bins binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.stack([np.frombuffer(b, np.float16) for b in got["bins"].to_pylist()]).astype(np.float32)
    number = {k: n for n, k in enumerate(langs)}
    y = np.array([number[k] for k in got["lang"].to_pylist()])
    code = codewords(len(langs))
    goal = code[y].astype(np.float32)
    w, b = _logistic(x, goal)
    right = (((x @ w + b) > 0) == (goal > 0)).mean(0)
    trust = np.log(np.maximum(right, 0.501) / np.maximum(1 - right, 1e-3))
    trust = np.maximum(trust, 0.05) / np.maximum(trust, 0.05).sum()
    return LanguageModel(langs, code, np.ascontiguousarray(w.reshape(3, BINS, -1).astype(np.float32)), b, trust, 4.0)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    names = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = tx.blobs(batch.column(2))
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in tx.slices(off, _PART):
                known = letters[lo:hi] & bool(model.langs)
                if len(model.langs) > 1:
                    best, score, unsure = model.decode(model.margins(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                else:
                    best, score, unsure = np.zeros(hi - lo, int), np.ones(hi - lo), np.zeros(hi - lo, bool)
                yield tx.rows(schema, batch.column(0).slice(lo, hi - lo), list(names[np.where(known, best, len(model.langs))]), np.where(known, score, 0.0), np.where(known, unsure, True))

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), has_letter.alias("letter"), tx.as_bytes().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tx.documents(spark, sf_dir)
    model = fit_languages(docs.where(tx.id_crc("doc_id") % 5 != 0))
    return predict_languages(docs, model).select("doc_id", (tx.id_crc("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
