"""Quality rules (operator 5): a decision list learned by sequential covering.

Counts of each text are made in Arrow batches; labelled counts (a bounded sample) teach an ordered list of threshold conjunctions;
the list is applied as an ordered Spark conditional expression.

Edge cases: a null or empty text has no words, all counts 0, base_failed true and kept false. Repeated rows give one row each. An empty
table gives no rows. Without usable labels the list is empty and base_failed alone decides. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import text as tx

SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = bytes(range(0x80, 0xC0)) + tx.WHITESPACE
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0x100))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_digits")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def count_text(b: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = b.split()
    n = len(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen = Counter(triples)
        again = np.fromiter((seen[t] > 1 for t in triples), bool, len(triples))
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= again
        repeated = int(inside.sum())
    size = len(b)
    return (
        n,
        len(b.translate(None, _NOT_CHARS)),
        size - len(b.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        size - len(b.translate(None, bytes(range(65, 91)))),
        b.count(b"!"),
        size - len(b.translate(None, b"0123456789")),
    )


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tx.release()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, len(ids), 500):
            part = [count_text(b) for b in texts.slice(lo, 500).to_pylist()]
            yield tx.rows(_SCHEMA, ids.slice(lo, 500), *zip(*part))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row."""
    tx.small_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text")).mapInArrow(_count_batches, schema)


def _counts() -> dict[str, Column]:
    return {c: F.col(c) for c in COUNTS}


def features(of: dict[str, Column] | None = None) -> dict[str, Column]:
    """What the rules test, from COUNTS."""
    of = of or _counts()
    words, chars, lines = (F.greatest(of[c], F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "words": of["n_words"].cast("double"),
        "word_length": of["word_chars"] / words,
        "symbols": of["n_symbols"] / chars,
        "dup_lines": of["n_dup_lines"] / lines,
        "repeats": of["n_repeat_words"] / words,
        "upper": of["n_upper"] / chars,
        "bangs": of["n_bang"] / words,
        "digits": of["n_digits"] / chars,
        "line_words": of["n_words"] / lines,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """All tests hold: the text is of low quality."""

    tests: tuple[Test, ...]
    precision: float
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.holds(x) for t in self.tests])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.tests))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> list[Test]:
    """Add the test with the best information gain until no good row is covered."""
    inside, tests = np.ones(len(bad), bool), []
    while len(tests) < most_tests and (good := int((inside & ~bad).sum())):
        p0 = int((inside & bad).sum())
        if not p0:
            break
        before, best = np.log2(p0 / (p0 + good)), (1e-9, None, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            cuts = cuts[np.unique(np.linspace(0, len(cuts) - 1, 200).astype(int))]
            p_low, n_low = np.cumsum(y)[cuts], cuts + 1
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, len(y) - n_low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - before), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    t = Test(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
                    best = (gain[k], t, t.holds(x))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[2]
    return tests


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.9, least: int = 5, most_rules: int = 24, most_tests: int = 4) -> list[Rule]:
    """Sequential covering. Each rule grows on two thirds of what is left, is pruned on the rest, and stays if its precision on all that is
    left reaches `precision` over at least `least` rows."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    fold = np.arange(len(bad)) % 3
    for turn in range(2 * most_rules):
        if len(rules) == most_rules or int((left & bad).sum()) < least:
            break
        grow, prune = left & (fold != turn % 3), left & (fold == turn % 3)
        tests = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_tests)
        worth = []
        for k in range(1, len(tests) + 1):
            inside = np.logical_and.reduce([t.holds(x) for t in tests[:k]]) & prune
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            worth.append((p - n) / (p + n) if p + n else -1.0)
        if not worth:
            continue
        tests = tests[: int(np.argmax(worth)) + 1]
        inside = np.logical_and.reduce([t.holds(x) for t in tests]) & left
        p, n = int((inside & bad).sum()), int(inside.sum())
        if n >= least and p / n >= precision:
            rules.append(Rule(tuple(tests), p / n, n))
            left &= ~inside
        elif turn >= len(rules) * 2 + 6:
            break
    return rules


def verdict(rules: list[Rule], of: dict[str, Column] | None = None) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    of, out = of or features(), None
    for k, rule in enumerate(rules, 1):
        test = rule.tests[0].column(of)
        for t in rule.tests[1:]:
            test &= t.column(of)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit_rules(docs: DataFrame, labels: DataFrame, *, most_labels: int = 20_000, **how) -> list[Rule]:
    """Learn from labels.quality. `most_labels` bounds the labelled rows that are used (about so many, chosen by a hash of doc_id)."""
    lab = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("bad"))
    total = lab.count()
    if not total:
        return []
    key = F.col("doc_id").cast("long")
    some = tx.sampled(lab, key, most_labels, total)
    of = features()
    known = text_counts(tx.sampled(docs, key, most_labels, total)).join(some, "doc_id").select("doc_id", (F.col("bad") == 0).alias("bad"), *(c.alias(n) for n, c in of.items()))
    got = known.toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return []
    return learn_rules({n: got[n].to_numpy(float) for n in of}, got["bad"].to_numpy(bool), **how)


def base_failed(of: dict[str, Column] | None = None) -> Column:
    of = of or _counts()
    return (of["n_words"] < 50) | (100 * of["n_repeat_words"] > 50 * of["n_words"])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """COUNTS, base_failed, the rule that holds (0: none) and kept, for every row."""
    out = text_counts(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that `judge` keeps, with their columns. The counts travel with the rows, so no join is needed."""
    tx.small_batches(docs.sparkSession)
    names = [f"__{c}" for c in COUNTS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                counts = zip(*(count_text(b) for b in part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in counts)], names=[*part.schema.names[:-1], *names])

    counted = docs.withColumn("__bytes", tx.as_bytes()).mapInArrow(run, schema)
    of = {c: F.col(f"__{c}") for c in COUNTS}
    return counted.where(~base_failed(of) & (verdict(rules, features(of)) == 0)).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tx.documents(spark, sf_dir)
    rules = fit_rules(docs, tx.table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
