import re
from collections import Counter

import numpy as np

from barloom.llm import quality


def slow(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(words, words[1:], words[2:]))
    again = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_counts(spark, odd_docs, no_docs):
    rows = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    got = quality.judge(odd_docs, []).collect()
    assert len(got) == odd_docs.count()
    assert {(r["doc_id"], *r[1:6]) for r in got} == {(k, *slow(t or "")) for k, t in rows}
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality.judge(no_docs, []).count() == 0
    for t in ("a b c a b c d", "x|y #1\nx|y #1\n\n\n x", "é b é b é b é b"):
        assert quality.count_text(t.encode())[:5] == slow(t)


def test_rules_are_learned_and_applied(spark):
    rng = np.random.default_rng(0)
    n = 900
    x = {"words": rng.uniform(0, 1000, n), "symbols": rng.uniform(0, 0.2, n), "upper": rng.uniform(0, 1, n)}
    bad = (x["symbols"] > 0.15) | ((x["upper"] > 0.8) & (x["words"] < 500))
    rules = quality.learn_rules(x, bad)
    said = np.logical_or.reduce([r.holds(x) for r in rules])
    assert (said == bad).mean() > 0.97 and all(r.precision >= 0.9 for r in rules)
    rows = spark.createDataFrame([tuple(map(float, v)) for v in zip(*x.values())], ", ".join(f"{c} double" for c in x))
    from pyspark.sql import functions as F

    got = rows.select(quality.verdict(rules, {c: F.col(c) for c in x}).alias("rule")).collect()
    first = np.zeros(n, int)
    for k, r in reversed(list(enumerate(rules, 1))):
        first[r.holds(x)] = k
    assert [r["rule"] for r in got] == first.tolist()
    assert quality.learn_rules(x, np.zeros(n, bool)) == []


def test_fit_without_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit_rules(odd_docs, labels) == []
