import hashlib
import random
import re

import pytest

from barloom.llm import decontam


def brute(rows, items, percent=5):
    lower = str.maketrans(decontam.UPPER, decontam.LOWER)
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for item, t in items:
        w = of(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for k, t in rows:
        w, hit, names = of(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    names |= found
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 100 * len(hit) >= percent * len(w)))
    return sorted(out)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize(("seed", "short"), [(1, False), (2, True)])
def test_equals_brute_force(spark, seed, short):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Aa", "b", "cé", "d1", "e", "ff", "g"])
    items = [(k % 9, [word() for _ in range(rng.choice([13, 14, 20, 40] + [1, 4, 12] * short))]) for k in range(12)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(rng.choice([0, 5, 13, 30, 120]))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1]
            at, lo = rng.randrange(len(w) + 1), rng.randrange(len(item))
            w[at:at] = item[lo : lo + rng.choice([5, 12, 13, 14, 40])]
        rows.append((k // 2 * 2, rng.choice([" ", "-", ", "]).join(w) + rng.choice(["", "."])))
    items = [(k, " ".join(w)) for k, w in items] + [(77, None), (78, " .")]
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == brute(rows, items)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "same row"), (2, "short text"), (3, None), (4, "x " * 40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(odd_docs, benchmark).select(COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, items)
    assert sorted(tuple(r) for r in decontam.contamination(odd_docs, benchmark.limit(0), most_broadcast=0).select(COLUMNS).collect()) == brute(rows, [])
    assert decontam.contamination(no_docs, benchmark).count() == 0


def test_matches_are_longest_runs(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, "d " + " ".join(item.split()[5:20]))], "doc_id long, text string")
    _, hits = decontam.occurrences(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    keyed = docs.select("doc_id", decontam.text_key().alias("text_key"))
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["stop"]) for r in decontam.matches(hits).join(keyed, "text_key").collect()) == [(1, 9, 2, 32), (2, 9, 1, 16)]


def test_rows_without_an_id_and_repeated_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, item), (None, item), (None, None), (7, item), (7, "clean"), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame([(1, item), (2, "w3 w4")], "item_id long, text string")).drop("text_key").collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"], r["contaminated"]) for r in got) == [(0, 0, 0, False), (0, 20, 2, True), (0, 20, 2, True), (7, 0, 0, False), (7, 20, 2, True), (7, 20, 2, True)]
