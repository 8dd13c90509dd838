import random

import pytest

from barloom.llm import jaccard
from barloom.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    passage, rows = [word() for _ in range(30)], []
    bases = [[word() for _ in range(rng.choice([3, 6, 20, 60, 200]))] for _ in range(12)]
    for _ in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w[rng.randrange(len(w)) : 0] = passage
        rows.append((len(rows) * 3, (" " if rng.random() < 0.9 else "\n").join(w)))
    return rows


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"cells": 4, "fragment": 8, "tries": 1, "rounds": 1}), (3, {"cells": 1 << 12, "fragment": 3, "most_broadcast": 0})])
def test_equals_brute_force(spark, seed, how):
    rows = corpus(random.Random(seed))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **how)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = jaccard.near_duplicates(odd_docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_components_of_a_path(spark):
    n = 70
    got = components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 300), (200, 300), (5, 5)], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {i: 0 for i in range(n + 1)} | {200: 200, 300: 200}
