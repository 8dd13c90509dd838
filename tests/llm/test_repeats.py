import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barloom.llm import repeats


def brute(rows, span, least):
    """rows in the order of the corpus; equal rows are first or later together."""
    seen = Counter(t[i : i + span] for _, t in rows for i in range(len(t) - span + 1))
    first, starts = {}, {}
    for n, (k, t) in enumerate(rows):
        for i in range(len(t) - span + 1):
            first.setdefault(t[i : i + span], (k, t, i))
    for k, t in rows:
        for i in range(len(t) - least + 1):
            starts.setdefault(t[i : i + least], []).append((k, t, i))
    out = []
    for k, t in rows:
        gone, late = np.zeros(len(t) + 1, bool), np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            gone[i : i + span] |= seen[t[i : i + span]] > 1
            late[i : i + span] |= first[t[i : i + span]] != (k, t, i)
        longest = factor = 0
        for i in range(len(t) - least + 1):
            own = 0
            for j, u, e in starts[t[i : i + least]]:
                if (j, u, e) == (k, t, i) and not own:
                    own = 1  # itself, once
                    continue
                n = next((x for x in range(least, span) if x >= len(t) - i or x >= len(u) - e or t[i + x] != u[e + x]), span)
                longest = max(longest, n)
                if (j, u, e) != (k, t, i) and rows.index((j, u)) * 10**6 + e < rows.index((k, t)) * 10**6 + i:
                    factor = max(factor, n)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((k, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(late.sum()), longest, factor))
    return sorted(out)


def in_order(spark, rows):
    """Rows sorted as the operator does, by doc_id and a hash of the row."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r[0], bytes(r[2])) for r in sorted(repeats._keyed(df).collect())]


def corpus(rng):
    fresh = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, rows = [fresh(n) for n in (140, 200, 700, 900)], []
    for k in range(40):
        t = fresh(rng.choice([0, 10, 150, 600]))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            lo = rng.randrange(len(s) // 3)
            s = s[lo : lo + rng.randrange(len(s))]
            if s and rng.random() < 0.4:
                i = rng.randrange(len(s))
                s = s[:i] + "#" + s[i + 1 :]
            t += s + fresh(rng.choice([0, 1, 50]))
        rows.append((rng.randrange(30), t))
    return rows + [(50, "ab" * 300), (51, "ab" * 100), (52, "z" * 700), (53, rows[7][1]), (54, rows[7][1]), (54, rows[7][1])]


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"most_bytes": 300}), (3, {"most_broadcast": 0, "most_bytes": 2000})])
def test_equals_brute_force(spark, seed, how):
    rows = corpus(random.Random(seed))
    found = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), span=150, least=130, **how)
    got = found.mapInArrow(repeats.cut, repeats.CUT).collect()
    assert sorted(tuple(r) for r in got) == brute(in_order(spark, rows), 150, 130)


def test_dealt_groups(spark):
    """An anchor with more kinds than a task takes: removals are the same, factors below span may count as least."""
    rows = corpus(random.Random(5))
    found = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), span=150, least=130, most_kinds=2)
    got = sorted(tuple(r) for r in found.mapInArrow(repeats.cut, repeats.CUT).collect())
    want = brute(in_order(spark, rows), 150, 130)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g[6:], w[6:], strict=True):
            assert x == y or 130 <= x < y < 150


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    got = repeats.repeated_spans(odd_docs).mapInArrow(repeats.cut, repeats.CUT).collect()
    assert sorted(tuple(r)[:5] for r in got) == [b[:5] for b in brute(rows, 400, 399)]
    assert repeats.repeated_spans(no_docs).count() == 0


def test_long_text(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(300_000))
    rows = [(1, long), (2, "x" * 1_000_000), (3, "begin " + long[500_000:500_500] + " end")]
    got = {r[0]: r for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).mapInArrow(repeats.cut, repeats.CUT).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"], got[1]["n_later"]) == (500, 1, 0)
    assert (got[2]["n_removed"], got[2]["n_later"]) == (1_000_000, 1_000_000 - 1)
    assert (got[3]["n_removed"], got[3]["n_later"]) == (500, 500)


def test_longest_previous_factors():
    rng = random.Random(4)
    for text in (b"", b"a", b"aaaa", b"abab", b"a\0\0a\0", bytes(rng.choice(b"ab") for _ in range(60))):
        length, source = repeats.longest_previous_factors(text)
        for i in range(len(text)):
            want = max((k for j in range(i) for k in range(len(text) - i + 1) if text[i : i + k] == text[j : j + k]), default=0)
            assert length[i] == want and (want == 0 or text[source[i] : source[i] + want] == text[i : i + want])
            assert want == 0 or source[i] < i
