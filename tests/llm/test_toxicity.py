import numpy as np
import pytest

from barloom.llm import toxicity


def chain(e, start, moves):
    """Marginals one word at a time."""
    out, m = np.zeros(len(e)), np.exp(moves)
    for a, b in zip(start[:-1], start[1:], strict=True):
        if a == b:
            continue
        w = np.stack([np.ones(b - a), np.exp(e[a:b])], 1)
        f, g = w.copy(), np.ones_like(w)
        for t in range(1, b - a):
            f[t] = f[t - 1] @ m * w[t]
            f[t] /= f[t].sum()
        for t in range(b - a - 2, -1, -1):
            g[t] = m @ (g[t + 1] * w[t + 1])
            g[t] /= g[t].sum()
        h = f * g
        out[a:b] = h[:, 1] / h.sum(1)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_marginals(seed):
    rng = np.random.default_rng(seed)
    e, start = rng.normal(size=700) * 3, np.array([0, 3, 3, 150, 699, 700])
    moves = rng.normal(size=(2, 2)) * 2
    assert np.allclose(toxicity.marginals(e, start, moves), chain(e, start, moves), atol=1e-9)


@pytest.fixture
def learned(spark):
    rng = np.random.default_rng(3)
    words, rude, rows = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)], ["idjot", "scvm"], []
    for k in range(300):
        w = list(rng.choice(words, rng.integers(5, 40)))
        if k % 3 == 0:
            for _ in range(3):
                w.insert(rng.integers(0, len(w)), str(rng.choice(rude)))
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    return docs, labels, toxicity.fit_toxicity(docs.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 <> 1"))


def test_held_out_and_spans(learned):
    docs, _, model = learned
    for r in toxicity.score_toxicity(docs.where("doc_id % 4 = 1"), model).join(docs, "doc_id").collect():
        assert (r["score"] >= 0.3) == (r["doc_id"] % 3 == 0)
        found = [r["text"][int(s) : int(e)] for s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert " ".join(found).split() == [w for w in r["text"].split() if w in ("idjot", "scvm")]


def test_odd_texts(learned, odd_docs, no_docs):
    _, labels, model = learned
    got = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] < 0.3 for r in got)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    flat = toxicity.fit_toxicity(odd_docs, labels.where("toxic = 0"))
    assert {r["score"] < 1e-9 for r in toxicity.score_toxicity(odd_docs, flat).collect()} == {True}
