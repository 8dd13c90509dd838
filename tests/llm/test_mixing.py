import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import mixing

CODE = mixing.Code.of(np.bincount(np.frombuffer(b"some words of a text, and the end", np.uint8), minlength=256))


def test_code_is_prefix_free_and_complete():
    paths = {tuple(zip(CODE.nodes[s : s + n].tolist(), CODE.bits[s : s + n].tolist())) for s, n in zip(CODE.start, CODE.length)}
    assert len(paths) == 256 and math.isclose(sum(2.0**-n for n in CODE.length), 1)


NO_KINDS = mixing.Kinds({}, np.zeros((1, 1), np.float32))
cut = mixing.Tokenizer(NO_KINDS)


def test_tokens():
    rng = random.Random(1)
    assert cut(b"") == [b"\0\xf8\xff"] and cut(b"One. two\nx  y") == [b"\0\xf8One. ", b"\0\xfatwo\n", b"\0\xf9x ", b"\0\xfb ", b"\0\xfby\xff"]
    for _ in range(300):
        text = "".join(rng.choice(" \n.abé") * rng.choice([1, 1, 1, 50]) for _ in range(rng.randrange(12))).encode()
        got = cut(text)
        assert b"".join(t[2:] for t in got) == text + b"\xff" and all(3 <= len(t) <= 51 for t in got)
        # where a token ends depends only on what stands before
        for t in got:
            assert t[2:-1].strip() == t[2:-1] and (t[-1:].isspace() or t[-1] == 255 or len(t) == 50)


def test_kinds_of_texts():
    words = [b"the", b"of", b"and", b"der", b"die", b"und"]
    together = np.full((6, 6), 2.0)
    together[:3, :3] = together[3:, 3:] = 90
    together[np.diag_indices(6)] = 100
    kinds = mixing.Kinds.of(words, together, 2)
    got = mixing.Tokenizer(kinds)(b"The rest of xyz. Und der die und q of der")
    told = [t[0] for t in got]
    # what comes before a token tells its kind
    assert told[0] == 0 and len(set(told[1:6])) == 1 and told[6] in (1, 2) and told[8] == told[9] == told[10] != told[1]
    assert b"".join(t[2:] for t in got) == b"The rest of xyz. Und der die und q of der\xff"
    assert mixing.Kinds.of(words[:1], together[:1, :1], 2).words == {}


def model(seed, sizes=mixing.CELLS):
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    return mixing.MixModel(CODE, rng.integers(15 << 10, 17 << 10, n).astype(np.uint16) * np.uint16(2) + rng.integers(0, 8, n).astype(np.uint16), rng.normal(size=(64, 5)).astype(np.float32) / 3, sizes)


def test_probabilities_of_a_next_symbol_add_up():
    m, total = model(1), 0.0
    for b in range(256):  # 255 is the end
        first, bit, x, gate = m.inputs([b"\1\xfbab" + bytes([b])])
        z = m.mixed(x, gate)
        total += math.exp(-np.log1p(np.exp(np.where(bit, -z, z)))[-int(CODE.length[b]) :].astype(float).sum())
    assert math.isclose(total, 1, rel_tol=1e-4)


TEXTS = [b"", b"a b", b"xyz " * 200, b"", b"hello world " * 40, b"q", b"z" * 500]


def test_texts_do_not_touch_each_other():
    texts = [cut(t) for t in TEXTS]
    both = mixing.Scorer(model(2)).score(texts)
    alone = [mixing.Scorer(model(2)).score([t])[0] for t in texts]
    few = mixing.Scorer(model(2), most=3)  # what is kept is thrown away again and again
    assert np.allclose(both, alone) and np.allclose(both, [few.score([t])[0] for t in texts + texts[:0]])


def test_long_texts_hand_on_what_they_have_seen():
    texts = [cut(t) for t in TEXTS]
    assert np.allclose(mixing.Scorer(model(2)).score(texts), mixing.Scorer(model(2)).score(texts, longest=20))


def test_every_token_is_refined_as_by_a_plain_scorer():
    m = model(3)
    for text in (b"abcdefgh " * 60, b"x", b"one two three four one six seven eight one ten eleven " * 9):
        keys, want, seen = cut(text), 0.0, Counter()
        trust = list(mixing._TRUST)
        for i, key in enumerate(keys):
            first, bit, x, gate = m.inputs([key])
            cost = 0.0
            for j in range(len(bit)):
                z = float(m.weights[gate[j], 4]) + sum(float(m.weights[gate[j], k]) * float(x[k][j]) / 128 for k in range(4))
                cost += math.log(1 + math.exp(-z if bit[j] else z))
            told = [(1 - s) * math.exp(-cost) + s * seen[key] / i if i else math.exp(-cost) for s in mixing._SHARES]
            p = sum(t * q for t, q in zip(trust, told))
            want += math.log10(p)
            trust = [t * q / p for t, q in zip(trust, told)]  # those that foretold it better count more from now on
            seen[key] += 1
        got = mixing.Scorer(m).score([keys])[0]
        assert abs(got - want) < 1e-3 * max(1, -want)
        if len(keys) > 8:
            assert got > -sum(m.costs([k])[0] for k in keys) / math.log(10) + 1


def plain_contexts(key, j):
    """What predicts byte j of a token."""
    kind, so_far = key[0], key[2:j] or key[1:2]
    return (kind, key[max(1, j - 2) : j]), (kind, key[max(1, j - 3) : j]), so_far, (kind, so_far)


def test_counts_grow_with_the_corpus_and_tell_fold_1_apart(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh.") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(120)]
    own = mixing._texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    counted = own.where("fold > 0").selectExpr("explode(split(string(text), ' ')) w").where("w <> ''").groupBy("w").count()
    known = counted.selectExpr("binary(w) word", "count c")
    kinds = mixing._kinds(own, known, 50, 3)
    assert len(kinds.odds) > 20
    mixing._ROW, row = 60, mixing._ROW  # many borders
    try:
        counted = mixing._token_counts(own, kinds, known, 300)
    finally:
        mixing._ROW = row
    nodes = mixing._nodes(counted, CODE, 0)
    want = [{}, {}, {}, {}]
    cut = mixing.Tokenizer(kinds)
    for k, t in rows:
        fold = zlib.crc32(str(k).encode()) % 10
        for key in cut(t.encode()) if fold else []:
            for j in range(2, len(key)):
                s, n = CODE.start[key[j]], CODE.length[key[j]]
                for kind, c in enumerate(plain_contexts(key, j)):
                    for i in range(s, s + n):
                        want[kind].setdefault((c, int(CODE.nodes[i])), [0] * 4)[int(CODE.bits[i]) + 2 * (fold == 1)] += 1
    got = [[], [], [], []]
    stored = nodes.collect()
    for r in stored:
        got[r["kind"]] += mixing._counts_of(r["counts"], r["n"]).tolist()
    assert [sorted(g) for g in got] == [sorted(w.values()) for w in want]
    # nodes below a level go; but for those on the way to a border
    level = mixing._level(np.array([4]))[0]
    some = {k: [] for k in range(4)}
    for r in mixing._nodes(counted, CODE, level).collect():
        some[r["kind"]] += mixing._counts_of(r["counts"], r["n"]).tolist()
    for k in (2, 3):
        high = Counter(tuple(v) for v in want[k].values() if sum(v) >= 4)
        assert not high - Counter(map(tuple, some[k])) and not Counter(map(tuple, some[k])) - Counter(map(tuple, got[k]))
        assert len(some[k]) < len(got[k])
    one_row = mixing._token_counts(own, kinds, known, 10**6, 1)
    assert mixing.least_level(one_row, CODE, 1 << 23) == 1
    level = mixing.least_level(one_row, CODE, 500)
    assert sum(sum(v) > 0 and mixing._level(np.array([sum(v)]))[0] >= level for w in want[2:] for v in w.values()) <= 500 + 400
    # every cell holds the odds of its counts
    sizes = (1 << 20, 1 << 20, 1 << 22, 1 << 22)
    late, whole = (mixing.MixModel(CODE, mixing._packed(nodes, sizes, early), np.zeros((64, 5), np.float32), sizes) for early in (False, True))
    wrong = n = 0
    for key in {key for _, t in rows[:20] for key in cut(t.encode())}:
        for m, early in ((late, False), (whole, True)):
            _, bit, x, _ = m.inputs([key])
            steps = [(j, i) for j in range(2, len(key)) for i in range(CODE.start[key[j]], CODE.start[key[j]] + CODE.length[key[j]])]
            for at, (j, i) in enumerate(steps):
                for kind, c in enumerate(plain_contexts(key, j)):
                    four = want[kind].get((c, int(CODE.nodes[i])), [0] * 4)
                    zero, one = four[0] + four[2] * early, four[1] + four[3] * early
                    n += 1
                    wrong += abs(x[kind][at] / 128 - min(15.99, max(-15.99, math.log((one + 0.1) / (zero + 0.1))))) > 0.01
    assert wrong < 0.02 * n  # shared cells


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_base_and_learning(spark, odd_docs, head):
    rng = np.random.default_rng(0)
    words = ["the", "of", "Station", "train", "énd"]
    rows = [(100 + k, " ".join(rng.choice(words, 40, p=[0.4, 0.3, 0.1, 0.1, 0.1]))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    fold = lambda k: zlib.crc32(str(k).encode()) % 10
    count = Counter(w for k, t in rows if fold(k) for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = []
    for k, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want.append((k, fold(k) == 0, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    got = mixing.lm_scores(docs, head_words=head).collect()
    assert sorted((*r[:5], round(r[5], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    if head:
        held = [r["bits_per_byte"] for r in got if r["doc_id"] >= 100 and r["held_out"]]
        assert held and np.mean(held) < 2


def test_empty_table(spark, no_docs):
    assert mixing.lm_scores(no_docs).count() == 0


def test_text_like_fold_1_is_known(spark):
    fold = {f: [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == f] for f in (0, 1, 2)}
    rows = [(k, "plain words of a text " * 8) for k in fold[2]] + [(k, "zyx-wvu QPO/NML " * 8) for k in fold[1][1:]] + [(k, "zyx-wvu QPO/NML " * 8) for k in fold[0][:3]]
    got = mixing.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) == 3 and all(r["bits_per_byte"] < 2.5 for r in got)


def test_no_node_of_a_token_so_far_is_left_out(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh.") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(120)]
    own = mixing._texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    known = own.selectExpr("explode(split(string(text), ' ')) w").where("w <> ''").groupBy("w").count().selectExpr("binary(w) word", "count c")
    mixing._ROW, row = 300, mixing._ROW  # some borders
    try:
        counted = mixing._token_counts(own, NO_KINDS, known, 300, 3, every=True)
    finally:
        mixing._ROW = row
    want = {}
    for k, t in rows:
        fold = zlib.crc32(str(k).encode()) % 10
        for key in cut(t.encode()) if fold else []:
            for j in range(3, len(key)):
                s, n = CODE.start[key[j]], CODE.length[key[j]]
                for i in range(s, s + n):
                    want.setdefault((key[2:j], int(CODE.nodes[i])), [0] * 4)[int(CODE.bits[i]) + 2 * (fold == 1)] += 1
    m, tables, total, met = mixing.MixModel.of(CODE, np.full(sum(mixing.CELLS), 7, np.uint16), mixing.CELLS), 0, 0, set()
    for r in counted.collect():
        flat, off, two = mixing._tokens_of(r)
        for early in (False, True):
            first, _, x, _ = mixing.Block(m, flat, off, two, early).inputs(np.arange(len(two)))
            for t in range(len(two)):
                key = flat[off[t] : off[t + 1]].tobytes()
                met.add(key)
                steps = [(j, i) for j in range(2, len(key)) for i in range(CODE.start[key[j]], CODE.start[key[j]] + CODE.length[key[j]])]
                for at, (j, i) in enumerate(steps):
                    four = want.get((key[2:j], int(CODE.nodes[i])), [0] * 4)
                    got, total = x[2][first[t] + at] / 128, total + (j > 2)
                    if got == -16:  # the tables have it
                        tables += j > 2
                    elif j > 2:
                        assert abs(got - min(15.99, max(-15.99, math.log((four[1] + four[3] * early + 0.1) / (four[0] + four[2] * early + 0.1))))) < 0.01
    # held-out tokens are there too, and only nodes at the borders are left to the tables
    assert met == {key for _, t in rows for key in cut(t.encode())} and tables < 0.2 * total


def test_costs_that_come_by_the_join_give_the_same_scores(spark):
    rng = np.random.default_rng(4)
    words = ["the", "of", "Station", "train", "énd", *(f"w{k}x" for k in range(200))]
    rows = [(k, " ".join(rng.choice(words, 60))) for k in range(80)] + [(900, "the " * 300), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = [{r["doc_id"]: r["score"] for r in mixing.lm_scores(docs, head_tokens=n).collect()} for n in (0, 40, 10**6)]
    assert all(abs(b[k] - by[0][k]) < 1e-6 * max(1, -by[0][k]) for b in by[1:] for k in by[0])
    texts, cost = [cut(t) for t in TEXTS], {}
    m = model(2)
    for t in texts:
        cost |= dict(zip(t, m.costs(t).tolist()))
    sums, rest = mixing.tokens_before(texts, cost)
    total = sums + np.log(mixing._TRUST)[:, None]
    assert not rest and np.allclose(np.log(np.exp(total - total.max(axis=0)).sum(axis=0)) + total.max(axis=0), mixing.Scorer(m).score(texts) * math.log(10), rtol=1e-5)


def test_texts_are_cut_once_and_meet_their_costs_by_chunk(spark):
    # before, every rare word and token of a text was a row of its own that two joins had to meet
    docs = spark.createDataFrame([(k, f"rare{k} word{k % 7} the") for k in range(60)], "doc_id long, text string")
    out = mixing.lm_scores(docs)
    assert "Join" not in out._jdf.queryExecution().toString() and out.count() == 60


def test_chunks_have_the_words_of_plain_splits():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("aBc") * rng.choice([1, 2, 47, 48, 49, 96, 97, 200]) + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(9))).encode() for _ in range(200)]
    flat, off = mixing._joined(texts)
    chunk = mixing.Chunk.cut(flat, off)
    word, words, ends = chunk.words()
    place = np.concatenate([[0], np.cumsum(chunk.many)])
    for k, t in enumerate(texts):
        assert [words[ends[w] : ends[w + 1]].tobytes() for w in word[place[k] : place[k + 1]] if w >= 0] == t.lower().split()
        assert b"".join(chunk.flat[chunk.off[n] : chunk.off[n + 1]].tobytes() for n in chunk.number[place[k] : place[k + 1]]) == t + b"\xff"
    for x in (np.zeros(0, np.int32), np.array([0, 5, 70_000, 1 << 30], np.int32)):
        assert (mixing._loosened(mixing._squeezed(x), np.int32) == x).all() and (mixing._ascended(mixing._ascending(x), len(x)) == x).all()
