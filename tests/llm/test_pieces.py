import itertools
import random
import time

import numpy as np
import public_tokenizers
import pytest

from barloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def seg():
    return pieces.Segmenter(MODEL, 4)


def every_path(seg, word):
    ends = seg.lattice(word)[0]
    paths = [[(0, ())]]
    for j in range(1, len(word) + 1):
        paths.append([(s + t, a + b) for i, t, b in ends[j] for s, a in paths[i]])
    return paths[-1]


def test_search_equals_brute_force(seg):
    for word in ("▁the", "▁station", "▁ererand", "ééaux", "▁▁▁ab", "日x", "\n", "▁"):
        want = sorted((s for s, _ in every_path(seg, word)), reverse=True)[:4]
        got = seg.search(word)
        assert [s for s, _ in got] == pytest.approx(want)
        assert len({ids for _, ids in got}) == len(got)
        assert got[0][1] in [a for s, a in every_path(seg, word) if s == want[0]]


def test_text_n_best_is_best_sum_over_words(seg):
    text = "The station ererand on éaux"
    words = [seg.search(w) for w in seg.split(text)]
    want = [s / pieces.UNIT for s in sorted((sum(s for s, _ in c) for c in itertools.product(*words)), reverse=True)[:4]]
    assert seg.segment(text)[1] == pytest.approx(want)
    assert [s for s, _ in seg.n_best(text)] == pytest.approx(want)


def test_many_words_at_once_equal_the_search(seg):
    rng = random.Random(3)
    words = {pieces.SPACE * rng.randrange(2) + "".join(rng.choice(["the", "er", "e", "n", "a", "é", "日", "…", "12", "\n"]) for _ in range(1 + rng.randrange(9))) for _ in range(600)}
    s = pieces.Segmenter(MODEL, 4)
    s.learn(words)
    assert 0.5 * len(words) < len(s.cache) <= len(words)
    for w, (ids, score, loss) in s.cache.items():
        got = s.search(w)
        assert score == got[0][0] and loss == (got[0][0] - got[1][0] if len(got) > 1 else None)
        own = [(t, a) for t, a in every_path(s, w) if t == score] if len(w) < 12 else []
        assert not own or tuple(np.frombuffer(ids, s.kind).tolist()) in [a for _, a in own]


def test_ties_do_not_depend_on_the_company():
    words = ["▁" + a + b for a in ("abab", "cdcd", "the", "hfgb") for b in ("aa", "er", "gb", "…x")]
    together, alone = pieces.Segmenter(MODEL, 3), pieces.Segmenter(MODEL, 3, most_words=1)
    together.learn(words)
    for w in words:
        assert together.segment("", [w])[0].tolist() == alone.segment("", [w])[0].tolist()


def test_cuts_change_nothing(seg):
    rng = random.Random(2)
    whole = lambda text: seg.search(pieces.SPACE + text.replace(" ", pieces.SPACE))
    for _ in range(300):
        text = "".join(rng.choice(["the", "er", " ", "  ", ".", ",", "12", "é", "²", "²." , "日", "\n", "a", "…)"]) for _ in range(1 + rng.randrange(7)))
        want = [s / pieces.UNIT for s, _ in whole(text)]
        assert seg.segment(text)[1] == want
        got = seg.n_best(text)
        assert [s for s, _ in got] == want and len({tuple(ids) for _, ids in got}) == len(got)
        assert all(seg.decode(np.array(ids)) == text for _, ids in got)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "x-" * 50_000, "é" * 100_000, " " * 100_000, "." * 100_000])
def test_long_words_with_many_ties(seg, text):
    began = time.process_time()
    ids, scores = seg.segment(text)
    assert time.process_time() - began < 4
    assert seg.decode(ids) == text and 1 <= len(scores) <= 4 and scores == sorted(scores, reverse=True)


def test_ties_are_all_found(seg):
    word = "a" * 9
    want = sorted((s for s, _ in every_path(seg, word)), reverse=True)[:4]
    got = seg.search(word)
    assert [s for s, _ in got] == want and len({ids for _, ids in got}) == 4


def test_round_trip(seg):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab é日\n\t .x") for _ in range(rng.randrange(60)))
        assert seg.decode(seg.segment(text)[0]) == text


def test_table(spark, odd_docs, no_docs):
    got = pieces.segment_texts(odd_docs, MODEL).collect()
    assert len(got) == odd_docs.count() and all(r["round_trip"] for r in got)
    assert next(r for r in got if r["doc_id"] == 0)["n_pieces"] == 0
    assert pieces.segment_texts(no_docs, MODEL).count() == 0
    assert pieces.segment_ids(odd_docs, MODEL).count() == odd_docs.count()
