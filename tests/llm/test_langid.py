import math

import numpy as np

from barloom.llm import langid


def test_codewords_differ():
    for n in (2, 3, 4, 7, 30):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and (code.any(0) & ~code.all(0)).all()
        if n in (3, 4, 30):
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def naive_margins(model, raw):
    """Sums over the n-grams of one text, letter by letter."""
    folded = [32] * 2 + [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    total = np.zeros(model.code.shape[1])
    for k in range(2, len(folded)):
        a, b, c = folded[k], folded[k - 1], folded[k - 2]
        two = (a + b * 263) * 2654435761 % 2**32 >> 20
        three = (a + b * 263 + c * 70657) * 2246822519 % 2**32 >> 20
        total += model.weights[0][a] + model.weights[1][two] + model.weights[2][three]
    return total / max(1, len(raw)) + model.bias


def naive_decode(model, margins):
    losses = [sum(t * math.log(1 + math.exp(-m if bit else m)) for t, m, bit in zip(model.trust, margins, word)) for word in model.code]
    best = losses.index(min(losses))
    return best, 1 / sum(math.exp(-model.sharp * (x - losses[best])) for x in losses)


def test_margins_and_decoding_equal_a_naive_decoder():
    rng = np.random.default_rng(7)
    code = langid.codewords(5)
    model = langid.LanguageModel(list("abcde"), code, rng.normal(size=(3, langid.BINS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]), rng.random(code.shape[1]), 2.0)
    texts = [t.encode() for t in ("", "A", "Zß. é", "the Cat sat\non 12 mats", "日本語", "x" * 3000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    margins = model.margins(np.frombuffer(b"".join(texts), np.uint8), off)
    best, score, unsure = model.decode(margins)
    for k, t in enumerate(texts):
        want = naive_margins(model, t)
        assert np.allclose(margins[k], want, atol=1e-3)
        number, p = naive_decode(model, margins[k])
        assert best[k] == number and np.isclose(score[k], p) and unsure[k] == (score[k] < 0.75)


def test_equal_losses_give_the_first_language():
    code = langid.codewords(3)
    model = langid.LanguageModel(list("abc"), code, np.zeros((3, langid.BINS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]), 4.0)
    best, score, unsure = model.decode(model.margins(np.frombuffer(b"some text", np.uint8), np.array([0, 9])))
    assert best[0] == 0 and np.isclose(score[0], 1 / 3) and unsure[0]


def test_held_out(spark, odd_docs, no_docs):
    rng, rows = np.random.default_rng(0), []
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "mnopé", "dd": "xyzüß"}
    for k in range(240):
        lang = list(letters)[k % 4]
        rows.append((k, " ".join("".join(rng.choice(list(letters[lang]), 4)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs.where("doc_id % 5 <> 0"))
    got = langid.predict_languages(docs.where("doc_id % 5 = 0"), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    got = langid.predict_languages(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    blank = {r["doc_id"] for r in odd_docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == blank
    assert langid.predict_languages(no_docs, model).count() == 0
    one = langid.fit_languages(docs.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in langid.predict_languages(docs, one).collect()} == {"aa"}
    none = langid.fit_languages(no_docs)
    assert {r["lang_pred"] for r in langid.predict_languages(docs, none).collect()} == {"und"}
