import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text, by the libraries over whole texts and plain loops."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    back = {c: b for b, c in al.WordEncoder._byte_chars().items()}
    docs = []
    for t in texts:
        a = a_model.encode(" " + t, add_special_tokens=False) if t else None
        b = b_model.encode(t) if t else []
        if not t:
            docs.append(None)
            continue
        a_parts = [bytes(back[c] for c in x) for x in a.tokens]
        b_parts = [bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [b_model.id_to_piece(k)]]
        if {b"".join(a_parts), b"".join(b_parts)} != {(" " + t).encode()}:
            docs.append(None)
            continue
        a_ends, b_ends = list(itertools.accumulate(map(len, a_parts))), list(itertools.accumulate(map(len, b_parts)))
        links = []
        for i, (end, part) in enumerate(zip(a_ends, a_parts)):
            for j, (b_end, b_part) in enumerate(zip(b_ends, b_parts)):
                if end - len(part) < b_end and b_end - len(b_part) < end:
                    links.append((a.ids[i], b[j]))
        groups, last = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            groups.append(",".join(str(k) for k, e in zip(a.ids, a_ends) if last < e <= end) + "|" + ",".join(str(k) for k, e in zip(b, b_ends) if last < e <= end))
            last = end
        docs.append((len(a.ids), len(b), groups, links))
    count = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == most[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


def rows_of(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in frame.collect())


def wanted(docs):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(docs, brute([t for _, t in docs])))


ODD = ["it's we'll\nI've", "a▁b", "ﬁ① ½3²", "x  y   z ", " lead", "\n", " ", "\n\n a\n\n\nb", "tab\tand\r\nreturn\r", "<|endoftext|> <s> </s> <unk>", "é è 日本語 テキスト", "\x00 \x85a\xa0 b　c ", "));\r\n() {\r", "🙂🙂 👩‍👩‍👧", "a_b __init__ _x", "1234567 12.5%", "w" * 3000]


def test_units_give_what_whole_texts_give():
    aligner, rng = al.Aligner(A, B, most_units=50), random.Random(3)
    alphabet = ["a", "the", "'s", "'", ".", ",", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "½", "7", "日", "\xa0", "\x1c", "▁", "_", "🙂", "(", "))"]
    texts = [*ODD, *("".join(rng.choices(alphabet, k=rng.randrange(1, 25))) for _ in range(1500))]
    for t in texts:
        units = aligner.units(t)
        assert "".join(map(aligner.named, units)) == " " + t
        known, whole = aligner.learn(set(units)), aligner.whole(t)
        if None in known.values():
            continue
        assert whole and b";".join(known[u][1] for u in units) == whole[1], t
    assert aligner.in_units


def test_components_are_the_minimal_groups():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 40)
        a, b = (sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(0, 12)))}) for _ in range(2))
        i, j = al.overlaps(np.array(a), np.array(b))
        at = lambda ends, k: (ends[k - 1] if k else 0, ends[k])
        assert sorted(zip(i.tolist(), j.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if at(a, i)[0] < at(b, j)[1] and at(b, j)[0] < at(a, i)[1]]
        root = al.components(i, len(a) + j, len(a) + len(b))
        ends = {r: max(e for e, x in zip(a, root) if x == r) for r in set(root.tolist())}
        assert sorted(ends.values()) == sorted(set(a) & set(b)) and sorted(max(e for e, x in zip(b, root[len(a) :]) if x == r) for r in ends) == sorted(ends.values())


def test_components_of_any_graph():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 30))
        u, v = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        want = np.arange(n)
        for _ in range(n):
            for x, y in zip(u, v):
                want[x] = want[y] = min(want[x], want[y])
        assert (al.components(u, v, n) == want).all()


@pytest.mark.parametrize("most_pairs", [1_000_000, 0])
def test_equals_brute_force_on_odd_texts(spark, odd_docs, most_pairs):
    rows = [*((r["doc_id"], r["text"]) for r in odd_docs.collect()), *enumerate(ODD), (None, "the same row"), (None, "the same row")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, pairs string")
    assert rows_of(al.align(frame, A, B, most_pairs=most_pairs)) == wanted(rows)


def test_empty_table(spark, no_docs):
    assert al.align(no_docs, A, B).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    short = [r for r in rows if len(r[1] or "") < 3000]
    frame = spark.createDataFrame(short, "doc_id long, text string")
    assert rows_of(al.align(frame, A, B)) == wanted(short) and len(short) > 100
    assert al.op12_token_alignment(spark, "/root/testdata/sf0.001").count() == len(rows)
