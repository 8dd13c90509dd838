import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from barloom.llm import pieces
from test_decontam import brute as contaminated
from test_jaccard import brute as linked
from test_pii import brute as private


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(3)]
    rows, labels = [], []
    for k in range(150):
        w = [word() for _ in range(rng.randrange(60, 150))]
        bad = k % 4 == 0
        if bad:
            w = [x + "###" for x in w]
        elif k % 10 == 1:
            w[5:5] = items[k % 3][1].split()
        elif k % 10 == 3:
            w[9:9] = ["a.b@example.com", "10.0.0.1"]
        elif k % 10 == 7 and k > 7:
            w = rows[k - 10][1].split()
            w[3] = word()
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, int(not bad), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, rows[5][1], "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs, text = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    want = {k for k, t in text.items() if t and "###" not in t}
    step = iter(corpus_pipeline.STAGES)

    def after(docs, last=False):
        out = next(step)[1](spark, docs, path)
        assert last or out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    docs = after(docs)
    assert {r["doc_id"] for r in docs.collect()} == want
    want = {k for k, _, c in linked([(k, text[k]) for k in sorted(want)]) if k == c}
    docs = after(docs)
    assert {r["doc_id"] for r in docs.collect()} == want and 902 not in want
    want = {r[0] for r in contaminated([(k, text[k]) for k in want], items) if not r[5]}
    docs = after(docs)
    assert {r["doc_id"] for r in docs.collect()} == want
    docs = after(docs)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == want
    for k, r in got.items():
        assert r["n_chars"] == len(r["text"]) and not private(r["text"])
        assert re.sub(r"a\.b@example\.com", "[email]", text[k]).replace("10.0.0.1", "[ip]") == r["text"]
    seg = pieces.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 3)
    out = after(docs, True).collect()
    assert all(r["round_trip"] and len(r["scores"]) == 3 for r in out)
    assert {r["doc_id"]: r["ids"] for r in out} == {k: seg.segment(r["text"])[0].tolist() for k, r in got.items()}


def test_empty_table(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_repeated_rows_and_ids(spark, folder):
    """Rows with one doc_id are judged by their texts; of repeated rows one stays; clashing columns do no harm."""
    path, rows, _ = folder
    a, b, c = (rows[k][1] for k in (1, 2, 3))
    docs = [(5, a), (5, b), (5, b), (6, a), (None, c), (None, c), (7, c), (8, None), (9, "")]
    made = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in docs], "doc_id long, text string, n_shingles string, component_id string, n long")
    got = corpus_pipeline.one_of_each(spark, made, path)
    assert got.columns == made.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(5, a), (5, b), (0, c), (8, ""), (9, "")])
