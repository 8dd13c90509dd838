import hashlib
import re

import numpy as np
import pytest

from barloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


CHECK = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": luhn, "phone": lambda m: 9 <= sum(c.isdigit() for c in m) <= 15}


def brute(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t or "") if CHECK[k](m[0])]


TEXTS = [
    "mail a.b@c.de and x@y@z.com_x@y.org, é bob+1@mail-1.example.com.", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 11.2.3.45", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12",
    "+1 (555) 123-4567 +49.30.123456 +1 2 +12345678901234567 call (555) 123-4567", "日本 a@b.co 日 1.1.1.1", "password=b7db7aa4a5fcc78305 token = \"ce0cc631f6559e745b37cb8be6fc63ae\"",
    "1" * 30_000, "a" * 30_000 + "@", "1-" * 9_000, "a.b@" * 3_000, "user (at) example.com",
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_base_spans(spark, texts, odd_docs, no_docs):
    for docs in (texts, odd_docs):
        rows = {(r["doc_id"], tuple(brute(r["text"]))) for r in docs.collect()}
        got = pii.personal_data(docs).select("doc_id", pii.listed(pii.F.col("base")).alias("s")).collect()
        assert {(r["doc_id"], tuple(r["s"].split(",") if r["s"] else ())) for r in got} == rows and len(got) == docs.count()
    assert pii.personal_data(no_docs).count() == 0


def test_added_and_redacted(texts):
    got = {r["doc_id"]: r["s"] for r in pii.personal_data(texts).select("doc_id", pii.listed(pii.F.col("added")).alias("s")).collect()}
    assert got[5].startswith("secret:9:27") and got[4] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(texts).collect()}
    assert clean[4] == "日本 [email] 日 [ip]"
    assert not any(brute(t) for t in (clean[0], clean[4])) and set(clean) == set(range(len(TEXTS)))


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    said = [truth ^ (rng.random(4000) < e) for e in (0.05, 0.1, 0.2, 0.5, 0.3)]
    rows, counts = np.unique(["".join("1" if v else "0" for v in r) for r in zip(*said)], return_counts=True)
    post, told, prior = pii.em(list(rows), counts.astype(float))
    assert abs(prior - 0.4) < 0.08 and told[0, 1, 1] > 0.88 and abs(told[3, 1, 1] - told[3, 0, 1]) < 0.12
    p = dict(zip(rows, pii.classify(list(rows), counts.astype(float), post)))
    assert np.mean([(p["".join("1" if v else "0" for v in r)] >= 0.5) == t for r, t in zip(zip(*said), truth)]) > 0.93


def test_digest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d/documents.parquet")
    for r in pii.op2_private_votes(spark, f"{tmp_path}/d").collect():
        want = brute(dict(rows)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(w.startswith(k) for w in want) for k in pii.BASE]
        assert set(want) <= set(r["spans"].split(","))  or not want


def test_long_keys_are_found_and_redacted(spark):
    keys = ["a1" * 80, "k" * 60 + "9" + "Zx_" * 40, "q7-" * 1700]
    texts = spark.createDataFrame([(k, f"token={key} end") for k, key in enumerate(keys)] + [(9, "password = b7db7aa4a5fcc78305")], "doc_id long, text string")
    spans = {r["doc_id"]: r["s"] for r in pii.personal_data(texts).select("doc_id", pii.listed(pii.F.col("added")).alias("s")).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(texts).collect()}
    for k, key in enumerate(keys):
        assert f"secret:6:{6 + len(key)}" in spans[k].split(",") and clean[k] == "token=[secret] end"


def test_many_matches_in_one_text(spark):
    parts = [x for k in range(7000) for x in (f"u{k}@é u{k}@x{k}.com", f"10.{k % 256}.0.1", "日本 and")]
    text = " ".join(parts)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.personal_data(frame).select(pii.listed(pii.F.col("base")).alias("s")).first()["s"].split(",")
    assert got == brute(text) and len(got) > 7000
    spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in got))
    want, at = "", 0
    for s, e, k in spans:
        want += text[at : max(at, s)] + (f"[{k}]" if e > at else "")
        at = max(at, e)
    assert pii.redact(frame).first()["text"] == want + text[at:]


def test_candidates_that_overlap_base_spans_are_left_out(spark):
    rng = np.random.default_rng(4)
    frame, want = [], {}
    for k in range(200):
        cands = []
        for _ in range(rng.integers(0, 12)):
            s = int(rng.integers(0, 60))
            cands.append((int(rng.integers(0, 5)), s, s + int(rng.integers(1, 9)), bool(rng.random() < 0.5), "1"))
        frame.append((k, cands))
        want[k] = sorted((c[0], c[1], c[2]) for c in cands if not c[3] and not any(b[3] and b[1] < c[2] and c[1] < b[2] for b in cands))
    df = spark.createDataFrame(frame, f"k int, cands {pii._NONE}")
    got = {r["k"]: sorted((c["kind"], c["start"], c["stop"]) for c in r["a"]) for r in df.select("k", pii._apart(pii.F.col("cands")).alias("a")).collect()}
    assert got == want
