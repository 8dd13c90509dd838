import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def full_or_power(n, size):
    return n == size or n & (n - 1) == 0


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_plan_places_every_token_once_and_pads_nothing(size):
    rng = random.Random(size)
    for trial in range(60):
        lengths = [rng.choice([1, 2, size // 2, size - 1, rng.randrange(1, size)]) if trial % 2 else min(size - 1, int(rng.expovariate(4 / size)) + 1) for _ in range(rng.randrange(0, 400))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        places, sequences = pk.plan(counts, size)
        docs, packs = defaultdict(list), defaultdict(list)
        for p in places:
            assert p.take > 0 and p.high > p.low
            for k in range(p.high - p.low):
                docs[p.length, p.low + k].append((p.start, p.take))
                packs[p.sequence + k].append((p.offset, p.take))
        assert set(docs) == {(n, k) for n, c in counts.items() for k in range(c)} and set(packs) == set(range(sequences))
        for (length, _), parts in docs.items():
            assert [s for s, _ in sorted(parts)] == [0, *np.cumsum([t for _, t in sorted(parts)])[:-1]] and sum(t for _, t in parts) == length
        for parts in packs.values():
            parts.sort()
            assert [s for s, _ in parts] == [0, *np.cumsum([t for _, t in parts])[:-1]] and full_or_power(sum(t for _, t in parts), size)


def test_most_documents_stay_whole_and_the_plan_is_small():
    rng = random.Random(1)
    counts = defaultdict(int)
    for _ in range(200_000):
        counts[min(4095, int(rng.expovariate(1 / 700)) + 1)] += 1
    places, _ = pk.plan(counts, 4096)
    cut = sum(p.high - p.low for p in places if p.take < p.length and p.start == 0)
    assert cut < 2000 and len(places) < 50_000
    more, _ = pk.plan({n: 1000 * c for n, c in counts.items()}, 4096)
    assert len(more) < 50_000  # a larger corpus has no larger plan


def test_longest_first_into_the_shortest_pack():
    places, n = pk.plan({6: 1, 5: 1, 3: 1, 2: 1}, 8)
    assert n == 2 and [(p.length, p.sequence, p.offset) for p in places] == [(6, 0, 0), (5, 1, 0), (3, 1, 5), (2, 0, 6)]


def check(pieces, docs, size):
    whole, left = Tokenizer.from_file(PATH), defaultdict(list)
    for doc_id, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        left[doc_id].append(np.array(ids, "<u4").tobytes())
    by, packs = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by[r["doc_id"]].append(r)
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(left)
    for doc_id, rows in by.items():
        parts = sorted((r["doc_tokens"], r["start"], r["ids"]) for r in rows)
        if len(left[doc_id]) == 1:
            assert b"".join(ids for _, _, ids in parts) == left[doc_id][0] and {n for n, _, _ in parts} == {len(left[doc_id][0]) // 4}
            assert all(left[doc_id][0][4 * s :].startswith(ids) for _, s, ids in parts)
        else:  # several documents under one id
            assert sum(len(ids) for _, _, ids in parts) == sum(map(len, left[doc_id]))
            assert all(any(d[4 * s :].startswith(ids) for d in left[doc_id]) for _, s, ids in parts)
    assert sorted(packs) == list(range(len(packs)))
    for parts in packs.values():
        parts.sort()
        assert [s for s, _ in parts] == [0, *np.cumsum([t for _, t in parts])[:-1]] and full_or_power(sum(t for _, t in parts), size)


@pytest.mark.parametrize("most_cells", [1_000_000, 0])
@pytest.mark.parametrize("size", [16, 4096])
def test_odd_texts(spark, odd_docs, size, most_cells):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(None, "a b"), (99, "a " * 20_000)]
    frame = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, n int, ids binary").repartition(3)
    pieces = pk.pack(frame, PATH, size=size, most_cells=most_cells)
    check(pieces.collect(), docs, size)
    joined = pk.sequences(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * size for r in joined)


def test_empty_table(spark, no_docs):
    assert pk.pack(no_docs, PATH).collect() == []


def test_query_over_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(pk.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH).collect(), docs, 4096)
    got = pk.op13_histogram_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = Tokenizer.from_file(PATH)
    ids = {d: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in docs}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in got.collect())
