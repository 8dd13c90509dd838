import io
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import sstable, text

PATH = public_tokenizers.path("word_bpe_49k.json")


class Buffer(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_round_trip_and_lookup():
    out, rng = Buffer(), np.random.default_rng(0)
    rows = [(int(k), rng.integers(0, 60_000 if k % 3 else 90_000, rng.integers(0, 50)).astype(np.uint32)) for k in sorted(rng.integers(-500, 5000, 800))]
    w = sstable.ShardWriter(out, 512)
    for k, ids in rows:
        w.add(k, ids)
    w.close()
    shard = sstable.Shard(out)
    assert [(sstable.id_of(k), v.tolist()) for k, v in shard] == [(k, v.tolist()) for k, v in rows]
    assert shard.n_docs == len(rows) and shard.n_ids == sum(len(v) for _, v in rows) and len(shard.place) > 5
    for k in range(-510, 5010, 7):
        assert [v.tolist() for v in shard.get(k)] == [v.tolist() for i, v in rows if i == k]


def test_encoder_equals_library():
    whole, enc = Tokenizer.from_file(PATH), sstable.WordEncoder(PATH, most_words=5)
    for t in ("", "Hello WORLD don't it's", "ΑΣ ΣΑΣ é", "a\x1cb c\xa0d", "x<|endoftext|>y", "µ²½ªßÀÖ×÷ÿ", "é 日本", "a\x85b\x0bc 12,3"):
        assert enc.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_runs_between_white_space_are_encoded_once():
    whole, enc = Tokenizer.from_file(PATH), sstable.WordEncoder(PATH)
    rng = np.random.default_rng(3)
    bits = ["Don't", "it\u2019s", "\u0301x", "\u00e9", "e\u0301", "\u65e5\u672c", "12,3", "<|endoftext|>", "a\x85b", "q\xa0r", "\u2000", "\x1c", "\u0130", "\u03a3", "z" * 70, "\u0345", "\x00"]
    gaps = ["", " ", "  ", "\n", "\t\r\n", "\x0b\x0c"]
    for _ in range(500):
        t = "".join(str(rng.choice(bits)) + str(rng.choice(gaps)) for _ in range(rng.integers(1, 12)))
        assert enc.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids
    # texts beyond Latin-1 are worked off by runs too, so words that come again cost nothing
    seen = []
    enc.whole = type("Counted", (), {"encode": lambda self, t, add_special_tokens: seen.append(t) or whole.encode(t, add_special_tokens=add_special_tokens)})()
    for _ in range(3):
        enc.encode("the caf\u00e9 \u201copens\u201d again \u201copens\u201d".encode())
    assert seen == ["\u201copens\u201d"]


def test_other_files_go_through_the_library():
    other = public_tokenizers.path("byte_bpe_50k.json")
    whole, enc = Tokenizer.from_file(other), sstable.WordEncoder(other)
    assert enc.find is None and sstable.WordEncoder(PATH).find is not None
    for t in ("", "Hello WORLD  don't", " é 12"):
        assert enc.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_files_hold_every_document(spark, odd_docs, no_docs):
    folder = text.scratch(spark, "test-sst")
    shards = sstable.write_shards(odd_docs, folder, PATH)
    got = sorted(map(tuple, sstable.read_shards(spark, folder, shards).collect()), key=lambda r: r[1])
    whole, at, want = Tokenizer.from_file(PATH), 0, []
    for r in sorted(odd_docs.collect(), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert [len(v) for v in sstable.lookup(folder, shards, 12)] == [3, 3] and sstable.lookup(folder, shards, 999) == []
    folder = text.scratch(spark, "test-sst")
    assert sstable.read_shards(spark, folder, sstable.write_shards(no_docs, folder, PATH)).count() == 0
