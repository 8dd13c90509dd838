"""Token-id output (operator 10) as sorted-string-table shards.

A shard holds the token ids of documents in ascending doc_id order: prefix-compressed entries in compressed blocks, a sparse index (first key,
place and size of each block), a Bloom filter over the keys, and a footer. Lookup reads the footer, asks the filter, finds the block by binary
search and scans it. Spark range-partitions the documents by doc_id and every task writes one shard into a folder that driver and executors
share (a temporary name, then a rename, so a task that runs again does no harm).

Edge cases: a null or empty text has the end id alone. Rows with the same doc_id stay apart, in the order of their texts. An empty table makes
no shard and no rows. Rows without a doc_id have no key: they are left out. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

MAGIC = b"BLSST01\n"
_FOOTER = struct.Struct("<QQQQQQ")  # place and size of the index, place and size of the filter, documents, ids
_FLIP = 1 << 63


def key_of(doc_id: int) -> bytes:
    """Eight bytes that sort as the signed number does."""
    return struct.pack(">Q", doc_id + _FLIP)


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - _FLIP


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class Bloom:
    """k bits of a bit table for each key, by double hashing."""

    def __init__(self, bits: bytearray, k: int = 7):
        self.bits, self.k = bits, k

    @classmethod
    def of(cls, keys: list[bytes], per_key: int = 10) -> Bloom:
        out = cls(bytearray(max(8, -(-len(keys) * per_key // 8))))
        for key in keys:
            for p in out._places(key):
                out.bits[p >> 3] |= 1 << (p & 7)
        return out

    def _places(self, key: bytes) -> Iterator[int]:
        a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
        return ((a + i * b) % (8 * len(self.bits)) for i in range(self.k))

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class ShardWriter:
    """Appends (doc_id, ids) in ascending order of doc_id to a binary stream."""

    def __init__(self, out, block_bytes: int = 1 << 16):
        self.out, self.block_bytes, self.at, self.n_ids = out, block_bytes, 0, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def _flush(self) -> None:
        if self.block:
            b = zlib.compress(bytes(self.block), 1)
            self.index.append((self.first, self.at, len(b)))
            self._put(b)
            self.block.clear()

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("keys must not descend")
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((k for k in range(8) if key[k] != self.last[k]), 8)
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(8 - shared) + _varint(2 * len(value) + wide) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        index = b"".join(key + struct.pack("<QQ", at, size) for key, at, size in self.index)
        bloom = bytes(Bloom.of(self.keys).bits)
        footer = _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids) + MAGIC
        self._put(index + bloom + footer)


class Shard:
    """Reads a shard through a seekable file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._read(size - _FOOTER.size - len(MAGIC), _FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("this is no shard")
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids = _FOOTER.unpack(tail[: _FOOTER.size])
        raw = self._read(at, n)
        self.first = [raw[k : k + 8] for k in range(0, n, 24)]
        self.place = [struct.unpack("<QQ", raw[k + 8 : k + 24]) for k in range(0, n, 24)]
        self.bloom = Bloom(bytearray(self._read(bloom_at, bloom_n)))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        b, at, last = zlib.decompress(self._read(*self.place[k])), 0, b""
        while at < len(b):
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            size, at = _read_varint(b, at)
            last = last[:shared] + b[at : at + rest]
            at += rest
            yield last, np.frombuffer(b, "<u4" if size & 1 else "<u2", (size >> 1) // (4 if size & 1 else 2), at)
            at += size >> 1

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.place)):
            yield from self.block(k)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this doc_id."""
        key = key_of(doc_id)
        if key not in self.bloom:
            return []
        found: list[np.ndarray] = []
        for k in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.first)):
            if self.first[k] > key:
                break
            found += [ids for have, ids in self.block(k) if have == key]
        return found


class WordEncoder:
    """Token ids of texts by a `tokenizers` file with word ends, with bounded caches of words and of the runs between white space.

    Where the file normalises and splits by a pattern, as `FORM` has it, no token, special token or normalised character reaches over ASCII white space,
    so each distinct run between such is encoded once; of a run its BPE model sees each distinct word once, and the pattern is the file's own. All texts under
    other files, and runs beyond Latin-1, with control separators or with the text of a special token, go through the library's whole pipeline. Little-endian machines only.
    """

    #: The parts of a file whose words can be encoded one by one; its pattern matches no white space.
    FORM = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], ("Removed", True, False, False), r"\s+")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Longer runs are not kept.
    _LONG = 64

    def __init__(self, path: str, most_words: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.whole, self.most, self.cache, self.others = Tokenizer.from_file(path), most_words, {}, {}
        parts = json.loads(self.whole.to_str())
        pattern = self._pattern(parts)
        self.model, self.find = self.whole.model, regex.compile(pattern).findall if pattern else None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.byte_chars = self._byte_chars()

    @classmethod
    def _pattern(cls, parts: dict) -> str | None:
        """The pattern by which the file splits, or none if it has another form."""
        norm, pre = ((parts.get(k) or {}).get(name, []) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if [x["type"] for x in norm] != cls.FORM[0] or [x["type"] for x in pre] != cls.FORM[1] or parts.get("post_processor") or parts.get("truncation") or parts["model"]["type"] != "BPE":
            return None
        if any(c.isspace() or t["lstrip"] or t["rstrip"] for t in parts.get("added_tokens") or [] for c in t["content"]):
            return None
        split, level = pre
        same = (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) == cls.FORM[2]
        pattern = split["pattern"].get("Regex")
        return pattern if same and pattern == cls.PATTERN and norm[1]["pattern"].get("Regex") == cls.FORM[3] and norm[1]["content"] == " " else None

    @staticmethod
    def _byte_chars() -> dict[int, str]:
        """The usual printable stand-ins of bytes: printable bytes stand for themselves, the others follow from U+0100."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*plain}))}

    def _run(self, r: str) -> bytes:
        """Ids of a run; where it has several words, of each, and the run is kept beside them."""
        if len(self.cache) >= self.most:
            self.cache.clear()
        words = () if r.isalpha() else self.find(r)
        if len(words) > 1:
            get = self.cache.get
            out = b"".join([get(w) or self._run(w) for w in words])
        else:
            w = r if r.isascii() and r.isprintable() else r.encode().decode("latin-1").translate(self.byte_chars)
            out = array("I", [t.id for t in self.model.tokenize(w)]).tobytes()
        if len(r) <= self._LONG:
            self.cache[r] = out
        return out

    def encode(self, b: bytes) -> np.ndarray:
        text = b.decode("utf-8", "replace")
        if self.find is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if self._plain(text):
            get = self.cache.get
            return np.frombuffer(b"".join([get(r) or self._run(r) for r in text.lower().split()]), "<u4")
        get = self.others.get
        return np.frombuffer(b"".join([get(r) or self._other(r) for r in b.split()]), "<u4")

    def _plain(self, text: str) -> bool:
        """Whether all is Latin-1 (which NFC leaves as it is), without control separators and special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(c in text for c in "\x1c\x1d\x1e\x1f\x85\xa0") and not any(s in text for s in self.special)

    def _other(self, r: bytes) -> bytes:
        text = r.decode("utf-8", "replace")
        out = b"".join(map(self._run, text.lower().split())) if self._plain(text) else array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.others) >= self.most // 4:
            self.others.clear()
        if len(r) <= self._LONG:
            self.others[r] = out
        return out


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


_encoders: dict[str, WordEncoder] = {}


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, block_bytes: int = 1 << 16) -> DataFrame:
    """Encode every text, append end_id and write shards below `folder`. Returns their list: shard, name, n_docs, n_tokens, in ascending order
    of doc_id; it has a row for each shard, never for each document."""
    schema = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))
        number, writer, end = TaskContext.get().partitionId(), None, np.array([end_id], np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                for doc_id, b in zip(batch.column(0).slice(lo, 200).to_pylist(), batch.column(1).slice(lo, 200).to_pylist(), strict=True):
                    if writer is None:
                        fs, path = _fs(folder)
                        fs.create_dir(path, recursive=True)
                        part, name = f"{path}/.{uuid.uuid4().hex}", f"shard-{number:06d}.sst"
                        stream = fs.open_output_stream(part)
                        writer = ShardWriter(stream, block_bytes)
                    writer.add(doc_id, np.concatenate([encoder.encode(b), end]))
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(part, f"{path}/{name}")
            yield tx.rows(schema, [number], [name], [len(writer.keys)], [writer.n_ids])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text"))
    made = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard int, name string, n_docs long, n_tokens long")
    return tx.stored(made, "shards")


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 of every document in the shards, read from the files."""
    listed = sorted(shards.collect(), key=lambda r: r["shard"])
    starts = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in listed])]).astype(int)
    todo = spark.createDataFrame([(r["name"], int(s)) for r, s in zip(listed, starts, strict=False)], "name string, start long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as file:
                    shard = Shard(file)
                    for k in range(len(shard.place)):
                        out = []
                        for key, ids in shard.block(k):
                            out.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            at += len(ids)
                        yield tx.rows(schema, *zip(*out))

    return todo.repartition(max(1, len(listed)), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, shards: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this doc_id, by filter, index and one block of the shards that may have it."""
    fs, path = _fs(folder)
    found = []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):
        with fs.open_input_file(f"{path}/{r['name']}") as file:
            found += Shard(file).get(doc_id)
    return found


def op10_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = tx.scratch(spark, "sst")
    shards = write_shards(tx.documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, folder, shards)
