"""Language-model scoring (operator 3) by online logistic mixing of hashed-context bit predictors.

A text is cut into tokens: up to 47 bytes that are no white space, and the byte of white space or the end of the text after them (a longer run is
cut every 48 bytes). Every byte, and the end, is spelled in the bits of one Huffman code of the corpus. Four contexts predict each bit from counts:
the last two bytes and the last three, each with the kind of the text so far, and the whole token so far without and with that kind;
before the first byte of a token stands how the token before it ends. (The last byte alone got weights of 0.00 to -0.03, so it is left out.) The kind
is one of a few clusters of frequent words that go together in texts (so of languages, mostly); the frequent words before a token tell it. Their
stretched probabilities are mixed with weights that a gate chooses by how much the two last contexts have seen. The weights are learned online
on one ninth of the training documents, whose counts join the tables only after that.

Within every text the mixture is refined after every token: a few blends of it with the text's own earlier tokens are weighted by how well each
has foretold the text so far. So a text that repeats itself costs less, and one that doesn't costs next to nothing more.

Texts are cut once, into chunks of some megabytes: the different tokens of each, and all tokens as numbers. Spark counts the tokens of all training
chunks, deals them out in their order and stores them, so what is gathered grows with the corpus. From
the counted tokens it works out (context, node, zeros, ones): a token is a row of bits, so in sorted order the tokens that share
a node stand together. The tables have four cells at least for each (context, node) that they hold, two bytes a
cell, and go to every task. Of the token so far, a task that holds a part of the sorted tokens has all nodes there, so the counts of all are exact and no table
holds them, but for nodes that reach over the border of a part. So every different token is spelled once, by the task that has its neighbours, and its cost goes to each chunk that
has it. Words are dealt by their hash, and their counts for the base score return to the chunks likewise.

Edge cases: null and empty texts have the end alone. A very long text is a chunk of its own. Rows with the same doc_id
give one row each. An empty table gives no rows; without training documents all predictions are one half. Further columns of the input are
ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

#: Bytes that UTF-8 never has: the end of a text, and what stands before a token: nothing, the end of a line, of a sentence, another word, or
#: the part of a longer one.
END, START, LINE, SENTENCE, WORD, PART = 0xFF, 0xF8, 0xF9, 0xFA, 0xFB, 0xFC
LONGEST = 48
#: Tokens of a row of counts, about; bytes of text of a chunk.
_ROW, _CHUNK = 1 << 17, 4 << 20
#: Least cells of the tables of the four contexts.
CELLS = (1 << 16,) * 4
KINDS = len(CELLS)
_PART = 1 << 17
_SUMMED = 1 << 20
_GATES = 64
_WEIGHTS = (0.1, 0.2, 0.35, 0.35, 0.0)
#: Shares of the text's own tokens in the blends, and the weights that these begin with.
_SHARES, _TRUST = np.array([0.0, 1 / 64, 1 / 8, 1 / 2]), np.array([0.85, 0.05, 0.05, 0.05])


@dataclass(frozen=True)
class Kinds:
    """Tells the kind of a text from its frequent words; rows of odds: the log-likelihood of a word in texts of each kind."""

    words: dict[bytes, int]
    odds: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], together: np.ndarray, kinds: int) -> Kinds:
        """Clusters of words by how many texts have both: spectral coordinates, the farthest words as first centres, then nearest centres."""
        n = len(words)
        if n < kinds:
            return cls({}, np.zeros((1, 1), np.float32))
        alone = np.maximum(np.diag(together), 1)
        near = together / np.sqrt(np.outer(alone, alone))
        degree = np.maximum(near.sum(axis=1), 1e-9)
        at = np.linalg.eigh(near / np.sqrt(np.outer(degree, degree)))[1][:, -kinds:]
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
        chosen = [int(np.argmax(alone))]
        for _ in range(kinds - 1):
            chosen.append(int(np.argmin((at @ at[chosen].T).max(axis=1))))
        centre = at[chosen]
        for _ in range(30):
            own = np.argmax(at @ centre.T, axis=1)
            centre = np.stack([at[own == k].sum(axis=0) if (own == k).any() else centre[k] for k in range(kinds)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        share = together / alone[:, None]  # of the texts with a word, those with another
        odds = np.log(np.stack([share[own == k].sum(axis=0) / max(1, (own == k).sum()) for k in range(kinds)], axis=1) + 1e-3)
        # counts are whole numbers, but a product of matrices may differ in its last bits
        odds = np.round(odds - odds.max(axis=1, keepdims=True), 3)
        return cls({w: k for k, w in enumerate(words)}, np.concatenate([odds, np.zeros((1, kinds))]).astype(np.float32))


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some stretches, one after another."""
    end = np.cumsum(size, dtype=np.int64)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]


def _binaries(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _different(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of some byte strings among the different ones, bytes and offsets of those, as they first come)."""
    if len(off) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    got = _binaries(flat, off).dictionary_encode()
    return got.indices.to_numpy(), *tx.blobs(got.dictionary)


def _hashes(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings."""
    out = np.zeros(len(off) - 1, np.uint64)
    for lo, hi in tx.slices(off, 1 << 18):
        part, at = flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        power, under = _powers(len(part) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((part + np.uint64(1)) * power[: len(part)])])
        out[lo:hi] = _spread((total[at[1:]] - total[at[:-1]]) * under[at[:-1]])
    return out


#: Bytes that end a token, lower case, and what stands before the token that follows one with this last byte.
_STOPS, _LOWER, _MARKS = np.zeros(256, bool), np.arange(256, dtype=np.uint8), np.full(256, PART - START)
_STOPS[[*tx.WHITESPACE, END]] = True
_LOWER[65:91] += 32
_MARKS[[*tx.WHITESPACE]] = WORD - START
_MARKS[[10, 13]] = LINE - START


@dataclass(frozen=True)
class Chunk:
    """Some texts, cut into tokens: the different tokens, the numbers of all among them, and how many each text has. Words longer than a token stand
    beside them, lower-cased, as the different ones and the numbers of all."""

    flat: np.ndarray
    off: np.ndarray
    number: np.ndarray
    many: np.ndarray
    long_flat: np.ndarray
    long_off: np.ndarray
    long_number: np.ndarray

    @classmethod
    def cut(cls, flat: np.ndarray, off: np.ndarray) -> Chunk:
        end = off[1:] + np.arange(len(off) - 1)
        text, own = np.full(len(flat) + len(end), END, np.uint8), np.ones(len(flat) + len(end), bool)
        own[end] = False
        text[own] = flat
        stop = np.flatnonzero(_STOPS[text])
        size, ends = np.diff(stop, prepend=-1), stop + 1
        longer = np.flatnonzero(size > LONGEST)
        long_number, long_flat, long_off = _different(_gathered(_LOWER[text], (ends - size)[longer], size[longer] - 1) if len(longer) else text[:0], _offsets(size[longer] - 1))
        if len(longer):
            parts = (size - 1) // LONGEST + 1
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            ends = np.minimum(np.repeat(ends - size, parts) + LONGEST * (k + 1), np.repeat(ends, parts))
        number, flat, off = _different(text, np.concatenate([[0], ends]))
        return cls(flat, off, number, np.diff(np.searchsorted(ends, end + 1, "right"), prepend=0), long_flat, long_off, long_number)

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """The different tokens, lower-cased, without what ends them."""
        size = np.diff(self.off) - _STOPS[self.flat[self.off[1:] - 1]]
        return _gathered(_LOWER[self.flat], self.off[:-1], size), _offsets(size)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of each token the number of the word that ends there, or -1; bytes and offsets of the words, lower-cased)."""
        flat, off = self.bare()
        part = ~_STOPS[self.flat[self.off[1:] - 1]]
        none = part | (np.diff(off) == 0)
        of, flat, off = _different(flat, off)
        word, inner = np.where(none, -1, of)[self.number], part[self.number]
        word[np.flatnonzero(inner[:-1] & ~inner[1:]) + 1] = len(off) - 1 + self.long_number
        return word, np.concatenate([flat, self.long_flat]), np.concatenate([off, off[-1] + self.long_off[1:]])

    def frequent(self, kinds_words: list[bytes]) -> np.ndarray:
        """Of each different token, the place of its word among the given ones, or -1."""
        got = pc.index_in(_binaries(*self.bare()), value_set=pa.array(kinds_words, pa.binary()))
        return got.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def keyed(self, kinds: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of each token its number among the different ones with what stands before, of those: number of the token, and eight times its kind and what stands before)."""
        size, number = np.diff(self.off), self.number
        mark = _MARKS[self.flat[self.off[1:] - 1]]
        mark[(mark == WORD - START) & (size > 1) & np.isin(self.flat[np.maximum(self.off[1:] - 2, 0)], [*b".!?"])] = SENTENCE - START
        first = np.cumsum(self.many) - self.many
        head = np.zeros(len(number), np.int64)
        head[1:] = mark[number[:-1]]
        head[first] = 0
        found = self.frequent(list(kinds.words))[number]
        at = np.flatnonzero(found >= 0)
        if len(at):
            text = np.repeat(np.arange(len(first)), self.many)
            begin, word = np.searchsorted(at, first), found[at]
            most, likely = np.full(len(at), np.iinfo(np.int64).min), np.zeros(len(at), np.int64)
            for k, odds in enumerate(np.rint(kinds.odds.T * 1000.0).astype(np.int64)):  # whole thousandths: sums do not depend on what is summed beside
                told = _offsets(odds[word])
                told = told[1:] - told[begin[text[at]]]
                likely[told > most] = k + 1
                most = np.maximum(most, told)
            seen = np.cumsum(found >= 0) - (found >= 0)
            has = seen > begin[text]
            head[has] += likely[seen[has] - 1] * 8
        got = pa.array(number.astype(np.int64) << 11 | head).dictionary_encode()
        key = got.dictionary.to_numpy()
        return got.indices.to_numpy(), key >> 11, key & 2047

    def tokens(self, token: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with the two bytes before them."""
        size = np.diff(self.off)[token] + 2
        off = _offsets(size)
        out, own = np.empty(off[-1], np.uint8), np.ones(off[-1], bool)
        own[off[:-1]] = own[off[:-1] + 1] = False
        out[off[:-1]], out[off[:-1] + 1] = head >> 3, START + (head & 7)
        out[own] = _gathered(self.flat, self.off[token], size - 2)
        return out, off


class Tokenizer:
    """Cuts a text into tokens, each after two bytes: the kind of the text so far (0: not known), and what stands before the token. The last
    token has the end."""

    def __init__(self, kinds: Kinds):
        self.kinds = kinds

    def __call__(self, text: bytes) -> list[bytes]:
        chunk = Chunk.cut(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        number, token, head = chunk.keyed(self.kinds)
        flat, off = chunk.tokens(token, head)
        return [flat[off[k] : off[k + 1]].tobytes() for k in number]


@dataclass(frozen=True)
class Code:
    """Paths of the 256 symbols through the inner nodes of a Huffman tree."""

    length: np.ndarray
    start: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    #: Of each symbol its place among the leaves from left to right, the symbols in that order, and of two places the bits that both begin with.
    rank: np.ndarray
    leaf: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            new = 256 + len(children)
            children[new] = (x, y)
            heapq.heappush(heap, (a + b, new, new))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
        while stack:
            at, path = stack.pop()
            if at < 256:
                paths[at] = path
            else:
                stack += [(child, [*path, (at - 256, bit)]) for bit, child in enumerate(children[at])]
        length = np.array([len(p) for p in paths])
        leaf = np.array(sorted(range(256), key=lambda k: [b for _, b in paths[k]]))
        same = [next((j for j, (a, b) in enumerate(zip(paths[x], paths[y])) if a[1] != b[1]), len(paths[x])) for x, y in zip(leaf, leaf[1:])]
        common = np.diag(length[leaf]).astype(np.int64)
        for k in range(256):
            common[k, k + 1 :] = common[k + 1 :, k] = np.minimum.accumulate(same[k:]) if k < 255 else []
        rank = np.empty(256, np.uint8)
        rank[leaf] = np.arange(256)
        return cls(length, np.cumsum(length) - length, np.array([n for p in paths for n, _ in p], np.uint64), np.array([b for p in paths for _, b in p], bool), rank, leaf, common)


_known_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse."""
    if not _known_powers or len(_known_powers[0]) < n:
        size = max(n, 1 << 18)
        _known_powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))])) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64))]
    return [p[:n] for p in _known_powers]


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _contexts(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(symbols, contexts as 56-bit numbers) of some tokens with the two bytes before each; these are no symbols."""
    n = len(flat)
    index, begin = np.arange(n), np.repeat(off[:-1], np.diff(off))
    place = index - begin
    wide = flat.astype(np.uint64)
    kind = wide[begin]
    one, two, three = (wide[np.maximum(index - k, 0)] * (place > k) for k in (1, 2, 3))
    power, under = _powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((wide + np.uint64(1)) * power[:n])])
    first = np.minimum(begin + 2, index)  # of the token itself
    so_far = (total[:-1] - total[first]) * under[first]
    so_far[place == 2] = one[place == 2]
    so_far = _spread(so_far)
    two = one | two << np.uint64(8)
    three = two | three << np.uint64(16)
    own = place > 1
    told = [c << np.uint64(8) | kind for c in (two, three)]
    return flat[own], [_spread(c[own] * np.uint64(8) + np.uint64(k)) >> np.uint64(8) for k, c in enumerate((*told, so_far, so_far + kind))]


def _ids(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """48-bit numbers of (context, node)."""
    return _spread(context ^ (node + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)


def _bits(flat: np.ndarray, off: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(number of each token's first bit and the number of all; of every bit: it, its node, its symbol; of every symbol the contexts) of some tokens."""
    sym, contexts = _contexts(flat, off)
    length = code.length[sym]
    first = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(first[-1]) + np.repeat(code.start[sym] - first[:-1], length)
    return first[off - 2 * np.arange(len(off))], code.bits[at], code.nodes[at], np.repeat(np.arange(len(sym)), length), contexts


def _joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (tx.id_crc("doc_id") % 10).cast("int").alias("fold"), tx.as_bytes().alias("text"))


def _chunks(docs: DataFrame) -> DataFrame:
    """Texts cut into tokens, about _CHUNK bytes of text a row: what `Chunk` holds, and the texts' doc_id, fold and bytes."""
    if "number" in docs.columns:
        return docs
    kinds = {"chunk": pa.int64(), "doc_id": pa.list_(pa.int64()), "fold": pa.list_(pa.int32())} | dict.fromkeys(("bytes", *_CHUNK_TYPES), pa.binary())
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            flat, off = tx.blobs(batch.column(2))
            for lo, hi in tx.slices(off, _CHUNK):
                c = Chunk.cut(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                made = {"flat": c.flat, "size": np.diff(c.off), "number": c.number, "many": c.many, "long_flat": c.long_flat, "long_size": np.diff(c.long_off), "long_number": c.long_number}
                ids, folds = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 1))
                yield tx.rows(schema, [n], [ids], [folds], [np.diff(off[lo : hi + 1]).tobytes()], *([_squeezed(made[k].astype(t))] for k, t in _CHUNK_TYPES.items()))
                n += 1

    return docs.select("doc_id", "fold", "text").mapInArrow(run, "chunk long, doc_id array<long>, fold array<int>, " + ", ".join(f"{k} binary" for k in ("bytes", *_CHUNK_TYPES)))


_CHUNK_TYPES = {"flat": np.uint8, "size": np.uint8, "number": np.int32, "many": np.int32, "long_flat": np.uint8, "long_size": np.int64, "long_number": np.int32}


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first all low bytes, then the next: small ones take little room."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _loosened(b: bytes, kind: type) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _ascending(x: np.ndarray) -> bytes:
    """Ascending numbers as their steps."""
    step = np.diff(x, prepend=0)
    return step.astype(np.uint16 if len(x) and step.max() < 1 << 16 else np.uint32).tobytes()


def _ascended(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32), dtype=np.int64)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; of large ones only a few are copied at a time."""
    for batch in batches:
        few = max(1, batch.num_rows * (1 << 20) // max(1, batch.nbytes))
        for lo in range(0, batch.num_rows, few):
            yield from batch.slice(lo, few).to_pylist()


def _chunk_of(row: dict) -> tuple[Chunk, np.ndarray]:
    """(chunk, fold of each of its texts, -1 without doc_id)."""
    x = {k: _loosened(row[k], t) for k, t in _CHUNK_TYPES.items()}
    chunk = Chunk(x["flat"], _offsets(x["size"]), x["number"], x["many"].astype(np.int64), x["long_flat"], _offsets(x["long_size"]), x["long_number"])
    return chunk, np.array([-1 if f is None else f for f in row["fold"]], np.int64)


def _histogram(counted: DataFrame) -> np.ndarray:
    """Counts of the 256 symbols of all training texts, from their tokens."""
    schema = pa.schema([("symbol", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for row in _rows_of(batches):
            flat, off, two = _tokens_of(row)
            n, own = np.repeat(two[:, 0], np.diff(off)), np.ones(len(flat), bool)
            own[off[:-1]] = own[off[:-1] + 1] = False
            total += np.bincount(flat[own], n[own], 256).astype(np.int64)
        yield tx.rows(schema, np.arange(256), total)

    out = np.zeros(256, np.int64)
    for r in counted.select(*_COUNTED).mapInArrow(run, "symbol int, n long").groupBy("symbol").sum("n").collect():
        out[r[0]] = r[1]
    return out


def _word_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """(word, c) of all training texts, and for every chunk rows (chunk, at, value): some numbers of its words as `Chunk.words` gives them, and their counts. Words are dealt by
    their hash, each chunk's once; a task sums those of a part."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("flat", pa.binary()), ("size", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            chunk, fold = _chunk_of(row)
            word, flat, off = chunk.words()
            n = len(off) - 1
            used = np.flatnonzero(np.bincount(word[word >= 0], minlength=n))
            count = np.bincount(word[(word >= 0) & np.repeat(fold > 0, chunk.many)], minlength=n).astype(np.int32)
            part = (_hashes(flat, off) % np.uint64(parts)).astype(np.int16)
            used = used[np.argsort(part[used], kind="stable")]
            cut = np.flatnonzero(np.diff(part[used], prepend=-1, append=-1))
            size = np.diff(off)
            made = [(part[at[0]], row["chunk"], _ascending(at), _gathered(flat, off[at], size[at]).tobytes(), size[at].tobytes(), count[at].tobytes()) for at in (used[lo:hi] for lo, hi in zip(cut, cut[1:]))]
            if made:
                yield tx.rows(schema, *zip(*made))

    schema2 = pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("value", pa.binary()), ("word", pa.binary()), ("c", pa.int64())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            size = [np.frombuffer(r["size"], np.int64) for r in held]
            number, flat, off = _different(np.frombuffer(b"".join(r["flat"] for r in held), np.uint8), _offsets(np.concatenate(size)))
            c = np.bincount(number, np.concatenate([np.frombuffer(r["n"], np.int32) for r in held])).astype(np.int64)
            lo = 0
            for r, k in zip(held, size, strict=True):
                yield tx.rows(schema2, [r["chunk"]], [r["at"]], [c[number[lo : lo + len(k)]].tobytes()], [None], [None])
                lo += len(k)
            kept = np.flatnonzero(c)
            none = pa.nulls(len(kept), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(kept), pa.int64()), none, none, _binaries(flat, off).take(pa.array(kept)), pa.array(c[kept])], schema=schema2)

    made = chunks.mapInArrow(run, "part int, chunk long, at binary, flat binary, size binary, n binary").repartition(1 + parts // 2, "part").sortWithinPartitions("part")
    return tx.stored(made.mapInArrow(whole, "chunk long, at binary, value binary, word binary, c long"), "words")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part, which follow each other."""
    for _, rows in groupby(_rows_of(batches), lambda r: r["part"]):
        yield list(rows)


def _kinds(docs: DataFrame, words: DataFrame, most: int, kinds: int) -> Kinds:
    """Kinds of texts by the `most` most frequent words; the texts with two of them are counted over all training texts."""
    top = sorted(_head(words, most))
    schema, columns = pa.schema([("row", pa.int32()), ("n", pa.binary())]), "row int, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(top), len(top)), np.int64)
        for row in _rows_of(batches):
            chunk, fold = _chunk_of(row)
            word, flat, off = chunk.words()
            found = pc.index_in(_binaries(flat, off), value_set=pa.array(top, pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero((word >= 0) & np.repeat(fold > 0, chunk.many))
            text, found = np.repeat(np.arange(len(fold)), chunk.many)[at], found[word[at]]
            for lo in range(0, len(fold), 2048):
                begin, end = np.searchsorted(text, (lo, lo + 2048))
                own = slice(begin, end)
                has = np.zeros((min(2048, len(fold) - lo), len(top)), np.float32)
                is_top = found[own] >= 0
                has[text[own][is_top] - lo, found[own][is_top]] = 1
                total += (has.T @ has).astype(np.int64)
        yield tx.rows(schema, np.arange(len(top)), [x.tobytes() for x in total])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in _rows_of(batches):
            sums[row["row"]] = sums.get(row["row"], 0) + np.frombuffer(row["n"], np.int64)
        if sums:
            yield tx.rows(schema, list(sums), [x.tobytes() for x in sums.values()])

    together = np.zeros((len(top), len(top)))
    if top:
        for r in _chunks(docs).mapInArrow(run, columns).repartition("row").mapInArrow(whole, columns).collect():
            together[r["row"]] = np.frombuffer(r["n"], np.int64)
    return Kinds.of(top, together, kinds)


def _borders(words: DataFrame, parts: int | None, sample: int = 20_000) -> np.ndarray:
    """Borders that cut tokens in the order of their bytes into `parts` of about equal size, by a hash sample of the words, as they are and capital. They
    only tell which task counts what."""
    n = words.count()
    parts = parts or min(2048, 16 + n // 30_000)
    few = words.where(F.pmod(F.xxhash64("word"), F.lit(1 + n // sample)) == 0).select("word")
    seen = [bytes(r[0][:LONGEST]) for r in few.collect()]
    points = sorted({*seen, *(w.capitalize() for w in seen[::4])})
    return np.array(sorted({points[len(points) * k // parts] for k in range(1, parts)}) if points else [], f"S{LONGEST}")


def _merged_tokens(flat: np.ndarray, off: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat, sizes, counts) of the different tokens among some, in the order of their bytes without the two before them, and the place of each given one there."""
    number, flat, off = _different(flat, off)
    n, size = len(off) - 1, np.diff(off)
    two = np.stack([np.bincount(number, two[:, k], n) for k in (0, 1)], axis=1).astype(np.int64)
    text = np.zeros((n, LONGEST + 3), np.uint8)
    bare = size - 2
    row, place = np.repeat(np.arange(n), bare), np.arange(bare.sum()) - np.repeat(np.cumsum(bare) - bare, bare)
    text[row, place] = flat[np.repeat(off[:-1] + 2, bare) + place]
    text[:, LONGEST], text[:, LONGEST + 1], text[:, LONGEST + 2] = bare, flat[off[:-1]] + 1, flat[off[:-1] + 1]
    by = np.argsort(text.view(f"S{LONGEST + 3}").ravel(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    return _gathered(flat, off[by], size[by]), size[by], two[by], rank[number]


def _token_counts(docs: DataFrame, kinds: Kinds, words: DataFrame, most_tokens: int, parts: int | None = None, every: bool = False) -> DataFrame:
    """Tokens of all training texts (every: of all texts, those of held-out ones alone with counts of 0) with how often they occur, and how often in texts of fold 1: rows (n, tokens, sizes, counts) of many tokens
    each, that follow each other in the order of their bytes (without the two before them). A chunk's different tokens are sent in blocks, one
    for each part of that order (of up to `most_tokens`); a task then merges the blocks of a part. The columns chunks, many, at and place tell of each block its chunk, how many tokens it has here, their
    numbers as `Chunk.keyed` gives them, and their places in the row."""
    borders = _borders(words, parts)
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), *((k, pa.binary()) for k in ("at", "tokens", "sizes", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            chunk, fold = _chunk_of(row)
            number, token, head = chunk.keyed(kinds)
            fold = np.repeat(fold, chunk.many)
            two = np.stack([np.bincount(number[own], minlength=len(token)) for own in (fold > 0, fold == 1)], axis=1)
            n, size = len(chunk.off) - 1, np.diff(chunk.off)
            text = np.zeros((n, LONGEST), np.uint8)
            text[np.repeat(np.arange(n), size), np.arange(len(chunk.flat)) - np.repeat(chunk.off[:-1], size)] = chunk.flat
            part = np.searchsorted(borders, text.view(f"S{LONGEST}").ravel(), "right").astype(np.int16)[token]
            by = np.argsort(part, kind="stable")
            by = by if every else by[two[by, 0] > 0]
            cut = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
            made = []
            for at in (by[k : min(k + most_tokens, hi)] for lo, hi in zip(cut, cut[1:]) for k in range(lo, hi, most_tokens)):
                flat, off = chunk.tokens(token[at], head[at])
                made.append((part[at[0]], row["chunk"], _ascending(at), flat.tobytes(), np.diff(off).astype(np.uint8).tobytes(), two[at].T.astype(np.int32).tobytes()))
            if made:
                yield tx.rows(schema, *zip(*made))

    columns = ("tokens", "sizes", "counts", "chunks", "many", "at", "place")
    schema2 = pa.schema([("n", pa.int64()), *((k, pa.binary()) for k in columns)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            size = np.frombuffer(b"".join(r["sizes"] for r in held), np.uint8).astype(np.int64)
            two = np.concatenate([np.frombuffer(r["counts"], np.int32).reshape(2, -1).T for r in held])
            at = np.concatenate([_ascended(r["at"], len(r["sizes"])) for r in held]).astype(np.int32)
            chunks = np.array([r["chunk"] for r in held], np.int64)
            block = np.repeat(np.arange(len(held)), [len(r["sizes"]) for r in held])
            flat, size, two, place = _merged_tokens(np.frombuffer(b"".join(r["tokens"] for r in held), np.uint8), _offsets(size), two)
            end = _offsets(size)
            for lo in range(0, len(size), _ROW):
                hi = min(len(size), lo + _ROW)
                here = np.flatnonzero((place >= lo) & (place < hi))
                blobs = (size[lo:hi].astype(np.uint8), np.ascontiguousarray(two[lo:hi].T), chunks, np.bincount(block[here], minlength=len(held)), at[here], (place[here] - lo).astype(np.int32))
                yield tx.rows(schema2, [hi - lo], [_blob(flat[end[lo] : end[hi]])], *([_blob(x)] for x in blobs))

    made = _chunks(docs).mapInArrow(run, "part int, chunk long, at binary, tokens binary, sizes binary, counts binary").repartition(1 + len(borders) // 16, "part").sortWithinPartitions("part")
    return tx.stored(made.mapInArrow(whole, "n long, " + ", ".join(f"{k} binary" for k in columns)), "tokens", "none")


#: Columns of counted tokens that the model needs.
_COUNTED = ("tokens", "sizes", "counts")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(key)
    key, n = key[by], n[by]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.intp)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _blob(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unblob(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _packed_counts(four: np.ndarray) -> bytes:
    """Rows of four counts, column by column, so that they compress well."""
    return _blob(np.ascontiguousarray(four.T, np.int64 if four.size and four.max() >= 1 << 32 else np.uint32))


def _counts_of(b: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(b)
    return np.frombuffer(raw, np.uint32 if len(raw) == 16 * n else np.int64).reshape(4, n).T.astype(np.int64)


def _sorted_bits(flat: np.ndarray, off: np.ndarray, code: Code, by_kind: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, common, border): tokens in the order of their bits (by_kind: of their kind first), how many leading bits each has in common with
    the one before it, and how many symbols with the first or the last token as given."""
    n, size = len(off) - 1, np.diff(off)
    text = np.zeros((n, LONGEST + 1), np.uint8)
    text[:, 0] = flat[off[:-1]] if by_kind else 0
    at = np.repeat(off[:-1] + 2, size - 2)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    text[np.repeat(np.arange(n), size - 2), 1 + inner] = code.rank[flat[at + inner]]
    border = np.zeros(n, np.int64)
    for end in (0, n - 1):
        apart = text[:, 1:] != text[end, 1:]
        shared = np.where(apart.any(axis=1), apart.argmax(axis=1), LONGEST)
        border = np.maximum(border, shared)
    order = np.argsort(text.view(f"S{LONGEST + 1}").ravel(), kind="stable")
    text = text[order]
    apart = text[1:] != text[:-1]
    where = apart.argmax(axis=1)
    same = ~apart[np.arange(n - 1), where]
    bits = np.cumsum(code.length[code.leaf[text[:, 1:]]], axis=1)  # past the end of a token it does not matter
    k = np.maximum(where, 1) - 1
    before = np.where(k > 0, bits[np.arange(n - 1), np.maximum(k - 1, 0)], 0)
    common = before + code.common[text[:-1][np.arange(n - 1), k + 1], text[1:][np.arange(n - 1), k + 1]]
    common = np.where(same, 1 << 20, np.where(where == 0, -1, common))
    return order, np.concatenate([[-1], common]), border[order]


def token_nodes(flat: np.ndarray, off: np.ndarray, two: np.ndarray, code: Code, by_kind: bool, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the tokens with counts `two` (all, early), for each bit after their first symbol: (token, bit within it, four counts, whole) of the
    different nodes. All tokens with the symbols before a node are here (it is whole) unless the first or the last token begins with these; whole nodes
    below `level` are left out."""
    order, common, border = _sorted_bits(flat, off, code, by_kind)
    size = np.diff(off)
    length = code.length[flat]
    total = np.concatenate([[0], np.cumsum(length)])
    n_bits = (total[off[1:]] - total[off[:-1] + 2])[order]
    begin = length[off[:-1] + 2][order]
    inside = total[np.minimum(off[:-1][order] + 3 + border, off[1:][order])] - total[off[:-1] + 2][order]
    at = np.repeat(code.start[flat] - total[:-1], length) + np.arange(total[-1])
    bit, start = code.bits[at], total[off[:-1] + 2][order]
    two = two[order]
    act = np.flatnonzero(n_bits > begin)
    b = int(begin[act].min()) if len(act) else 0
    while len(act):
        new = common[act] < b
        new[0] = True
        first = np.flatnonzero(new)
        w = two[act]
        on = w * bit[start[act] + b][:, None]
        sums, ones = np.add.reduceat(w, first), np.add.reduceat(on, first)
        four = np.stack([sums[:, 0] - ones[:, 0] - sums[:, 1] + ones[:, 1], ones[:, 0] - ones[:, 1], sums[:, 1] - ones[:, 1], ones[:, 1]], axis=1)
        one_of = act[first]
        is_whole = inside[one_of] <= b
        keep = (begin[one_of] <= b) & (sums[:, 0] > 0) & (~is_whole | (_level(sums[:, 0]) >= level))
        yield order[one_of[keep]], np.full(int(keep.sum()), b), four[keep], is_whole[keep]
        # what lies below a node has no larger count
        stay = np.repeat(~is_whole | (_level(sums[:, 0]) >= level), np.diff(np.append(first, len(act))))
        b += 1
        act = act[stay & (n_bits[act] > b)]


#: No cell that `pack` gives: the table has it.
_TABLE = np.uint16(0xFFFF)
#: Above every level of counts.
_NO_LEVEL = 1 << 30


def own_cells(flat: np.ndarray, off: np.ndarray, two: np.ndarray, code: Code, by_kind: bool, early: bool) -> np.ndarray:
    """Of every bit of some tokens in the order of their bytes, the cell of its node from the counts of these tokens, or _TABLE: in the first symbol, and where other tokens may begin with the
    same symbols as the first or the last one here."""
    order, common, border = _sorted_bits(flat, off, code, by_kind)
    length = code.length[flat]
    total = np.concatenate([[0], np.cumsum(length)])
    start, begin = total[off[:-1] + 2], length[off[:-1] + 2]
    n_bits = total[off[1:]] - start
    dense = np.cumsum(n_bits) - n_bits
    place = np.arange(n_bits.sum()) - np.repeat(dense, n_bits)
    full = code.bits[np.repeat(code.start[flat] - total[:-1], length) + np.arange(total[-1])]
    bit = full[place + np.repeat(start, n_bits)]
    n = two[:, 0] if early else two[:, 0] - two[:, 1]
    none = np.zeros(len(n), np.int64)
    # what a token has alone; nodes of several follow
    out = np.where(bit, np.repeat(pack(none, n), n_bits), np.repeat(pack(n, none), n_bits))
    out[place < np.repeat(begin, n_bits)] = _TABLE
    inside = (total[np.minimum(off[:-1][order] + 3 + border, off[1:][order])] - start[order])
    n, dense, begin, n_bits = n[order], dense[order], begin[order], n_bits[order]
    act = np.flatnonzero(n_bits > begin)
    b = int(begin[act].min()) if len(act) else 0
    while len(act):
        new = common[act] < b
        new[0] = True
        first = np.flatnonzero(new)
        at = dense[act] + b
        sums, ones = np.add.reduceat(n[act], first), np.add.reduceat(n[act] * bit[at], first)
        whole = inside[act[first]] <= b
        many = np.diff(np.append(first, len(act)))
        own = begin[act] <= b
        out[at[own]] = np.repeat(np.where(whole, pack(sums - ones, ones), _TABLE), many)[own]
        stay = np.repeat((many > 1) | ~whole, many)
        b += 1
        act = act[stay & (n_bits[act] > b)]
    return out


class Block:
    """Tokens in the order of their bytes with their counts, and what the nodes of each have seen: those of the token so far from the block itself, whatever their number, others from the model's tables."""

    def __init__(self, model: MixModel, flat: np.ndarray, off: np.ndarray, two: np.ndarray, early: bool):
        self.model, self.flat, self.off, self.two = model, flat, off, two
        self.cells = [own_cells(flat, off, two, model.code, by_kind, early) for by_kind in (False, True)]
        total = np.concatenate([[0], np.cumsum(model.code.length[flat])])
        n_bits = total[off[1:]] - total[off[:-1] + 2]
        self.first = np.cumsum(n_bits) - n_bits

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(self.off)[which]
        off = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(off[-1]) + np.repeat(self.off[which] - off[:-1], size)], off

    def inputs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """MixModel.inputs of some of the tokens."""

        def own(first: np.ndarray) -> list[np.ndarray]:
            at = np.arange(first[-1]) + np.repeat(self.first[which] - first[:-1], np.diff(first))
            return [c[at] for c in self.cells]

        return self.model.looked_up(*self.keys(which), own)


def _tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = _unblob(row["sizes"], np.uint8).astype(np.int64)
    return _unblob(row["tokens"], np.uint8), np.concatenate([[0], np.cumsum(size)]), _unblob(row["counts"], np.int64).reshape(2, -1).T


def least_level(counted: DataFrame, code: Code, most_nodes: int) -> int:
    """The least level of counts so that up to `most_nodes` whole nodes of tokens so far (without and with a kind) have it."""
    schema = pa.schema([("level", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, off, two = _tokens_of(row)
                found = np.zeros(1 << 11, np.int64)
                for by_kind in (False, True):
                    for _, _, four, whole in token_nodes(flat, off, two, code, by_kind, 1):
                        found += np.bincount(_level(four[whole].sum(axis=1)), minlength=len(found))
                full = np.flatnonzero(found)
                yield tx.rows(schema, full, found[full])

    level, kept = 1, 0  # nodes seen once say little
    for r in sorted(counted.select(*_COUNTED).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["level"]):
        kept += r["n"]
        if kept > most_nodes:
            return r["level"] + 1
    return level


def _nodes(counted: DataFrame, code: Code, level: int) -> DataFrame:
    """kind, shard, n, ids, counts: of the n different (context, node) of a kind whose 48-bit numbers begin with the byte `shard`, the rest of
    these numbers, and four counts each: bits 0 and 1 outside fold 1, then in it. One row for each kind and shard."""
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
    columns = "kind int, shard int, n long, ids binary, counts binary"

    def emit(kind: int, key: np.ndarray, four: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(key)
        key, four = key[by], four[by]
        cut = np.searchsorted(key, np.arange(257, dtype=np.uint64) << np.uint64(40))
        full = np.flatnonzero(np.diff(cut))
        low = np.uint64((1 << 40) - 1)
        return tx.rows(schema, [kind] * len(full), full, np.diff(cut)[full], [_blob(key[cut[j] : cut[j + 1]] & low) for j in full], [_packed_counts(four[cut[j] : cut[j + 1]]) for j in full])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(KINDS)]
        for batch in batches:
            for row in batch.to_pylist():
                flat, off, two = _tokens_of(row)
                sym, contexts = _contexts(flat, off)
                size = np.diff(off) - 2
                of, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                for kind, c in enumerate(contexts):
                    pick = slice(None) if kind < KINDS - 2 else start
                    pairs[kind].append(_summed([c[pick] << np.uint64(8) | sym[pick]], [two[of[pick]]]))
                    if sum(len(k) for k, _ in pairs[kind]) > _SUMMED:
                        pairs[kind] = [_summed(*map(list, zip(*pairs[kind])))]
                length = code.length[sym]
                total = np.concatenate([[0], np.cumsum(length)])
                symbol_of = np.repeat(np.arange(len(sym)), length)
                for kind in (KINDS - 2, KINDS - 1):
                    found = list(token_nodes(flat, off, two, code, kind == KINDS - 1, level))
                    if found:
                        token, b, four, _ = (np.concatenate(x) for x in zip(*found))
                        at = total[start[token]] + b
                        s = symbol_of[at]
                        yield emit(kind, _ids(contexts[kind][s], code.nodes[code.start[sym[s]] + at - total[s]]), four)
        for kind, parts in enumerate(pairs):
            if parts:
                key, two = _summed(*map(list, zip(*parts)))
                sym, c = (key & np.uint64(255)).astype(np.intp), key >> np.uint64(8)
                length = code.length[sym]
                at = np.arange(length.sum()) + np.repeat(code.start[sym] - np.cumsum(length) + length, length)
                four = np.zeros((len(at), 4), np.int64)
                w, one = np.repeat(two, length, axis=0), code.bits[at].astype(np.intp)
                four[np.arange(len(at)), one] = w[:, 0] - w[:, 1]
                four[np.arange(len(at)), 2 + one] = w[:, 1]
                yield emit(kind, *_summed([_ids(np.repeat(c, length), code.nodes[at])], [four]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, ([], []), 0

        def finish() -> pa.RecordBatch:
            key, four = _summed(*held)
            return tx.rows(schema, [now[0]], [now[1]], [len(key)], [_blob(key)], [_packed_counts(four)])

        for batch in batches:
            for kind, shard, n, ids, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (kind, shard) != now:
                    if now is not None:
                        yield finish()
                    now, held, size = (kind, shard), ([], []), 0
                held[0].append(_unblob(ids, np.uint64))
                held[1].append(_counts_of(counts, n))
                size += n
                if size > _SUMMED:
                    held = tuple([x] for x in _summed(*held))
                    size = 0
        if now is not None:
            yield finish()

    return counted.select(*_COUNTED).mapInArrow(part, columns).repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(whole, columns)


def table_sizes(nodes: DataFrame) -> tuple[int, ...]:
    """Cells of each table: a power of two, at least four for each node."""
    n = {r[0]: r[1] for r in nodes.groupBy("kind").agg(F.sum("n")).collect()}
    return tuple(max(least, 1 << max(0, 4 * n.get(k, 0) - 1).bit_length()) for k, least in enumerate(CELLS))


def _level(counts: np.ndarray) -> np.ndarray:
    """32 levels for each doubling."""
    return np.floor(32 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def _packed(nodes: DataFrame, sizes: tuple[int, ...], early: bool) -> np.ndarray:
    """The tables of MixModel, with or without the counts of fold 1. Tasks pack their shards; the driver puts them side by side."""
    schema = pa.schema([("at", pa.int64()), ("cells", pa.binary())])
    start = np.cumsum((0, *sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, shard, n, ids, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                wide = sizes[kind] >> 8
                four = _counts_of(counts, n)
                cell = (_unblob(ids, np.uint64) >> np.uint64(40 - (wide.bit_length() - 1))).astype(np.intp)
                zero, one = (np.bincount(cell, four[:, b] + four[:, 2 + b] * early, wide) for b in (0, 1))
                yield tx.rows(schema, [start[kind] + shard * wide], [pack(zero, one).tobytes()])

    out = np.full(start[-1], pack(np.zeros(1), np.zeros(1))[0], np.uint16)
    rows = nodes.select("kind", "shard", "n", "ids", "counts").mapInArrow(run, "at long, cells binary")
    for r in rows.coalesce(1 + int(start[-1] >> 22)).toLocalIterator():
        v = np.frombuffer(r["cells"], np.uint16)
        out[r["at"] : r["at"] + len(v)] = v
    return out


def pack(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of each cell, the log-odds of bit 1 in 4096 steps from -16 to 16, and in the last three bits how much it has seen."""
    odds = np.clip(np.log((one + 0.1) / (zero + 0.1)), -15.99, 15.99)
    seen = np.minimum(7, np.log2(1 + zero + one) / 1.5).astype(np.uint16)
    return np.round((odds + 16) * 128).astype(np.uint16) * np.uint16(8) + seen


@dataclass(frozen=True)
class MixModel:
    code: Code
    packed: np.ndarray  # cells of all tables as `pack` gives them
    weights: np.ndarray  # (gates, inputs)
    sizes: tuple[int, ...] = CELLS

    def __reduce__(self):  # most cells are empty
        return _restored, (self.code, zlib.compress(self.packed.tobytes(), 1), self.weights, self.sizes)

    @classmethod
    def of(cls, code: Code, packed: np.ndarray, sizes: tuple[int, ...]) -> MixModel:
        return cls(code, packed, np.tile(np.array(_WEIGHTS, np.float32), (_GATES, 1)), sizes)

    def inputs(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(number of each token's first bit, bit, inputs in 128ths, gate) of every bit of some tokens."""
        return self.looked_up(*_joined(keys), None)

    def looked_up(self, flat: np.ndarray, off: np.ndarray, own: Callable[[np.ndarray], list[np.ndarray]] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """The inputs of some tokens; `own` gives, of the numbers of first bits, the cells of the last two contexts that are known without the tables."""
        first, bit, node, of, contexts = _bits(flat, off, self.code)
        found, start = own(first) if own else [], 0
        found = [None] * (KINDS - len(found)) + found
        for k, size in enumerate(self.sizes):
            which = slice(None) if found[k] is None else np.flatnonzero(found[k] == _TABLE)
            cells = self.packed[(_ids(contexts[k][of[which]], node[which]) >> np.uint64(48 - (size.bit_length() - 1))).astype(np.intp) + start]
            if found[k] is None:
                found[k] = cells
            else:
                found[k][which] = cells
            start += size
        gate = (found[-2] & np.uint16(7)) * np.uint16(8) + (found[-1] & np.uint16(7))
        return first, bit, [(f >> np.uint16(3)).astype(np.int16) - np.int16(2048) for f in found], gate

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.weights[:, -1][gate]
        for k, v in enumerate(x):
            z += (self.weights[:, k] * np.float32(1 / 128))[gate] * v
        return z

    def costs(self, keys: list[bytes]) -> np.ndarray:
        """What each token costs, in nats."""
        return self.cost_of(*self.inputs(keys))

    def cost_of(self, first: np.ndarray, bit: np.ndarray, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = self.mixed(x, gate)
        return np.add.reduceat(np.log1p(np.exp(np.minimum(np.where(bit, -z, z), np.float32(60)))), first[:-1], dtype=np.float64)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        out = self[key] = len(self)
        return out


class Scorer:
    """Scores texts under a model; the costs of `most` tokens are kept."""

    def __init__(self, model: MixModel, most: int = 300_000):
        self.model, self.most = model, most
        self.ids = _Numbers()
        self.cost = np.zeros(1 << 16)

    def number(self, keys: list[bytes]) -> np.ndarray:
        """Numbers of some tokens, whose costs stand in `cost`. Numbers given before may become void."""
        if len(self.ids) >= self.most:
            self.ids.clear()
        had, ids = len(self.ids), self.ids
        out = np.array(list(map(ids.__getitem__, keys)), np.int64)
        if len(ids) > had:
            new = list(islice(reversed(ids), len(ids) - had))[::-1]
            while len(self.cost) < len(ids):
                self.cost = np.concatenate([self.cost, np.zeros_like(self.cost)])
            for lo in range(0, len(new), 1 << 13):
                part = new[lo : lo + (1 << 13)]
                self.cost[had + lo : had + lo + len(part)] = self.model.costs(part)
        return out

    def score(self, texts: list[list[bytes]], longest: int = 1 << 16) -> np.ndarray:
        """log10 probability of each text, given as its tokens. A text of more than `longest` tokens is scored in pieces."""
        total = np.zeros((len(_SHARES), len(texts)))
        usual = [k for k, t in enumerate(texts) if 0 < len(t) <= longest]
        if usual:
            total[:, usual] = self._blends([texts[k] for k in usual], 0, None)
        for k in (k for k, t in enumerate(texts) if len(t) > longest):
            seen: Counter = Counter()
            for lo in range(0, len(texts[k]), longest):
                part = texts[k][lo : lo + longest]
                total[:, k] += self._blends([part], lo, seen)[:, 0]
                seen.update(part)
        total += np.log(_TRUST)[:, None]
        top = total.max(axis=0)
        # the product of what the blends foretell, each weighted by what it has foretold before, is the weighted mean of their products
        return (top + np.log(np.exp(total - top).sum(axis=0))) / math.log(10) * (np.array([len(t) for t in texts]) > 0)

    def _blends(self, texts: list[list[bytes]], begun: int, seen: Counter | None) -> np.ndarray:
        """log probability of each text under each blend; `begun` tokens stand before it, counted in `seen`."""
        keys = [t for text in texts for t in text]
        number = self.number(keys)
        length = np.array([len(t) for t in texts])
        off = np.cumsum(length) - length
        place = np.arange(len(keys)) - np.repeat(off, length)
        # how often the token stands before in its text
        own = np.repeat(np.arange(len(texts)), length) * (int(number.max()) + 1) + number
        by = np.argsort(own, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = own[by][1:] != own[by][:-1]
        start = np.flatnonzero(new)
        before = np.empty(len(by), np.int64)
        before[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
        if seen:
            before += np.array([seen[k] for k in keys], np.int64)
        model = -self.cost[number]
        place += begun
        again = np.log(np.maximum(before, 1e-300) / np.maximum(place, 1))
        out = [np.add.reduceat(model, off)]
        for share in _SHARES[1:]:
            blend = np.where(place > 0, np.logaddexp(model + math.log1p(-share), np.where(before > 0, again + math.log(share), -np.inf)), model)
            out.append(np.add.reduceat(blend, off))
        return np.stack(out)


def _restored(code: Code, packed: bytes, weights: np.ndarray, sizes: tuple[int, ...]) -> MixModel:
    return MixModel(code, np.frombuffer(zlib.decompress(packed), np.uint16), weights, sizes)


def _learn_weights(counted: DataFrame, model: MixModel, step: float = 0.3) -> np.ndarray:
    """Gated weights learned online by every task on its tokens of fold 1 in a mixed order, averaged by how often each gate was used."""
    sent = counted.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("gate", pa.int32()), ("used", pa.float64()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        w, used = m.weights.copy(), np.zeros(_GATES)
        for batch in batches:
            for row in batch.to_pylist():
                flat, off, two = _tokens_of(row)
                block = Block(m, flat, off, two, False)
                which = np.random.default_rng(len(two)).permutation(np.flatnonzero(two[:, 1]))
                for lo in range(0, len(which), 500):
                    part = which[lo : lo + 500]
                    first, bit, x, g = block.inputs(part)
                    n = np.repeat(two[part, 1].astype(np.float32), np.diff(first))
                    xs = [*(v * np.float32(1 / 128) for v in x), np.float32(1)]
                    z = sum(w[:, k][g] * v for k, v in enumerate(xs))
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    err = bit - p
                    curve = p * (1 - p) + err * err  # sure and wrong predictions must not overshoot
                    for k, v in enumerate(xs):
                        w[:, k] += step * np.bincount(g, n * err * v, _GATES) / (np.bincount(g, n * curve * v * v, _GATES) * (len(xs) if k < len(xs) - 1 else 1) + 50)
                    used += np.bincount(g, n, _GATES)
        yield tx.rows(schema, np.arange(_GATES), used, [list(map(float, v)) for v in w * used[:, None]])

    n = model.weights.shape[1]
    got = counted.select(*_COUNTED).mapInArrow(run, "gate int, used double, sums array<double>").groupBy("gate").agg(F.sum("used").alias("used"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(n))).collect()
    out = model.weights.copy()
    for r in got:
        if r["used"] > 0:
            out[r["gate"]] = [r[f"s{k}"] / r["used"] for k in range(n)]
    sent.destroy()
    return out


def _costs(counted: DataFrame, model: MixModel) -> DataFrame:
    """Rows (chunk, at, value): some numbers of a chunk's different tokens as `Chunk.keyed` gives them, and their costs (in nats). Every different token is spelled once."""
    sent = counted.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            flat, off, two = _tokens_of(row)
            block, cost = Block(sent.value, flat, off, two, True), np.empty(len(two), np.float32)
            for lo in range(0, len(two), 1 << 13):
                part = np.arange(lo, min(len(two), lo + (1 << 13)))
                cost[part] = sent.value.cost_of(*block.inputs(part))
            chunks, end = _unblob(row["chunks"], np.int64), _offsets(_unblob(row["many"], np.int64))
            at, place = (_unblob(row[k], np.int32) for k in ("at", "place"))
            yield tx.rows(schema, *zip(*((c, _ascending(at[lo:hi]), cost[place[lo:hi]].tobytes()) for c, lo, hi in zip(chunks.tolist(), end, end[1:]))))

    return tx.stored(counted.mapInArrow(run, "chunk long, at binary, value binary"), "costs", "none")


def blend_sums(number: np.ndarray, many: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """log probabilities of texts under each blend; texts as `many` numbers of tokens each, `cost` by number."""
    text = np.repeat(np.arange(len(many)), many)
    first = np.cumsum(many) - many
    own = text * len(cost) + number
    by = np.argsort(own, kind="stable")
    start = np.flatnonzero(np.diff(own[by], prepend=-1))
    before = np.empty(len(by), np.int64)
    before[by] = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    model = -cost[number].astype(np.float64)
    again = np.flatnonzero(before)
    told, of = before[again] / (again - first[text[again]]), text[again]
    plain, p = np.add.reduceat(model, first), np.exp(model[again])
    out = [plain]
    for share in _SHARES[1:]:
        out.append(plain + math.log1p(-share) * (many - 1 - np.bincount(of, minlength=len(many))) + np.bincount(of, np.log((1 - share) * p + share * told) - model[again], len(many)))
    return np.stack(out)


def tokens_before(texts: list[list[bytes]], cost: dict[bytes, float]) -> tuple[np.ndarray, list[tuple[int, bytes, list[float]]]]:
    """(log probabilities of the texts under each blend, as far as they are known, rest): of the tokens in `cost` all; of every other one that stands in a text, the rest has
    (text, token, logs of the shares for `_blended`), which lacks its cost alone."""
    numbers = _Numbers()
    length = np.array([len(t) for t in texts])
    number = np.array([numbers[t] for text in texts for t in text], np.int64)
    off = np.cumsum(length) - length
    text = np.repeat(np.arange(len(texts)), length)
    place = np.arange(len(number)) - np.repeat(off, length)
    by = np.argsort(text * (len(numbers) + 1) + number, kind="stable")
    own = text[by] * (len(numbers) + 1) + number[by]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    many = np.diff(np.append(start, len(by)))
    before = np.empty(len(by), np.int64)
    before[by] = np.arange(len(by)) - np.repeat(start, many)
    names = list(numbers)
    model = -np.array([cost.get(t, np.nan) for t in names])[number] if names else np.zeros(0)
    known = ~np.isnan(model)
    again = np.log(np.maximum(before, 1e-300) / np.maximum(place, 1))
    out = np.empty((len(_SHARES), len(texts)))
    for k, share in enumerate(_SHARES):
        ahead = np.where(place > 0, math.log1p(-share), 0.0)
        blend = np.where(known, model, 0.0) + ahead
        if share:
            blend = np.where(before > 0, np.where(known, np.logaddexp(blend, again + math.log(share)), 0.0), blend)
        out[k] = np.bincount(text, blend, len(texts))
    new = ~known[by[start]]
    rest = [(t, names[n], again[by[lo + 1 : lo + m]].tolist() if m > 1 else []) for t, n, lo, m in zip(text[by[start[new]]].tolist(), number[by[start[new]]].tolist(), start[new].tolist(), many[new].tolist())]
    return out, rest


def _head(words: DataFrame, most: int, value: str = "c") -> dict[bytes, int]:
    """`value` of up to `most` of the most frequent words; a histogram tells from which count on they are taken."""
    level = F.floor(32 * F.log2("c")).cast("int")
    least, kept = None, 0
    for r in sorted(words.where("c > 0").groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        kept += r["count"]
        if kept > most:
            break
        least = r["level"]
    return {bytes(r["word"]): r[value] for r in words.where(level >= least).collect()} if least is not None else {}


def lm_scores(docs: DataFrame, *, most_words: int = 200_000, head_words: int = 200_000, head_tokens: int = 200_000, kind_words: int = 512, text_kinds: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    most_words: tokens of a chunk that travel in one row. kind_words, text_kinds: the frequent words that tell the kind of a text, and the number of kinds.
    head_words, head_tokens: without effect, kept for callers. (Frequent words and tokens were sent to every task; now every chunk gets what it needs.)
    """
    chunks = tx.stored(_chunks(_texts(docs)), "chunks", "none")
    n_chunks = chunks.count()
    words = _word_counts(chunks, min(2048, 16 + n_chunks // 2))
    counts = words.where("word is not null").select("word", "c")
    kinds = _kinds(chunks, counts, kind_words, text_kinds)
    counted = _token_counts(chunks, kinds, counts, most_words, every=True)
    histogram = _histogram(counted)
    code, ends = Code.of(histogram), int(histogram[END])
    nodes = tx.stored(_nodes(counted, code, _NO_LEVEL), "contexts", "none")
    sizes = table_sizes(nodes)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, n_kinds = sums[0] + ends, sums[1] + (ends > 0)
    weights = _learn_weights(counted, MixModel.of(code, _packed(nodes, sizes, early=False), sizes)).astype(np.float32)
    costs = _costs(counted, MixModel(code, _packed(nodes, sizes, early=True), weights, sizes))
    tx.discard(counted)
    tx.discard(nodes)
    below = n_all + 0.1 * (n_kinds + 1)
    end = math.log10((ends + 0.1) / below)
    schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows_of(batches):
            if row["what"] < 2:
                held.append(row)
                continue
            chunk, _ = _chunk_of(row)
            number, token, _ = chunk.keyed(kinds)
            word, _, off = chunk.words()
            cost, c = np.zeros(len(token), np.float32), np.zeros(len(off) - 1, np.int64)
            for r in held:
                if r["chunk"] == row["chunk"]:
                    into = (cost, c)[r["what"]]
                    value = np.frombuffer(r["value"], into.dtype)
                    into[_ascended(r["at"], len(value))] = value
            held = []
            base, first = np.log10((c + 0.1) / below), _offsets(chunk.many)
            for lo, hi in tx.slices(first, _PART):
                many, own = chunk.many[lo:hi], slice(first[lo], first[hi])
                at = np.flatnonzero(word[own] >= 0)
                text, w = np.repeat(np.arange(hi - lo), many)[at], word[own][at]
                # the product of what the blends foretell, each weighted by what it has foretold before, is the weighted mean of their products
                total = blend_sums(number[own], many, cost) + np.log(_TRUST)[:, None]
                top = total.max(axis=0)
                score = (top + np.log(np.exp(total - top).sum(axis=0))) / math.log(10)
                n_bytes = np.frombuffer(row["bytes"], np.int64)[lo:hi]
                n_words, n_known = (np.bincount(x, minlength=hi - lo) for x in (text, text[c[w] > 0]))
                yield tx.rows(schema, row["doc_id"][lo:hi], row["fold"][lo:hi], n_bytes, n_words, n_known, np.bincount(text, base[w], hi - lo), score)

    told = [t.select("chunk", F.lit(k).alias("what"), "at", "value") for k, t in enumerate((costs, words.where("chunk is not null")))]
    all_ = told[0].union(told[1]).unionByName(chunks.withColumn("what", F.lit(2)), allowMissingColumns=True)
    out = all_.repartition(1 + n_chunks // 2, "chunk").sortWithinPartitions("chunk", "what").mapInArrow(run, "doc_id long, fold int, n_bytes long, n_words long, n_known long, base double, score double")
    return out.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end)).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(tx.documents(spark, sf_dir))
