"""Alignment of the tokens of two tokenizers over the same texts (operator 12).

Two tokens are linked where their byte ranges overlap. Union-find over this bipartite graph gives its connected components; as both tokenizers cover the
text without gaps, these are exactly the minimal groups, between places where tokens of both end. The members of a component expand into its links. Spark then
counts for every pair of ids the documents that link it, finds the highest count of every A id, and joins both back to the documents' links.

Texts are read in units that start at a space or a line feed after another character. Neither tokenizer joins anything across such a place (this is tested
on the files when they are read; where a file does not promise it, a text is one unit), so a unit is aligned once and kept in a bounded cache.

Edge cases: a null or empty text has no tokens; neither has one whose tokens, joined, are not the bytes of a space and the text (it has U+2581, say): all
numbers are 0 and the digest is ''. Very long texts and units take time and memory in proportion to their length; units over `LONG` characters are not kept.
Ties: every link with its A id's highest count is a best one. Repeated rows are documents of their own and count each. A table without rows gives none. Further
columns of the input are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx
from barloom.llm.sstable import WordEncoder

SPACE = "▁"
#: Longest unit that is kept, units kept in each of two generations, and pairs of ids whose counts are broadcast (24 bytes each); more are shuffled.
LONG, MOST_UNITS, MOST_PAIRS = 200, 200_000, 1_000_000
#: White space other than the space and the line feed.
_ODD_SPACE = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace()) - {" ", "\n"}
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every pair of tokens whose ranges overlap, in order; both arrays of ends rise to the same last end."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, by union-find over all edges (u, v) at once: roots are hooked to smaller roots, then paths are compressed."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


class Aligner:
    """Groups and links of texts by a `tokenizers` file (A, of a space and the text) and a SentencePiece model (B, which adds that space)."""

    def __init__(self, a_file: str, b_file: str, most_units: int = MOST_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in WordEncoder._byte_chars().items()}
        a_bytes = {k: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, k in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(k, b"") for k in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        #: Lengths of the tokens, and ids as text with what can follow them: another id of the group, the other side, the next group, the unit's end.
        self.a_size, self.b_size = (np.array([*map(len, x)]) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([[b"%d%s" % (k, end) for k in range(len(x))] for end in ends], object) for x, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";", b""))))
        self.mark = self.b.piece_to_id(SPACE)
        parts = json.loads(self.a.to_str())
        level = parts.get("pre_tokenizer") or {}
        plain = not parts["normalizer"] and not parts["post_processor"] and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, True)
        self.in_units = plain and self.mark != self.b.unk_id() and not any("\n" in p or SPACE in p.lstrip(SPACE) for k, p in enumerate(pieces) if not self.b.is_control(k))
        self.most, self.young, self.old = most_units, {}, {}

    def units(self, text: str) -> list[str]:
        """The units of a text. Their names: without the first space, or with a line feed in front; where other white space plays a part, a carriage
        return and the whole unit."""
        s = " " + text
        if not self.in_units:
            return ["\r" + s]
        if _ODD_SPACE.isdisjoint(s) and not any(p in s for p in ("  ", " \n", "\n ", "\n\n")) and s[-1] not in " \n":
            return s[1:].replace("\n", " \n").split(" ")
        return ["\r" + u for u in _CUT.split(s)]

    @staticmethod
    def named(unit: str) -> str:
        return unit[1:] if unit[0] == "\r" else unit if unit[0] == "\n" else " " + unit

    def _aligned(self, raw: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple[bytes, bytes, bytes] | None]:
        """Of every unit (n_a, n_b, n_groups and n_links; groups as text; pairs a * 2**32 + b of all links), or none if its tokens are not its bytes."""
        want = [r.encode("utf-8", "replace") for r in raw]
        a_of, b_of = self.a_bytes, self.b_bytes
        good = [b"".join([a_of[k] for k in x]) == w == b"".join([b_of[k] for k in y]) for x, y, w in zip(a, b, want, strict=True)]
        out: list[tuple[bytes, bytes, bytes] | None] = [None] * len(raw)
        a, b, at = ([x for x, g in zip(every, good, strict=True) if g] for every in (a, b, range(len(raw))))
        if not at:
            return out
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ia, ib = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        a_ends, b_ends = np.cumsum(self.a_size[ia]), np.cumsum(self.b_size[ib])
        i, j = overlaps(a_ends, b_ends)
        # every component has an A token, so its least node is its first A token; units end where both sides do, so none is joined with the next
        root = components(i, len(ia) + j, len(ia) + len(ib))
        first = root[: len(ia)] == np.arange(len(ia))
        a_group = np.cumsum(first) - 1
        b_group = a_group[root[len(ia) :]]
        a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
        n_groups = np.diff(a_group[a_stop - 1] + 1, prepend=0)
        links = np.searchsorted(i, a_stop - 1, "right")
        # a group's A ids stand before its B ids
        a_last, b_last = np.append(first[1:], True), np.append(b_group[1:] != b_group[:-1], True)
        b_kind = b_last.astype(int)
        b_kind[b_stop - 1] = 2
        stream = np.empty(len(ia) + len(ib), object)
        stream[np.arange(len(ia)) + np.searchsorted(b_group, a_group)] = self.a_text[a_last.astype(int), ia]
        stream[np.arange(len(ib)) + np.searchsorted(a_group, b_group, "right")] = self.b_text[b_kind, ib]
        parts, stop = stream.tolist(), (a_stop + b_stop).tolist()
        heads = np.stack([n_a, n_b, n_groups, np.diff(links, prepend=0)], axis=1).astype(np.int64).tobytes()
        pairs, links = (ia[i] << 32 | ib[j]).tobytes(), (8 * links).tolist()
        lo = link = 0
        for k, (unit, hi, end) in enumerate(zip(at, stop, links, strict=True)):
            out[unit] = heads[32 * k : 32 * k + 32], b"".join(parts[lo:hi]), pairs[link:end]
            lo, link = hi, end
        return out

    def learn(self, units: Iterable[str]) -> dict[str, tuple[bytes, bytes, bytes] | None]:
        """What is known of each unit; new ones are aligned, many at once."""
        units, young, old = list(units), self.young, self.old
        new = [u for u in units if u not in young and u not in old]
        raw = [self.named(u) for u in new]
        # a unit with a space in front gets that space from the model; before others its mark goes
        spaced = [r[0] == " " for r in raw]
        b_ids = self.b.encode([r[1:] if s else r for r, s in zip(raw, spaced, strict=True)], num_threads=1)
        b_ids = [[self.mark] if r == " " else b if s else b[1:] for r, s, b in zip(raw, spaced, b_ids, strict=True)]
        made = dict(zip(new, self._aligned(raw, [e.ids for e in self.a.encode_batch_fast(raw, add_special_tokens=False)], b_ids), strict=True))
        found = {u: young[u] if u in young else old[u] if u in old else made[u] for u in units}
        young.update((u, e) for u, e in found.items() if len(u) <= LONG)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return found

    def whole(self, text: str) -> tuple[bytes, bytes, bytes] | None:
        """A whole text as one unit."""
        b = self.b.encode(text, num_threads=1)
        return self._aligned([" " + text], [self.a.encode(" " + text, add_special_tokens=False).ids], [b])[0]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligned(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (different pairs of linked ids, a * 2**32 + b) with times (their links) of every row."""
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in numbers), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def lists(parts: list[np.ndarray], kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligners.get((a_file, b_file)) or _aligners.setdefault((a_file, b_file), Aligner(a_file, b_file))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            _, off = tx.blobs(batch.column(1))
            for lo, hi in tx.slices(off, 1 << 21):
                texts = [b.decode("utf-8", "replace") for b in batch.column(1).slice(lo, hi - lo).to_pylist()]
                split = [aligner.units(t) if t else [] for t in texts]
                known = aligner.learn(set().union(*split))
                heads, digests, pairs, times = [], [], [], []
                for text, units in zip(texts, split, strict=True):
                    count = Counter(units)
                    own = [known[u] for u in count]
                    if None in own:
                        whole = aligner.whole(text)
                        units, own, count = ([0], [whole], {0: 1}) if whole else ([], [], {})
                        groups = [whole[1]] if whole else []
                    else:
                        groups = [known[u][1] for u in units]
                    if not units:
                        heads.append([0, 0, 0, 0])
                        digests.append("")
                        pairs.append(np.zeros(0, np.int64))
                        times.append(np.zeros(0, np.int32))
                        continue
                    each = np.fromiter(count.values(), np.int64, len(count))
                    head = np.frombuffer(b"".join([e[0] for e in own]), np.int64).reshape(-1, 4)
                    code, place = np.unique(np.frombuffer(b"".join([e[2] for e in own]), np.int64), return_inverse=True)
                    heads.append(each @ head)
                    digests.append(hashlib.sha256(b";".join(groups)).hexdigest())
                    pairs.append(code)
                    times.append(np.bincount(place, np.repeat(each, head[:, 3])).astype(np.int32))
                rows = pa.array(np.arange(row, row + hi - lo))
                row += hi - lo
                made = [pa.array(c, pa.int64()) for c in np.array(heads, np.int64).reshape(-1, 4).T]
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(lo, hi - lo), *made, pa.array(digests, pa.string()), lists(pairs, pa.int64()), lists(times, pa.int32())], schema=schema)

    kinds = ", ".join(["row long", "doc_id long", *(f"{c} long" for c in numbers), "groups_sha256 string", "pairs array<long>", "times array<int>"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text")).mapInArrow(run, kinds)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, a, b, count (documents that link it) and best (no pair of the same A id has more) of every pair of linked ids in aligned()'s rows."""
    counts = tx.stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.expr("cast(pair & 4294967295L AS int)").alias("b"), "count")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links with their A id's highest count), count_sum (of counts over links) and groups_sha256 of every row."""
    found = tx.stored(aligned(docs, a_file, b_file), "aligned")
    counts = tx.stored(pair_counts(found).select("pair", "count", "best"), "counts")
    counts = F.broadcast(counts) if counts.count() <= most_pairs else counts
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    heads = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return heads.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(tx.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
