"""N-best segmentation into the pieces of a SentencePiece model (operator 7).

The pieces that match a text form a lattice. A forward Viterbi pass gives the best score of reaching each place; these scores are the exact
heuristic of an A* search that runs backward from the end, so complete paths come off its queue in order of score. A place that has come off
the queue n times is closed, as n paths through it are enough; so a search takes n steps for each place at most, however many paths tie. Scores
are whole numbers (billionths), so equal paths are exactly equal; of these, any n are given, but the best of a word is the same in every task.

Only the n - 1 words of a text that lose least by another reading can have one in the text's n best. So the forward pass, with its best path, is
made for the words of many texts at once, all of one length as columns; a pass from the end then tells what each piece off the best path
loses at least, and the search runs over the words that take part.

No piece reaches over a place between two characters that stand side by side in no piece, so texts are cut there (first at the borders of words
and of runs of letters, if the vocabulary has no piece across them, then by pairs of characters). The parts are read alone and kept in a
bounded cache; the best segmentations of a text are the best sums over its parts.

The model file is a byte-pair one: its scores number its merges (0, -1, -2, ..) and are no logarithms of probabilities, so sums of them would
prefer few rare pieces. A piece of rank r in their order scores -log(r + 2), by Zipf's law; the model is not trained here. A character
that no piece covers falls back to its bytes at `BYTE_SCORE` each.

Edge cases: a null or empty text has no pieces, the score 0 and decodes to the empty text. Very long texts and words take time and memory in
proportion to their length. Repeated rows give one row each. A table without rows gives none. Further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

SPACE = "▁"
UNIT = 10**9
BYTE_SCORE = -14 * UNIT
_LETTER = re.compile(r"[^\W\d_]")
#: Longest word of the passes over many words, and how many of them are taken at once.
_LONG, _MANY = 64, 2048
_NONE = -(1 << 55)
_ODD = 0x9E3779B97F4A7C15
_POWER, _UNDER = (np.cumprod(np.array([1, *[x] * _LONG], np.uint64)) for x in (_ODD, pow(_ODD, -1, 1 << 64)))


class Segmenter:
    """Segmentations of texts by a SentencePiece model file, best first."""

    def __init__(self, path: str, n_best: int = 3, most_words: int = 150_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.most, self.cache, self.full, self.long = n_best, most_words, {}, {}, ("", [])
        self.text_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        pieces: dict[str, int] = {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.text_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                self.text_of.append(b"")
            else:
                pieces[piece] = k
                self.text_of.append(piece.replace(SPACE, " ").encode())
        self.kind = "<u2" if len(self.text_of) <= 0x10000 else "<u4"
        order = sorted(pieces, key=lambda p: (-model.get_score(pieces[p]), pieces[p]))
        #: Of every piece and its beginnings: ((id,), score), or none for a beginning that is no piece.
        self.tree: dict[str, tuple[tuple[int], int] | None] = {p[:k]: None for p in order for k in range(1, len(p))}
        self.tree |= {p: ((pieces[p],), round(-math.log(r + 2) * UNIT)) for r, p in enumerate(order)}
        some = [p for p in order if len(p) <= _LONG]
        self.longest = max(map(len, some))
        hashes = np.array([int(self._sums([p])[-1, 0]) for p in some], np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.numbers, self.scores = hashes[by], *(np.array([v(self.tree[p]) for p in some])[by] for v in (lambda t: t[0][0], lambda t: t[1]))
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have one hash")
        inner = [p for p in order if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces reach over word boundaries: {inner[:3]}")
        self.pairs = {p[k : k + 2] for p in order for k in range(len(p) - 1)}
        plain = lambda p: len({bool(_LETTER.match(c)) for c in p.lstrip(SPACE)}) < 2
        #: Characters of pieces that join letters with others; texts that have one are cut at words only.
        self.joining = sorted({c for p in order if not plain(p) for c in p if _LETTER.match(c) and not c.isalpha()})
        apart = all(plain(p) or set(p) & set(self.joining) for p in order)
        #: Spaces with the word, or with the run of letters or of others, that follows them.
        self.at_spaces = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words = re.compile(f"{SPACE}*{_LETTER.pattern}+|{SPACE}*(?:[\\d_]|[^\\w{SPACE}])+|{SPACE}+").findall if apart else self.at_spaces

    def lattice(self, word: str) -> tuple[list[list[tuple[int, int, tuple[int, ...]]]], list[int]]:
        """For each place, the (start, score, ids) of the pieces that end there, a character without a piece has its bytes; and for each place
        the best score of reaching it."""
        get, n = self.tree.get, len(word)
        ends: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best = [0] + [-(1 << 62)] * n
        for i in range(n):
            so_far, alone = best[i], True
            for j in range(i + 1, n + 1):
                hit = get(word[i:j], False)
                if hit:
                    ends[j].append((i, hit[1], hit[0]))
                    if so_far + hit[1] > best[j]:
                        best[j] = so_far + hit[1]
                    alone = alone and j > i + 1
                elif hit is False:
                    break
            if alone:
                raw = word[i].replace(SPACE, " ").encode()
                score = BYTE_SCORE * len(raw)
                ends[i + 1].append((i, score, tuple(self.byte_id[b] for b in raw)))
                best[i + 1] = max(best[i + 1], so_far + score)
        return ends, best

    def search(self, word: str) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids), best first."""
        ends, best = self.lattice(word)
        if not word:
            return [(0, ())]
        most, taken, last = self.n, [0] * (len(word) + 1), len(word)
        ways: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
        # a way that waits is the k-th best piece before a place; only when it is taken, the next one waits
        queue: list[tuple[int, int, int, int, int, tuple]] = []
        found, serial, push, pop = [], 0, heapq.heappush, heapq.heappop

        def reach(at: int, score: int, tail: tuple) -> None:
            nonlocal serial
            own = ways.get(at)
            if own is None:
                own = ways[at] = sorted(ends[at], key=lambda e: -best[e[0]] - e[1])
            serial += 1
            push(queue, (-(best[own[0][0]] + own[0][1] + score), serial, at, 0, score, tail))

        reach(last, 0, ())
        while queue and len(found) < most:
            _, _, at, k, score, tail = pop(queue)
            own = ways[at]
            i, s, part = own[k]
            if k + 1 < len(own):
                serial += 1
                push(queue, (-(best[own[k + 1][0]] + own[k + 1][1] + score), serial, at, k + 1, score, tail))
            if i == 0:
                ids: list[tuple[int, ...]] = [part]
                while tail:
                    ids.append(tail[0])
                    tail = tail[1]
                found.append((score + s, tuple(x for p in ids for x in p)))
            elif taken[i] < most:
                taken[i] += 1
                reach(i, score + s, (part, tail))
        return found

    @staticmethod
    def _sums(words: list[str]) -> np.ndarray:
        """Of words of one length, sums of characters times powers: differences of two, brought to one power, are hashes of what stands between."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n).T.astype(np.uint64)
        out = np.zeros((n + 1, len(words)), np.uint64)
        np.cumsum((codes + np.uint64(1)) * _POWER[:n, None], axis=0, out=out[1:])
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Puts words into the cache, many at once."""
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = set(words)
        by: dict[int, list[str]] = {}
        for w in new:
            by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            for lo in range(0, len(group) if n <= _LONG else 0, _MANY):
                self._learn(group[lo : lo + _MANY])

    def _learn(self, words: list[str]) -> None:
        n, w = len(words[0]), len(words)
        m, col, sums = min(n, self.longest), np.arange(w), self._sums(words)
        score, ids = np.full((n, m, w), _NONE, np.int64), np.zeros((n, m, w), np.int32)
        for i in range(n):
            k = min(m, n - i)
            h = (sums[i + 1 : i + 1 + k] - sums[i]) * _UNDER[i]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            score[i, :k] = np.where(self.hashes[at] == h, self.scores[at], _NONE)
            ids[i, :k] = self.numbers[at]
        best, step = np.zeros((n + 1, w), np.int64), np.zeros((n + 1, w), np.int64)
        for j in range(1, n + 1):
            ways = np.stack([best[j - k] + score[j - k, k - 1] for k in range(1, min(m, j) + 1)])
            step[j] = ways.argmax(axis=0)
            best[j] = ways[step[j], col]
        rest = np.zeros((n + 1, w), np.int64)
        for i in reversed(range(n)):
            rest[i] = np.stack([score[i, k - 1] + rest[i + k] for k in range(1, min(m, n - i) + 1)]).max(axis=0)
        # the best path, from the end, and the best of those that leave it
        path, place, count = np.zeros((w, n), np.int32), np.full(w, n), np.zeros(w, np.int64)
        on = np.zeros((n, m, w), bool)
        for t in range(1, n + 1):
            live = np.flatnonzero(place > 0)
            if not len(live):
                break
            k = step[place[live], live]
            place[live] -= k + 1
            on[place[live], k, live] = True
            path[live, n - t] = ids[place[live], k, live]
            count[live] += 1
        other = np.full(w, _NONE, np.int64)
        for i in range(n):
            for k in range(1, min(m, n - i) + 1):
                np.maximum(other, np.where(on[i, k - 1], _NONE, best[i] + score[i, k - 1] + rest[i + k]), out=other)
        known = (score[:, 0] > _NONE).all(axis=0)  # a character that is no piece has its bytes: see `lattice`
        raw, wide = path.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        loss = (best[n] - other).tolist()
        top, lone, size = best[n].tolist(), (other <= _NONE // 2).tolist(), count.tolist()
        for c in np.flatnonzero(known).tolist():
            self.cache[words[c]] = (raw[((c + 1) * n - size[c]) * wide : (c + 1) * n * wide], top[c], None if lone[c] else loss[c])

    def readings(self, word: str) -> list[tuple[int, tuple[int, ...]]]:
        """The n best of a word, from those of the parts that no piece joins."""
        found = self.full.get(word) or (self.long[1] if self.long[0] == word else None)
        if found:
            return found
        pairs, cuts = self.pairs, [0]
        cuts += [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        if len(cuts) == 1:
            found = self.search(word)
        else:
            found = self._joined([self.readings(word[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(word)])])
        if len(word) <= _LONG:
            if len(self.full) >= self.most // 4:
                self.full.clear()
            self.full[word] = found
        else:
            self.long = word, found  # kept for the text at hand
        return found

    def _joined(self, parts: list[list[tuple[int, tuple[int, ...]]]]) -> list[tuple[int, tuple[int, ...]]]:
        """The n best of parts one after another: best first, then those that lose least in few of the parts."""
        base = sum(p[0][0] for p in parts)
        # only the parts with the least loss can have another reading in one of the n best
        loose = heapq.nsmallest(self.n - 1, (k for k, p in enumerate(parts) if len(p) > 1), key=lambda k: parts[k][0][0] - parts[k][1][0])
        found: list[tuple[int, dict[int, int]]] = [(0, {})]
        for k in loose:
            found = heapq.nsmallest(self.n, ((loss + parts[k][0][0] - s, {**chosen, k: way}) for loss, chosen in found for way, (s, _) in enumerate(parts[k])), key=lambda x: x[0])
        return [(base - loss, tuple(i for k, p in enumerate(parts) for i in p[chosen.get(k, 0)][1])) for loss, chosen in found]

    def _word(self, word: str) -> tuple[bytes, int, int | None]:
        """(ids of the best as bytes, its score, what the next best loses, if there is one)."""
        if len(self.cache) >= self.most:
            self.cache.clear()
        if len(word) <= _LONG:
            self._learn([word])  # as among many others, so that of equal paths the same one is given
            if word in self.cache:
                return self.cache[word]
        found = self.readings(word)
        out = (np.array(found[0][1], self.kind).tobytes(), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else None)
        if len(word) <= _LONG:
            self.cache[word] = out
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text, with the mark that SentencePiece puts before it."""
        if not text:
            return []
        cut = self.at_spaces if any(c in text for c in self.joining) else self.words
        return cut(SPACE + text.replace(" ", SPACE))

    def _made(self, words: list[str]) -> tuple[list[tuple[bytes, int, int | None]], list[int]]:
        """The best of each word, and the places of those that take part in the n best."""
        get = self.cache.get
        made = [get(w) or self._word(w) for w in words]
        loose = heapq.nsmallest(self.n - 1, [(m[2], k) for k, m in enumerate(made) if m[2] is not None])
        return made, [k for _, k in loose]

    def segment(self, text: str, words: list[str] | None = None) -> tuple[np.ndarray, list[float]]:
        """(ids of the best segmentation, scores of the n best); words: `split` of the text, if it is known."""
        words = self.split(text) if words is None else words
        made, loose = self._made(words)
        ids = np.frombuffer(b"".join([m[0] for m in made]), self.kind)
        score, worse = sum([m[1] for m in made]), [0]
        for k in loose:
            found = self.readings(words[k])
            worse = heapq.nsmallest(self.n, (w + found[0][0] - s for w in worse for s, _ in found))
        return ids, [(score - w) / UNIT for w in worse]

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a text, best first; ties in any order."""
        words = self.split(text)
        made, loose = self._made(words)
        parts = [[(m[1], tuple(np.frombuffer(m[0], self.kind).tolist()))] for m in made]
        for k in loose:
            parts[k] = self.readings(words[k])
        return [(s / UNIT, list(ids)) for s, ids in self._joined(parts)]

    def decode(self, ids: np.ndarray) -> str:
        of = self.text_of
        text = b"".join([of[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _segmented(batches: Iterator[pa.RecordBatch], model: str, n_best: int) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, list[float], bool]]]]:
    """(doc_id, [(ids of the best, scores, decoding gives the text)]) of some rows at a time."""
    s = tx.kept(("segmenter", model, n_best), lambda: Segmenter(model, n_best))
    for batch in batches:
        _, off = tx.blobs(batch.column(1))
        for lo, hi in tx.slices(off, 1 << 21):
            texts = [b.decode("utf-8", "replace") for b in batch.column(1).slice(lo, hi - lo).to_pylist()]
            words = [s.split(t) for t in texts]
            s.learn(set().union(*words))
            out = []
            for text, own in zip(texts, words, strict=True):
                ids, scores = s.segment(text, own)
                out.append((ids, scores, s.decode(ids) == text.replace(SPACE, " ")))
            yield batch.column(0).slice(lo, hi - lo), out


def segment_texts(docs: DataFrame, model: str, *, n_best: int = 3) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the best ids as little-endian 32-bit numbers), score, scores (n best) and round_trip (decoding gives the text) of every row."""
    tx.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("scores", pa.list_(pa.float64())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, out in _segmented(batches, model, n_best):
            yield tx.rows(schema, doc_id, *zip(*((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), scores[0], scores, same) for ids, scores, same in out)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, score double, scores array<double>, round_trip boolean")


def segment_ids(docs: DataFrame, model: str, *, n_best: int = 3) -> DataFrame:
    """doc_id, ids (array<int>) of the best segmentation, scores (n best) and round_trip (decoding gives the text) of every row."""
    tx.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("scores", pa.list_(pa.float64())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, out in _segmented(batches, model, n_best):
            yield tx.rows(schema, doc_id, *zip(*((ids.astype(np.int32), scores, same) for ids, scores, same in out)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tx.as_bytes().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, scores array<double>, round_trip boolean")


def op7_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment_texts(tx.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
