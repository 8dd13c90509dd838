"""Repeated passages (operator 6) by suffix order and longest previous factors.

The factor of a place is the longest string from it that also starts elsewhere; factors count from `least` bytes on and are cut at `span`. Bytes
inside a factor of `span` bytes are removed. Suffixes of the whole corpus need not be sorted in one place:

1. Every window of `least` bytes has an anchor, the least of its 64-byte grams; equal windows have equal anchors at equal offsets, so all factors
   of a place start in windows with its anchor. Windows in a row with one anchor are a run. Runs whose anchor occurs once hold no factor.
2. Runs of an anchor that are equal as far as their last window reaches (by a 64-bit hash) are one kind: they repeat each other in all their windows.
3. Where an anchor has several kinds, the first run of each is read again. A task gets all kinds of an anchor, puts the suffixes at their
   places in order, and finds for each place the previous and the next smaller position in that order: the longer of the two common beginnings is its longest
   previous factor, and the longest of all others stands beside it. An anchor with very many kinds is dealt to several tasks; the firsts that
   these find then meet by 64-bit hashes of their `span` and `least` bytes, so a factor between these two lengths can count as `least` there.

`repeated_spans` gives the bytes of all copies, and those of later copies alone: without these the first of each is kept.

Edge cases: null and empty texts have no bytes; texts shorter than `least` have no factors. Rows with the same doc_id give one row each, and equal
rows repeat each other; rows equal in doc_id and text are first or later together. Order is that of doc_id, then of a hash of the text, then of
places. Very long texts are cut into runs like others; a stretch with a short period makes one row. An empty table gives no rows. Further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

GRAM = 64
_BIG = 128
_PART = 1 << 20
_BITS = np.uint64(28)  # of a place within a batch; the order of grams is that of their hashes' other bits, then of places
_BYTE = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _mix(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    x = a * _ODD[turn % 4]
    x ^= x >> np.uint64(32)
    x += b
    x *= _ODD[(turn + 1) % 4]
    x ^= x >> np.uint64(29)
    return x


def _grams(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of GRAM and of _BIG bytes."""
    h, size, gram, turn = _BYTE[flat], 1, None, 0
    while size < _BIG:
        h = _mix(h[:-size], h[size:], turn) if len(h) > size else h[:0]
        size, turn = 2 * size, turn + 1
        if size == GRAM:
            gram = h
    return gram, h


def _stretch(big: np.ndarray, at: np.ndarray, size: np.ndarray | int, most: int) -> np.ndarray:
    """Hash of the `size` bytes (_BIG to most) from each place, of overlapping grams."""
    end = at + size - _BIG
    out = _mix(big[at], np.asarray(size).astype(np.uint64), 2)
    for k in range(_BIG, most - _BIG, _BIG):
        out = _mix(out, big[np.minimum(at + k, end)], 3)
    return _mix(out, big[end], 1)


def runs(flat: np.ndarray, off: np.ndarray, least: int, span: int) -> tuple[np.ndarray, ...]:
    """(row, first place, last place, times, hash of the anchor, hash of the run) of the runs of windows of some texts; places count within
    the text. Equal runs that follow each other are one with times > 1."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(flat) < least:
        return none
    gram, big = _grams(flat)
    low = (gram >> _BITS << _BITS) | np.arange(len(gram), dtype=np.uint64)
    width, done = least - GRAM + 1, 1
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if width > done:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    anchor = (low & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    length = np.diff(off)
    whole = length >= least
    count = length[whole] - least + 1
    row = np.repeat(np.flatnonzero(whole), count)
    if not len(row):
        return none
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = off[row] + place
    a = anchor[at]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    begin, end = at[first], np.minimum(at[last] + span, off[row[first] + 1])
    body = _mix(_stretch(big, begin, end - begin, least - GRAM + span), ((last - first) * 4096 + (a[first] - begin)).astype(np.uint64), 2)
    name, owner, wide = gram[a[first]], row[first], last - first + 1
    new = np.ones(len(first), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1]) | (body[1:] != body[:-1]) | (wide[1:] != wide[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(first)))
    first, last = first[new], last[new]
    return owner[new], place[first], place[last], times, name[new], body[new]


def _as_spans(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of runs of consecutive places, both sorted by owner, then place."""
    if not len(places):
        return owner, places, places
    new = np.ones(len(places), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    return owner[first], places[first], places[last]


def _range_lists(places: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Of each of n owners, the ranges of its places."""
    owner, lo, hi = _as_spans(places, owner)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"]))


def suffix_order(data: np.ndarray, at: np.ndarray, room: np.ndarray, group: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the suffixes at some places, by group, then by their first `span` bytes, then by place. A suffix has `room` bytes.
    common: the bytes that each has in common with the one before it in this order, 0 for the first of a group."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.zeros((n, span + 8), np.uint8)
    text[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    padded = np.concatenate([data, np.zeros(span, np.uint8)])
    text[:, 8:] = np.lib.stride_tricks.sliding_window_view(padded, span)[at]
    short = np.flatnonzero(room < span)
    for lo in range(0, len(short), 1 << 14):
        k = short[lo : lo + (1 << 14)]
        text[k, 8:] *= np.arange(span) < room[k][:, None]
    order = np.argsort(text.view(f"S{span + 8}").ravel(), kind="stable")
    common = np.zeros(n, np.int64)
    step = 1 << 14
    for lo in range(1, n, step):
        hi = min(n, lo + step)
        part = text[order[lo - 1 : hi]]
        apart = part[1:] != part[:-1]
        where = apart.argmax(axis=1)
        where[~apart[np.arange(len(where)), where]] = span + 8
        common[lo:hi] = np.maximum(where - 8, 0)
    common[1:] = np.minimum(common[1:], np.minimum(room[order[1:]], room[order[:-1]]))
    return order, common


def _smaller_before(value: np.ndarray, common: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each index, the nearest index before it with a smaller value, and the least `common` between the two (0: there is none within
    `longest` steps). Blocks of powers of two are skipped."""
    n = len(value)
    least, shared, size = [value], [common], 1
    while size < longest:
        v, c = least[-1].copy(), shared[-1].copy()
        v[size:] = np.minimum(v[size:], least[-1][:-size])
        c[size:] = np.minimum(c[size:], shared[-1][:-size])
        least.append(v)
        shared.append(c)
        size *= 2
    at, have = np.arange(n), np.full(n, np.iinfo(np.int64).max)
    for k in reversed(range(len(least))):
        skip = (at >= 1 << k) & (least[k][np.maximum(at - 1, 0)] > value)
        have = np.where(skip, np.minimum(have, shared[k][at]), have)
        at = np.where(skip, at - (1 << k), at)
    have = np.where(at > 0, np.minimum(have, common[at]), 0)
    at = np.maximum(at - 1, 0)
    return at, np.where(value[at] < value, have, 0)


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, source, elsewhere) of each suffix, numbered by place: its longest previous factor, where that starts earlier (-1: nowhere), and
    the longest factor that starts anywhere else. The source is the previous or the next smaller position in suffix order."""
    n = len(order)
    length, source, elsewhere = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if not n:
        return length, source, elsewhere
    cut = np.flatnonzero(common == 0)
    longest = int(np.diff(np.append(cut, n)).max())
    before, left = _smaller_before(order, common, longest)
    flipped = np.concatenate([[0], common[:0:-1]])
    after, right = (x[::-1] for x in _smaller_before(order[::-1], flipped, longest))
    after = n - 1 - after
    found = np.maximum(left, right)
    length[order] = found
    source[order] = np.where(found > 0, order[np.where(left >= right, before, after)], -1)
    elsewhere[order] = np.maximum(common, np.append(common[1:], 0))
    return length, source, elsewhere


def longest_previous_factors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, sources) of one text: how many bytes from each place also start earlier, and where (-1: nowhere)."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b))
    return previous_factors(*suffix_order(b, at, len(b) - at, np.zeros(len(b), np.int64), len(b)))[:2]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", tx.as_bytes()).alias("key"), tx.as_bytes().alias("text"))


def _anchors(docs: DataFrame, least: int, span: int) -> DataFrame:
    """A row for each run: doc_id, key, lo, hi (places), times, room (the last place with `span` bytes), anchor, body."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("times", pa.int32()), ("room", pa.int32()), ("anchor", pa.int64()), ("body", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = tx.blobs(batch.column(2))
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            for lo, hi in tx.slices(off, _PART):
                row, first, last, times, anchor, body = runs(flat[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], least, span)
                room = np.diff(off)[lo:hi][row] - span
                yield tx.rows(schema, ids.slice(lo, hi - lo).take(pa.array(row)), keys[lo:hi][row], *(x.astype(np.int32) for x in (first, last, times, room)), anchor.view(np.int64), body.view(np.int64))

    return docs.mapInArrow(run, "doc_id long, key long, lo int, hi int, times int, room int, anchor long, body long")


def _pieces(texts: DataFrame, span: int) -> DataFrame:
    """Of texts(doc_id, key, text, found): a row for each run in found, with its bytes as far as its last window of `span` bytes reaches."""
    run = F.col("run")
    size = run["hi"] - run["lo"] + F.lit(span)
    split = texts.select("doc_id", "key", "text", F.explode("found").alias("run"))
    return split.select(run["anchor"].alias("anchor"), run["sub"].alias("sub"), run["subs"].alias("subs"), run["body"].alias("body"), "doc_id", "key", run["lo"].alias("lo"), (run["hi"] - run["lo"] + 1).alias("windows"), F.substring("text", run["lo"] + 1, size).alias("piece"))


def _told(pieces: DataFrame, least: int, span: int, most_bytes: int) -> DataFrame:
    """Factors in each group (anchor, sub) of pieces. Of a piece with some: anchor, body, spans (ranges of windows whose span bytes also are
    elsewhere), later (earlier), longest and factor (of all its places). Of a group dealt to several tasks also a row for each first of a
    window: window (its hash), width, and its place."""
    kinds = [("anchor", pa.int64()), ("body", pa.int64()), ("spans", _RANGES), ("later", _RANGES), ("longest", pa.int32()), ("factor", pa.int32())]
    kinds += [("window", pa.int64()), ("width", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("place", pa.int32())]
    schema = pa.schema(kinds)

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        anchor, sub, subs, body, key, lo, windows = (table.column(c).to_numpy() for c in ("anchor", "sub", "subs", "body", "key", "lo", "windows"))
        data, off = tx.blobs(table.column("piece").chunk(0))
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])
        again = np.zeros(len(anchor), bool)  # rows equal in doc_id and text
        again[1:] = ~new[1:] & (body[1:] == body[:-1]) & (key[1:] == key[:-1]) & (lo[1:] == lo[:-1])
        count = np.where(again, 0, windows)
        piece = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        at = off[piece] + inner
        room = np.minimum(off[piece + 1] - at, span)
        group = (np.cumsum(new) - 1)[piece]
        big = _grams(data)[1]
        name = _mix(_stretch(big, at, least, least), group.astype(np.uint64), 0)
        by = np.argsort(name)
        twice = np.zeros(len(name), bool)
        same = name[by][1:] == name[by][:-1]
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        some = np.flatnonzero(twice)
        length, elsewhere = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        order, common = suffix_order(data, at[some], room[some], group[some], span)
        common[common < least] = 0
        length[some], _, elsewhere[some] = previous_factors(order, common)
        n = len(count)
        top = lambda v: np.maximum.reduceat(v, (np.cumsum(count) - count)[count > 0]) if len(v) else v
        longest, factor = np.zeros(n, np.int32), np.zeros(n, np.int32)
        longest[count > 0], factor[count > 0] = top(elsewhere), top(length)
        told = np.flatnonzero(longest > 0)
        lists = [_range_lists(inner[v >= span], piece[v >= span], n).take(pa.array(told)) for v in (elsewhere, length)]
        none = pa.nulls(len(told), pa.int64()), pa.nulls(len(told), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(anchor[told]), pa.array(body[told]), *lists, pa.array(longest[told]), pa.array(factor[told]), none[0], none[1], none[0], none[0], none[1], none[1]], schema=schema)
        open_ = (subs > 1)[piece]
        for width, first in ((span, open_ & (length < span) & (room >= span)), (least, open_ & (length < least))):
            if first.any():
                p = piece[first]
                hashed = _stretch(big, at[first], width, width).view(np.int64)
                nulls = pa.nulls(len(p), _RANGES), pa.nulls(len(p), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(anchor[p]), pa.array(body[p]), nulls[0], nulls[0], nulls[1], nulls[1], pa.array(hashed), pa.array(np.full(len(p), width, np.int32)), table.column("doc_id").chunk(0).take(pa.array(p)), pa.array(key[p]), pa.array(lo[p]), pa.array(inner[first].astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole groups, but for the last
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(8).nbytes
            while size >= most_bytes:
                table = pa.Table.from_batches(held)
                a, s = table.column("anchor").to_numpy(), table.column("sub").to_numpy()
                ends = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1
                off = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("piece")).to_numpy().astype(np.int64))])
                fit = ends[off[ends] <= most_bytes]
                cut = int(fit[-1]) if len(fit) else int(ends[0]) if len(ends) else 0
                if not cut:
                    break
                yield from solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = int(off[-1] - off[cut])
        if held and sum(b.num_rows for b in held):
            yield from solve(pa.Table.from_batches(held))

    ranges = "array<struct<lo:int,hi:int>>"
    by = pieces.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "doc_id", "key", "lo")
    return by.mapInArrow(run, f"anchor long, body long, spans {ranges}, later {ranges}, longest int, factor int, window long, width int, doc_id long, key long, lo int, place int")


def _met(told: DataFrame, least: int, span: int) -> DataFrame:
    """(anchor, body, spans, later, longest, factor) of the firsts whose windows other tasks have too."""
    at = F.struct("doc_id", "key", "lo", "place")
    windows = told.where("window is not null").select("anchor", "body", "window", "width", at.alias("at"))
    shared = windows.groupBy("window", "width").agg(F.count("*").alias("n"), F.min("at").alias("one")).where("n > 1")
    both = windows.join(shared, ["window", "width"]).withColumn("late", F.col("at") != F.col("one"))
    whole = F.struct(F.col("at.place").alias("lo"), F.col("at.place").alias("hi"))
    return both.groupBy("anchor", "body").agg(
        F.collect_list(F.when(F.col("width") == span, whole)).alias("spans"),
        F.collect_list(F.when((F.col("width") == span) & F.col("late"), whole)).alias("later"),
        F.max("width").alias("longest"),
        F.max(F.when(F.col("late"), F.col("width")).otherwise(0)).alias("factor"),
    )


def _small(df: DataFrame, size: F.Column, most_bytes: int) -> DataFrame:
    """Broadcast up to `most_bytes` (rows of `size` bytes), shuffled beyond."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df.hint("shuffle_hash")


def _repeats(docs: DataFrame, least: int, span: int, most_bytes: int, most_kinds: int, most_broadcast: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, room, spans, later, longest, factor) for each row with factors; spans, later: ranges (lo, hi) of windows, they can overlap. And the
    tables that it reads."""
    anchors = tx.stored(_anchors(docs, least, span), "anchors")
    shared = tx.stored(anchors.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "shared")
    met = tx.stored(anchors.join(shared.hint("merge"), "anchor"), "runs")
    at = F.struct("doc_id", "key", "lo", "hi")
    kinds = tx.stored(met.groupBy("anchor", "body").agg(F.sum("times").alias("n"), F.min(at).alias("one")), "kinds")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("subs", F.ceil(F.col("kinds") / most_kinds).cast("int"))
    many = tx.stored(many, "many")
    question = kinds.join(many.hint("merge"), "anchor").withColumn("sub", F.pmod("body", "subs").cast("int"))
    run = F.struct("anchor", "body", "sub", "subs", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))
    question = tx.stored(question.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(run).alias("found")), "question")
    # lists of runs take more room than the keys of their texts: these go first, so that other texts stay at home
    few = _small(question.select("key"), F.lit(16), most_broadcast)
    texts = docs.join(few, "key", "left_semi").join(_small(question, 24 + 56 * F.size("found"), most_broadcast // 8), "key")
    told = tx.stored(_told(_pieces(texts, span), least, span, most_bytes), "told")
    verdicts = told.where("window is null").select("anchor", "body", "spans", "later", "longest", "factor")
    if many.where("subs > 1").take(1):
        verdicts = verdicts.unionByName(_met(told, least, span))
    solved = tx.stored(kinds.join(verdicts, ["anchor", "body"], "left").where("n > 1 or longest > 0"), "solved")
    every = met.select("anchor", "body", "key", "room", "times", "lo", "hi", at.alias("at")).join(solved.hint("merge"), ["anchor", "body"])
    equal, wide = F.col("n") > 1, F.col("hi") - F.col("lo") + 1
    run = lambda lo: F.array(F.struct((F.col("lo") + lo).alias("lo"), (F.col("lo") + wide * F.col("times") - 1).alias("hi")))
    moved = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<lo:int,hi:int>>")), lambda x: F.struct((F.col("lo") + x["lo"]).alias("lo"), (F.col("lo") + x["hi"]).alias("hi")))
    reach = F.least(F.lit(span), F.col("room") + span - F.col("lo"))  # bytes that the first window has at most
    late = equal & (F.col("at") != F.col("one"))
    # of the first run, what is later by its verdict; the runs that repeat it in place are later
    first = F.concat(moved("later"), F.when(F.col("times") > 1, run(wide)).otherwise(F.array().cast("array<struct<lo:int,hi:int>>")))
    every = every.select(
        "key", "room",
        F.when(equal, run(F.lit(0))).otherwise(moved("spans")).alias("spans"),
        F.when(late, run(F.lit(0))).otherwise(first).alias("later"),
        F.when(equal, reach).otherwise(F.col("longest")).alias("longest"),
        F.when(late | (F.col("times") > 1), reach).otherwise(F.coalesce("factor", F.lit(0))).alias("factor"),
    )
    of = every.groupBy("key").agg(F.max("room").alias("room"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("later")).alias("later"), F.max("longest").alias("longest"), F.max("factor").alias("factor"))
    return of, [anchors, shared, met, kinds, many, question, told, solved]


def _merged(spans: list[dict], room: int, span: int) -> list[dict]:
    """Bytes (start, stop) covered by the windows at the places in `spans` up to the place `room`; runs that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted((x["lo"], min(x["hi"], room) + span) for x in spans if x["lo"] <= room):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "stop": e} for s, e in out]


def repeated_spans(docs: DataFrame, *, span: int = 400, least: int = 224, most_bytes: int = 1 << 20, most_kinds: int = 2048, most_broadcast: int = 64 << 20) -> DataFrame:
    """doc_id, text (bytes), spans and later (array<struct<start, stop>>, bytes inside a string of `span` bytes that starts anywhere else, or that
    starts earlier), longest and factor (bytes of the longest factor, and of the longest previous one, 0 below `least`, cut at `span`) of every
    row; null where a row has no factor.

    most_bytes: bytes whose suffixes a task sorts at once. most_kinds: kinds of an anchor that a task takes; more are dealt to several.
    most_broadcast: bytes up to which keys and spans are broadcast to the texts (lists of runs up to an eighth); more are shuffled.
    """
    if not 2 * GRAM <= least <= span:
        raise ValueError(f"least must be {2 * GRAM} at least, and span not below it")
    own = _keyed(docs)
    pairs = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("key", pa.int64()), ("spans", pairs), ("later", pairs), ("longest", pa.int32()), ("factor", pa.int32())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                room = b.column(1).to_pylist()
                found = [[_merged(x, r, span) for x, r in zip(b.column(c).to_pylist(), room, strict=True)] for c in (2, 3)]
                yield tx.rows(schema, b.column(0), *found, b.column(4), b.column(5))

    found, read = _repeats(own, least, span, most_bytes, most_kinds, most_broadcast)
    kind = "array<struct<start:int,stop:int>>"
    spans = tx.stored(found.mapInArrow(merge, f"key long, spans {kind}, later {kind}, longest int, factor int"), "spans")
    for table in read:
        tx.discard(table)
    return own.join(_small(spans, 64 + 48 * (F.size("spans") + F.size("later")), most_broadcast), "key", "left").drop("key")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of the query from those of `repeated_spans`."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), *((c, pa.int64()) for c in ("n_later", "longest_repeat", "longest_factor"))])
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            out = []
            for b, spans, later, longest, factor in zip(*(batch.column(c).slice(lo, 200).to_pylist() for c in range(1, 6)), strict=True):
                digest, at, gone = hashlib.sha256(), 0, 0
                for x in spans or ():
                    digest.update(b[at : x["start"]])
                    at, gone = x["stop"], gone + x["stop"] - x["start"]
                digest.update(b[at:])
                out.append((len(b), gone, len(spans or ()), digest.hexdigest(), sum(x["stop"] - x["start"] for x in later or ()), longest or 0, factor or 0))
            yield tx.rows(schema, batch.column(0).slice(lo, 200), *zip(*out))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_later long, longest_repeat long, longest_factor long"


def op6_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(tx.documents(spark, sf_dir)).mapInArrow(cut, CUT)
