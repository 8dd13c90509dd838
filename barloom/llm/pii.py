"""Personal data (operator 2) by aggregating weak labelers, with DataFrame operations only.

Patterns find candidates: the base kinds in their strict form, and looser forms (numbers without a plus, numbers failing the card checksum,
spelled-out mail addresses, credentials). Labelers vote on each candidate: its strict pattern, gazetteers (top-level domains, card issuers,
country codes, key prefixes), words before it, and its variety of characters. Expectation-maximisation over the counts of vote patterns (a few
hundred numbers, whatever the input) estimates how far each labeler can be trusted; a logistic classifier learns from the resulting
posteriors and judges every candidate. Base spans always stay; other candidates are added if they are judged personal and overlap no base span.

Places are code points, end exclusive. Matches of a kind are leftmost and do not overlap; the text between matches (split) and the matches
(regexp_extract_all) give their places without any UDF.

Edge cases: a null text counts as empty. Very long texts, and texts of very many matches, take time little more than in proportion (n matches cost n times the
square root of n in copies). Ties: spans that start at one place stand by kind or stop. Rows with the same doc_id give one row each. An empty table gives no rows. Without candidates nothing
is trained. Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import text as tx

#: Order of the kinds in digests and span lists. `secret` has no base form.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELERS = ("pattern", "gazetteer", "context", "denied", "variety")

#: Greedy parts at a pattern's end are possessive and runs are entered at their start or where the last match ended: the same matches as
#: the plain patterns, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
}
_NEEDS = {"email": "@", "phone": "+"}
_LOOSE_NEEDS = {"email": r"\(at\)|\[at\]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "secret": r"[0-9]"}
_CONTEXT = r"(?:phone|tel|call|mobile|fax|card|visa|credit|mail|contact|ip|host|server|addr|address|pass|password|passwd|pwd|token|secret|key|api)[^a-z]{0,6}$"
_DENIED = r"(?:isbn|version|doi|order|invoice|ref|page|rev|build|issue)[\x20.:#]*$"
_GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|co|eu|de|fr|es|it|uk|us)$",
    "ip": r"^(?!(?:0|127|255)\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|39|44|49|81|86|91)|\()",
    "secret": r"^(?:sk|pk|ghp|gho|AKIA|xox|eyJ)",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """The checksum of 13 to 19 digits holds."""
    d = _digits(m)
    values = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(2 * (F.ascii(c) - 48) - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.when(F.length(d).between(13, 19), F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def _strict(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, op, zero: int) -> Column:
    """Of every number of an array<int>, op (sums or extremes) over those before it. Blocks of about the square root of its length are gathered alone and then joined, so an array of n numbers
    costs n times that root in copies, not n times n."""

    def scan(block: Column) -> Column:
        begin = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, begin, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(v: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda k: scan(F.slice(v, k * size + 1, size)))
        joined = lambda made: F.flatten(F.zip_with(made, scan(F.transform(made, lambda x: x["at"]))["out"], lambda x, at: F.transform(x["out"], lambda y: op(y, at))))
        return F.when(F.size(v) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return _let(values, whole)


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, m, before>> of the matches."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda p, m: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("size"), m.alias("m"), F.lower(F.right(p, F.lit(24))).alias("before")))

    def placed(found: Column) -> Column:
        ends = _before(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, x: a + x, 0)
        return F.zip_with(found, ends, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"), x["m"].alias("m"), x["before"].alias("before")))

    # the text after the last match has no match beside it
    return _let(F.filter(pairs, lambda x: x["m"].isNotNull()), placed)


def _votes(kind: str, base: Column, m: Column, before: Column) -> Column:
    said = lambda test, yes, no: F.when(test, yes).otherwise(no)
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(m, "[^A-Za-z0-9]", ""), ""))) >= 4
    pattern = base if kind in BASE else m.rlike("[A-Za-z]") & m.rlike("[0-9].*[0-9].*[0-9]")
    return F.concat(said(pattern, "1", "0"), said(m.rlike(_GAZETTEER[kind]), "1", "0" if kind in ("ip", "card") else "-"), said(before.rlike(_CONTEXT), "1", "-"), said(before.rlike(_DENIED), "0", "-"), said(variety, "1", "0"))


def _judged_by(number: int, strict: bool):
    """Of a match, a candidate with its votes."""

    def one(x: Column) -> Column:
        base = _strict(KINDS[number], x["m"]) if strict else F.lit(False)
        return F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), base.alias("base"), _votes(KINDS[number], base, x["m"], x["before"]).alias("votes"))

    return one


_FAR = (1 << 31) - 1
_NONE = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:string>>"


def _candidates(text: Column) -> Column:
    """array<struct<kind, start, stop, base, votes>> by kind, then start; base spans and others."""
    parts = []
    for number, kind in enumerate(KINDS):
        for pattern, needs, strict in ((PATTERNS.get(kind), text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike("[0-9]"), True), (LOOSE.get(kind), text.rlike(_LOOSE_NEEDS.get(kind, "")), False)):
            if pattern is None:
                continue

            found = F.transform(_found(text, pattern), _judged_by(number, strict))
            if kind == "card":  # other runs of digits are candidates only if they are as long as a card's number
                found = F.filter(found, lambda x: x["base"] | (x["stop"] - x["start"]).between(13, 23))
            parts.append(F.when(needs, found).otherwise(F.array().cast(_NONE)))
    return F.concat(*parts)


def em(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each vote pattern, P(vote | class) as (labelers, 2 classes, 3 votes), prior) of two classes, labelers independent given the class."""
    votes = np.array([["01-".index(v) for v in p] for p in patterns])
    told = np.full((votes.shape[1], 2, 3), 1 / 3)
    told[:, 1], told[:, 0] = (0.1, 0.5, 0.4), (0.5, 0.1, 0.4)
    prior = 0.5
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[None] + sum(np.log(told[k][:, votes[:, k]]).T for k in range(votes.shape[1]))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        prior = float(np.clip((counts @ post + 1) / (counts.sum() + 2), 0.01, 0.99))
        for k in range(votes.shape[1]):
            for v in range(3):
                told[k, 1, v] = (counts * post)[votes[:, k] == v].sum()
                told[k, 0, v] = (counts * (1 - post))[votes[:, k] == v].sum()
        # pseudo-counts keep a yes likelier for personal data than a no
        told += np.array([[2.0, 0.5, 1.0], [0.5, 2.0, 1.0]])[None]
        told /= told.sum(2, keepdims=True)
    return post, told, prior


def classify(patterns: list[str], counts: np.ndarray, post: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """P(personal) of each vote pattern by logistic regression on the single votes, trained on the posteriors."""
    x = np.array([[1.0, *(v == "1" for v in p), *(v == "0" for v in p)] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (counts * (post - p)) - l2 * w)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def train(found: DataFrame) -> dict[tuple[int, str], float]:
    """P(personal) by (kind, votes), from all candidates of a table with the column cands. The driver sees counts of vote patterns alone."""
    counted = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({r["kind"] for r in counted}):
        own = sorted((r["votes"], r["count"]) for r in counted if r["kind"] == kind)
        patterns, counts = [v for v, _ in own], np.array([n for _, n in own], float)
        post, _, _ = em(patterns, counts)
        out |= {(kind, v): float(p) for v, p in zip(patterns, classify(patterns, counts, post), strict=True)}
    return out


def _accepted(known: dict[tuple[int, str], float], least: float):
    """The test that a candidate's votes are judged personal."""
    good = [f"{k}{v}" for (k, v), p in known.items() if p >= least]
    return lambda c: F.concat(c["kind"].cast("string"), c["votes"]).isin(good) if good else F.lit(False)


def _apart(cands: Column) -> Column:
    """The candidates that are no base spans and overlap none. In the order of starts a base span before a candidate overlaps it if the greatest stop so far lies beyond its start, one after it if
    the next start lies before its stop."""
    ordered = F.array_sort(F.transform(cands, lambda c: F.struct(c["start"].alias("start"), (~c["base"]).alias("more"), c["stop"].alias("stop"), c["kind"].alias("kind"))))

    def tested(x: Column) -> Column:
        stops = _before(F.transform(x, lambda c: F.when(c["more"], 0).otherwise(c["stop"])), F.greatest, 0)
        nexts = F.reverse(_before(F.transform(F.reverse(x), lambda c: F.when(c["more"], _FAR).otherwise(c["start"])), F.least, _FAR))
        each = F.zip_with(F.zip_with(x, stops, lambda c, s: F.struct(c.alias("c"), s.alias("s"))), nexts, lambda c, n: F.struct(c["c"].alias("c"), c["s"].alias("s"), n.alias("n")))
        free = F.filter(each, lambda c: c["c"]["more"] & (c["s"] <= c["c"]["start"]) & (c["n"] >= c["c"]["stop"]))
        return F.transform(free, lambda c: c["c"])

    return _let(ordered, tested)


def personal_data(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """doc_id, base and added (array<struct<kind, start, stop>>, by kind, then start) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = tx.stored(docs.select("doc_id", _candidates(text).alias("cands")), "spans")
    good = _accepted(train(found), least)
    place = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))
    base = F.transform(F.filter("cands", lambda c: c["base"]), place)
    more = _apart(F.filter("cands", lambda c: c["base"] | good(c)))
    return found.select("doc_id", base.alias("base"), F.array_sort(F.transform(more, place)).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.get(name, c["kind"]), c["start"].cast("string"), c["stop"].cast("string"))))


def redact(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """The rows of docs (doc_id, text, ..) with every span replaced by [kind]; columns and their order stay.

    The spans are found again on the rows themselves, so rows with the same doc_id keep their own texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    good = _accepted(train(docs.select(_candidates(text).alias("cands"))), least)
    row = docs.withColumn("__cands", _candidates(text))
    kept = F.filter("__cands", lambda c: c["base"] | good(c))
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"))))
    clean = F.when(F.size("__cands") > 0, _let(ordered, lambda spans: _let(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{_CHUNK}}}"), 0), lambda chunks: _written(spans, chunks)))).otherwise(F.col("text"))
    return row.select(*(clean.alias(c) if c == "text" else F.col(c) for c in docs.columns))


#: Characters of a chunk of a text: a place is found within its chunk, so no place costs the whole text.
_CHUNK = 1000


def _between(chunks: Column, begin: Column, end: Column) -> Column:
    """The text from one place to another, from the chunks of a text."""
    first, last = F.floor(begin / _CHUNK).cast("int"), F.floor(end / _CHUNK).cast("int")
    chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    whole = F.array_join(F.slice(chunks, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    apart = F.concat(F.substring(chunk(first), begin % _CHUNK + 1, F.lit(_CHUNK)), whole, F.substring(chunk(last), F.lit(1), end % _CHUNK))
    return F.when(begin >= end, F.lit("")).when(first == last, F.substring(chunk(first), begin % _CHUNK + 1, end - begin)).otherwise(apart)


def _written(spans: Column, chunks: Column) -> Column:
    """The text with every span's name in its place. Spans of two kinds can overlap: what an earlier one has covered is not written again."""
    name = F.array(*map(F.lit, KINDS))
    size = F.when(F.size(chunks) > 0, (F.size(chunks) - 1) * _CHUNK + F.char_length(F.element_at(chunks, -1))).otherwise(0)

    def parts(covered: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            mark = F.when(c["stop"] > at, F.concat(F.lit("["), F.get(name, c["kind"]), F.lit("]"))).otherwise("")
            return F.concat(_between(chunks, at, F.greatest(at, c["start"])), mark)

        last = F.greatest(F.lit(0), F.array_max(F.transform(spans, lambda c: c["stop"])))
        return F.concat(F.array_join(F.zip_with(spans, covered, one), ""), _between(chunks, last, size))

    return _let(_before(F.transform(spans, lambda c: c["stop"]), F.greatest, 0), parts)


def op2_private_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(tx.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    whole = F.array_sort(F.concat("base", "added"))
    return got.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(whole).alias("spans"), F.size("added").cast("long").alias("n_added"))
