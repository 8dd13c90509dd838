"""Headlines and transcripts: normal forms, lexicon scores, daily aggregates, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import div
from barloom.operators.joins import as_of

C = F.col

# The lexicon, its smoothing, and the names of tickers must be these for the same scores.
POSITIVE = ["surge", "surges", "surged", "rally", "rallies", "rallied", "gain", "gains", "gained", "beat", "beats", "beating", "exceed", "exceeds", "exceeded", "record", "growth", "expand", "expansion", "profit", "profitable", "outperform", "outperformed", "bullish", "upgrade", "upgraded", "momentum", "soar", "soars", "high", "rebound"]
NEGATIVE = ["slump", "slumps", "slumped", "drop", "drops", "dropped", "fall", "falls", "fell", "miss", "misses", "missed", "decline", "declines", "declined", "loss", "losses", "cut", "cuts", "cutting", "downgrade", "downgraded", "bearish", "plunge", "plunges", "recession", "inflation", "layoff", "layoffs", "investigation", "scrutiny", "outage", "dampen", "contract", "contraction", "crash", "threaten", "threatens", "threatened", "constraint", "constraints", "warning", "weak", "weaken", "weakened", "down", "collapse"]
SMOOTH, LEAST_NEUTRAL, NO_HIT = 0.1, 0.05, (0.075, 0.075, 0.85)
COMPANIES = {"AAPL": ["APPLE", "APPLE INC", "IPHONE", "TIM COOK"], "MSFT": ["MICROSOFT", "MICROSOFT CORP", "WINDOWS", "AZURE", "SATYA NADELLA"], "SPY": ["S&P 500", "SPDR", "ETF", "FED", "FEDERAL RESERVE", "WALL STREET"]}
ADDRESS = r"https?://\S+|www\.\S+"

_WORD = r"\p{L}\p{N}_"  # letters and digits of any script
_SPACE = r"\s\x1c-\x1f\x85\xa0"


def normalise(headline: Column) -> Column:
    """Without addresses, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(headline, ADDRESS, ""), rf"(?U)[{_SPACE}]+", " "))


def headline_hash(headline: Column) -> Column:
    """Of the letters and digits of any script, the underscores and the spaces between them, in lower case."""
    bare = F.regexp_replace(F.lower(headline), rf"(?U)[^{_WORD}{_SPACE}]", "")
    return F.sha2(F.regexp_replace(bare, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "").cast("binary"), 256)


def map_ticker(headline: Column, names: dict[str, list[str]] = COMPANIES, default: str | None = None) -> Column:
    """The first ticker that stands as a word, else the first one whose name the headline contains, in any case; default if none."""
    upper = F.upper(headline)
    out = F
    for ticker in names:
        out = out.when(upper.rlike(rf"(?<![{_WORD}])\Q{ticker.upper()}\E(?![{_WORD}])"), ticker)
    for ticker, words in names.items():
        for w in words:
            out = out.when(upper.contains(w.upper()), ticker)
    return out.otherwise(default)


def deduplicate(news: DataFrame) -> DataFrame:
    """One row for each (ticker, hash) of headlines of over five characters: the earliest."""
    clean = news.withColumn("headline", normalise(C("headline"))).where(F.length("headline") > 5).withColumn("hash", headline_hash(C("headline")))
    w = Window.partitionBy("ticker", "hash").orderBy("published_at", "headline")
    return clean.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _hits(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(lexicon)))


def lexicon_scores(df: DataFrame, text: str = "text", positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """df with label, score, confidence, positive, negative and neutral from smoothed counts of lexicon words; a text without any, or none at
    all, is neutral. Words, counts and shares are worked out one after another, each once."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{_WORD}]+"), 0)
    out = df.withColumn("_w", words).withColumns({"_p": _hits(C("_w"), positive), "_n": _hits(C("_w"), negative)}).drop("_w")
    total = C("_p") + C("_n") + 3 * SMOOTH
    out = out.withColumns({"_u": (C("_p") + SMOOTH) / total, "_d": (C("_n") + SMOOTH) / total})
    out = out.withColumn("_r", F.greatest(F.lit(LEAST_NEUTRAL), 1 - (C("_u") + C("_d"))))
    whole, none = C("_u") + C("_d") + C("_r"), C("_p") + C("_n") == 0
    shares = {name: F.when(none, F.lit(x)).otherwise(C(c) / whole) for name, x, c in zip(("positive", "negative", "neutral"), NO_HIT, ("_u", "_d", "_r"), strict=True)}
    out = out.withColumns(shares)
    up, down, flat = C("positive"), C("negative"), C("neutral")
    label = F.when((up > down) & (up > flat), "positive").when((down > up) & (down > flat), "negative").otherwise("neutral")
    return out.withColumns({"score": up - down, "label": label, "confidence": F.when(label == "neutral", flat).otherwise(F.greatest(up, down))}).drop("_p", "_n", "_u", "_d", "_r")


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """ticker, date: mean and deviation (0 for one) of score, number of headlines, of positive and of negative ones, by UTC date."""
    by = scored.groupBy("ticker", F.to_date("published_at").alias("date"))
    return by.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("dev"), F.count("*").alias("n"), F.count_if(C("score") > 0.05).alias("n_positive"), F.count_if(C("score") < -0.05).alias("n_negative"))


def known_by(news: DataFrame, cutoff: Column) -> DataFrame:
    """The headlines published up to a moment; later ones would leak."""
    return news.where(C("published_at") <= cutoff)


def leaks(news: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows of news(symbol, ts, published_at) that were published after the bar that they are joined to."""
    return news.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_semi").where(C("published_at") > C("ts").cast("timestamp"))


def call_features(calls: DataFrame, hedges: list[str], most_words: int = 350) -> DataFrame:
    """ticker, call_date and seven features of transcripts(ticker, call_date, text): sentiment of all, of the prepared part and of the answers (means over
    chunks weighted by their words; without answers that of the prepared part), their difference, hedge words in 1000, words, and the answers' share."""
    both = calls.withColumn("_id", F.monotonically_increasing_id()).withColumn("_s", sections(C("text")))
    heads = both.select("_id", "ticker", "call_date", hedge_density(C("text"), hedges).alias("uncertainty"), F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{2,}\b"), 0)).alias("word_count"))
    parts = both.select("_id", F.explode(F.array(F.struct(F.lit("prepared").alias("part"), C("_s.prepared").alias("t")), F.struct(F.lit("answers").alias("part"), C("_s.answers").alias("t")))).alias("p"))
    pieces = parts.select("_id", "p.part", F.explode(chunks(C("p.t"), most_words)).alias("chunk"))
    scored = lexicon_scores(pieces, "chunk").withColumn("w", F.size(F.array_remove(F.split(F.trim("chunk"), r"\s+"), "")))
    on = lambda part: (C("part") == part)
    mean = lambda c: div(F.sum(F.when(c, C("score") * C("w"))), F.sum(F.when(c, C("w"))))
    sums = scored.groupBy("_id").agg(mean(on("prepared")).alias("a"), mean(on("answers")).alias("b"), mean(F.lit(True)).alias("whole"), F.coalesce(div(F.sum(F.when(on("answers"), C("w"))), F.sum("w")), F.lit(0.0)).alias("share"))
    out = heads.join(sums, "_id", "left")
    prepared = F.coalesce("a", F.lit(0.0))
    answers = F.coalesce("b", prepared)
    four = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(name)
    return out.select("ticker", "call_date", four(C("whole"), "overall"), four(prepared, "prepared"), four(answers, "answers"), four(answers - prepared, "delta"), four(C("uncertainty"), "uncertainty"), C("word_count"), four(C("share"), "answer_share"))


def hedge_density(text: Column, hedges: list[str]) -> Column:
    """Hedge words per 1000 words of two letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{2,}\b"), 0)
    return F.coalesce(1000 * F.try_divide(_hits(words, hedges), F.size(words)), F.lit(0.0))


def sections(text: Column, mark: str = r"(?i)questions?\s+and\s+answers?|q\s*&\s*a\s+session") -> Column:
    """struct(prepared, answers): the text before and from the first mark; all is prepared without one."""
    at = F.regexp_instr(text, F.lit(mark))
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("prepared"), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("").alias("answers"))


def chunks(text: Column, most_words: int = 350) -> Column:
    """Paragraphs packed greedily into chunks of up to most_words words; a longer paragraph is packed by sentences."""
    count = lambda s: F.size(F.array_remove(F.split(F.trim(s), r"\s+"), ""))
    paragraphs = F.filter(F.split(text, r"\n\s*\n|\n"), lambda p: F.length(F.trim(p)) > 0)
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(count(p) > most_words, F.split(F.trim(p), r"(?<=[.!?])\s+")).otherwise(F.array(F.trim(p)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["n"] == 0) | (acc["n"] + count(p) <= most_words)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.when(acc["n"] == 0, p).otherwise(F.concat(acc["open"], F.lit("\n"), p)).alias("open"), (acc["n"] + count(p)).alias("n"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open"), count(p).alias("n"))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def align_calls(days: DataFrame, calls: DataFrame, columns: list[str], days_valid: int = 90) -> DataFrame:
    """days(ticker, ts) with the features of the last call that took effect: the midnight after call_date, for days_valid days; later calls win."""
    known = calls.withColumn("effective", F.date_add(F.to_date("call_date"), 1).cast(dict(days.dtypes)["ts"]))
    out = as_of(days, known, "ticker", "ts", "effective", columns, most_age=F.make_dt_interval(F.lit(days_valid)))
    return out.withColumn("has_active", C(columns[0]).isNotNull().cast("int"))
