"""Bars, articles, scores and headlines derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.scalars import clean_text, is_scorable, score_struct, text_key
from marketframe.operators.bars import build_bars, most_bars

SYMBOLS = ["click", "error", "purchase", "signup", "view"]
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ordinal(*parts: tuple[str, int]):
    """One decimal number that orders rows like the given integer columns with their digits."""
    out = F.lit(0).cast("decimal(38,0)")
    for expr, digits in parts:
        out = out * F.lit(10**digits).cast("decimal(20,0)") + F.expr(expr).cast("decimal(20,0)")
        out = out.cast("decimal(38,0)")
    return out


def bars_of_events(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    events = table(spark, sf, "events")
    at = _ordinal(("unix_micros(cast(ts as timestamp))", 0), ("event_id", 18))
    return build_bars(events, "event_type", "ts", F.col("value"), F.lit(1.0), unit, at)


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return bars_of_events(spark, sf, "hour")


def bars_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return bars_of_events(spark, sf, "minute")


def bars_weekdays(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of events on Monday to Friday: the trading calendar of the articles."""
    return bars_of_events(spark, sf, "day").where(F.weekday("ts") < 5)


def _bars_of_lineitem(items: DataFrame, symbol) -> DataFrame:
    at = _ordinal(
        ("l_orderkey", 0), ("l_linenumber", 1), ("cast(round(l_extendedprice * 100) as bigint)", 11),
        ("cast(l_quantity as bigint)", 3),
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return build_bars(items, symbol, "l_shipdate", price, F.col("l_quantity"), "day", at)


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    items = table(spark, sf, "lineitem")
    return _bars_of_lineitem(items.join(part, items.l_partkey == part.p_partkey), "p_brand")


def bars_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return _bars_of_lineitem(table(spark, sf, "lineitem"), F.col("l_suppkey").cast("string"))


def longest(spark: SparkSession, sf: str, bars) -> int:
    """Upper bound of the rows per symbol of the given kind of bars."""
    units = {bars_hourly: "hour", bars_minutes: "minute", bars_weekdays: "day"}
    if bars in units:
        return most_bars(table(spark, sf, "events"), "ts", units[bars])
    return most_bars(table(spark, sf, "lineitem"), "l_shipdate", "day")


def extent(spark: SparkSession, sf: str, bars) -> dict[str, int]:
    """Upper bounds of the rows per symbol and of the symbols of the given kind of bars."""
    if bars is bars_supplier:
        names = table(spark, sf, "supplier").select("s_suppkey")
    elif bars is bars_daily:
        names = table(spark, sf, "part").select("p_brand")
    else:
        names = table(spark, sf, "events").select("event_type")
    return {"longest": longest(spark, sf, bars), "symbols": names.distinct().count()}


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles (the first line is the title), plus an upper-case copy of what ``src0`` published."""
    docs = table(spark, sf, "documents")
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    days = F.pmod(F.floor(F.col("doc_id") / 5), F.lit(34)).cast("int")
    base = docs.select(
        F.get(names, F.pmod("doc_id", F.lit(5)).cast("int")).alias("symbol"),
        F.col("doc_id").alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("description"),
        F.col("source").alias("publisher"),
        F.date_format(F.date_add(F.lit("2023-12-30").cast("date"), days), "yyyy-MM-dd").alias("date"),
    )
    return _with_copies(base)


def _with_copies(base: DataFrame) -> DataFrame:
    copies = base.where(F.col("publisher") == "src0").withColumns({
        "seq": F.col("seq") + 10_000_000,
        "title": F.translate("title", LOWER, UPPER),
    })
    return base.unionByName(copies)


def brand_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The same articles, about the brands of ``bars_daily`` and spread over six years of its days."""
    doc = F.pmod("seq", F.lit(10_000_000))
    symbol = F.concat(F.lit("Brand#"), F.pmod(doc, F.lit(5)) + 1, F.pmod(F.floor(doc / 5), F.lit(5)) + 1)
    day = F.date_add(F.lit("1992-06-01").cast("date"), F.pmod(doc * 37, F.lit(2200)).cast("int"))
    return articles(spark, sf).withColumns({"symbol": symbol, "date": F.date_format(day, "yyyy-MM-dd")})


def timed_articles(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, seq, at): each article at a second of its day."""
    second = F.pmod(F.col("seq") * 7919, F.lit(86_400)).cast("int")
    midnight = F.to_timestamp_ntz(F.concat("date", F.lit(" 00:00:00")))
    at = midnight + F.make_dt_interval(secs=second)
    return articles(spark, sf).select("symbol", "seq", at.alias("at"))


def _hash_scorer():
    """Test stub, not a sentiment model: probabilities from the digits of the text's MD5.

    Local functions travel to the workers by value, so these need no package there.
    """

    def load():
        def score(texts: pd.Series) -> pd.DataFrame:
            keys = [hashlib.md5(t.strip().lower().encode()).hexdigest() for t in texts]
            positive = pd.Series([int(k[0:4], 16) / 131072 for k in keys], dtype="float64")
            negative = pd.Series([int(k[4:8], 16) / 131072 for k in keys], dtype="float64")
            return pd.DataFrame({"positive": positive, "negative": negative, "neutral": 1 - positive - negative})

        return score

    return load


hash_scorer = _hash_scorer()


def hash_probabilities(text) -> tuple:
    """The stub's probabilities as columns."""
    key = text_key(text)
    part = lambda at: F.conv(F.substring(key, at, 4), 16, 10).cast("double") / 131072
    positive, negative = part(1), part(5)
    return positive, negative, F.lit(1.0) - positive - negative


def scored_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with the stub's scores, computed as columns."""
    a = articles(spark, sf).withColumn("__text", clean_text(F.col("title"), F.col("description")))
    ok = is_scorable(F.col("__text"))
    p, n, u = hash_probabilities(F.col("__text"))
    record = score_struct(F.when(ok, p).otherwise(0.0), F.when(ok, n).otherwise(0.0), F.when(ok, u).otherwise(1.0))
    return a.withColumn("__score", record).select("*", "__score.*").drop("__score", "__text")


def headline_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as headlines, plus an upper-case copy of what ``src0`` published: seq, text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text", "source")
    copies = docs.where(F.col("source") == "src0").withColumns({
        "seq": F.col("seq") + 10_000_000, "text": F.translate("text", LOWER, UPPER)
    })
    return docs.unionByName(copies).drop("source")


def labelled_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: toxic 1, good 0, others 2; seq is the document."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kind = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2)
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("seq"), "text", kind.alias("label")
    )


def headline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled headlines with the stub's probabilities and its likeliest class."""
    p, n, u = hash_probabilities(F.col("text"))
    best = F.when((p >= n) & (p >= u), 0).when(n >= u, 1).otherwise(2)
    return labelled_headlines(spark, sf).select(
        "*", p.alias("positive"), n.alias("negative"), u.alias("neutral"), best.alias("prediction")
    )
