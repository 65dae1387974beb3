"""Scored articles to one row of sentiment per symbol and trading day, and on to bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.kernels import round4
from marketframe.functions.scalars import NEUTRAL_DAY, strip
from marketframe.operators.articles import (
    align_to_trading_day,
    score_articles,
    trading_days,
)
from marketframe.operators.panel import close_panel, open_panel
from marketframe.operators.skew import first_per_group, keep

COLUMNS = list(NEUTRAL_DAY)
_DAY = ["symbol", "trading_day"]
_UNIT = 1_000_000.0  # scores are summed as whole millionths


def news_days(scored: DataFrame) -> DataFrame:
    """One row of the 8 columns per (symbol, trading_day) with articles.

    ``scored`` has trading_day, title, seq and the score record. Per day the first
    article of each title counts; a day with only untitled ones is neutral. Sums run over
    whole millionths, so the result does not depend on the order of the rows.

    ``sentiment_momentum`` compares with the *rounded* mean of the previous day that had news.
    """
    one_each = first_per_group(
        scored.withColumn("__title", F.lower(strip(F.col("title")))),
        [*_DAY, "__title"],
        [F.col("seq")],
    )
    counted = F.col("__title") != ""
    units = lambda x: F.when(counted, F.rint(x * _UNIT).cast("bigint"))
    k = units(F.col("score"))
    days = one_each.groupBy(*_DAY).agg(
        F.count(k).alias("n"),
        F.sum(k).alias("s"),
        F.sum(k.cast("decimal(10,0)") * k.cast("decimal(10,0)")).alias("ss"),
        F.max(F.when(counted, F.col("score"))).alias("high"),
        F.min(F.when(counted, F.col("score"))).alias("low"),
        F.count(F.when(counted & (F.col("label") == "positive"), 1)).alias("n_positive"),
        F.sum(units(F.greatest("positive", "negative"))).alias("confidence"),
    )
    n, s = F.col("n"), F.col("s")
    count = n.cast("double")
    wide = lambda x: x.cast("decimal(19,0)")
    spread = (n.cast("decimal(12,0)") * F.col("ss").cast("decimal(26,0)") - wide(s) * wide(s)).cast("double")
    days = days.select(*_DAY, "n", "high", "low", "n_positive", "confidence",
                       F.when(n > 0, s / (count * _UNIT)).otherwise(0.0).alias("mean"),
                       F.when(n > 0, F.sqrt(spread) / count / _UNIT).alias("std"))
    rounded = round4(F.col("mean"))
    before = F.lag(rounded).over(Window.partitionBy("symbol").orderBy("trading_day"))
    some = F.col("n") > 0
    or_zero = lambda x: F.coalesce(round4(x), F.lit(0.0))
    return days.select(
        *_DAY,
        rounded.alias("sentiment_mean"),
        or_zero(F.col("high")).alias("sentiment_max"),
        or_zero(F.col("low")).alias("sentiment_min"),
        or_zero(F.col("std")).alias("sentiment_std"),
        round4(F.col("mean") - F.coalesce(before, F.lit(0.0))).alias("sentiment_momentum"),
        count.alias("article_count"),
        F.when(some, round4(F.col("n_positive") / count)).otherwise(0.5).alias("positive_ratio"),
        F.when(some, round4(F.col("confidence") / (count * _UNIT))).otherwise(0.0).alias("confidence_mean"),
    )


def fill_calendar(days: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per symbol and day with a bar; days without news are neutral."""
    by_ts = days.withColumnRenamed("trading_day", "ts")
    calendar = trading_days(bars).withColumnRenamed("day", "ts")
    return calendar.join(by_ts, ["symbol", "ts"], "left").fillna(NEUTRAL_DAY).select("symbol", "ts", *COLUMNS)


def aggregate_to_daily(scored: DataFrame, bars: DataFrame) -> DataFrame:
    """Scored articles of all symbols to ``daily_sentiment`` on the bars' calendar."""
    return fill_calendar(news_days(align_to_trading_day(scored, bars)), bars)


def build_daily_sentiment(
    articles: DataFrame, bars: DataFrame, scorer: Callable | object, **scoring
) -> DataFrame:
    """Articles of all symbols, scored in one pass, to daily sentiment.

    Symbols without bars have no trading day and fall out. What cannot count (late, or a
    repeated title of the same day) is dropped before scoring: the scorer is the expensive
    step, and the first article of a title is the one that counts either way. The kept
    articles are computed once, since scoring reads them for the distinct texts and for the join back.
    """
    dated = align_to_trading_day(articles, bars)
    titles = dated.withColumn("__title", F.lower(strip(F.col("title"))))
    kept = first_per_group(titles, [*_DAY, "__title"], [F.col("seq")]).drop("__title")
    return fill_calendar(news_days(score_articles(keep(kept), scorer, **scoring)), bars)


def of_earlier_days(daily: DataFrame, n: int = 1) -> DataFrame:
    """Every symbol and trading day with the 8 columns of ``n`` trading days earlier, NULL where there are none.

    For bars of which a day may have several: a shift by rows would show all but its first one the day's own news.
    """
    days = Window.partitionBy("symbol").orderBy("ts")
    return daily.select("symbol", "ts", *[F.lag(c, n).over(days).alias(c) for c in COLUMNS])


def merge_price_and_sentiment(
    bars: DataFrame, daily: DataFrame, shift_days: int = 1, longest: int | None = None, symbols: int | None = None
) -> DataFrame:
    """Bars plus the 8 sentiment columns of ``shift_days`` rows earlier.

    The row count stays. A value that is missing, also for want of an earlier row, is 0.0 in
    every column, ``positive_ratio`` included.
    """
    by_day = daily.withColumnsRenamed({"ts": "__day", "symbol": "__symbol"})
    same = (F.col("symbol") == F.col("__symbol")) & (F.to_date("ts") == F.col("__day"))
    q = open_panel(bars.join(by_day, same, "left").drop("__day", "__symbol"), longest=longest, symbols=symbols)
    shifted = {c: F.coalesce(q.frames.lag(c, shift_days) if shift_days else F.col(c), F.lit(0.0)) for c in COLUMNS}
    return close_panel(q.add(shifted))


def add_sentiment_placeholders(bars: DataFrame) -> DataFrame:
    """Bars plus the 8 columns of a day without news."""
    return bars.withColumns({c: F.lit(v) for c, v in NEUTRAL_DAY.items()})


def sentiment_summary(daily: DataFrame) -> DataFrame:
    """Coverage and mood per symbol; mean and sample deviation over days with news."""
    news = F.col("article_count") > 0
    s = F.when(news, F.col("sentiment_mean"))
    units = F.rint(s * _UNIT).cast("bigint")
    covered = F.count(F.when(news, 1))
    return daily.groupBy("symbol").agg(
        F.count("*").alias("total_days"),
        covered.alias("days_with_news"),
        (F.rint(covered * 1000.0 / F.count("*")) / 10.0).alias("coverage_pct"),
        F.coalesce(round4(F.try_divide(F.sum(units), F.count(s) * _UNIT)), F.lit(0.0)).alias("mean_sentiment"),
        F.when(covered == 0, 0.0).otherwise(round4(F.stddev_samp(s))).alias("std_sentiment"),
        F.count(F.when(s > 0.1, 1)).alias("bullish_days"),
        F.count(F.when(s < -0.1, 1)).alias("bearish_days"),
        F.count(F.when(s.between(-0.1, 0.1), 1)).alias("neutral_days"),
        (F.rint(F.avg("article_count") * 10.0) / 10.0).alias("avg_articles_day"),
    )


def coverage_report(daily: DataFrame) -> DataFrame:
    """Covered share, mean sentiment and articles per day over all days, per symbol."""
    return daily.groupBy("symbol").agg(
        (F.avg((F.col("article_count") > 0).cast("int")) * 100).alias("coverage_pct"),
        F.avg("sentiment_mean").alias("mean_sentiment"),
        F.avg("article_count").alias("avg_articles"),
    )
