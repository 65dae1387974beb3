"""Reading bars, articles and headlines from files, and writing features and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.scalars import parse_day
from marketframe.operators.bars import normalize_columns
from marketframe.operators.boosting import BoostedTrees
from marketframe.operators.headlines import headline_text
from marketframe.operators.skew import first_per_group
from marketframe.session import path_exists

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
ARTICLES = "symbol string, seq bigint, title string, description string, publisher string, date string"
HEADLINE_ITEMS = "seq bigint, title string, content struct<title: string>"


def read_bars(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    symbols: list[str] | None = None,
    period: str | None = None,
) -> DataFrame:
    """Bars from parquet, ORC, CSV (with header) or JSON files.

    Text formats are read with the bar schema, not inferred. ``symbols`` is a pushed-down
    filter. ``period``, such as ``3 months``, keeps what is newer than that before the last bar
    read; the last bar's time comes from one column. Bars that ``write_bars`` has laid out by month
    are then read from the folders of these months only; the month is not a column of the result.
    """
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(BARS)
    if fmt == "csv":
        reader = reader.option("header", True)
    loaded = reader.load(path)
    bars = normalize_columns(loaded)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    if period is not None:
        bars = within_period(bars, period, month="month" if "month" in bars.columns else None)
    return bars.drop("month")


def within_period(bars: DataFrame, period: str, ts: str = "ts", month: str | None = None) -> DataFrame:
    """Bars of the last ``period`` before the newest bar; ``month`` names a yyyy-MM partition column."""
    last, first = bars.agg(F.max(ts), F.max(ts) - F.expr(f"interval {period}")).first()
    if last is None:
        return bars.limit(0)
    if month is not None:
        bars = bars.where(F.col(month) >= f"{first:%Y-%m}")
    return bars.where(F.col(ts) >= F.lit(first).cast(bars.schema[ts].dataType))


def read_articles(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    days_back: int | None = None,
    max_articles: int | None = None,
) -> DataFrame:
    """Articles from JSON lines (default), parquet or CSV files."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(ARTICLES)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True)
    return recent_articles(reader.load(path), days_back, max_articles)


def recent_articles(
    articles: DataFrame, days_back: int | None = None, max_articles: int | None = None
) -> DataFrame:
    """Articles dated within ``days_back`` of the newest, the newest ``max_articles`` per symbol."""
    day = parse_day(F.col("date"))
    if days_back is not None:
        last = articles.agg(F.max(day).alias("last")).scalar()
        articles = articles.where(day >= F.date_sub(last, days_back))
    if max_articles is not None:
        articles = first_per_group(articles, ["symbol"], [day.desc_nulls_last(), F.col("seq")], max_articles)
    return articles


def read_headlines(spark: SparkSession, path: str) -> DataFrame:
    """Headline texts (seq, text) from JSON lines with ``title`` or ``content.title``."""
    items = spark.read.schema(HEADLINE_ITEMS).json(path)
    return items.select("seq", headline_text(F.col("content.title"), F.col("title")).alias("text"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as parquet by month, so that period and symbol filters prune files and row groups.

    Rows are ranged over (month, symbol, ts), which splits a hot symbol over many files.
    """
    by_month = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    sliced = by_month.repartitionByRange("month", "symbol", "ts").sortWithinPartitions("month", "symbol", "ts")
    sliced.write.mode("overwrite").partitionBy("month").parquet(path)


def merge_bars(bars: DataFrame, path: str) -> None:
    """Late and corrected bars into what ``write_bars`` has laid out; only the months they touch are read and rewritten.

    A bar replaces the one of its symbol and time, and of several new ones the greatest by its values stays. Months
    become visible when the whole job has been committed, so a lost executor leaves the old ones. ``bars`` must have the
    table's columns; those without a time are refused, since they belong to no month. A path without a table is written
    as by ``write_bars``; no bars change nothing.
    """
    spark, names = bars.sparkSession, list(bars.columns)
    values = [c for c in names if c not in ("symbol", "ts")]
    by_month = bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
    months = [r.month for r in by_month.select("month").distinct().collect()]  # a calendar's worth
    if None in months:
        raise ValueError("a bar without a time belongs to no month")
    if not months:
        return
    new = by_month.select(*names, "month", F.lit(1).alias("__turn"))
    if path_exists(spark, path):
        schema = ", ".join(f"`{c}` {t}" for c, t in bars.dtypes) + ", month string"
        old = spark.read.schema(schema).parquet(path).where(F.col("month").isin(months))
        new = new.unionByName(old.withColumn("__turn", F.lit(0)))
    last = F.max(F.struct("__turn", *values)).alias("__last")
    rows = new.groupBy("symbol", "ts", "month").agg(last).select("symbol", "ts", *[F.col(f"__last.{c}").alias(c) for c in values], "month")
    sliced = rows.select(*names, "month").repartitionByRange("month", "symbol", "ts").sortWithinPartitions("month", "symbol", "ts")
    sliced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The feature table as parquet, in files ranged over (symbol, ts).

    A hot symbol gets many files and a million small ones share some; a filter on symbol or time
    skips files and row groups by their statistics.
    """
    sliced = features.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
    sliced.write.mode(mode).parquet(path)


def save_model(model: BoostedTrees | PipelineModel, path: str) -> None:
    if isinstance(model, BoostedTrees):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> BoostedTrees | PipelineModel:
    """What ``save_model`` wrote: a pipeline has a metadata folder, boosted trees a table of nodes."""
    if path_exists(SparkSession.active(), f"{path}/nodes"):
        return BoostedTrees.load(path)
    return PipelineModel.load(path)
