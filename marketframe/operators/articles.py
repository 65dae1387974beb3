"""News articles: text, scores, duplicates, and the trading day they count for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.scalars import clean_text, is_scorable, parse_day, score_struct, strip, text_key
from marketframe.operators.skew import first_per_group, skew_safe_join
from marketframe.session import importable, path_exists

Scorer = Callable[[pd.Series], pd.DataFrame]
PROBABILITIES = ["positive", "negative", "neutral"]
#: Texts that a task turns into Python's strings at a time.
SCORED_AT_ONCE = 256
#: The model that a Python worker holds, by the name of the run that loaded it.
LOADED: dict[str, Scorer] = {}


def with_clean_text(articles: DataFrame, max_description: int | None = None) -> DataFrame:
    """Add ``text``: what the scorer reads. A model with a short window may limit the description."""
    return articles.withColumn("text", clean_text(F.col("title"), F.col("description"), max_description))


def symbols_with_prices(articles: DataFrame, bars: DataFrame) -> DataFrame:
    """Only articles of symbols that have bars."""
    return articles.join(bars.select("symbol").distinct(), "symbol", "left_semi")


def dedup_articles(articles: DataFrame, by: list[str]) -> DataFrame:
    """First article (lowest ``seq``) of each title within ``by``, untitled ones dropped.

    Titles are equal up to case and surrounding white space.
    """
    titled = articles.withColumn("__title", F.lower(strip(F.col("title")))).where(F.col("__title") != "")
    return first_per_group(titled, [*by, "__title"], [F.col("seq")]).drop("__title")


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct (symbol, day) that have a bar."""
    return bars.select("symbol", F.to_date("ts").alias("day")).distinct()


def align_to_trading_day(articles: DataFrame, bars: DataFrame) -> DataFrame:
    """Add ``trading_day``: the first day with a bar on or after the article's date.

    Articles without a readable date, or after the last bar, are dropped. Every calendar day of a
    symbol up to its last bar gets its trading day beforehand (a calendar's worth of rows), so
    each different (symbol, date) looks its day up once; days before the first bar look it up by the symbol's
    earliest day, which is one day too. Articles are dealt out by symbol and date, and those of a date
    that holds many by a hash of their content too, never by symbol alone.
    """
    dated = articles.withColumn("__day", parse_day(F.col("date"))).where(F.col("__day").isNotNull())
    days = trading_days(bars).where("symbol IS NOT NULL AND day IS NOT NULL")
    previous = F.lag("day").over(Window.partitionBy("symbol").orderBy("day"))
    # A trading day stands for the days after the one before it; the first one stands for itself.
    since = F.coalesce(F.date_add(previous, 1), F.col("day"))
    lookup = days.withColumn("__since", since).select(
        "symbol", F.col("day").alias("trading_day"), F.explode(F.sequence("__since", "day")).alias("__asked")
    )
    bounds = days.groupBy("symbol").agg(F.min("day").alias("__first"))
    asked = F.greatest("__day", "__first").alias("__asked")
    dates = dated.select("symbol", "__day").distinct().join(bounds, "symbol").select("symbol", "__day", asked)
    found = dates.join(lookup, ["symbol", "__asked"]).select("symbol", "__day", "trading_day")
    spread = F.xxhash64(*[c for c, t in articles.dtypes if "map<" not in t])
    return skew_safe_join(dated, found, ["symbol", "__day"], spread).select(*articles.columns, "trading_day")


def distinct_texts(df: DataFrame, text: str, seq: str) -> DataFrame:
    """One row per text key: the text of the lowest ``seq``. Short texts are left out."""
    return (
        df.where(is_scorable(F.col(text)))
        .groupBy(text_key(F.col(text)).alias("text_key"))
        .agg(F.min_by(text, seq).alias("text"))
    )


def score_texts(
    texts: DataFrame,
    scorer: Callable[[], Scorer] | object,
    batch_size: int = 32,
    partitions: int | None = None,
    carry_text: bool = False,
) -> DataFrame:
    """Class probabilities for each row of (text_key, text), and the text if asked for.

    ``scorer`` is either a fitted ``pyspark.ml`` model that reads ``text`` and writes
    ``probability`` ordered positive, negative, neutral, or a function that loads a model
    and returns what maps a Series of texts to these three columns. The latter
    is called once per Python worker: its model serves all tasks that the worker runs. Scoring costs far more than its bytes suggest, so the
    partition count is set here and not left to be merged by size.
    """
    keys = ["text_key", "text"] if carry_text else ["text_key"]
    if hasattr(scorer, "transform"):
        p = vector_to_array("probability")
        return scorer.transform(texts).select(
            *keys, *[p[i].alias(n) for i, n in enumerate(PROBABILITIES)]
        )

    importable(texts.sparkSession)
    name = f"{scorer.__module__}.{scorer.__qualname__}-{uuid.uuid4().hex}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Modules live as long as the worker, and so does what they hold.
        from marketframe.operators.articles import LOADED as loaded

        if name not in loaded:
            loaded.clear()  # a worker holds one model
            loaded[name] = scorer()
        # Only the texts of some calls become Python's at a time; what is carried stays in Arrow.
        step = max(1, SCORED_AT_ONCE // batch_size) * batch_size
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                some = batch.slice(begin, step)
                texts = some.column("text").to_pandas()
                parts = [loaded[name](texts.iloc[at : at + batch_size])[PROBABILITIES] for at in range(0, len(texts), batch_size)]
                found = pd.concat(parts, ignore_index=True)
                columns = [*(some.column(k) for k in keys), *(pa.array(found[p], pa.float64(), from_pandas=True) for p in PROBABILITIES)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *PROBABILITIES])

    n = partitions or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*(f"{k} string" for k in keys), *(f"{p} double" for p in PROBABILITIES)])
    return texts.select("text_key", "text").repartition(n, "text_key").mapInArrow(score, schema)


def score_once(
    texts: DataFrame,
    scorer: Callable[[], Scorer] | object,
    store: str,
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """Class probabilities for each row of (text_key, text), of which only texts that ``store`` lacks are scored.

    ``store`` is a folder of (text_key, positive, negative, neutral). New scores are appended by one job, which is seen
    whole or not at all, so a run that failed is simply run again. Two runs at a time may both append a
    text; its smallest record counts. The returned rows are those of ``texts``, read from the store.
    """
    spark = texts.sparkSession
    schema = ", ".join(["text_key string", *(f"{p} double" for p in PROBABILITIES)])

    def stored() -> DataFrame:
        record = F.min(F.struct(*PROBABILITIES)).alias("__p")
        return spark.read.schema(schema).parquet(store).groupBy("text_key").agg(record).select("text_key", "__p.*")

    new = texts
    if path_exists(spark, store):
        new = texts.join(stored().select("text_key"), "text_key", "left_anti")
    score_texts(new.select("text_key", "text"), scorer, batch_size, partitions).write.mode("append").parquet(store)
    return texts.select("text_key").join(stored(), "text_key")


def store_report(texts: DataFrame, store: str) -> DataFrame:
    """How many of the texts a store holds already: n_texts, hits, misses, hit_rate."""
    spark = texts.sparkSession
    known = spark.read.schema("text_key string").parquet(store).distinct() if path_exists(spark, store) else spark.createDataFrame([], "text_key string")
    found = texts.select("text_key").join(known.withColumn("__hit", F.lit(1)), "text_key", "left")
    out = found.agg(F.count("*").alias("n_texts"), F.count("__hit").alias("hits"))
    return out.select("n_texts", "hits", (F.col("n_texts") - F.col("hits")).alias("misses"), F.try_divide("hits", "n_texts").alias("hit_rate"))


def score_articles(
    articles: DataFrame,
    scorer: Callable[[], Scorer] | object,
    batch_size: int = 32,
    partitions: int | None = None,
    max_description: int | None = None,
) -> DataFrame:
    """Articles plus score, positive, negative, neutral and label.

    All symbols go through one pass that scores each distinct text once; texts under 10
    characters get the neutral record.
    """
    texts = with_clean_text(articles, max_description).withColumn("text_key", text_key(F.col("text")))
    scores = score_texts(distinct_texts(texts, "text", "seq"), scorer, batch_size, partitions)
    # A text that many articles share is skew on their side, which adaptive execution splits.
    joined = texts.join(scores, "text_key", "left")
    known = F.col("neutral").isNotNull()
    filled = [F.when(known, F.col(n)).otherwise(1.0 if n == "neutral" else 0.0) for n in PROBABILITIES]
    return joined.select(*articles.columns, score_struct(*filled).alias("__score")).select(
        *articles.columns, "__score.*"
    )


def text_duplication_report(df: DataFrame, text: str) -> DataFrame:
    """How many texts repeat an earlier one: what reuse of scores saves."""
    per_text = df.groupBy(text_key(F.col(text)).alias("k")).agg(F.count("*").alias("n"))
    out = per_text.agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_distinct"))
    return out.select(
        "n_texts",
        "n_distinct",
        (F.col("n_texts") - F.col("n_distinct")).alias("n_repeated"),
        (F.lit(1.0) - F.try_divide(F.col("n_distinct"), F.col("n_texts"))).alias("repeat_share"),
    )
