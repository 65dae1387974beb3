"""Articles: text, scores, duplicates, trading days, daily sentiment."""

import bisect

import numpy as np
import pandas as pd
import pytest
from bar_helpers import bars_frame, collect, to_spark
from pyspark.sql import functions as F

from catalog import tables as t
from marketframe.functions.scalars import NEUTRAL_DAY, clean_text, label_id, label_name, parse_day, score_struct
from marketframe.operators import articles as news
from marketframe.operators import daily_sentiment as daily
from marketframe.operators.skew import first_per_group, hash_ranks, skew_safe_join
from marketframe.sources.tables import ARTICLES

SCORED = "symbol string, seq bigint, title string, date string, score double, positive double, negative double, neutral double, label string"


@pytest.mark.parametrize("title, description, want", [
    ("Profit up", "Shares rally", "Profit up. Shares rally"),
    ("  Profit up\n", None, "Profit up"),
    ("[Removed]", "Shares rally", "Shares rally"),
    ("N/A", "null", ""),
    (None, None, ""),
    ("T", "  " + "x" * 300, "T. " + "x" * 200),
    ("None", "\tkept ", "kept"),
])
def test_clean_text(spark, title, description, want):
    df = spark.createDataFrame([(title, description)], "a string, b string")
    assert df.select(clean_text(F.col("a"), F.col("b"), 200)).first()[0] == want


def test_labels_and_scores(spark):
    df = spark.createDataFrame([(0.7, 0.2, 0.1), (0.2, 0.5, 0.3), (0.25, 0.25, 0.5), (0.4, 0.4, 0.2)], "p double, n double, u double")
    rows = df.select(score_struct(F.col("p"), F.col("n"), F.col("u")).alias("s")).select("s.*").collect()
    assert [r.label for r in rows] == ["positive", "negative", "neutral", "positive"]
    assert [r.score for r in rows] == [0.5, -0.3, 0.0, 0.0]
    ids = spark.createDataFrame([("Positive",), ("NEGATIVE",), ("neutral",)], "x string").select(label_id(F.col("x")))
    assert [r[0] for r in ids.collect()] == [0, 1, 2]
    names = spark.createDataFrame([(0,), (1,), (2,)], "x int").select(label_name(F.col("x")))
    assert [r[0] for r in names.collect()] == ["positive", "negative", "neutral"]


def test_unreadable_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-01-05T10:11:12",), ("soon",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(parse_day(F.col("d"))).collect()] == ["2024-01-05", "2024-01-05", "None", "None"]


def business_bars(spark, n=30, symbols=("S",)):
    pdf = pd.concat([bars_frame(s, n, 42) for s in symbols])
    days = pd.bdate_range("2024-01-02", periods=n)
    pdf["ts"] = list(days) * len(symbols)
    return to_spark(spark, pdf), days


def test_alignment_against_search(spark):
    bars, days = business_bars(spark, 20, ("S", "T"))
    bars = bars.where("not (symbol = 'T' and ts < '2024-01-10')")
    dates = pd.date_range("2023-12-25", "2024-02-10")
    rows = [(s, i * 2 + j, "t", "", "p", str(d.date())) for i, d in enumerate(dates) for j, s in enumerate("ST")]
    rows += [("S", 9001, "t", "", "p", "no date"), ("NOBARS", 9002, "t", "", "p", "2024-01-05")]
    got = {(r.symbol, r.seq): r.trading_day for r in news.align_to_trading_day(spark.createDataFrame(rows, ARTICLES), bars).collect()}
    want = {}
    for s, first in (("S", "2024-01-01"), ("T", "2024-01-10")):
        open_days = [d.date() for d in days if d >= pd.Timestamp(first)]
        for sym, seq, *_, date in rows:
            if sym == s and date != "no date":
                at = bisect.bisect_left(open_days, pd.Timestamp(date).date())
                if at < len(open_days):
                    want[(s, seq)] = open_days[at]
    assert got == want


def test_dedup_keeps_first_of_equal_titles(spark):
    rows = [("S", 3, " Beats "), ("S", 1, "BEATS"), ("S", 2, "other"), ("S", 4, " "), ("S", 5, None), ("U", 9, "beats")]
    df = spark.createDataFrame(rows, "symbol string, seq bigint, title string")
    assert sorted(r.seq for r in news.dedup_articles(df, ["symbol"]).collect()) == [1, 2, 9]


def test_group_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_per_group(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_shift_trace(spark):
    bars, days = business_bars(spark, 10)
    values = [round(0.9 - 0.1 * i, 1) for i in range(10)]
    d = spark.createDataFrame([("S", days[i].date(), *[v] * 8) for i, v in enumerate(values)],
                              "symbol string, ts date, " + ", ".join(f"{c} double" for c in NEUTRAL_DAY))
    out = collect(daily.merge_price_and_sentiment(bars, d))
    assert len(out) == 10 and out.sentiment_mean.tolist() == [0.0, *values[:-1]]
    assert out.positive_ratio[0] == 0.0
    same_day = collect(daily.merge_price_and_sentiment(bars, d, shift_days=0))
    assert same_day.sentiment_mean.tolist() == values


def test_neutral_fill(spark):
    bars, days = business_bars(spark)
    day = str(days[0].date())
    rows = [("S", i, f"title {i}", day, s, s, 0.1, 0.1, "positive") for i, s in enumerate((0.8, 0.7, 0.6))]
    out = collect(daily.aggregate_to_daily(spark.createDataFrame(rows, SCORED), bars))
    assert len(out) == 30
    first = out.iloc[0]
    assert first.sentiment_mean == 0.7 and first.article_count == 3 and first.sentiment_std == pytest.approx(0.0816)
    assert first.positive_ratio == 1 and first.sentiment_momentum == 0.7
    rest = out.iloc[1:]
    for c, v in NEUTRAL_DAY.items():
        assert (rest[c] == v).all()


def test_no_articles(spark):
    bars, _ = business_bars(spark)
    out = collect(daily.aggregate_to_daily(spark.createDataFrame([], SCORED), bars))
    assert len(out) == 30 and all((out[c] == v).all() for c, v in NEUTRAL_DAY.items())


def test_momentum_and_untitled_day(spark):
    bars, days = business_bars(spark, 5)
    rows = [
        ("S", 1, "a", str(days[0].date()), 0.5, 0.6, 0.1, 0.3, "positive"),
        ("S", 2, "", str(days[2].date()), 0.9, 0.9, 0.0, 0.1, "positive"),
        ("S", 3, "b", str(days[3].date()), 0.2, 0.5, 0.3, 0.2, "positive"),
        ("S", 4, "B ", str(days[3].date()), -0.9, 0.0, 0.9, 0.1, "negative"),
    ]
    out = collect(daily.aggregate_to_daily(spark.createDataFrame(rows, SCORED), bars))
    assert out.sentiment_mean.tolist() == [0.5, 0.0, 0.0, 0.2, 0.0]
    assert out.sentiment_momentum.tolist() == [0.5, 0.0, -0.5, 0.2, 0.0]
    assert out.article_count.tolist() == [1, 0, 0, 1, 0] and out.positive_ratio.tolist() == [1, 0.5, 0.5, 1, 0.5]


def counting_scorer(path):
    def load():
        def score(texts):
            with open(path, "a") as f:
                f.writelines("x\n" for _ in texts)
            n = len(texts)
            return pd.DataFrame({"positive": np.full(n, 0.6), "negative": np.full(n, 0.1), "neutral": np.full(n, 0.3)})

        return score

    return load


def test_each_distinct_text_is_scored_once(spark, tmp_path):
    path = tmp_path / "calls"
    texts = ["Shares rally on results", "shares rally on results ", "Another headline here", "Hi", "   ", None]
    rows = [("S", i, x, None, "p", "2024-01-03") for i, x in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, ARTICLES)
    out = news.score_articles(df, counting_scorer(str(path))).toPandas()
    assert path.read_text().count("x") == 2
    assert len(out) == 18 and (out.label == "positive").sum() == 9
    short = out[out.title.isin(["Hi", "   "]) | out.title.isna()]
    assert (short.neutral == 1).all() and (short.score == 0).all() and (short.label == "neutral").all()


def test_scoring_path_equals_column_path(spark, sf):
    keys = ["seq", "score", "positive", "negative", "neutral", "label"]
    a = news.score_articles(t.articles(spark, sf), t.hash_scorer).select(*keys)
    b = t.scored_articles(spark, sf).select(*keys)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dropping_before_scoring_changes_nothing(spark, sf):
    bars = t.bars_weekdays(spark, sf)
    a = daily.build_daily_sentiment(t.articles(spark, sf), bars, t.hash_scorer)
    b = daily.aggregate_to_daily(t.scored_articles(spark, sf), bars)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_symbols_with_prices(spark):
    bars, _ = business_bars(spark, 3)
    df = spark.createDataFrame([("S", 1), ("S", 2), ("X", 3), (None, 4)], "symbol string, seq bigint")
    assert sorted(r.seq for r in news.symbols_with_prices(df, bars).collect()) == [1, 2]


def test_summary(spark):
    days = pd.bdate_range("2024-01-02", periods=4)
    means, counts = [0.5, 0.1, 0.0, -0.3], [2.0, 1.0, 0.0, 1.0]
    rows = [("S", d.date(), m, 0.0, 0.0, 0.0, 0.0, n, 0.5, 0.0) for d, m, n in zip(days, means, counts)]
    df = spark.createDataFrame(rows, "symbol string, ts date, " + ", ".join(f"{c} double" for c in NEUTRAL_DAY))
    r = daily.sentiment_summary(df).first()
    assert (r.total_days, r.days_with_news, r.coverage_pct) == (4, 3, 75.0)
    assert r.mean_sentiment == 0.1 and r.std_sentiment == 0.4
    assert (r.bullish_days, r.bearish_days, r.neutral_days, r.avg_articles_day) == (1, 1, 1, 1.0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_with_a_hot_key(spark, how):
    """Key 7 holds a third of the rows, and some keys are NULL or unknown."""
    fact = spark.range(6000).select(
        F.when(F.col("id") < 2000, 7).when(F.col("id") < 2100, None).otherwise(F.col("id") % 900).alias("k"), "id")
    dim = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = skew_safe_join(fact, dim, ["k"], F.col("id"), how)
    want = fact.join(dim, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_spread(spark):
    fact = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id")
    dim = fact.select("k").distinct()
    joined = skew_safe_join(fact, dim.withColumn("v", F.lit(1)), ["k"], F.col("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = joined.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(per_task) == 4 and per_task.max() < 2500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_ranks_are_exact(spark):
    df = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = hash_ranks(df, "g", "h").toPandas()
    assert (got["rank"] == got.groupby("g").h.rank().astype(int)).all()
    assert (got.group_size == got.groupby("g").h.transform("size")).all()
