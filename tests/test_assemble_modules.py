"""The query ``assemble`` over ticks of its own: every module, and a day's news on the next day's bars only."""

from datetime import timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from catalog import tables as t
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from marketframe.operators.daily_sentiment import COLUMNS, build_daily_sentiment, of_earlier_days
from marketframe.operators.memory import LAG_PERIODS, LAG_TARGETS
from marketframe.plans import registry

DAYS, A_DAY = 5, 60


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two symbols with 60 ticks on each of 5 days, one of them at a price of 0, and some articles a day."""
    rng, path = np.random.default_rng(4), tmp_path_factory.mktemp("ticks")
    ticks = [
        (symbol, pd.Timestamp("2024-01-01") + timedelta(days=d, minutes=20 * k + 3 * i), round(float(rng.uniform(20, 80)), 2))
        for i, symbol in enumerate(("click", "view")) for d in range(DAYS) for k in range(A_DAY)
    ]
    events = pd.DataFrame(ticks, columns=["event_type", "ts", "value"]).assign(event_id=range(len(ticks)))
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.loc[235, "value"] = 0.0
    events.to_parquet(path / "events.parquet")
    words = ["profit", "loss", "growth", "court", "merger", "strike", "record", "recall"]
    texts = [f"{' '.join(rng.choice(words, 4))} {i}\n{' '.join(rng.choice(words, 6))}" for i in range(90)]
    pd.DataFrame({"doc_id": range(90), "text": texts, "source": [f"src{i % 3}" for i in range(90)]}).to_parquet(path / "documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return QUERIES["assemble"](spark, folder).toPandas()


def test_every_module_is_there(rows):
    made = [c for g, group in registry.FEATURE_GROUPS.items() if g != "lags" for c in group]
    made += [f"{c}_lag{k}" for c in LAG_TARGETS for k in LAG_PERIODS] + registry.DAILY_SENTIMENT + registry.ROLLING_SENTIMENT
    assert set(made) - set(registry.RAW_COLUMNS) <= set(rows.columns)
    assert len(rows) > 100 and rows.symbol.nunique() == 2 and not rows.isna().any().any()


def test_rows_equal_sql(rows, folder):
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(ORACLE["assemble"]).df()[list(rows.columns)].sort_values(["symbol", "ts"], ignore_index=True)
    got = rows.sort_values(["symbol", "ts"], ignore_index=True)
    assert got[["symbol", "ts"]].astype(str).equals(want[["symbol", "ts"]].astype(str))
    values = [c for c in rows.columns if c not in ("symbol", "ts")]
    assert np.allclose(got[values].astype(float), want[values].astype(float), rtol=0, atol=2e-6)


def test_all_bars_of_a_day_have_the_news_of_the_day_before(spark, rows, folder):
    daily = build_daily_sentiment(t.articles(spark, folder), t.bars_minutes(spark, folder), t.hash_scorer).toPandas()
    known = {(r.symbol, pd.Timestamp(r.ts) + timedelta(days=1)): r for r in daily.itertuples()}
    assert daily.article_count.gt(0).all() and daily.sentiment_mean.nunique() > DAYS
    for r in rows.itertuples():
        before = known[r.symbol, r.ts.normalize()]
        assert [getattr(r, c) for c in COLUMNS] == pytest.approx([getattr(before, c) for c in COLUMNS], abs=1e-6)


def test_of_earlier_days(spark):
    days = [("A", f"2024-01-0{d}", float(d)) for d in (2, 5, 8)] + [("B", "2024-01-05", 9.0)]
    daily = spark.createDataFrame(pd.DataFrame(days, columns=["symbol", "ts", "x"])).selectExpr(
        "symbol", "cast(ts as date) ts", *[f"x {c}" for c in COLUMNS])
    at = lambda n: {(r.symbol, r.ts.day): r.sentiment_mean for r in of_earlier_days(daily, n).collect()}
    assert at(1) == {("A", 2): None, ("A", 5): 2.0, ("A", 8): 5.0, ("B", 5): None}
    assert at(0) == {("A", 2): 2.0, ("A", 5): 5.0, ("A", 8): 8.0, ("B", 5): 9.0}
