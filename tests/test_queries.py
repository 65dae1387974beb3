"""Registered queries next to their SQL, and the shape of the registry."""

import duckdb
import pytest
from bar_helpers import SF

import __spark_entry__ as entry
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from scripts.check_queries import rows_of

CHECKED = [
    "bars_hourly", "bars_daily", "clean_bars", "rolling_kernels", "trend_ma", "momentum_rsi", "macd_lines",
    "vol_regime_flags", "volume_obv", "patterns_triple", "interactions", "sequence", "return_stats",
    "align_next_trading_day", "score_articles", "build_daily_sentiment", "rolling_sentiment_cross",
    "dedup_headlines", "weak_label", "stratified_split", "prf_report", "chronological_split", "simple_features",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("events", "lineitem", "part", "documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 90
    assert set(QUERIES) <= set(queries) and set(ORACLE) <= set(sql)
    assert set(QUERIES) - set(ORACLE) == {
        "headline_classifier", "train_eval", "feature_importance", "predict_latest"}


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"symbol", "ts", "target", "rsi_14"} <= set(df.columns) and len(df.columns) > 300
    assert df.count() > 0
