"""No more tasks than symbols: each task generates the code of all windows, with rows or without."""

import re

import pytest
from bar_helpers import bars_frame, collect, to_spark

from catalog import tables as t
from catalog.queries import QUERIES
from marketframe.operators.panel import extent, open_panel
from marketframe.plans.features import build_features


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def dealt(df):
    """Into how many partitions ``repartition`` deals the panel, for each time it does."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_a_task_per_symbol_at_most(many_partitions, panel):
    assert extent(panel) == {"longest": 330, "symbols": 3}
    assert dealt(open_panel(panel).df) == [3]
    assert dealt(open_panel(panel, longest=330, symbols=3).df) == [3]
    assert dealt(open_panel(panel, longest=330).df) == [60]  # their number isn't known
    assert dealt(open_panel(panel, tasks=7).df) == [7]


def test_more_symbols_than_partitions(spark, panel):
    assert dealt(open_panel(panel, longest=330, symbols=1000).df) == [4]


def test_no_bars(many_partitions, panel):
    empty = panel.where("symbol = 'NONE'")
    assert extent(empty) == {"longest": 0, "symbols": 0}
    assert open_panel(empty).df.rdd.getNumPartitions() == 1 and build_features(empty, modules=["returns"]).count() == 0


def test_a_symbol_without_a_name_counts(spark, panel):
    nameless = panel.selectExpr("if(symbol = 'ONE', NULL, symbol) AS symbol", "ts", "close")
    assert extent(nameless)["symbols"] == 3


def test_blocks_in_few_tasks(many_partitions):
    bars = to_spark(many_partitions, bars_frame("HOT", 2500, 11))
    p = open_panel(bars, max_rows=700, halo=300)
    assert p.blocked and dealt(p.df) == [4]
    blocks = collect(build_features(bars, modules=["trend"], max_rows=700, halo=300))
    whole = collect(build_features(bars, modules=["trend"]))
    assert len(blocks) == len(whole) == 2500 and (blocks.hh_streak == whole.hh_streak).all()


def test_queries_know_their_symbols(many_partitions, sf):
    """``features_all``, which ``model_features`` writes, has 25 brands at any size."""
    for bars in (t.bars_daily, t.bars_hourly, t.bars_supplier):
        found, bound = extent(bars(many_partitions, sf)), t.extent(many_partitions, sf, bars)
        assert found["symbols"] <= bound["symbols"] and found["longest"] <= bound["longest"]
    assert dealt(QUERIES["features_all"](many_partitions, sf)) == [25]
    assert dealt(QUERIES["trend_adx"](many_partitions, sf)) == [5]
