"""A symbol cut into blocks gives the same features as a symbol in one piece."""

import numpy as np
import pandas as pd
import pytest
from bar_helpers import bars_frame, collect, to_spark
from pyspark.sql import functions as F

from marketframe.operators import panel as panels
from marketframe.operators.bars import clean_bars, fill_forward
from marketframe.operators.model import target_label
from marketframe.operators.panel import Panel, close_panel, open_panel
from marketframe.plans.features import build_features

HALO = panels.HALO


@pytest.fixture(scope="module")
def long_pdf():
    hot = bars_frame("HOT", 6200, 11, start="1990-01-01")
    # a streak and an unknown stretch far longer than the halo
    hot.loc[1000:4200, "high"] = 200 + np.arange(3201) * 0.5
    return pd.concat([hot, bars_frame("SHORT", 400, 12)])


@pytest.fixture(scope="module")
def long_bars(spark, long_pdf):
    return to_spark(spark, long_pdf).cache()


def same(a, b, tol=1e-9):
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "if":
            x, y = a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float)
            assert (np.isnan(x) == np.isnan(y)).all(), c
            ok = ~np.isnan(x)
            scale = np.maximum(1.0, np.abs(y[ok]))
            assert (np.abs(x[ok] - y[ok]) <= tol * scale).all(), c
        else:
            assert (a[c] == b[c]).all(), c


def test_blocks_cover_every_row_once(long_bars):
    p = open_panel(long_bars, max_rows=1700, halo=HALO)
    assert p.blocked
    counts = p.df.groupBy("symbol", "__block", "__own").count().toPandas()
    assert counts[counts["__own"]]["count"].sum() == 6600
    # no task sees more than a block, its halo, and a month at either end
    assert counts.groupby(["symbol", "__block"])["count"].sum().max() <= 1700 + HALO + 2 * 31
    assert counts[counts.symbol == "HOT"]["__block"].nunique() == 4
    back = close_panel(p)
    assert back.columns == long_bars.columns and back.count() == 6600


def test_positions_are_global(long_bars, long_pdf):
    p = open_panel(long_bars, max_rows=1700)
    got = collect(close_panel(p.add({"i": p.position()})))
    assert (got.i == got.groupby("symbol").cumcount() + 1).all()


@pytest.mark.parametrize("modules", [
    ["trend", "momentum"], ["macd"], ["volatility", "volume"], ["geometry", "patterns", "sequence", "lags"],
    ["sr_proximity", "returns"],
])
def test_features_are_the_same(long_bars, modules):
    whole = collect(build_features(long_bars, modules=modules))
    blocks = collect(build_features(long_bars, modules=modules, max_rows=1700))
    same(blocks, whole)


def test_streak_longer_than_halo(long_bars):
    blocks = build_features(long_bars, modules=["trend"], max_rows=1700)
    assert blocks.agg(F.max("hh_streak")).first()[0] >= 3200


def test_fill_forward_across_blocks(spark, long_bars):
    known = F.when(F.year("ts") != 1995, F.when(F.year("ts") != 1996, F.col("close")))
    holes = long_bars.withColumn("close", F.when(F.year("ts").between(1992, 1998), None).otherwise(F.col("close")))
    whole = collect(fill_forward(holes, ["close"]))
    p = open_panel(holes, max_rows=1700)
    blocks = collect(close_panel(p.last_known({"close": F.col("close")})))[list(whole.columns)]
    same(blocks, whole)
    assert known is not None and whole.close.notna().all()


def test_looking_ahead_across_blocks(long_bars, monkeypatch):
    whole = collect(target_label(long_bars, 5))
    monkeypatch.setattr(panels, "MAX_ROWS", 1700)
    same(collect(target_label(long_bars, 5)), whole)


def test_clean_bars_rules(spark):
    nan, none = float("nan"), None
    rows = [
        ("A", "2024-01-01", none, 2.0, 1.0, 1.5, 10.0, 1),   # no open yet: goes
        ("A", "2024-01-02", 1.0, 2.0, 1.0, 1.5, 10.0, 2),
        ("A", "2024-01-02", 1.0, 2.0, 1.0, 1.7, 11.0, 3),    # same time, later: stays
        ("A", "2024-01-03", 1.0, nan, 1.0, none, none, 4),   # filled from the row before
        ("A", "2024-01-04", 1.0, 2.0, 3.0, 1.5, 10.0, 5),    # crossed: goes
        ("A", "2024-01-05", -1.0, 2.0, 1.0, 1.5, 10.0, 6),   # negative: goes
        (none, "2024-01-06", 1.0, 2.0, 1.0, 1.5, 10.0, 7),   # no symbol: goes
    ]
    schema = "symbol string, ts string, open double, high double, low double, close double, volume double, n int"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = collect(clean_bars(df, sequence="n"))
    assert list(out.columns) == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert out[["open", "high", "low", "close", "volume"]].values.tolist() == [
        [1.0, 2.0, 1.0, 1.7, 11.0], [1.0, 2.0, 1.0, 1.7, 11.0]]


def test_panel_of_short_symbols_is_one_piece(long_bars):
    assert isinstance(open_panel(long_bars), Panel) and not open_panel(long_bars).blocked


@pytest.fixture(scope="module")
def second_bars(spark):
    """200,000 bars of one symbol, a second apart, and a short one."""
    at = F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, id)")
    close = 100 + F.sin(F.col("id") / 50) * 5 + F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    hot = spark.range(200_000).select(F.lit("HOT").alias("symbol"), at.alias("ts"), close.alias("close"))
    few = spark.range(50).select(F.lit("FEW").alias("symbol"), at.alias("ts"), close.alias("close"))
    bars = hot.union(few).withColumn("open", F.round(F.col("close"), 1))
    return bars.select(
        "symbol", "ts", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close",
        F.lit(10.0).alias("volume"),
    ).cache()


def test_dense_months_are_cut(second_bars):
    p = open_panel(second_bars)
    assert p.blocked
    sizes = p.df.groupBy("symbol", "__block").agg(F.count("*").alias("n"), F.count_if("__own").alias("own")).toPandas()
    assert sizes.own.sum() == 200_050 and (sizes.own > 0).all()
    assert sizes.n.max() <= panels.MAX_ROWS + HALO + 2 * 60  # a unit is a minute
    assert sizes.n.sum() <= 1.1 * 200_050


def test_dense_blocks_give_the_same_features(second_bars):
    modules = ["trend", "volume", "sequence", "geometry"]
    columns = ["symbol", "ts", "sma_200", "hh_streak", "ll_streak", "dir_streak", "obv_change_20d", "ema_50"]
    few = second_bars.where("ts < '2024-03-01 06:00:00'")
    whole = collect(build_features(few, modules=modules).select(columns))
    same(collect(build_features(few, modules=modules, max_rows=5000).select(columns)), whole)


def test_rows_without_time_or_symbol_stay(spark):
    pdf = bars_frame("AAA", 900, 5)
    df = to_spark(spark, pd.concat([pdf, bars_frame("BBB", 300, 6)]))
    holes = df.withColumn("ts", F.when(F.pmod(F.xxhash64("close", "ts"), F.lit(9)) > 0, F.col("ts")))
    holes = holes.withColumn("symbol", F.when(F.col("symbol") != "BBB", F.col("symbol")))
    keys = ["symbol", "ts", "close", "open", "high", "low"]
    cols = [*keys, "hh_streak"]
    whole = build_features(holes, modules=["trend"]).select(cols).toPandas()
    blocks = build_features(holes, modules=["trend"], max_rows=400, halo=300).select(cols).toPandas()
    # the order among rows without a time is not defined: compare what does not depend on it
    shape = lambda d: d[keys].sort_values(keys, na_position="first").reset_index(drop=True)
    pd.testing.assert_frame_equal(shape(blocks), shape(whole))
    assert len(whole) == 1200 and whole.ts.isna().sum() > 100


def test_blocked_plan_reads_little(spark, tmp_path, second_bars):
    second_bars.limit(3000).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    df = build_features(bars, max_rows=700, halo=300, longest=3000)
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    plan = query.executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert plan.count("FileScan") and final.count("FileScan") <= 4
    assert query.optimizedPlan().toString().count("Join Inner") == 3  # units (twice, one reused), states


def test_blocked_queries_are_registered():
    import __spark_entry__ as entry

    assert {"features_blocked", "clean_bars_blocked"} <= set(entry.queries()) & set(entry.oracle_sql())
