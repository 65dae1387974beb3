"""Feature modules against pandas and by hand, and the properties of the whole table."""

import warnings

import numpy as np
import pandas as pd
import pytest
from bar_helpers import bars_frame, collect, to_spark
from pyspark.sql import functions as F

from marketframe.functions.kernels import Frames, above_quantile, below_quantile, rank_in
from marketframe.operators import candles, memory, technical
from marketframe.operators.bars import drop_warmup
from marketframe.operators.rolling_sentiment import add_rolling_sentiment_features
from marketframe.operators.daily_sentiment import add_sentiment_placeholders
from marketframe.plans import registry
from marketframe.plans.features import MODULES, build_features


@pytest.fixture(scope="module")
def features(panel):
    return build_features(panel).cache()


@pytest.fixture(scope="module")
def table(features):
    return collect(features)


def one(table, symbol="AAA"):
    return table[table.symbol == symbol].reset_index(drop=True)


def close_to(got, want, tol=1e-9):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    ok = ~np.isnan(want)
    assert np.allclose(got[ok], want[ok], rtol=tol, atol=tol)


def seeded_ema(x, k):
    x = np.asarray(x, dtype=float)
    out = np.full(len(x), np.nan)
    seen = [i for i, v in enumerate(x) if not np.isnan(v)]
    if len(seen) < k:
        return out
    out[seen[k - 1]] = x[seen[:k]].mean()
    for a, b in zip(seen[k - 1:], seen[k:]):
        out[b] = 2 / (k + 1) * x[b] + (1 - 2 / (k + 1)) * out[a]
    return out


def test_column_counts(features, panel):
    assert len(features.columns) - len(panel.columns) == 336
    assert features.columns[: len(panel.columns)] == panel.columns
    sizes = {}
    for name, module in MODULES.items():
        if name in ("geometry", "patterns", "strength", "interactions", "sequence", "lags"):
            continue
        sizes[name] = len(module(panel).columns) - len(panel.columns)
    assert sizes == {
        "trend": 34, "momentum": 14, "macd": 16, "volatility": 22, "volume": 18, "sr_proximity": 9, "returns": 18,
    }


def test_model_columns(features):
    chosen = registry.model_features(features)
    assert len(chosen.columns) == 2 + 315
    assert set(registry.feature_columns(features)) == set(chosen.columns) - {"symbol", "ts"}
    assert "candle_range" in chosen.columns and "close_lag1" in chosen.columns and "close" not in chosen.columns
    kept = registry.model_features(features, extra_drop=["rsi_14"], keep_ohlcv=True).columns
    assert {"open", "high", "low", "volume"} <= set(kept) and "rsi_14" not in kept and "close" not in kept


def test_groups(features):
    for name, columns in registry.FEATURE_GROUPS.items():
        missing = set(columns) - set(features.columns)
        assert missing == ({f"ret_1d_lag{n}" for n in memory.LAG_PERIODS} if name == "lags" else set())
    assert registry.select_feature_group(features, "nothing").columns == ["symbol", "ts"]
    assert [len(v) for v in registry.SENTIMENT_GROUPS.values()] == [3, 2, 4, 4, 3, 3]
    assert len(registry.ROLLING_SENTIMENT) == 19 and registry.group_columns("nothing") == []


def test_averages(table):
    a = one(table)
    c = a.close
    for k in (20, 50, 200):
        close_to(a[f"sma_{k}"], c.rolling(k).mean())
    for k in (9, 21, 50):
        close_to(a[f"ema_{k}"], seeded_ema(c, k))
    line = seeded_ema(c, 12) - seeded_ema(c, 26)
    close_to(a.macd_line, line)
    close_to(a.macd_signal, seeded_ema(line, 9))
    assert (a.price_vs_sma200[:199] == 0).all() and a.sma_200[:199].isna().all()


def test_rsi(table):
    a = one(table)
    d = a.close.diff()
    for k in (7, 14, 21):
        up = d.clip(lower=0).ewm(alpha=1 / k, adjust=False, min_periods=k).mean()
        down = (-d.clip(upper=0)).ewm(alpha=1 / k, adjust=False, min_periods=k).mean()
        close_to(a[f"rsi_{k}"], 100 * up / (up + down))
        assert a[f"rsi_{k}"].isna().sum() == k


def test_rsi_simple(panel, panel_pdf):
    got = one(collect(technical.add_rsi_simple(panel)))
    d = panel_pdf[panel_pdf.symbol == "AAA"].close.diff()
    up, down = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
    close_to(got.rsi_simple, 100 - 100 / (1 + up / down), 1e-8)


def test_volatility(table):
    a = one(table)
    width = a.bb_bandwidth
    assert (a.bb_upper.dropna() >= a.bb_lower.dropna()).all()
    q = width.rolling(252, min_periods=50).quantile(0.2)
    assert (a.bb_squeeze == (width < q).astype(int)).all() and a.bb_squeeze.sum() > 0
    for name, p, above in (("high_volatility", 0.75, True), ("low_volatility", 0.25, False)):
        q = a.atr_pct.rolling(252, min_periods=50).quantile(p)
        want = (a.atr_pct > q) if above else (a.atr_pct < q)
        assert (a[name] == want.astype(int)).all() and a[name].sum() > 0
    rank = (a.high - a.low).rolling(20, min_periods=10).apply(lambda x: pd.Series(x).rank(pct=True).iloc[-1])
    close_to(a.range_percentile, rank)
    tr = pd.concat([a.high - a.low, (a.high - a.close.shift()).abs(), (a.low - a.close.shift()).abs()], axis=1).max(axis=1)
    close_to(a.atr_14, tr.rolling(14).mean())


def test_volume(table):
    a = one(table)
    v = a.volume.replace(0, np.nan)
    close_to(a.volume_ma20, v.rolling(20).mean())
    sign = np.sign(a.close.diff()).fillna(1)
    obv = (sign * a.volume).cumsum()
    assert (a.obv_above_ma == (obv > obv.rolling(20).mean()).astype(int)).all()
    want = (obv / obv.shift(5).replace(0, np.nan) - 1)
    close_to(a.obv_change_5d, want)
    # zero volume leaves the ratio at its neutral value
    assert (a.volume_ratio[a.volume == 0] == 1).all()


def test_no_volume_column(panel):
    bare = panel.drop("volume")
    assert technical.add_volume_features(bare).columns == bare.columns
    assert "volume_ratio" not in build_features(bare, modules=["volume", "sr_proximity"]).columns


def test_streaks(table):
    a = one(table)
    run = best = 0
    for up, got in zip(a.high > a.high.shift(), a.hh_streak):
        run = run + 1 if up else 0
        assert got == run
        best = max(best, run)
    assert best > 2
    run, prev = 0, None
    for d, got in zip(a.candle_direction, a.dir_streak):
        run = run + 1 if d == prev else 1
        prev = d
        assert got == d * run


def test_returns(table):
    a = one(table)
    r = np.log(a.close / a.close.shift()) * 100
    close_to(a.ret_1d, r)
    close_to(a.ret_skew_5d, r.rolling(5).skew(), 1e-6)
    close_to(a.ret_positive_5d, (r > 0).rolling(5).mean())
    up, down = r.clip(lower=0).rolling(10).mean(), r.clip(upper=0).abs().rolling(10).mean().replace(0, np.nan)
    close_to(a.up_down_ratio_10d, (up / down).fillna(1.0))
    close_to(a.ret_1d_norm, (r / a.atr_pct.replace(0, np.nan)).fillna(0))


def test_hammer_by_hand(spark):
    """Six falling bars, then a small body on a long lower wick."""
    rows = [("S", f"2024-01-0{i + 1}", 20.0 - i, 20.1 - i, 18.9 - i, 19.0 - i) for i in range(6)]
    rows += [("S", "2024-01-07", 13.0, 13.32, 11.0, 13.3), ("S", "2024-01-08", 10.0, 10.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, open double, high double, low double, close double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = collect(candles.add_pattern_strength(candles.add_pattern_features(candles.add_candle_geometry(df))))
    assert out.pat_hammer.tolist() == [0, 0, 0, 0, 0, 0, 1, 0]
    assert out.hammer_quality[6] == pytest.approx(2.0 / 2.32)
    # a bar without range: every share is 0, a doji, and no pattern that needs a range
    last = out.iloc[7]
    assert last.body_ratio == 0 and last.pat_doji == 1 and last.pat_gravestone_doji == 0 and last.doji_indecision == 1
    assert out.body_vs_atr.isna().all()


def test_one_row_symbol(table):
    row = one(table, "ONE").iloc[0]
    assert row.hh_streak == 0 and row.dir_streak in (-1, 0, 1) and pd.isna(row.sma_20)
    assert row.price_vs_sma20 == 0 and row.sma20_sma50_ratio == 1 and row.golden_cross == 0


def test_warmup_needs_200_rows(features):
    kept = drop_warmup(features.select("symbol", "ts", "sma_200")).groupBy("symbol").count().collect()
    assert {r["symbol"]: r["count"] for r in kept} == {"AAA": 131}


def test_no_infinities(table):
    values = table.select_dtypes("number").to_numpy(dtype=float)
    assert not np.isinf(values).any()


def test_no_lookahead(panel, features):
    """Features at a row are the same when later bars are not there yet."""
    cut = F.lit("2001-09-15").cast("timestamp_ntz")
    early = collect(build_features(panel.where(F.col("ts") <= cut)))
    full = collect(features.where(F.col("ts") <= cut))
    pd.testing.assert_frame_equal(early, full, check_dtype=False)


def test_symbols_do_not_mix(panel, features):
    alone = collect(build_features(panel.where("symbol = 'BBB'").repartition(7)))
    pd.testing.assert_frame_equal(alone, collect(features.where("symbol = 'BBB'")), check_dtype=False)


def test_one_shuffle_one_sort(spark, panel_pdf):
    bars = to_spark(spark, panel_pdf.head(300))  # not the cached bars
    plan = build_features(bars, longest=330)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    few = build_features(bars, longest=330).select("symbol", "ts", "roc_5")
    assert few._jdf.queryExecution().executedPlan().toString().count("Window [") <= 1


def test_kernels_with_ties(spark):
    pdf = pd.DataFrame({"symbol": "S", "ts": pd.date_range("2024-01-01", periods=200), "x": np.random.default_rng(5).integers(0, 6, 200).astype(float)})
    f, x = Frames(["symbol"], F.col("ts")), F.col("x")
    df = to_spark(spark, pdf).withColumn("r", f.recent(x, 30)).withColumn("i", f.row())
    r = F.col("r")
    got = collect(df.select(
        "symbol", "ts", rank_in(r, x, 15).alias("rank"), below_quantile(r, x, 0.2, 10).alias("below"),
        above_quantile(r, x, 0.75, 10).alias("above"), f.quantile(x, 0.3, 30, 10).alias("q"),
        f.slope(x, F.col("i"), 10).alias("slope"),
    ))
    s = pdf.x
    close_to(got["rank"], s.rolling(30, min_periods=15).apply(lambda v: pd.Series(v).rank(pct=True).iloc[-1]))
    assert (got.below == (s < s.rolling(30, min_periods=10).quantile(0.2)).astype(int)).all()
    assert (got.above == (s > s.rolling(30, min_periods=10).quantile(0.75)).astype(int)).all()
    close_to(got.q, s.rolling(30, min_periods=10).quantile(0.3))
    close_to(got.slope, s.rolling(10).apply(lambda v: np.polyfit(np.arange(10), v, 1)[0]), 1e-7)


def sentiment_bars(panel):
    h = F.xxhash64("symbol", "ts")
    s = F.round((F.pmod(h, F.lit(2001)) - 1000) / 2500, 4)
    return add_sentiment_placeholders(panel).withColumns({
        "sentiment_mean": F.when(F.pmod(h, F.lit(5)) == 0, 0.0).otherwise(s),
        "article_count": F.pmod(h, F.lit(7)).cast("double"),
    })


def test_rolling_sentiment(panel):
    out = build_features(sentiment_bars(panel), modules=["momentum", "returns"])
    assert set(registry.ROLLING_SENTIMENT) <= set(out.columns)
    a = one(collect(out))
    s = a.sentiment_mean
    close_to(a.sentiment_ma7, s.rolling(7, min_periods=1).mean())
    close_to(a.sentiment_vol_3d, s.rolling(3, min_periods=2).std().fillna(0), 1e-7)
    d = s.diff()
    up = d.clip(lower=0).rolling(14, min_periods=7).mean()
    down = (-d.clip(upper=0)).rolling(14, min_periods=7).mean().replace(0, np.nan)
    close_to(a.sentiment_rsi, (100 - 100 / (1 + up / down)).fillna(50))
    run = 0.0
    for sign, got in zip(np.sign(s), a.sentiment_streak):
        run = 0.0 if sign == 0 else (run + sign if np.sign(run) == sign else sign)
        assert got == run
    n7 = a.article_count.rolling(7, min_periods=1).mean()
    assert (a.article_count_spike == (a.article_count > 2 * n7).astype(int)).all()
    assert (a.attention_trend == (n7 > n7.shift(3)).astype(int)).all()
    assert (a.sent_price_confirm == a.sentiment_regime * np.sign(a.ret_1d.fillna(0))).all()


def test_rolling_sentiment_without_price_features(panel):
    with pytest.warns(UserWarning):
        out = collect(add_rolling_sentiment_features(sentiment_bars(panel)))
    assert (out[["sent_price_confirm", "sent_rsi_diverge", "sent_momentum_align"]] == 0).all().all()
    with pytest.warns(UserWarning):
        assert add_rolling_sentiment_features(panel).columns == panel.columns


def test_same_columns_with_and_without_news(panel):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a = build_features(add_sentiment_placeholders(panel), modules=["returns"])
        b = build_features(sentiment_bars(panel), modules=["returns"])
    assert a.columns == b.columns


def test_bars_frame_has_edge_cases():
    pdf = bars_frame("X", 300, 9)
    assert (pdf.high == pdf.low).any() and (pdf.volume == 0).any() and (pdf.high >= pdf.low).all()
