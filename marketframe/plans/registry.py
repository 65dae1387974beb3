"""Which columns belong together, and which the model gets.

The lists are fixed values. Some group members are never produced (``ret_1d`` is not lagged by
default); ``select_feature_group`` returns what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketframe.functions.scalars import NEUTRAL_DAY
from marketframe.operators.bars import inf_to_null
from marketframe.operators.memory import LAG_PERIODS

# Raw levels that are dropped before training (fixed values).
RAW_COLUMNS = [
    "sma_20", "sma_50", "sma_200", "ema_9", "ema_21", "ema_50",
    "bb_upper", "bb_middle", "bb_lower",
    "macd_line", "macd_signal", "macd_histogram",
    "atr_14", "volume_ma20",
    "body_size", "body_abs", "upper_wick", "lower_wick", "body_abs_ma5",
    "money_flow", "vwap_20", "close",
]
OHLCV = ["open", "high", "low", "close", "volume"]
NOT_FEATURES = ["ticker", "symbol", "target"]

# Feature groups (fixed values).
FEATURE_GROUPS: dict[str, list[str]] = {
    "trend": [
        "price_vs_sma20", "price_vs_sma50", "price_vs_sma200", "price_vs_ema9", "price_vs_ema21", "price_vs_ema50",
        "sma20_sma50_ratio", "sma50_sma200_ratio", "ema9_ema21_ratio",
        "golden_cross", "death_cross", "ema9_ema21_cross",
        "sma20_rising", "sma50_rising", "ema21_rising",
        "ma5_slope", "ma10_slope", "ma20_slope", "ma50_slope",
        "lr_slope_5", "lr_slope_10", "lr_slope_20",
        "di_plus", "di_minus", "adx_proxy", "hh_streak", "ll_streak", "trend_agreement",
    ],
    "momentum": [
        "rsi_7", "rsi_14", "rsi_21", "rsi_overbought", "rsi_oversold", "rsi_neutral",
        "rsi_momentum", "rsi_momentum_3d", "rsi_normalized", "rsi_fast_slow_diff",
        "roc_3", "roc_5", "roc_10", "roc_20",
    ],
    "macd": [
        "macd_line_pct", "macd_signal_pct", "macd_histogram_pct",
        "macd_bullish_cross", "macd_bearish_cross", "macd_zero_cross_up", "macd_zero_cross_down",
        "macd_above_signal", "macd_above_zero", "histogram_momentum", "histogram_growing",
        "bullish_divergence", "bearish_divergence",
    ],
    "volatility": [
        "bb_bandwidth", "bb_percent", "bb_near_upper", "bb_near_lower", "bb_above_upper",
        "bb_below_lower", "bb_squeeze", "bb_bandwidth_change", "bb_expanding",
        "atr_pct", "atr_ratio", "rv5", "rv20", "vol_regime", "kc_position",
        "high_volatility", "low_volatility", "range_percentile",
    ],
    "volume": [
        "volume_ratio", "volume_spike", "volume_extreme_spike", "volume_low", "volume_trend",
        "obv_change_5d", "obv_change_20d", "obv_above_ma", "price_vol_confirm", "close_position",
        "bullish_vol_conf", "bearish_vol_conf", "vol_percentile", "money_flow_ma10", "dist_to_vwap",
    ],
    "geometry": [
        "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "wick_imbalance", "body_position",
        "body_midpoint_pos", "candle_direction", "close_open_pct", "body_vs_atr", "range_vs_atr",
        "body_size_trend",
    ],
    "patterns": [
        "pat_doji", "pat_gravestone_doji", "pat_dragonfly_doji", "pat_hammer", "pat_inv_hammer",
        "pat_shooting_star", "pat_hanging_man", "pat_spinning_top", "pat_bull_marubozu",
        "pat_bear_marubozu", "pat_bull_engulf", "pat_bear_engulf", "pat_piercing",
        "pat_dark_cloud", "pat_bull_harami", "pat_bear_harami", "pat_tweezer_top",
        "pat_tweezer_bottom", "pat_morning_star", "pat_evening_star", "pat_3white_soldiers",
        "pat_3black_crows", "pat_inside_bar", "pat_outside_bar",
        "bullish_pattern_count", "bearish_pattern_count", "pattern_signal",
    ],
    "strength": [
        "hammer_quality", "star_quality", "bull_engulf_strength", "bear_engulf_strength",
        "doji_indecision", "marubozu_conviction",
    ],
    "interactions": [
        "bull_pat_at_bb_low", "bear_pat_at_bb_high",
        "hammer_oversold", "bull_engulf_oversold", "morning_star_oversold",
        "shooting_star_overbought", "bear_engulf_overbought", "evening_star_overbought",
        "confirmed_bull_divergence", "confirmed_bear_divergence",
        "doji_in_squeeze", "spinning_top_in_squeeze",
        "soldiers_trend_align", "crows_trend_align", "bull_pat_macd_cross", "bear_pat_macd_cross",
    ],
    "sequence": [
        "dir_balance_3", "dir_balance_5", "dir_balance_10", "dir_streak",
        "bull_pat_5d_cluster", "bear_pat_5d_cluster", "pat_signal_5d", "pat_signal_3d_mean",
        "pct_from_high_10", "pct_from_high_20", "pct_from_low_10", "pct_from_low_20",
    ],
    "sr_proximity": [
        "dist_to_high_20", "dist_to_low_20", "range_pos_20",
        "dist_to_high_50", "dist_to_low_50", "range_pos_50",
        "dist_to_high_100", "dist_to_low_100", "range_pos_100",
    ],
    "lags": [
        f"{c}_lag{n}"
        for c in ("rsi_14", "pattern_signal", "trend_agreement", "bb_percent", "volume_ratio",
                  "candle_direction", "ret_1d", "macd_histogram_pct")
        for n in LAG_PERIODS
    ],
    "returns": [
        "ret_1d", "ret_2d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ret_1d_norm", "ret_5d_norm",
        "ret_mean_5d", "ret_mean_10d", "ret_mean_20d", "ret_std_5d", "ret_std_10d", "ret_std_20d",
        "ret_skew_5d", "ret_positive_5d", "ret_positive_10d", "up_down_ratio_10d",
        "max_drawdown_10d", "ret_acceleration",
    ],
}

SENTIMENT_GROUPS: dict[str, list[str]] = {
    "rolling_means": ["sentiment_ma3", "sentiment_ma7", "sentiment_ma14"],
    "rolling_volatility": ["sentiment_vol_3d", "sentiment_vol_7d"],
    "trend": ["sentiment_trend_3_7", "sentiment_trend_7_14", "sentiment_regime", "sentiment_improving"],
    "momentum": ["sentiment_momentum_3d", "sentiment_accel", "sentiment_rsi", "sentiment_streak"],
    "attention": ["article_count_ma7", "article_count_spike", "attention_trend"],
    "cross_signal": ["sent_price_confirm", "sent_rsi_diverge", "sent_momentum_align"],
}
ROLLING_SENTIMENT = [c for group in SENTIMENT_GROUPS.values() for c in group]
DAILY_SENTIMENT = list(NEUTRAL_DAY)

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _numeric(df: DataFrame, drop: set[str]) -> list[str]:
    return [c for c, t in df.dtypes if c not in drop and (t in _NUMERIC or t.startswith("decimal"))]


def feature_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns a model may be trained on."""
    return _numeric(df, {*RAW_COLUMNS, *OHLCV, *NOT_FEATURES})


def all_columns_but_raw(df: DataFrame) -> list[str]:
    """The simple choice: every column but OHLCV, identifiers and the target."""
    return [c for c in df.columns if c not in {*OHLCV, *NOT_FEATURES, "ts"}]


def model_features(
    df: DataFrame,
    extra_drop: list[str] | None = None,
    keep_ohlcv: bool = False,
    keys: tuple[str, ...] = ("symbol", "ts"),
) -> DataFrame:
    """Keys plus the model's numeric columns, infinities as NULL.

    Without ``keep_ohlcv`` open, high, low and volume go too; close always does.
    """
    drop = {*RAW_COLUMNS, *(extra_drop or []), *([] if keep_ohlcv else OHLCV), *keys}
    kept = [k for k in keys if k in df.columns]
    return inf_to_null(df.select(*kept, *_numeric(df, drop)))


def group_columns(name: str) -> list[str]:
    """Columns of a rolling-sentiment group; an unknown group has none."""
    return SENTIMENT_GROUPS.get(name, [])


def select_feature_group(df: DataFrame, name: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys plus the columns of one feature or sentiment group that are present."""
    names = FEATURE_GROUPS.get(name, SENTIMENT_GROUPS.get(name, []))
    return df.select(*keys, *[c for c in names if c in df.columns])
