"""What the recent past looked like: sequences, support and resistance, lags, returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.functions.kernels import flag, prices, safe_div, zero_to_null
from marketframe.operators.candles import direction
from marketframe.operators.panel import Panel, panel_operator, with_states


# Columns that are lagged by default, and by how many rows (fixed values).
LAG_TARGETS = [
    "close", "rsi_14", "rsi_normalized", "macd_histogram_pct", "macd_above_signal",
    "price_vs_sma20", "price_vs_sma50", "trend_agreement", "bb_percent", "atr_pct", "vol_regime",
    "volume_ratio", "obv_change_5d", "body_ratio", "wick_imbalance", "candle_direction",
    "pattern_signal", "bullish_pattern_count", "bearish_pattern_count", "dir_streak",
    "dir_balance_5",
]
LAG_PERIODS = [1, 2, 3, 5, 10]


def _turned(f, d):
    """True where a direction begins."""
    return f.lag(d).isNull() | (d != f.lag(d))


@with_states(lambda f, names: {"__t_start": ("latest", _turned(f, direction()))})
@panel_operator
def add_sequence_features(p: Panel) -> Panel:
    """Counts of rising and falling bars, streaks, pattern clusters, extremes (18 columns)."""
    _, H, L, C = prices()
    f = p.frames
    d = F.col("candle_direction")
    bulls, bears = p.column_or("bullish_pattern_count", 0), p.column_or("bearish_pattern_count", 0)
    signal = p.column_or("pattern_signal", 0)
    p = p.add({"__t_turn": _turned(f, d)})
    p = p.latest({"__t_start": F.col("__t_turn")})
    counts = {}
    for k in (3, 5, 10):
        rising, falling = f.total(flag(d == 1), k), f.total(flag(d == -1), k)
        counts |= {
            f"bull_candles_{k}": rising.cast("double"),
            f"bear_candles_{k}": falling.cast("double"),
            f"dir_balance_{k}": (rising - falling).cast("double"),
        }
    p = p.add({
        **counts,
        "dir_streak": d * (F.col("__t_pos") - F.col("__t_start") + 1).cast("int"),
        "bull_pat_5d_cluster": f.total(bulls, 5).cast("double"),
        "bear_pat_5d_cluster": f.total(bears, 5).cast("double"),
        "pat_signal_3d_mean": f.mean(signal, 3),
        **{f"__t_h{k}": f.high(H, k) for k in (10, 20)},
        **{f"__t_l{k}": f.low(L, k) for k in (10, 20)},
    })
    return p.add({
        "pat_signal_5d": F.col("bull_pat_5d_cluster") - F.col("bear_pat_5d_cluster"),
        **{f"pct_from_high_{k}": safe_div(F.col(f"__t_h{k}") - C, F.col(f"__t_h{k}")) * 100 for k in (10, 20)},
        **{f"pct_from_low_{k}": safe_div(C - F.col(f"__t_l{k}"), F.col(f"__t_l{k}")) * 100 for k in (10, 20)},
    })


@panel_operator
def add_sr_proximity(p: Panel) -> Panel:
    """Distance to rolling highs and lows from half a window on (9 columns)."""
    _, H, L, C = prices()
    f, out = p.frames, {}
    for k in (20, 50, 100):
        top, bottom = f.high(H, k, k // 2), f.low(L, k, k // 2)
        out |= {
            f"dist_to_high_{k}": safe_div(top - C, C) * 100,
            f"dist_to_low_{k}": safe_div(C - bottom, C) * 100,
            f"range_pos_{k}": safe_div(C - bottom, top - bottom),
        }
    return p.add(out)


@panel_operator
def add_lag_features(p: Panel, features: list[str] | None = None, periods: list[int] | None = None) -> Panel:
    """``{feature}_lag{n}`` for the given columns; absent ones are skipped."""
    names = [n for n in (features or LAG_TARGETS) if n in p]
    return p.add({f"{n}_lag{k}": p.frames.lag(n, k) for n in names for k in (periods or LAG_PERIODS)})


@panel_operator
def add_return_features(p: Panel) -> Panel:
    """Log returns in percent, their statistics and the drawdown (up to 20 columns).

    The two normalised returns appear only if volatility features ran before.
    """
    _, _, _, C = prices()
    f = p.frames
    p = p.add({f"ret_{k}d": F.ln(F.try_divide(C, f.lag(C, k))) * 100 for k in (1, 2, 3, 5, 10, 20)})
    r = F.col("ret_1d")
    known = r.isNotNull()
    gain = F.when(known, F.greatest(r, F.lit(0.0)))
    loss = F.when(known, F.greatest(-r, F.lit(0.0)))
    peak = f.high(C, 10)
    out = {}
    if "atr_pct" in p:
        out["ret_1d_norm"] = safe_div(r, F.col("atr_pct"))
    if "rv5" in p:
        out["ret_5d_norm"] = safe_div(F.col("ret_5d"), F.col("rv5"))
    for k in (5, 10, 20):
        out |= {f"ret_mean_{k}d": f.mean(r, k), f"ret_std_{k}d": f.std(r, k)}
    return p.add({
        **out,
        "ret_skew_5d": f.skew(r, 5),
        **{f"ret_positive_{k}d": f.mean(flag(r > 0), k) for k in (5, 10)},
        "up_down_ratio_10d": safe_div(f.mean(gain, 10), f.mean(loss, 10), 1.0),
        "max_drawdown_10d": F.try_divide((peak - C) * 100, zero_to_null(peak)),
        "ret_acceleration": f.diff(r),
    })
