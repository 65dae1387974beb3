"""Trend, momentum, MACD, volatility and volume features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketframe.functions.kernels import above_quantile, below_quantile, flag, prices, rank_in, safe_div, sum_of, zero_to_null
from marketframe.operators.panel import Panel, panel_operator, with_states



def crosses_above(p: Panel, a: Column, b: Column) -> Column:
    return flag((a > b) & (p.frames.lag(a) <= p.frames.lag(b)))


def crosses_below(p: Panel, a: Column, b: Column) -> Column:
    return flag((a < b) & (p.frames.lag(a) >= p.frames.lag(b)))


def _swings(f) -> dict[str, Column]:
    _, H, L, _ = prices()
    return {"__t_hh": flag(H > f.lag(H)), "__t_ll": flag(L < f.lag(L))}


@with_states(lambda f, names: {f"__t_l_{k}_streak": ("latest", x == 0) for k, x in zip(("hh", "ll"), _swings(f).values())})
@panel_operator
def add_trend_features(p: Panel) -> Panel:
    """Moving averages, slopes, directional strength and swing streaks (34 columns).

    ``ma5_slope`` to ``ma50_slope`` take their sources from sma_20, sma_50, sma_200 and
    sma_200: the names are fixed and do not tell the window.
    """
    _, H, L, C = prices()
    f = p.frames
    up, down = f.diff(H), F.abs(f.diff(L))
    p = p.add({
        **{f"sma_{k}": f.mean(C, k) for k in (20, 50, 200)},
        "__t_row": f.row(),
        # A bar without a predecessor moved by 0, it is not missing.
        "__t_up": F.when(up > down, F.greatest(up, F.lit(0.0))).otherwise(0.0),
        "__t_down": F.when(down > up, down).otherwise(0.0),
        **_swings(f),
    })
    p = p.ema({f"ema_{k}": ("close", k) for k in (9, 21, 50)})
    p = p.run_lengths({"hh_streak": "__t_hh", "ll_streak": "__t_ll"})

    sma20, sma50, sma200 = (F.col(f"sma_{k}") for k in (20, 50, 200))
    ema9, ema21 = F.col("ema_9"), F.col("ema_21")
    averages = {"sma20": "sma_20", "sma50": "sma_50", "sma200": "sma_200",
                "ema9": "ema_9", "ema21": "ema_21", "ema50": "ema_50"}
    slopes = {5: sma20, 10: sma50, 20: sma200, 50: sma200}
    span = zero_to_null(f.mean(H - L, 14))
    p = p.add({
        **{f"price_vs_{n}": safe_div(C - F.col(c), F.col(c)) * 100 for n, c in averages.items()},
        "sma20_sma50_ratio": safe_div(sma20, sma50, 1.0),
        "sma50_sma200_ratio": safe_div(sma50, sma200, 1.0),
        "ema9_ema21_ratio": safe_div(ema9, ema21, 1.0),
        "golden_cross": crosses_above(p, sma50, sma200),
        "death_cross": crosses_below(p, sma50, sma200),
        "ema9_ema21_cross": crosses_above(p, ema9, ema21),
        "sma20_rising": flag(sma20 > f.lag(sma20)),
        "sma50_rising": flag(sma50 > f.lag(sma50)),
        "ema21_rising": F.coalesce(F.signum(f.diff(ema21)), F.lit(0.0)).cast("int"),
        **{f"ma{n}_slope": safe_div(f.diff(s, 3), f.lag(s, 3)) * 100 for n, s in slopes.items()},
        **{f"__t_slope_{k}": f.slope(C, F.col("__t_row"), k) for k in (5, 10, 20)},
        **{f"__t_mean_{k}": f.mean(C, k) for k in (5, 10, 20)},
        "di_plus": safe_div(f.mean(F.col("__t_up"), 14), span) * 100,
        "di_minus": safe_div(f.mean(F.col("__t_down"), 14), span) * 100,
    })
    plus, minus = F.col("di_plus"), F.col("di_minus")
    votes = [F.signum(F.col(f"price_vs_{n}")) for n in ("sma20", "sma50", "ema21", "ema50")]
    p = p.add({
        **{
            f"lr_slope_{k}": F.col(f"__t_slope_{k}") / (F.col(f"__t_mean_{k}") + 1e-10) * 100
            for k in (5, 10, 20)
        },
        "__t_dx": safe_div(F.abs(plus - minus), plus + minus) * 100,
        "trend_agreement": sum_of(votes) / len(votes),
    })
    return p.add({"adx_proxy": f.mean(F.col("__t_dx"), 14)})


def rsi(gain: Column, loss: Column) -> Column:
    return F.try_divide(gain * 100.0, gain + loss)


@panel_operator
def add_momentum_features(p: Panel) -> Panel:
    """Wilder RSI at three lengths, its zones, and rates of change (14 columns)."""
    _, _, _, C = prices()
    f = p.frames
    change = f.diff(C)
    p = p.add({
        "__t_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "__t_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
    })
    p = p.wilder({f"__t_{side}{k}": (f"__t_{side}", k) for side in ("gain", "loss") for k in (7, 14, 21)})
    p = p.add({f"rsi_{k}": rsi(F.col(f"__t_gain{k}"), F.col(f"__t_loss{k}")) for k in (7, 14, 21)})
    r = F.col("rsi_14")
    return p.add({
        "rsi_overbought": flag(r > 70),
        "rsi_oversold": flag(r < 30),
        "rsi_neutral": flag(r.between(40, 60)),
        "rsi_momentum": f.diff(r),
        "rsi_momentum_3d": f.diff(r, 3),
        "rsi_normalized": r / 100,
        "rsi_fast_slow_diff": F.col("rsi_7") - F.col("rsi_21"),
        **{f"roc_{k}": (F.try_divide(C, f.lag(C, k)) - 1) * 100 for k in (3, 5, 10, 20)},
    })


@panel_operator
def add_rsi_simple(p: Panel, period: int = 14) -> Panel:
    """RSI from plain rolling means of gains and losses, as ``rsi_simple``.

    Only gains in the window give 100; a flat window has no value.
    """
    _, _, _, C = prices()
    f = p.frames
    p = p.add({"__t_change": f.diff(C)})
    d = F.col("__t_change")
    known = d.isNotNull()
    p = p.add({
        "__t_gain": f.mean(F.when(known, F.greatest(d, F.lit(0.0))), period),
        "__t_loss": f.mean(F.when(known, F.greatest(-d, F.lit(0.0))), period),
    })
    return p.add({"rsi_simple": rsi(F.col("__t_gain"), F.col("__t_loss"))})


@panel_operator
def add_macd_features(p: Panel) -> Panel:
    """MACD(12, 26, 9): line, signal, histogram, crosses and divergences (16 columns)."""
    _, _, _, C = prices()
    f = p.frames
    p = p.ema({"__t_fast": ("close", 12), "__t_slow": ("close", 26)})
    p = p.add({"macd_line": F.col("__t_fast") - F.col("__t_slow")})
    p = p.ema({"macd_signal": ("macd_line", 9)})
    line, signal, hist = (F.col(f"macd_{n}") for n in ("line", "signal", "histogram"))
    p = p.add({"macd_histogram": line - signal})
    p = p.add({"__t_size": F.abs(hist)})

    def ten_before(fn, x):
        frame = f.rows_before(10)
        return F.when(F.count(x).over(frame) >= 5, fn(x).over(frame))

    return p.add({
        **{f"macd_{n}_pct": safe_div(F.col(f"macd_{n}"), C) * 100 for n in ("line", "signal", "histogram")},
        "macd_bullish_cross": crosses_above(p, line, signal),
        "macd_bearish_cross": crosses_below(p, line, signal),
        "macd_zero_cross_up": flag((line > 0) & (f.lag(line) <= 0)),
        "macd_zero_cross_down": flag((line < 0) & (f.lag(line) >= 0)),
        "macd_above_signal": flag(line > signal),
        "macd_above_zero": flag(line > 0),
        "histogram_momentum": f.diff(hist),
        "histogram_growing": flag(F.col("__t_size") > f.lag("__t_size")),
        "bullish_divergence": flag((C < ten_before(F.min, C)) & (hist > ten_before(F.min, hist))),
        "bearish_divergence": flag((C > ten_before(F.max, C)) & (hist < ten_before(F.max, hist))),
    })


YEAR = 252  # trading rows per year


@panel_operator
def add_volatility_features(p: Panel) -> Panel:
    """Bollinger bands, ATR, realised volatility, Keltner position, regimes (22 columns).

    Bands are named by what they are (upper above lower); ``atr_14`` is a simple mean of
    true ranges.
    """
    _, H, L, C = prices()
    f = p.frames
    before = f.lag(C)
    p = p.add({
        "bb_middle": f.mean(C, 20),
        "__t_dev": f.roll(F.stddev_pop, C, 20),
        # greatest() skips the missing previous close of the first row
        "__t_tr": F.greatest(H - L, F.abs(H - before), F.abs(L - before)),
        "__t_ret": F.ln(F.try_divide(C, before)),
        "__t_range": F.coalesce(H - L, F.lit(0.0)),
    })
    mid, dev = F.col("bb_middle"), F.col("__t_dev")
    p = p.add({
        "bb_upper": mid + 2 * dev,
        "bb_lower": mid - 2 * dev,
        "atr_14": f.mean(F.col("__t_tr"), 14),
        "rv5": f.std(F.col("__t_ret"), 5) * (math.sqrt(YEAR) * 100),
        "rv20": f.std(F.col("__t_ret"), 20) * (math.sqrt(YEAR) * 100),
        "__t_ranges": f.recent(F.col("__t_range"), 20),
    })
    up, lo, atr = F.col("bb_upper"), F.col("bb_lower"), F.col("atr_14")
    p = p.add({
        "bb_bandwidth": F.try_divide((up - lo) * 100, mid),
        "bb_percent": F.try_divide(C - lo, up - lo),
        "atr_pct": safe_div(atr, C) * 100,
        "atr_ratio": safe_div(atr, f.mean(atr, 50), 1.0),
        "vol_regime": safe_div(F.col("rv5"), F.col("rv20"), 1.0),
        "kc_position": safe_div(C - (mid - atr * 2), (mid + atr * 2) - (mid - atr * 2)),
        "range_percentile": rank_in(F.col("__t_ranges"), F.col("__t_range"), 10),
    })
    width, share, atr_pct = F.col("bb_bandwidth"), F.col("bb_percent"), F.col("atr_pct")
    p = p.add({"__t_widths": f.recent(width, YEAR), "__t_atrs": f.recent(atr_pct, YEAR)})
    widths, atrs = F.col("__t_widths"), F.col("__t_atrs")
    return p.add({
        "bb_near_upper": flag(share > 0.8),
        "bb_near_lower": flag(share < 0.2),
        "bb_above_upper": flag(share > 1),
        "bb_below_lower": flag(share < 0),
        "bb_squeeze": below_quantile(widths, width, 0.20, 50),
        "bb_bandwidth_change": F.try_divide(width, f.lag(width, 3)) - 1,
        "bb_expanding": flag(width > f.lag(width)),
        "high_volatility": above_quantile(atrs, atr_pct, 0.75, 50),
        "low_volatility": below_quantile(atrs, atr_pct, 0.25, 50),
    })


def _traded() -> Column:
    return F.coalesce(F.col("volume"), F.lit(0.0))


def _signed_volume(f) -> Column:
    """On-balance volume's steps: the first row has no direction of its own and counts as a rise."""
    return F.coalesce(F.signum(f.diff(F.col("close"))), F.lit(1.0)) * _traded()


@with_states(lambda f, names: {"__t_obv": ("sum", _signed_volume(f))} if "volume" in names else {})
@panel_operator
def add_volume_features(p: Panel) -> Panel:
    """Volume ratios, on-balance volume, money flow and VWAP (18 columns).

    Returns the panel unchanged if there is no volume. Zero volume counts as missing in
    averages and as zero in sums.
    """
    _, H, L, C = prices()
    if "volume" not in p:
        return p
    f = p.frames
    traded = _traded()
    move = F.try_divide(C, f.lag(C)) - 1
    p = p.add({
        "__t_vol": zero_to_null(F.col("volume")),
        "__t_v0": traded,
        "__t_move": move,
        "__t_signed": _signed_volume(f),
        "money_flow": (H + L + C) / 3 * traded,
    })
    vol, v0, ret = F.col("__t_vol"), F.col("__t_v0"), F.col("__t_move")
    p = p.running_sum({"__t_obv": F.col("__t_signed")})
    obv = F.col("__t_obv")
    p = p.add({
        "volume_ma20": f.mean(vol, 20),
        "money_flow_ma10": f.mean(F.col("money_flow"), 10),
        "vwap_20": F.try_divide(f.total(F.col("money_flow"), 20), f.total(v0, 20)),
        "obv_change_5d": F.try_divide(obv, f.lag(obv, 5)) - 1,
        "obv_change_20d": F.try_divide(obv, f.lag(obv, 20)) - 1,
        "obv_above_ma": flag(obv > f.mean(obv, 20)),
        "close_position": safe_div(C - L, H - L, 0.5),
        "__t_volumes": f.recent(v0, 20),
    })
    p = p.add({"volume_ratio": safe_div(vol, F.col("volume_ma20"), 1.0)})
    ratio, ma, vwap = F.col("volume_ratio"), F.col("volume_ma20"), F.col("vwap_20")
    return p.add({
        "volume_spike": flag(ratio > 2),
        "volume_extreme_spike": flag(ratio > 3),
        "volume_low": flag(ratio < 0.5),
        "volume_trend": flag(ma > f.lag(ma, 5)),
        "price_vol_confirm": flag((ret != 0) & (ratio > 1.2)),
        "bullish_vol_conf": flag(ret > 0) * ratio,
        "bearish_vol_conf": flag(ret < 0) * ratio,
        "vol_percentile": rank_in(F.col("__t_volumes"), v0, 10),
        "dist_to_vwap": safe_div(C - vwap, vwap) * 100,
    })

