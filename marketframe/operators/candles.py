"""Candle geometry, candlestick patterns, their strength and their interactions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketframe.functions.kernels import clip, flag, prices, safe_div, sum_of, zero_to_null
from marketframe.operators.panel import Panel, panel_operator


# Which flags count as bullish and bearish (fixed values).
BULLISH = [
    "pat_hammer", "pat_inv_hammer", "pat_dragonfly_doji", "pat_bull_engulf", "pat_piercing",
    "pat_bull_harami", "pat_tweezer_bottom", "pat_morning_star", "pat_3white_soldiers",
    "pat_bull_marubozu",
]
BEARISH = [
    "pat_shooting_star", "pat_hanging_man", "pat_gravestone_doji", "pat_bear_engulf",
    "pat_dark_cloud", "pat_bear_harami", "pat_tweezer_top", "pat_evening_star",
    "pat_3black_crows", "pat_bear_marubozu",
]


def direction() -> Column:
    """1 for a rising bar, -1 for a falling one, else 0."""
    O, _, _, C = prices()
    return F.coalesce(F.signum(C - O), F.lit(0.0)).cast("int")


@panel_operator
def add_candle_geometry(p: Panel) -> Panel:
    """Body, wicks and their shares of the bar's range (17 columns).

    ``body_vs_atr`` and ``range_vs_atr`` are NULL unless volatility features ran before.
    """
    O, H, L, C = prices()
    body, size = C - O, F.abs(C - O)
    top, bottom = H - F.greatest(O, C), F.least(O, C) - L
    span = H - L
    atr = F.col("atr_14") if "atr_14" in p else None
    nothing = F.lit(None).cast("double")
    p = p.add({
        "body_size": body,
        "body_abs": size,
        "upper_wick": top,
        "lower_wick": bottom,
        "candle_range": F.coalesce(span, F.lit(0.0)),
        "body_ratio": safe_div(size, span),
        "upper_wick_ratio": safe_div(top, span),
        "lower_wick_ratio": safe_div(bottom, span),
        "wick_imbalance": safe_div(top - bottom, span),
        "body_position": safe_div(bottom, span),
        "body_midpoint_pos": safe_div((O + C) / 2 - L, span),
        "candle_direction": direction(),
        "close_open_pct": safe_div(body, O) * 100,
        "body_vs_atr": nothing if atr is None else safe_div(size, atr),
        "range_vs_atr": nothing if atr is None else safe_div(F.coalesce(span, F.lit(0.0)), atr),
        "body_abs_ma5": p.frames.mean(size, 5),
    })
    return p.add({"body_size_trend": safe_div(F.col("body_abs"), F.col("body_abs_ma5")) - 1})


def _context(p: Panel) -> tuple[Column, Column]:
    """(down, up): the trend a reversal pattern must appear in, from what is available."""
    _, _, _, C = prices()
    if "trend_agreement" not in p:
        earlier = p.frames.lag(C, 5)
        return C < earlier, C > earlier
    down, up = F.col("trend_agreement") < -0.25, F.col("trend_agreement") > 0.25
    if "rsi_14" not in p:
        return down, up
    strength = F.coalesce(F.col("rsi_14"), F.lit(50.0))
    return down & (strength < 50), up & (strength > 50)


@panel_operator
def add_pattern_features(p: Panel) -> Panel:
    """24 candlestick flags and three summary counts; needs the candle geometry."""
    O, H, L, C = prices()
    f = p.frames
    down, up = _context(p)
    lagged = {"o": O, "c": C, "h": H, "l": L, "b": F.col("body_abs"), "d": F.col("candle_direction")}
    p = p.add({
        "__t_down": F.coalesce(down, F.lit(False)),
        "__t_up": F.coalesce(up, F.lit(False)),
        **{f"__t_{n}1": f.lag(x) for n, x in lagged.items()},
        **{f"__t_{n}2": f.lag(x, 2) for n, x in lagged.items() if n in "ocbd"},
    })
    o1, c1, h1, l1, b1, d1 = (F.col(f"__t_{n}1") for n in lagged)
    o2, c2, b2, d2 = (F.col(f"__t_{n}2") for n in "ocbd")
    body, share, d = F.col("body_abs"), F.col("body_ratio"), F.col("candle_direction")
    top, bottom = F.col("upper_wick"), F.col("lower_wick")
    span = zero_to_null(F.col("candle_range"))
    down, up = F.col("__t_down"), F.col("__t_up")

    rises, falls = d == 1, d == -1
    turns_up, turns_down = (d1 == -1) & rises, (d1 == 1) & falls
    doji = share <= 0.10
    small_body = share <= 0.35
    hammer = (bottom >= 2 * body) & (top <= body * 0.3) & small_body & (span > C * 0.001)
    inverted = (top >= 2 * body) & (bottom <= body * 0.3) & small_body
    engulfs, inside = body > b1 * 1.1, body < b1 * 0.5
    middle1, middle2 = (o1 + c1) / 2, (o2 + c2) / 2
    star = (b2 > C * 0.01) & (b1 < b2 * 0.5)
    solid = (body > C * 0.005) & (b1 > C * 0.005) & (b2 > C * 0.005)

    p = p.add({
        "pat_doji": flag(doji),
        "pat_gravestone_doji": flag(doji & (bottom <= span * 0.05)),
        "pat_dragonfly_doji": flag(doji & (top <= span * 0.05)),
        "pat_hammer": flag(hammer & down),
        "pat_inv_hammer": flag(inverted & down),
        "pat_shooting_star": flag(inverted & up),
        "pat_hanging_man": flag(hammer & up),
        "pat_spinning_top": flag(
            (share > 0.10) & (share <= 0.30) & (top >= span * 0.20) & (bottom >= span * 0.20)
        ),
        "pat_bull_marubozu": flag(rises & (share >= 0.95)),
        "pat_bear_marubozu": flag(falls & (share >= 0.95)),
        "pat_bull_engulf": flag(turns_up & (O < c1) & (C > o1) & engulfs),
        "pat_bear_engulf": flag(turns_down & (O > c1) & (C < o1) & engulfs),
        "pat_piercing": flag(turns_up & (O < c1) & (C > middle1) & (C < o1)),
        "pat_dark_cloud": flag(turns_down & (O > c1) & (C < middle1) & (C > o1)),
        "pat_bull_harami": flag(turns_up & (O > c1) & (C < o1) & inside),
        "pat_bear_harami": flag(turns_down & (O < c1) & (C > o1) & inside),
        "pat_tweezer_top": flag(turns_down & (F.abs(H - h1) <= span * 0.05)),
        "pat_tweezer_bottom": flag(turns_up & (F.abs(L - l1) <= span * 0.05)),
        "pat_morning_star": flag((d2 == -1) & star & rises & (C > middle2) & f.lag("__t_down", 2)),
        "pat_evening_star": flag((d2 == 1) & star & falls & (C < middle2) & f.lag("__t_up", 2)),
        "pat_3white_soldiers": flag(rises & (d1 == 1) & (d2 == 1) & (C > c1) & (c1 > c2) & solid),
        "pat_3black_crows": flag(falls & (d1 == -1) & (d2 == -1) & (C < c1) & (c1 < c2) & solid),
        "pat_inside_bar": flag((H < h1) & (L > l1)),
        "pat_outside_bar": flag((H > h1) & (L < l1)),
    })
    bulls, bears = (sum_of([F.col(c) for c in names]) for names in (BULLISH, BEARISH))
    return p.add({
        "bullish_pattern_count": bulls,
        "bearish_pattern_count": bears,
        "pattern_signal": bulls - bears,
    })


@panel_operator
def add_pattern_strength(p: Panel) -> Panel:
    """Graded quality of the fired patterns (6 columns)."""
    size, span = F.col("body_abs"), F.col("candle_range")
    growth = clip(safe_div(size, p.frames.lag(size)) - 1, 0, 5)

    def where_fired(names, value):
        fired = [F.col(n) == 1 for n in names if n in p]
        if not fired:
            return F.lit(0.0)
        return F.when(sum_of([x.cast("int") for x in fired]) > 0, value).otherwise(0.0)

    return p.add({
        "hammer_quality": where_fired(["pat_hammer", "pat_hanging_man"], safe_div(F.col("lower_wick"), span)),
        "star_quality": where_fired(["pat_shooting_star", "pat_inv_hammer"], safe_div(F.col("upper_wick"), span)),
        "bull_engulf_strength": where_fired(["pat_bull_engulf"], growth),
        "bear_engulf_strength": where_fired(["pat_bear_engulf"], growth),
        "doji_indecision": clip(1 - F.col("body_ratio") / 0.10, 0, 1),
        "marubozu_conviction": where_fired(["pat_bull_marubozu", "pat_bear_marubozu"], F.col("body_ratio")),
    })


# Patterns that are crossed with volume and with directional strength (fixed values).
VOLUME_CROSSED = [
    "pat_hammer", "pat_bull_engulf", "pat_morning_star", "pat_3white_soldiers", "pat_bull_marubozu",
    "pat_shooting_star", "pat_bear_engulf", "pat_evening_star", "pat_3black_crows", "pat_bear_marubozu",
]
STRENGTH_CROSSED = ["pat_hammer", "pat_bull_engulf", "pat_shooting_star", "pat_bear_engulf"]


@panel_operator
def add_interaction_features(p: Panel) -> Panel:
    """Products of patterns with volume, trend, volatility and momentum state (30 columns).

    An input whose module did not run takes its neutral value.
    """
    volume = clip(p.column_or("volume_ratio", 1.0), 0, 5)
    strength = p.column_or("adx_proxy", 0.0) / 100
    band = clip(p.column_or("bb_percent", 0.5), 0, 1)
    trend, squeeze = p.column_or("trend_agreement", 0.0), p.column_or("bb_squeeze", 0)
    low, high = p.column_or("rsi_oversold", 0), p.column_or("rsi_overbought", 0)
    bulls, bears = p.column_or("bullish_pattern_count", 0), p.column_or("bearish_pattern_count", 0)
    fired = lambda name: p.column_or(f"pat_{name}", 0)

    out = {f"{n}_vol": F.col(n) * volume for n in VOLUME_CROSSED if n in p}
    out |= {f"{n}_adx": F.col(n) * strength for n in STRENGTH_CROSSED if n in p}
    out |= {
        "bull_pat_at_bb_low": bulls * (1 - band),
        "bear_pat_at_bb_high": bears * band,
        "hammer_oversold": fired("hammer") * low,
        "bull_engulf_oversold": fired("bull_engulf") * low,
        "morning_star_oversold": fired("morning_star") * low,
        "shooting_star_overbought": fired("shooting_star") * high,
        "bear_engulf_overbought": fired("bear_engulf") * high,
        "evening_star_overbought": fired("evening_star") * high,
        "doji_in_squeeze": fired("doji") * squeeze,
        "spinning_top_in_squeeze": fired("spinning_top") * squeeze,
        "soldiers_trend_align": fired("3white_soldiers") * clip(trend, 0, 1),
        "crows_trend_align": fired("3black_crows") * clip(-trend, 0, 1),
    }
    if "bullish_divergence" in p:
        out["confirmed_bull_divergence"] = flag((F.col("bullish_divergence") == 1) & (bulls >= 1))
        out["confirmed_bear_divergence"] = flag((F.col("bearish_divergence") == 1) & (bears >= 1))
    if "macd_bullish_cross" in p:
        out["bull_pat_macd_cross"] = bulls * F.col("macd_bullish_cross")
        out["bear_pat_macd_cross"] = bears * F.col("macd_bearish_cross")
    return p.add(out)
