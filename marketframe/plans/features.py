"""The whole feature table, module by module in the order they depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators import candles, memory, technical
from marketframe.operators.bars import finite
from marketframe.operators.candles import BEARISH, BULLISH
from marketframe.operators.memory import LAG_TARGETS
from marketframe.operators.panel import close_panel, open_panel
from marketframe.operators.rolling_sentiment import add_rolling_sentiment_features

MODULES = {
    "trend": technical.add_trend_features,
    "momentum": technical.add_momentum_features,
    "macd": technical.add_macd_features,
    "volatility": technical.add_volatility_features,
    "volume": technical.add_volume_features,
    "geometry": candles.add_candle_geometry,
    "patterns": candles.add_pattern_features,
    "strength": candles.add_pattern_strength,
    "interactions": candles.add_interaction_features,
    "sequence": memory.add_sequence_features,
    "sr_proximity": memory.add_sr_proximity,
    "lags": memory.add_lag_features,
    "returns": memory.add_return_features,
}


# Features that a later module reads. All others are packed as soon as they are there: 340 separate
# columns through every window would cost more than computing them.
READ_LATER = {
    *LAG_TARGETS,
    "adx_proxy", "rsi_oversold", "rsi_overbought", "bullish_divergence", "bearish_divergence",
    "macd_bullish_cross", "macd_bearish_cross", "bb_squeeze", "atr_14", "rv5",
    "body_abs", "upper_wick", "lower_wick", "candle_range",
    *BULLISH, *BEARISH, "pat_doji", "pat_spinning_top",
    "ret_1d", "ret_5d",
}


def build_features(
    bars: DataFrame,
    symbol: str = "symbol",
    ts: str = "ts",
    modules: list[str] | None = None,
    max_rows: int | None = None,
    halo: int | None = None,
    longest: int | None = None,
    symbols: int | None = None,
) -> DataFrame:
    """All derived columns for all symbols; call ``drop_warmup`` on what you select.

    The panel is opened once, so all modules share one shuffle and one sort. Selecting a
    few columns of the result prunes every window they do not need.
    ``modules`` limits the list to some of ``MODULES``, in the fixed order. Rolling
    sentiment is added when the bars carry daily sentiment.
    """
    chosen = [m for name, m in MODULES.items() if modules is None or name in modules]
    chosen += [add_rolling_sentiment_features] * ("sentiment_mean" in bars.columns)
    carriers = [m.states for m in chosen if hasattr(m, "states")]
    states = lambda f: {o: x for m in carriers for o, x in m(f, bars.columns).items()}
    p = open_panel(bars, symbol, ts, max_rows, halo, longest=longest, symbols=symbols, states=states)
    own = list(bars.columns)
    order, packs = list(own), {}
    for name, module in MODULES.items():
        if modules is not None and name not in modules:
            continue
        before = set(p.names)
        p = module(p)
        new = [c for c in p.names if c not in before]
        order += new
        done = {c: finite(c) for c in new if c not in READ_LATER}
        if done:
            packs[f"__{name}"] = list(done)
            p = p.pack(f"__{name}", done)
    if "sentiment_mean" in p:
        before = set(p.names)
        p = add_rolling_sentiment_features(p)
        order += [c for c in p.names if c not in before]
    place = {c: f"{pack}.{c}" for pack, columns in packs.items() for c in columns}
    left = {c: t for c, t in p.df.select(*[c for c in order if c not in place]).dtypes}
    last = {c: finite(c) if t == "double" else F.col(c) for c, t in left.items()}
    return close_panel(p, [(last[c] if c in last else F.col(place[c])).alias(c) for c in order])
