"""Features of the daily sentiment series and its agreement with price."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from marketframe.functions.kernels import flag, round4
from marketframe.operators.panel import Panel, panel_operator, with_states

NEUTRAL_BAND = 0.10
RSI_ROWS = 14
SPIKE = 2.0


def _mood():
    return F.coalesce(F.signum(F.col("sentiment_mean")), F.lit(0.0))


def _mood_turned(f, d):
    """True where a mood begins."""
    return F.coalesce(d != f.lag(d), F.lit(True))


@with_states(lambda f, names: {"__t_mood": ("latest", _mood_turned(f, _mood()))} if "sentiment_mean" in names else {})
@panel_operator
def add_rolling_sentiment_features(p: Panel) -> Panel:
    """19 columns from daily sentiment; unchanged, with a warning, if there is none.

    ``sent_price_confirm`` is regime times price direction: +1 if both go the same way
    (also both down), -1 if they part. Its inputs ``ret_1d``, ``ret_5d`` and ``rsi_14`` come from
    the return and momentum modules; without them the cross signals are 0.
    """
    if "sentiment_mean" not in p:
        warnings.warn("no sentiment_mean column: rolling sentiment features skipped", stacklevel=3)
        return p
    f = p.frames
    s = F.col("sentiment_mean")
    change = f.diff(s)
    p = p.add({
        **{f"sentiment_ma{k}": f.mean(s, k, 1) for k in (3, 7, 14)},
        **{f"sentiment_vol_{k}d": F.coalesce(f.std(s, k, 2), F.lit(0.0)) for k in (3, 7)},
        "__t_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
        "__t_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "__t_dir": _mood(),
    })
    ma3, ma7, ma14 = (F.col(f"sentiment_ma{k}") for k in (3, 7, 14))
    d = F.col("__t_dir")
    p = p.add({
        "sentiment_trend_3_7": round4(ma3 - ma7),
        "sentiment_trend_7_14": round4(ma7 - ma14),
        "sentiment_regime": F.when(ma7 > NEUTRAL_BAND, 1.0).when(ma7 < -NEUTRAL_BAND, -1.0).otherwise(0.0),
        "sentiment_improving": flag(ma3 > ma7),
        "__t_turn": _mood_turned(f, d),
        "__t_up": f.mean(F.col("__t_gain"), RSI_ROWS, RSI_ROWS // 2),
        "__t_dn": f.mean(F.col("__t_loss"), RSI_ROWS, RSI_ROWS // 2),
    })
    p = p.latest({"__t_mood": F.col("__t_turn")})
    up, dn = F.col("__t_up"), F.col("__t_dn")
    out = {
        "sentiment_rsi": F.coalesce(
            F.lit(100.0) - F.try_divide(F.lit(100.0), F.try_divide(up, dn) + 1.0), F.lit(50.0)
        ),
        "sentiment_streak": d * (F.col("__t_pos") - F.col("__t_mood") + 1),
    }

    if "sentiment_momentum" in p:
        m = F.col("sentiment_momentum")
        out["sentiment_momentum_3d"] = round4(f.mean(m, 3, 1))
        out["sentiment_accel"] = round4(F.coalesce(f.diff(m), F.lit(0.0)))
    else:
        out |= {"sentiment_momentum_3d": F.lit(0.0), "sentiment_accel": F.lit(0.0)}

    if "article_count" in p:
        n = F.col("article_count")
        p = p.add({"__t_n7": f.mean(n, 7, 1)})
        n7 = F.col("__t_n7")
        out |= {
            "article_count_ma7": F.rint(n7 * 100.0) / 100.0,
            "article_count_spike": flag(n > n7 * SPIKE),
            "attention_trend": flag(n7 > f.lag(n7, 3)),
        }
    else:
        out |= {"article_count_ma7": F.lit(0.0), "article_count_spike": F.lit(0), "attention_trend": F.lit(0)}

    absent = [c for c in ("ret_1d", "ret_5d", "rsi_14") if c not in p]
    if absent:
        warnings.warn(f"cross signals that need {absent} are set to 0", stacklevel=3)
    regime, trend = F.col("sentiment_regime"), F.col("sentiment_trend_3_7")
    zero = F.lit(0.0)
    out |= {
        "sent_price_confirm": regime * F.signum(p.column_or("ret_1d", 0.0)) if "ret_1d" in p else zero,
        "sent_rsi_diverge": flag((regime > 0) & (p.column_or("rsi_14", 50.0) > 70)),
        "sent_momentum_align": (
            flag(F.signum(F.coalesce(trend, zero)) == F.signum(p.column_or("ret_5d", 0.0)))
            if "ret_5d" in p
            else F.lit(0)
        ),
    }
    return p.add(out)
