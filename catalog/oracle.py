"""SQL for the same results, written for DuckDB over the same tables.

Where it can, the SQL takes another road than the Spark code: recursion for exponential
means, islands for streaks, quantile functions for the regime flags, a subquery for the next
trading day.
"""

from __future__ import annotations

from marketframe.operators.headlines import GOLD
from marketframe.operators.memory import LAG_PERIODS, LAG_TARGETS
from marketframe.plans import registry

ORACLE: dict[str, str] = {}

W = "PARTITION BY symbol ORDER BY ts"


def frame(k: int) -> str:
    return f"{W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"


def roll(fn: str, x: str, k: int, m: int | None = None) -> str:
    need = k if m is None else m
    return f"CASE WHEN count({x}) OVER ({frame(k)}) >= {need} THEN {fn}({x}) OVER ({frame(k)}) END"


def mean(x: str, k: int, m: int | None = None) -> str:
    """Mean that adds the rows up oldest first."""
    total = f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER ({frame(k)}), lambda p, q: p + q)"
    n = f"count({x}) OVER ({frame(k)})"
    return f"CASE WHEN {n} >= {k if m is None else m} THEN {total} / {n} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def sd(a: str, b: str, fill: str = "0.0") -> str:
    return f"coalesce(({a}) / nullif({b}, 0), {fill})"


def flag(p: str) -> str:
    return f"CASE WHEN {p} THEN 1 ELSE 0 END"


def r6(x: str, name: str | None = None) -> str:
    """Six places, half to even, never -0.0; the queries round the same way."""
    return f"round_even(({x}) * 1000000, 0) / 1000000 + 0.0 AS {name or x}"


def round4(x: str) -> str:
    return f"round_even(({x}) * 10000, 0) / 10000"


def clip(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


class Chain:
    """A list of CTEs, each adding columns to the one before."""

    def __init__(self, *ctes: str, start: str = "bars"):
        self.ctes, self.last, self.numbered = list(ctes), start, False

    def add(self, body: str) -> Chain:
        name = f"s{len(self.ctes)}"
        self.ctes.append(f"{name} AS MATERIALIZED ({body})")
        self.last = name
        return self

    def step(self, **columns: str) -> Chain:
        new = ", ".join(f"{x} AS {n}" for n, x in columns.items())
        return self.add(f"SELECT *, {new} FROM {self.last}")

    def exponential(self, specs: dict[str, tuple[str, float, int, bool]]) -> Chain:
        """out: (x, alpha, k, seeded). Seeded means start with the mean of k values."""
        so_far = f"{W} ROWS UNBOUNDED PRECEDING"
        columns = {"rn": f"row_number() OVER ({W})"}
        for o, (x, _, k, seeded) in specs.items():
            columns[f"n_{o}"] = f"count({x}) OVER ({so_far})"
            columns[f"f_{o}"] = mean(x, k) if seeded else x
            columns[f"x_{o}"] = x
        if self.numbered:
            del columns["rn"]
        self.numbered = True
        self.step(**columns)
        src = self.last
        first, rest = [], []
        for o, (_, a, k, seeded) in specs.items():
            at = k if seeded else 1
            first.append(f"CASE WHEN n_{o} = {at} THEN f_{o} END AS {o}")
            rest.append(
                f"CASE WHEN b.n_{o} = {at} AND e.{o} IS NULL THEN b.f_{o} "
                f"WHEN b.n_{o} > {at} THEN {a!r}::DOUBLE * b.x_{o} + {1.0 - a!r}::DOUBLE * e.{o} END"
            )
        name = f"r{len(self.ctes)}"
        self.ctes.append(
            f"{name} AS (SELECT symbol, rn, {', '.join(first)} FROM {src} WHERE rn = 1 "
            f"UNION ALL SELECT b.symbol, b.rn, {', '.join(rest)} FROM {name} e "
            f"JOIN {src} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"
        )
        outs = ", ".join(
            (f"e.{o}" if seeded else f"CASE WHEN b.n_{o} >= {k} THEN e.{o} END AS {o}")
            for o, (_, _, k, seeded) in specs.items()
        )
        return self.add(f"SELECT b.*, {outs} FROM {src} b JOIN {name} e USING (symbol, rn)")

    def ema(self, specs: dict[str, tuple[str, int]]) -> Chain:
        return self.exponential({o: (x, 2.0 / (k + 1), k, True) for o, (x, k) in specs.items()})

    def wilder(self, specs: dict[str, tuple[str, int]]) -> Chain:
        return self.exponential({o: (x, 1.0 / k, k, False) for o, (x, k) in specs.items()})

    def sql(self, final: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.ctes)} {final.format(last=self.last)}"

    def out(self, doubles: list[str] = (), plain: list[str] = (), keys: tuple[str, ...] = ("symbol", "ts")) -> str:
        cols = [*keys, *[r6(c) for c in doubles], *plain]
        return self.sql(f"SELECT {', '.join(cols)} FROM {{last}}")


# ---- bars ----


def event_bars(unit: str) -> str:
    return f"""bars AS MATERIALIZED (SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY 1, 2)"""


HOURLY = event_bars("hour")
MINUTES = event_bars("minute")
WEEKDAYS = event_bars("day").replace("bars AS", "all_days AS") + (
    ", bars AS MATERIALIZED (SELECT * FROM all_days WHERE isodow(ts) <= 5)"
)
_ORDER = "l_orderkey, l_linenumber, l_extendedprice, l_quantity"
DAILY = f"""bars AS MATERIALIZED (SELECT p_brand AS symbol, date_trunc('day', l_shipdate) AS ts,
    first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
    sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
OHLCV = ["open", "high", "low", "close", "volume"]
DIRTY = HOURLY.replace("bars AS", "fine AS") + """, bars AS MATERIALIZED (SELECT symbol, ts,
    CASE WHEN open > 150 THEN -open ELSE open END AS open, high,
    CASE WHEN high BETWEEN 100 AND 110 THEN high + 1 ELSE low END AS low,
    CASE WHEN close < 8 THEN NULL ELSE close END AS close,
    CASE WHEN volume = 2 THEN NULL WHEN volume = 3 THEN 0 ELSE volume END AS volume FROM fine)"""

ORACLE["bars_hourly"] = Chain(HOURLY).out(OHLCV)
ORACLE["bars_daily"] = Chain(DAILY).out(OHLCV)


def _clean() -> str:
    c = Chain(DIRTY).add(
        "SELECT * FROM bars WHERE coalesce(open > 0, true) AND coalesce(high > 0, true) AND "
        "coalesce(low > 0, true) AND coalesce(close > 0, true) AND coalesce(high >= low, true)"
    )
    fill = ", ".join(f"last_value({x} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS {x}" for x in OHLCV)
    c.add(f"SELECT symbol, ts, {fill} FROM {c.last}")
    c.add(f"SELECT * FROM {c.last} WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    return c.out(OHLCV)


ORACLE["clean_bars"] = ORACLE["clean_bars_blocked"] = _clean()
_PRICES = ["open", "high", "low", "close"]
ORACLE["validate_timeseries"] = f"""WITH {DIRTY}, counts AS (SELECT symbol, count(*) AS n_bars,
    CAST(0 AS BIGINT) AS duplicate_times,
    CAST(sum({' + '.join(flag(f'{c} IS NULL') for c in _PRICES)}) AS BIGINT) AS null_values,
    CAST(sum({' + '.join(flag(f'{c} <= 0') for c in _PRICES)}) AS BIGINT) AS bad_prices,
    CAST(sum({flag('high < low')}) AS BIGINT) AS crossed_bars,
    date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS missing_steps FROM bars GROUP BY symbol)
    SELECT *, {flag('null_values + bad_prices + crossed_bars = 0')} AS is_valid FROM counts"""
ORACLE["drop_zero_volume"] = f"WITH {DIRTY} SELECT symbol, ts, {', '.join(r6(c) for c in OHLCV)} FROM bars WHERE volume > 0"
ORACLE["within_last_period"] = (
    f"WITH {DAILY} SELECT symbol, ts, {', '.join(r6(c) for c in OHLCV)} FROM bars "
    "WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 3 MONTH"
)
# The 200-row mean and its 3-row difference are the last trend columns to get a value: row 200.
ORACLE["drop_warmup"] = f"""WITH {DAILY}, numbered AS (SELECT symbol, ts, row_number() OVER ({W}) AS rn FROM bars)
    SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM numbered WHERE rn >= 200 GROUP BY symbol"""


def rank_of(x: str, k: int, m: int) -> str:
    recent = f"list({x}) OVER ({frame(k)})"
    below = f"len(list_filter({recent}, lambda v: v < {x}))"
    equal = f"len(list_filter({recent}, lambda v: v = {x}))"
    return f"CASE WHEN len({recent}) >= {m} THEN ({below} + ({equal} + 1) / 2) / len({recent}) END"


def _ranked(x: str, k: int, m: int, name: str, c: Chain) -> Chain:
    c.step(recent=f"list({x}) OVER ({frame(k)})", rank_x=x)
    return c.step(**{name: (
        f"CASE WHEN len(recent) >= {m} THEN (len(list_filter(recent, lambda v: v < rank_x)) + "
        f"(len(list_filter(recent, lambda v: v = rank_x)) + 1) / 2) / len(recent) END"
    )})


def _kernels() -> str:
    c = Chain(HOURLY).step(i=f"row_number() OVER ({W})")
    _ranked("close", 20, 10, "rank_20", c)
    c.step(
        slope_10=f"CASE WHEN i >= 10 THEN regr_slope(close, i) OVER ({frame(10)}) END",
        quantile_50=f"CASE WHEN i >= 25 THEN quantile_cont(close, 0.2) OVER ({frame(50)}) END",
        skew_5=roll("skewness", "close", 5),
    )
    return c.out(["rank_20", "slope_10", "quantile_50", "skew_5"])


ORACLE["rolling_kernels"] = _kernels()

# ---- trend ----


def trend(c: Chain) -> Chain:
    c.step(
        sma_20=mean("close", 20), sma_50=mean("close", 50), sma_200=mean("close", 200),
        up=f"high - {lag('high')}", dn=f"abs(low - {lag('low')})",
        hh=flag(f"high > {lag('high')}"), ll=flag(f"low < {lag('low')}"),
        range14=mean("high - low", 14),
    )
    c.ema({f"ema_{k}": ("close", k) for k in (9, 21, 50)})
    c.step(
        dmp="CASE WHEN up > dn THEN greatest(up, 0) ELSE 0 END",
        dmm="CASE WHEN dn > up THEN dn ELSE 0 END",
        hg=f"sum(1 - hh) OVER ({W} ROWS UNBOUNDED PRECEDING)",
        lg=f"sum(1 - ll) OVER ({W} ROWS UNBOUNDED PRECEDING)",
        **{f"price_vs_{n}": sd(f"close - {m}", m) + " * 100" for n, m in (
            ("sma20", "sma_20"), ("sma50", "sma_50"), ("sma200", "sma_200"),
            ("ema9", "ema_9"), ("ema21", "ema_21"), ("ema50", "ema_50"))},
    )
    c.step(
        hh_streak="CAST(sum(hh) OVER (PARTITION BY symbol, hg ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INT)",
        ll_streak="CAST(sum(ll) OVER (PARTITION BY symbol, lg ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INT)",
        sma20_sma50_ratio=sd("sma_20", "sma_50", "1.0"),
        sma50_sma200_ratio=sd("sma_50", "sma_200", "1.0"),
        ema9_ema21_ratio=sd("ema_9", "ema_21", "1.0"),
        golden_cross=flag(f"sma_50 > sma_200 AND {lag('sma_50')} <= {lag('sma_200')}"),
        death_cross=flag(f"sma_50 < sma_200 AND {lag('sma_50')} >= {lag('sma_200')}"),
        ema9_ema21_cross=flag(f"ema_9 > ema_21 AND {lag('ema_9')} <= {lag('ema_21')}"),
        sma20_rising=flag(f"sma_20 > {lag('sma_20')}"),
        sma50_rising=flag(f"sma_50 > {lag('sma_50')}"),
        ema21_rising=f"CAST(coalesce(sign(ema_21 - {lag('ema_21')}), 0) AS INT)",
        **{f"ma{n}_slope": sd(f"{m} - {lag(m, 3)}", lag(m, 3)) + " * 100" for n, m in (
            (5, "sma_20"), (10, "sma_50"), (20, "sma_200"), (50, "sma_200"))},
        **{f"lr_slope_{k}": (
            f"CASE WHEN rn >= {k} THEN regr_slope(close, rn) OVER ({frame(k)}) END "
            f"/ ({mean('close', k)} + 1e-10) * 100") for k in (5, 10, 20)},
        di_plus=sd(mean("dmp", 14), "range14") + " * 100",
        di_minus=sd(mean("dmm", 14), "range14") + " * 100",
        trend_agreement="(sign(price_vs_sma20) + sign(price_vs_sma50) + sign(price_vs_ema21) + sign(price_vs_ema50)) / 4",
    )
    c.step(dx=sd("abs(di_plus - di_minus)", "di_plus + di_minus") + " * 100")
    return c.step(adx_proxy=mean("dx", 14))


ORACLE["trend_ma"] = trend(Chain(DAILY)).out([
    "sma_20", "sma_50", "sma_200", "ema_9", "ema_21", "ema_50",
    "price_vs_sma20", "price_vs_sma50", "price_vs_sma200", "price_vs_ema9", "price_vs_ema21", "price_vs_ema50",
    "sma20_sma50_ratio", "sma50_sma200_ratio", "ema9_ema21_ratio",
])
ORACLE["trend_cross"] = trend(Chain(DAILY)).out(["trend_agreement"], [
    "golden_cross", "death_cross", "ema9_ema21_cross", "sma20_rising", "sma50_rising", "ema21_rising"])
ORACLE["trend_slopes"] = trend(Chain(HOURLY)).out(["ma5_slope", "ma10_slope", "ma20_slope", "ma50_slope"])
ORACLE["trend_lr_slope"] = trend(Chain(HOURLY)).out(["lr_slope_5", "lr_slope_10", "lr_slope_20"])
ORACLE["trend_adx"] = trend(Chain(HOURLY)).out(["di_plus", "di_minus", "adx_proxy"])
ORACLE["trend_streaks"] = trend(Chain(DAILY)).out([], ["hh_streak", "ll_streak"])
ORACLE["features_blocked"] = trend(Chain(DAILY)).out(["sma_20", "sma_200", "adx_proxy"], ["hh_streak", "ll_streak"])

# ---- momentum ----


def momentum(c: Chain) -> Chain:
    c.step(drop_=f"close - {lag('close')}")
    c.step(up_="CASE WHEN drop_ > 0 THEN drop_ WHEN drop_ IS NOT NULL THEN 0.0::DOUBLE END",
           dn_="CASE WHEN drop_ < 0 THEN -drop_ WHEN drop_ IS NOT NULL THEN 0.0::DOUBLE END")
    c.wilder({f"{s}{k}": (f"{s}_", k) for s in ("up", "dn") for k in (7, 14, 21)})
    c.step(**{f"rsi_{k}": f"100 * up{k} / nullif(up{k} + dn{k}, 0)" for k in (7, 14, 21)})
    return c.step(
        rsi_overbought=flag("rsi_14 > 70"), rsi_oversold=flag("rsi_14 < 30"),
        rsi_neutral=flag("rsi_14 BETWEEN 40 AND 60"),
        rsi_momentum=f"rsi_14 - {lag('rsi_14')}", rsi_momentum_3d=f"rsi_14 - {lag('rsi_14', 3)}",
        rsi_normalized="rsi_14 / 100", rsi_fast_slow_diff="rsi_7 - rsi_21",
        **{f"roc_{k}": f"(close / {lag('close', k)} - 1) * 100" for k in (3, 5, 10, 20)},
    )


ORACLE["momentum_rsi"] = momentum(Chain(DAILY)).out(
    ["rsi_7", "rsi_14", "rsi_21", "rsi_momentum", "rsi_momentum_3d", "rsi_normalized", "rsi_fast_slow_diff"],
    ["rsi_overbought", "rsi_oversold", "rsi_neutral"])
ORACLE["momentum_roc"] = momentum(Chain(DAILY)).out(["roc_3", "roc_5", "roc_10", "roc_20"])


def _rsi_simple() -> str:
    c = Chain(DAILY).step(d=f"close - {lag('close')}")
    c.step(u="CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0::DOUBLE END",
           v="CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0::DOUBLE END")
    c.step(au=mean("u", 14), av=mean("v", 14))
    c.step(rsi_simple="CASE WHEN av = 0 THEN CASE WHEN au > 0 THEN 100.0 END ELSE 100 - 100 / (1 + au / av) END")
    return c.out(["rsi_simple"])


ORACLE["momentum_rsi_simple"] = _rsi_simple()

# ---- MACD ----


def macd(c: Chain) -> Chain:
    c.ema({"fast": ("close", 12), "slow": ("close", 26)})
    c.step(macd_line="fast - slow")
    c.ema({"macd_signal": ("macd_line", 9)})
    c.step(macd_histogram="macd_line - macd_signal")
    before = f"{W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"
    of = lambda fn, x: f"CASE WHEN count({x}) OVER ({before}) >= 5 THEN {fn}({x}) OVER ({before}) END"
    c.step(cmin=of("min", "close"), cmax=of("max", "close"),
           hmin=of("min", "macd_histogram"), hmax=of("max", "macd_histogram"))
    ll, ls, hl = lag("macd_line"), lag("macd_signal"), lag("macd_histogram")
    return c.step(
        **{f"macd_{n}_pct": sd(f"macd_{n}", "close") + " * 100" for n in ("line", "signal", "histogram")},
        macd_bullish_cross=flag(f"macd_line > macd_signal AND {ll} <= {ls}"),
        macd_bearish_cross=flag(f"macd_line < macd_signal AND {ll} >= {ls}"),
        macd_zero_cross_up=flag(f"macd_line > 0 AND {ll} <= 0"),
        macd_zero_cross_down=flag(f"macd_line < 0 AND {ll} >= 0"),
        macd_above_signal=flag("macd_line > macd_signal"), macd_above_zero=flag("macd_line > 0"),
        histogram_momentum=f"macd_histogram - {hl}",
        histogram_growing=flag(f"abs(macd_histogram) > abs({hl})"),
        bullish_divergence=flag("close < cmin AND macd_histogram > hmin"),
        bearish_divergence=flag("close > cmax AND macd_histogram < hmax"),
    )


ORACLE["macd_lines"] = macd(Chain(DAILY)).out([
    "macd_line", "macd_signal", "macd_histogram", "macd_line_pct", "macd_signal_pct", "macd_histogram_pct"])
ORACLE["macd_crosses"] = macd(Chain(DAILY)).out(["histogram_momentum"], [
    "macd_bullish_cross", "macd_bearish_cross", "macd_zero_cross_up", "macd_zero_cross_down",
    "macd_above_signal", "macd_above_zero", "histogram_growing"])
ORACLE["macd_divergence"] = macd(Chain(DAILY)).out([], ["bullish_divergence", "bearish_divergence"])

# ---- volatility ----


def volatility(c: Chain) -> Chain:
    pc = lag("close")
    c.step(
        bb_middle=mean("close", 20), dev=roll("stddev_pop", "close", 20),
        tr=f"greatest(high - low, abs(high - {pc}), abs(low - {pc}))",
        lr=f"ln(close / {pc})",
    )
    c.step(
        bb_upper="bb_middle + 2 * dev", bb_lower="bb_middle - 2 * dev", atr_14=mean("tr", 14),
        rv5=roll("stddev_samp", "lr", 5) + " * sqrt(252) * 100",
        rv20=roll("stddev_samp", "lr", 20) + " * sqrt(252) * 100",
    )
    c.step(
        bb_bandwidth="100 * (bb_upper - bb_lower) / nullif(bb_middle, 0)",
        bb_percent="(close - bb_lower) / nullif(bb_upper - bb_lower, 0)",
        atr_pct=sd("atr_14", "close") + " * 100",
        atr_ratio=sd("atr_14", mean("atr_14", 50), "1.0"),
        vol_regime=sd("rv5", "rv20", "1.0"),
        kc_position=sd("close - (bb_middle - 2 * atr_14)", "4 * atr_14"),
    )
    q = lambda x, p: f"CASE WHEN count({x}) OVER ({frame(252)}) >= 50 THEN quantile_cont({x}, {p}) OVER ({frame(252)}) END"
    return c.step(
        bb_near_upper=flag("bb_percent > 0.8"), bb_near_lower=flag("bb_percent < 0.2"),
        bb_above_upper=flag("bb_percent > 1"), bb_below_lower=flag("bb_percent < 0"),
        bb_squeeze=flag(f"bb_bandwidth < {q('bb_bandwidth', 0.2)}"),
        bb_bandwidth_change=f"bb_bandwidth / nullif({lag('bb_bandwidth', 3)}, 0) - 1",
        bb_expanding=flag(f"bb_bandwidth > {lag('bb_bandwidth')}"),
        high_volatility=flag(f"atr_pct > {q('atr_pct', 0.75)}"),
        low_volatility=flag(f"atr_pct < {q('atr_pct', 0.25)}"),
    )


ORACLE["vol_bollinger"] = volatility(Chain(DAILY)).out(
    ["bb_upper", "bb_middle", "bb_lower", "bb_bandwidth", "bb_percent"],
    ["bb_near_upper", "bb_near_lower", "bb_above_upper", "bb_below_lower"])
ORACLE["vol_squeeze"] = volatility(Chain(HOURLY)).out(["bb_bandwidth_change"], ["bb_squeeze", "bb_expanding"])
ORACLE["vol_atr"] = volatility(Chain(DAILY)).out(["atr_14", "atr_pct", "atr_ratio"])
ORACLE["vol_realised"] = volatility(Chain(DAILY)).out(["rv5", "rv20", "vol_regime"])
ORACLE["vol_keltner"] = volatility(Chain(DAILY)).out(["kc_position"])
ORACLE["vol_regime_flags"] = volatility(Chain(DAILY)).out([], ["high_volatility", "low_volatility"])
ORACLE["vol_range_rank"] = _ranked("high - low", 20, 10, "range_percentile", Chain(HOURLY)).out(["range_percentile"])

# ---- volume ----


def volume(c: Chain) -> Chain:
    c.step(
        vol="nullif(volume, 0)", v0="coalesce(volume, 0)", ret=f"close / {lag('close')} - 1",
        signed=f"coalesce(sign(close - {lag('close')}), 1) * coalesce(volume, 0)",
        money_flow="(high + low + close) / 3 * coalesce(volume, 0)",
    )
    c.step(obv=f"sum(signed) OVER ({W} ROWS UNBOUNDED PRECEDING)", volume_ma20=mean("vol", 20),
           money_flow_ma10=mean("money_flow", 10),
           vwap_20=f"{roll('sum', 'money_flow', 20)} / nullif({roll('sum', 'v0', 20)}, 0)")
    c.step(
        volume_ratio=sd("vol", "volume_ma20", "1.0"),
        obv_change_5d=f"obv / nullif({lag('obv', 5)}, 0) - 1",
        obv_change_20d=f"obv / nullif({lag('obv', 20)}, 0) - 1",
        obv_above_ma=flag(f"obv > {mean('obv', 20)}"),
        close_position=sd("close - low", "high - low", "0.5"),
        dist_to_vwap=sd("close - vwap_20", "vwap_20") + " * 100",
    )
    return c.step(
        volume_spike=flag("volume_ratio > 2"), volume_extreme_spike=flag("volume_ratio > 3"),
        volume_low=flag("volume_ratio < 0.5"), volume_trend=flag(f"volume_ma20 > {lag('volume_ma20', 5)}"),
        price_vol_confirm=flag("ret <> 0 AND volume_ratio > 1.2"),
        bullish_vol_conf="CASE WHEN ret > 0 THEN volume_ratio ELSE 0 END",
        bearish_vol_conf="CASE WHEN ret < 0 THEN volume_ratio ELSE 0 END",
    )


ORACLE["volume_ratio"] = volume(Chain(HOURLY)).out(
    ["volume_ma20", "volume_ratio", "close_position", "bullish_vol_conf", "bearish_vol_conf"],
    ["volume_spike", "volume_extreme_spike", "volume_low", "volume_trend", "price_vol_confirm"])
ORACLE["volume_obv"] = ORACLE["volume_obv_blocked"] = volume(Chain(HOURLY)).out(["obv_change_5d", "obv_change_20d"], ["obv_above_ma"])
ORACLE["volume_vwap"] = volume(Chain(HOURLY)).out(["money_flow", "money_flow_ma10", "vwap_20", "dist_to_vwap"])
ORACLE["volume_rank"] = _ranked("volume", 20, 10, "vol_percentile", Chain(HOURLY)).out(["vol_percentile"])

# ---- candles ----


def geometry(c: Chain, atr: bool = True) -> Chain:
    c.step(
        body_size="close - open", body_abs="abs(close - open)", upper_wick="high - greatest(open, close)",
        lower_wick="least(open, close) - low", candle_range="high - low",
    )
    return c.step(
        body_ratio=sd("body_abs", "candle_range"), upper_wick_ratio=sd("upper_wick", "candle_range"),
        lower_wick_ratio=sd("lower_wick", "candle_range"),
        wick_imbalance=sd("upper_wick - lower_wick", "candle_range"),
        body_position=sd("least(open, close) - low", "candle_range"),
        body_midpoint_pos=sd("(open + close) / 2 - low", "candle_range"),
        candle_direction="CAST(sign(body_size) AS INT)", close_open_pct=sd("body_size", "open") + " * 100",
        **({"body_vs_atr": sd("body_abs", "atr_14"), "range_vs_atr": sd("candle_range", "atr_14")} if atr else {}),
        body_abs_ma5=mean("body_abs", 5),
        body_size_trend=sd("body_abs", mean("body_abs", 5)) + " - 1",
    )


ORACLE["candle_geometry"] = geometry(volatility(Chain(HOURLY))).out([
    "body_size", "body_abs", "upper_wick", "lower_wick", "candle_range", "body_ratio",
    "upper_wick_ratio", "lower_wick_ratio", "wick_imbalance", "body_position", "body_midpoint_pos",
    "close_open_pct", "body_vs_atr", "range_vs_atr", "body_abs_ma5", "body_size_trend"], ["candle_direction"])


def patterns(c: Chain, context: bool = True) -> Chain:
    if context:
        down, up = ("trend_agreement < -0.25 AND coalesce(rsi_14, 50) < 50",
                    "trend_agreement > 0.25 AND coalesce(rsi_14, 50) > 50")
    else:
        down, up = f"close < {lag('close', 5)}", f"close > {lag('close', 5)}"
    c.step(
        dn_ctx=flag(down), up_ctx=flag(up), span="nullif(candle_range, 0)",
        **{f"{n}{k}": lag(x, k) for k in (1, 2) for n, x in (
            ("o", "open"), ("c", "close"), ("h", "high"), ("l", "low"), ("b", "body_abs"), ("d", "candle_direction"))},
    )
    hammer = ("lower_wick >= 2 * body_abs AND upper_wick <= body_abs * 0.3 AND body_ratio <= 0.35 "
              "AND span > close * 0.001")
    inv = "upper_wick >= 2 * body_abs AND lower_wick <= body_abs * 0.3 AND body_ratio <= 0.35"
    bull, bear = "d1 = -1 AND candle_direction = 1", "d1 = 1 AND candle_direction = -1"
    big = "body_abs > close * 0.005 AND b1 > close * 0.005 AND b2 > close * 0.005"
    c.step(
        pat_doji=flag("body_ratio <= 0.10"),
        pat_gravestone_doji=flag("body_ratio <= 0.10 AND lower_wick <= span * 0.05"),
        pat_dragonfly_doji=flag("body_ratio <= 0.10 AND upper_wick <= span * 0.05"),
        pat_hammer=flag(f"{hammer} AND dn_ctx = 1"), pat_inv_hammer=flag(f"{inv} AND dn_ctx = 1"),
        pat_shooting_star=flag(f"{inv} AND up_ctx = 1"), pat_hanging_man=flag(f"{hammer} AND up_ctx = 1"),
        pat_spinning_top=flag("body_ratio <= 0.30 AND upper_wick >= span * 0.20 AND lower_wick >= span * 0.20 "
                              "AND body_ratio > 0.10"),
        pat_bull_marubozu=flag("candle_direction = 1 AND body_ratio >= 0.95"),
        pat_bear_marubozu=flag("candle_direction = -1 AND body_ratio >= 0.95"),
        pat_bull_engulf=flag(f"{bull} AND open < c1 AND close > o1 AND body_abs > b1 * 1.1"),
        pat_bear_engulf=flag(f"{bear} AND open > c1 AND close < o1 AND body_abs > b1 * 1.1"),
        pat_piercing=flag(f"{bull} AND open < c1 AND close > (o1 + c1) / 2 AND close < o1"),
        pat_dark_cloud=flag(f"{bear} AND open > c1 AND close < (o1 + c1) / 2 AND close > o1"),
        pat_bull_harami=flag(f"{bull} AND open > c1 AND close < o1 AND body_abs < b1 * 0.5"),
        pat_bear_harami=flag(f"{bear} AND open < c1 AND close > o1 AND body_abs < b1 * 0.5"),
        pat_tweezer_top=flag(f"{bear} AND abs(high - h1) <= span * 0.05"),
        pat_tweezer_bottom=flag(f"{bull} AND abs(low - l1) <= span * 0.05"),
        pat_morning_star=flag("d2 = -1 AND b2 > close * 0.01 AND b1 < b2 * 0.5 AND candle_direction = 1 "
                              f"AND close > (o2 + c2) / 2 AND {lag('dn_ctx', 2)} = 1"),
        pat_evening_star=flag("d2 = 1 AND b2 > close * 0.01 AND b1 < b2 * 0.5 AND candle_direction = -1 "
                              f"AND close < (o2 + c2) / 2 AND {lag('up_ctx', 2)} = 1"),
        pat_3white_soldiers=flag(f"candle_direction = 1 AND d1 = 1 AND d2 = 1 AND close > c1 AND c1 > c2 AND {big}"),
        pat_3black_crows=flag(f"candle_direction = -1 AND d1 = -1 AND d2 = -1 AND close < c1 AND c1 < c2 AND {big}"),
        pat_inside_bar=flag("high < h1 AND low > l1"), pat_outside_bar=flag("high > h1 AND low < l1"),
    )
    c.step(
        bullish_pattern_count="pat_hammer + pat_inv_hammer + pat_dragonfly_doji + pat_bull_engulf + pat_piercing + "
        "pat_bull_harami + pat_tweezer_bottom + pat_morning_star + pat_3white_soldiers + pat_bull_marubozu",
        bearish_pattern_count="pat_shooting_star + pat_hanging_man + pat_gravestone_doji + pat_bear_engulf + "
        "pat_dark_cloud + pat_bear_harami + pat_tweezer_top + pat_evening_star + pat_3black_crows + pat_bear_marubozu",
    )
    return c.step(pattern_signal="bullish_pattern_count - bearish_pattern_count")


def with_patterns() -> Chain:
    c = trend(Chain(HOURLY))
    c.add(f"SELECT * EXCLUDE (up, dn) FROM {c.last}")
    c = momentum(c)
    return patterns(geometry(c, atr=False))


_FLAGS = {
    "patterns_single": ["pat_doji", "pat_gravestone_doji", "pat_dragonfly_doji", "pat_hammer", "pat_inv_hammer",
                        "pat_shooting_star", "pat_hanging_man", "pat_spinning_top", "pat_bull_marubozu",
                        "pat_bear_marubozu"],
    "patterns_double": ["pat_bull_engulf", "pat_bear_engulf", "pat_piercing", "pat_dark_cloud", "pat_bull_harami",
                        "pat_bear_harami", "pat_tweezer_top", "pat_tweezer_bottom", "pat_inside_bar",
                        "pat_outside_bar"],
    "patterns_triple": ["pat_morning_star", "pat_evening_star", "pat_3white_soldiers", "pat_3black_crows"],
    "patterns_summary": ["bullish_pattern_count", "bearish_pattern_count", "pattern_signal"],
}
for _name, _columns in _FLAGS.items():
    ORACLE[_name] = with_patterns().out([], _columns)
ORACLE["patterns_without_context"] = patterns(geometry(Chain(HOURLY), atr=False), context=False).out([], [
    "pat_hammer", "pat_inv_hammer", "pat_shooting_star", "pat_hanging_man", "pat_morning_star", "pat_evening_star"])


def strength(c: Chain) -> Chain:
    grow = clip(sd("body_abs", lag("body_abs")) + " - 1", "0", "5")
    return c.step(
        hammer_quality=f"CASE WHEN pat_hammer = 1 OR pat_hanging_man = 1 THEN {sd('lower_wick', 'candle_range')} ELSE 0 END",
        star_quality=f"CASE WHEN pat_shooting_star = 1 OR pat_inv_hammer = 1 THEN {sd('upper_wick', 'candle_range')} ELSE 0 END",
        bull_engulf_strength=f"CASE WHEN pat_bull_engulf = 1 THEN {grow} ELSE 0 END",
        bear_engulf_strength=f"CASE WHEN pat_bear_engulf = 1 THEN {grow} ELSE 0 END",
        doji_indecision=clip("1 - body_ratio / 0.10", "0", "1"),
        marubozu_conviction="CASE WHEN pat_bull_marubozu = 1 OR pat_bear_marubozu = 1 THEN body_ratio ELSE 0 END",
    )


ORACLE["pattern_strength"] = strength(with_patterns()).out(registry.FEATURE_GROUPS["strength"])


def interactions(c: Chain) -> tuple[Chain, list[str], list[str]]:
    """The chain with the crossed features, and their names: doubles, whole numbers."""
    bb, bt = clip("coalesce(bb_percent, 0.5)", "0", "1"), "trend_agreement"
    vol = clip("coalesce(volume_ratio, 1)", "0", "5")
    cols = {f"pat_{n}_vol": f"pat_{n} * {vol}" for n in (
        "hammer", "bull_engulf", "morning_star", "3white_soldiers", "bull_marubozu", "shooting_star",
        "bear_engulf", "evening_star", "3black_crows", "bear_marubozu")}
    cols |= {f"pat_{n}_adx": f"pat_{n} * coalesce(adx_proxy, 0) / 100" for n in (
        "hammer", "bull_engulf", "shooting_star", "bear_engulf")}
    cols |= {
        "bull_pat_at_bb_low": f"bullish_pattern_count * (1 - {bb})",
        "bear_pat_at_bb_high": f"bearish_pattern_count * {bb}",
        "soldiers_trend_align": f"pat_3white_soldiers * {clip(bt, '0', '1')}",
        "crows_trend_align": f"pat_3black_crows * {clip('-' + bt, '0', '1')}",
    }
    ints = {
        "hammer_oversold": "pat_hammer * rsi_oversold", "bull_engulf_oversold": "pat_bull_engulf * rsi_oversold",
        "morning_star_oversold": "pat_morning_star * rsi_oversold",
        "shooting_star_overbought": "pat_shooting_star * rsi_overbought",
        "bear_engulf_overbought": "pat_bear_engulf * rsi_overbought",
        "evening_star_overbought": "pat_evening_star * rsi_overbought",
        "confirmed_bull_divergence": flag("bullish_divergence = 1 AND bullish_pattern_count >= 1"),
        "confirmed_bear_divergence": flag("bearish_divergence = 1 AND bearish_pattern_count >= 1"),
        "doji_in_squeeze": "pat_doji * bb_squeeze", "spinning_top_in_squeeze": "pat_spinning_top * bb_squeeze",
        "bull_pat_macd_cross": "bullish_pattern_count * macd_bullish_cross",
        "bear_pat_macd_cross": "bearish_pattern_count * macd_bearish_cross",
    }
    return c.step(**cols, **ints), list(cols), list(ints)


def _interactions() -> str:
    c = trend(Chain(HOURLY))
    c.add(f"SELECT * EXCLUDE (up, dn) FROM {c.last}")
    c = momentum(c)
    c = volume(volatility(macd(c)))
    c, doubles, ints = interactions(patterns(geometry(c)))
    return c.out(doubles, ints)


ORACLE["interactions"] = _interactions()


def sequence(c: Chain) -> Chain:
    c.step(turn=f"CASE WHEN candle_direction = {lag('candle_direction')} THEN 0 ELSE 1 END",
           bull_=flag("candle_direction = 1"), bear_=flag("candle_direction = -1"))
    c.step(grp=f"sum(turn) OVER ({W} ROWS UNBOUNDED PRECEDING)")
    total = lambda x, k: f"CAST({roll('sum', x, k)} AS DOUBLE)"
    c.step(
        dir_streak="CAST(candle_direction * row_number() OVER (PARTITION BY symbol, grp ORDER BY ts) AS INT)",
        **{f"{s}_candles_{k}": total(f"{s}_", k) for s in ("bull", "bear") for k in (3, 5, 10)},
        bull_pat_5d_cluster=total("bullish_pattern_count", 5), bear_pat_5d_cluster=total("bearish_pattern_count", 5),
        pat_signal_3d_mean=roll("avg", "pattern_signal", 3),
        **{f"h{k}_": roll("max", "high", k) for k in (10, 20)}, **{f"l{k}_": roll("min", "low", k) for k in (10, 20)},
    )
    return c.step(
        **{f"dir_balance_{k}": f"bull_candles_{k} - bear_candles_{k}" for k in (3, 5, 10)},
        pat_signal_5d="bull_pat_5d_cluster - bear_pat_5d_cluster",
        **{f"pct_from_high_{k}": sd(f"h{k}_ - close", f"h{k}_") + " * 100" for k in (10, 20)},
        **{f"pct_from_low_{k}": sd(f"close - l{k}_", f"l{k}_") + " * 100" for k in (10, 20)},
    )


def _sequence() -> str:
    doubles = [f"{s}_candles_{k}" for s in ("bull", "bear") for k in (3, 5, 10)]
    doubles += [n for n in registry.FEATURE_GROUPS["sequence"] if n != "dir_streak"]
    return sequence(with_patterns()).out(doubles, ["dir_streak"])


ORACLE["sequence"] = ORACLE["sequence_blocked"] = _sequence()


def sr(c: Chain) -> Chain:
    for k in (20, 50, 100):
        hi, lo = roll("max", "high", k, k // 2), roll("min", "low", k, k // 2)
        c.step(**{f"hi{k}": hi, f"lo{k}": lo})
        c.step(**{
            f"dist_to_high_{k}": sd(f"hi{k} - close", "close") + " * 100",
            f"dist_to_low_{k}": sd(f"close - lo{k}", "close") + " * 100",
            f"range_pos_{k}": sd(f"close - lo{k}", f"hi{k} - lo{k}"),
        })
    return c


ORACLE["sr_proximity"] = sr(Chain(DAILY)).out(registry.FEATURE_GROUPS["sr_proximity"])


def returns(c: Chain, normalised: bool = False) -> Chain:
    c.step(**{f"ret_{k}d": f"ln(close / {lag('close', k)}) * 100" for k in (1, 2, 3, 5, 10, 20)})
    c.step(up_r="CASE WHEN ret_1d > 0 THEN ret_1d WHEN ret_1d IS NOT NULL THEN 0.0::DOUBLE END",
           dn_r="CASE WHEN ret_1d < 0 THEN -ret_1d WHEN ret_1d IS NOT NULL THEN 0.0::DOUBLE END",
           pos=flag("ret_1d > 0"), peak=roll("max", "close", 10))
    extra = {"ret_1d_norm": sd("ret_1d", "atr_pct"), "ret_5d_norm": sd("ret_5d", "rv5")} if normalised else {}
    return c.step(
        **extra,
        **{f"ret_mean_{k}d": roll("avg", "ret_1d", k) for k in (5, 10, 20)},
        **{f"ret_std_{k}d": roll("stddev_samp", "ret_1d", k) for k in (5, 10, 20)},
        ret_skew_5d=roll("skewness", "ret_1d", 5),
        ret_positive_5d=roll("avg", "pos", 5), ret_positive_10d=roll("avg", "pos", 10),
        up_down_ratio_10d=sd(roll("avg", "up_r", 10), roll("avg", "dn_r", 10), "1.0"),
        max_drawdown_10d="(peak - close) / nullif(peak, 0) * 100",
        ret_acceleration=f"ret_1d - {lag('ret_1d')}",
    )


# ---- all modules ----

# Features that are whole numbers (fixed values); all others are doubles.
WHOLE = {
    "hh_streak", "ll_streak", "golden_cross", "death_cross", "ema9_ema21_cross", "sma20_rising", "sma50_rising", "ema21_rising",
    "rsi_overbought", "rsi_oversold", "rsi_neutral", "macd_bullish_cross", "macd_bearish_cross", "macd_zero_cross_up",
    "macd_zero_cross_down", "macd_above_signal", "macd_above_zero", "histogram_growing", "bullish_divergence", "bearish_divergence",
    "bb_near_upper", "bb_near_lower", "bb_above_upper", "bb_below_lower", "bb_squeeze", "bb_expanding", "high_volatility",
    "low_volatility", "obv_above_ma", "volume_spike", "volume_extreme_spike", "volume_low", "volume_trend", "price_vol_confirm",
    "candle_direction", *registry.FEATURE_GROUPS["patterns"], "hammer_oversold", "bull_engulf_oversold", "morning_star_oversold",
    "shooting_star_overbought", "bear_engulf_overbought", "evening_star_overbought", "doji_in_squeeze", "spinning_top_in_squeeze",
    "confirmed_bull_divergence", "confirmed_bear_divergence", "bull_pat_macd_cross", "bear_pat_macd_cross", "dir_streak",
    "sentiment_improving", "article_count_spike", "attention_trend", "sent_rsi_diverge", "sent_momentum_align",
}
_LAGGED = {f"{x}_lag{k}": (x, k) for x in LAG_TARGETS for k in LAG_PERIODS}


def everything(c: Chain) -> tuple[Chain, list[str]]:
    """All 13 price modules on top of each other, and the names of their features."""
    trend(c).add(f"SELECT * EXCLUDE (up, dn) FROM {c.last}")
    volume(volatility(macd(momentum(c))))
    c, crossed, flags = interactions(strength(patterns(geometry(c))))
    sequence(c)
    _ranked("high - low", 20, 10, "range_percentile", c).add(f"SELECT * EXCLUDE (recent, rank_x, turn, grp) FROM {c.last}")
    _ranked("volume", 20, 10, "vol_percentile", c)
    returns(sr(c), True).step(**{n: lag(x, k) for n, (x, k) in _LAGGED.items()})
    names = [n for g, group in registry.FEATURE_GROUPS.items() if g != "lags" for n in group]
    names += [n for n in [*registry.RAW_COLUMNS, *crossed, *flags, "candle_range", *_LAGGED] if n != "close"]
    names += [f"{s}_candles_{k}" for s in ("bull", "bear") for k in (3, 5, 10)]
    return c, list(dict.fromkeys(names))


def whole(name: str) -> bool:
    return _LAGGED.get(name, (name, 0))[0] in WHOLE


def select(c: Chain, names: list[str], doubles: list[str] = (), plain: list[str] = ()) -> str:
    return c.out([*doubles, *[n for n in names if not whole(n)]], [*plain, *[n for n in names if whole(n)]])


ORACLE["features_all"] = select(*everything(Chain(DAILY)), doubles=OHLCV)
ORACLE["lags"] = select(everything(Chain(DAILY))[0], list(_LAGGED))
_RET = [f"ret_{k}d" for k in (1, 2, 3, 5, 10, 20)]
ORACLE["returns"] = returns(volatility(Chain(DAILY)), True).out([*_RET, "ret_1d_norm", "ret_5d_norm"])
ORACLE["return_stats"] = returns(Chain(DAILY)).out([
    *[f"ret_mean_{k}d" for k in (5, 10, 20)], *[f"ret_std_{k}d" for k in (5, 10, 20)], "ret_skew_5d",
    "ret_positive_5d", "ret_positive_10d", "up_down_ratio_10d", "max_drawdown_10d", "ret_acceleration"])
_RETURNS = [c for c in registry.FEATURE_GROUPS["returns"] if not c.endswith("_norm")]
ORACLE["feature_group"] = returns(Chain(HOURLY)).out(_RETURNS)


_ALL, _NAMES = everything(Chain(DAILY))
_ALL_COLUMNS = [*OHLCV, *_NAMES]
ORACLE["model_features"] = select(_ALL, [n for n in _NAMES if n not in registry.RAW_COLUMNS])
ORACLE["feature_cols_simple"] = returns(sr(Chain(DAILY))).out([*registry.FEATURE_GROUPS["sr_proximity"], *_RETURNS])
ORACLE["normalize_bar_columns"] = ORACLE["bars_hourly"]
ORACLE["bars_round_trip"] = f"""WITH {DAILY} SELECT symbol, ts, {', '.join(r6(c) for c in OHLCV)} FROM bars
    WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 2 MONTH"""
ORACLE["features_round_trip"] = ORACLE["sr_proximity"]
ORACLE["merged_bars"] = f"""WITH {DAILY} SELECT symbol, ts, {', '.join(r6(c) for c in OHLCV if c not in ('close', 'volume'))},
    {r6("close + CASE WHEN ts >= DATE '1996-10-15' THEN 1 ELSE 0 END", 'close')}, {r6('volume')} FROM bars"""


def _profile() -> str:
    """One row per column; quartiles by the engine's own interpolation."""
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    one = lambda x: (
        f"SELECT '{x}' AS feature, count(*) - count({x}) AS n_missing, count(*) FILTER (isinf({x}::DOUBLE)) AS n_infinite, "
        f"{r6(f'min({x})', 'min')}, {', '.join(r6(f'quantile_cont({x}::DOUBLE, {q})', n) for n, q in shares.items())}, "
        f"{r6(f'max({x})', 'max')}, {r6(f'avg({x})', 'mean')}, {r6(f'stddev_samp({x})', 'std')} FROM {_ALL.last}")
    return _ALL.sql(" UNION ALL ".join(one(x) for x in _ALL_COLUMNS))


ORACLE["feature_profile"] = _profile()


def _correlation() -> str:
    c = returns(sr(Chain(DAILY)))
    names = [*registry.FEATURE_GROUPS["sr_proximity"], *_RETURNS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return c.sql(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round_even(corr({a}, {b}) * 1000, 0) / 1000 + 0.0 AS corr FROM {c.last}"
        for a, b in pairs))


ORACLE["feature_correlation"] = _correlation()
# Which part a time is in: the distinct time at place floor(0.8 n), from 0, starts the test part.
CUT = """cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS place, count(*) OVER () AS n
    FROM (SELECT DISTINCT ts AS t FROM bars)) WHERE place = floor(n * 0.8))"""


def _consistency() -> str:
    c, names = everything(Chain(DAILY, CUT))
    c.add(f"SELECT *, ts < (SELECT t FROM cut) AS early FROM {c.last}")
    share = lambda x, part: f"avg({flag(f'{x} IS NULL')}) FILTER ({part})"
    return c.sql(" UNION ALL ".join(
        f"SELECT '{x}' AS feature, 1 AS in_train, {0 if x == 'ret_5d' else 1} AS in_test, {r6(share(x, 'early'), 'train_missing')}, "
        f"{r6('NULL::DOUBLE' if x == 'ret_5d' else share(x, 'NOT early'), 'test_missing')} FROM {c.last}"
        for x in [*OHLCV, *names]))


ORACLE["feature_consistency"] = _consistency()

# ---- news ----

TEXT_FEED = """feed AS MATERIALIZED (SELECT doc_id AS seq, text FROM documents UNION ALL SELECT doc_id + 10000000,
    translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM documents WHERE source = 'src0')"""

STRIP = r"regexp_replace(coalesce({x}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


ARTICLES = """base AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][CAST(doc_id % 5 AS INT) + 1] AS symbol,
    doc_id AS seq, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, source AS publisher,
    strftime(DATE '2023-12-30' + CAST((doc_id // 5) % 34 AS INT), '%Y-%m-%d') AS date FROM documents),
    articles AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT symbol, seq + 10000000,
    translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), description, publisher, date
    FROM base WHERE publisher = 'src0')"""


def known(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) IN ('[removed]', 'n/a', 'null', 'none', '') THEN '' ELSE {strip(x)} END"


TEXTS = f"""parts AS (SELECT *, {known('title')} AS head, {known('description')} AS rest FROM articles),
    texts AS MATERIALIZED (SELECT * EXCLUDE (head, rest),
    CASE WHEN head <> '' AND rest <> '' THEN head || '. ' || rest ELSE head || rest END AS text FROM parts)"""


def probabilities(key: str) -> str:
    part = lambda at: f"CAST('0x' || substr({key}, {at}, 4) AS INT) / 131072"
    return f"{part(1)} AS p, {part(5)} AS n, 1 - {part(1)} - {part(5)} AS u"


SCORED = f"""keyed AS (SELECT *, md5(lower({strip('text')})) AS k, length({strip('text')}) >= 10 AS ok FROM texts),
    chances AS (SELECT *, {probabilities('k')} FROM keyed),
    settled AS (SELECT * EXCLUDE (p, n, u), CASE WHEN ok THEN p ELSE 0 END AS p, CASE WHEN ok THEN n ELSE 0 END AS n,
    CASE WHEN ok THEN u ELSE 1 END AS u FROM chances),
    scored AS MATERIALIZED (SELECT symbol, seq, title, date, {round4('p - n')} AS score, {round4('p')} AS positive,
    {round4('n')} AS negative, {round4('u')} AS neutral,
    CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS label FROM settled)"""
CALENDAR = WEEKDAYS + ", cal AS MATERIALIZED (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM bars)"


def aligned(source: str) -> str:
    return f"""aligned AS MATERIALIZED (SELECT * FROM (SELECT a.*, (SELECT min(day) FROM cal c WHERE c.symbol = a.symbol
        AND c.day >= TRY_CAST(a.date AS DATE)) AS trading_day FROM {source} a) WHERE trading_day IS NOT NULL)"""


ORACLE["recent_news"] = f"""WITH {ARTICLES} SELECT symbol, seq, date FROM articles
    WHERE CAST(date AS DATE) >= (SELECT max(CAST(date AS DATE)) FROM articles) - 14
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC, seq) <= 20"""
ORACLE["clean_text"] = f"WITH {ARTICLES}, {TEXTS} SELECT symbol, seq, text FROM texts"
ORACLE["text_duplication_report"] = f"""WITH {TEXT_FEED}, c AS (SELECT count(*) AS n_texts,
    count(DISTINCT md5(lower({strip('text')}))) AS n_distinct FROM feed)
    SELECT n_texts, n_distinct, n_texts - n_distinct AS n_repeated, {r6('1 - n_distinct / n_texts', 'repeat_share')} FROM c"""
ORACLE["symbols_with_prices"] = f"""WITH {ARTICLES}, {WEEKDAYS} SELECT symbol, count(*) AS n FROM articles
    WHERE symbol IN (SELECT symbol FROM bars WHERE symbol <> 'signup') GROUP BY symbol"""
ORACLE["dedup_articles"] = f"""WITH {ARTICLES} SELECT symbol, date, seq, title FROM articles
    WHERE {strip('title')} <> '' QUALIFY row_number() OVER (PARTITION BY symbol, date, lower({strip('title')}) ORDER BY seq) = 1"""
ORACLE["align_next_trading_day"] = f"""WITH {ARTICLES}, {CALENDAR}, {aligned('articles')}
    SELECT symbol, seq, date, trading_day FROM aligned"""
_SCORES = ", ".join(r6(c) for c in ("score", "positive", "negative", "neutral"))
ORACLE["score_articles"] = f"WITH {ARTICLES}, {TEXTS}, {SCORED} SELECT symbol, seq, {_SCORES}, label FROM scored"

TIMED = f"""{ARTICLES}, timed AS (SELECT symbol, seq, CAST(date AS TIMESTAMP) + to_seconds((seq * 7919) % 86400) AS at FROM articles)"""
ORACLE["asof_next_bar"] = f"""WITH {TIMED}, {HOURLY} SELECT a.symbol, a.seq, a.at, b.ts, {r6('b.open', 'open')}, {r6('b.close', 'close')}
    FROM timed a ASOF JOIN bars b ON a.symbol = b.symbol AND a.at <= b.ts WHERE b.ts <= a.at + INTERVAL 2 DAY"""
ORACLE["asof_last_bar"] = f"""WITH {TIMED}, {HOURLY} SELECT a.symbol, a.seq, a.at, b.ts AS bar_ts, {r6('b.close', 'bar_close')}
    FROM timed a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.at >= b.ts"""
ORACLE["score_store"] = f"""WITH {ARTICLES}, {TEXTS}, keys AS (SELECT md5(lower({strip('text')})) AS k, bool_or(symbol <> 'view') AS known
    FROM texts WHERE length({strip('text')}) >= 10 GROUP BY 1),
    runs AS (SELECT 2 AS run, count(*) AS n_texts, count(*) FILTER (known) AS hits FROM keys UNION ALL SELECT 3, count(*), count(*) FROM keys)
    SELECT run, n_texts, hits, n_texts - hits AS misses, {r6('hits / n_texts', 'hit_rate')} FROM runs"""

DAY_COLUMNS = ["sentiment_mean", "sentiment_max", "sentiment_min", "sentiment_std", "sentiment_momentum",
               "article_count", "positive_ratio", "confidence_mean"]
NEWS = f"""{ARTICLES}, {TEXTS}, {SCORED}, {CALENDAR}, {aligned('scored')},
    firsts AS (SELECT *, lower({strip('title')}) AS norm FROM aligned
        QUALIFY row_number() OVER (PARTITION BY symbol, trading_day, lower({strip('title')}) ORDER BY seq) = 1),
    units AS (SELECT *, CASE WHEN norm <> '' THEN CAST(round_even(score * 1000000, 0) AS BIGINT) END AS k,
        CASE WHEN norm <> '' THEN CAST(round_even(greatest(positive, negative) * 1000000, 0) AS BIGINT) END AS conf
        FROM firsts),
    sums AS (SELECT symbol, trading_day, count(k) AS n, sum(k) AS s, sum(k::HUGEINT * k) AS ss,
        max(CASE WHEN norm <> '' THEN score END) AS hi, min(CASE WHEN norm <> '' THEN score END) AS lo,
        count(CASE WHEN norm <> '' AND label = 'positive' THEN 1 END) AS np, sum(conf) AS conf
        FROM units GROUP BY 1, 2),
    means AS (SELECT *, CASE WHEN n > 0 THEN s::DOUBLE / (n::DOUBLE * 1000000.0::DOUBLE) ELSE 0 END AS mean,
        CASE WHEN n > 0 THEN sqrt((n * ss - s * s)::DOUBLE) / n::DOUBLE / 1000000.0::DOUBLE END AS std FROM sums),
    news AS MATERIALIZED (SELECT symbol, trading_day, {round4('mean')} AS sentiment_mean,
        coalesce({round4('hi')}, 0) AS sentiment_max, coalesce({round4('lo')}, 0) AS sentiment_min,
        coalesce({round4('std')}, 0) AS sentiment_std,
        {round4(f"mean - coalesce(lag({round4('mean')}) OVER (PARTITION BY symbol ORDER BY trading_day), 0)")} AS sentiment_momentum,
        n::DOUBLE AS article_count,
        CASE WHEN n > 0 THEN {round4('np / n')} ELSE 0.5 END AS positive_ratio,
        CASE WHEN n > 0 THEN {round4('conf::DOUBLE / (n::DOUBLE * 1000000.0::DOUBLE)')} ELSE 0 END AS confidence_mean
        FROM means)"""
DAILY_SENTIMENT = NEWS + f""", daily AS MATERIALIZED (SELECT c.symbol, c.day AS ts,
    {', '.join(f"coalesce({x}, {0.5 if x == 'positive_ratio' else 0.0}) AS {x}" for x in DAY_COLUMNS)}
    FROM cal c LEFT JOIN news d ON d.symbol = c.symbol AND d.trading_day = c.day)"""
MERGED = DAILY_SENTIMENT + f""", joined AS (SELECT b.*, {', '.join(f'd.{x}' for x in DAY_COLUMNS)} FROM bars b
    LEFT JOIN daily d ON d.symbol = b.symbol AND d.ts = CAST(b.ts AS DATE)),
    merged AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, volume,
    {', '.join(f'coalesce({lag(x)}, 0.0) AS {x}' for x in DAY_COLUMNS)} FROM joined)"""
_DAY6 = ", ".join(r6(c) for c in DAY_COLUMNS)
ORACLE["daily_news"] = f"WITH {NEWS} SELECT symbol, trading_day, {_DAY6} FROM news"
ORACLE["sentiment_calendar_fill"] = f"WITH {DAILY_SENTIMENT} SELECT symbol, ts, {_DAY6} FROM daily"
ORACLE["build_daily_sentiment"] = ORACLE["sentiment_calendar_fill"]
ORACLE["merge_price_sentiment"] = Chain(MERGED, start="merged").out([*OHLCV, *DAY_COLUMNS])
ORACLE["sentiment_placeholders"] = Chain(WEEKDAYS).step(
    **{c: "0.5::DOUBLE" if c == "positive_ratio" else "0.0::DOUBLE" for c in DAY_COLUMNS}
).out([*OHLCV, *DAY_COLUMNS])


def rolling_sentiment(c: Chain, cross: bool = False) -> Chain:
    s = "sentiment_mean"
    c.step(
        **{f"sentiment_ma{k}": mean(s, k, 1) for k in (3, 7, 14)},
        **{f"sentiment_vol_{k}d": f"coalesce({roll('stddev_samp', s, k, 2)}, 0)" for k in (3, 7)},
        ds=f"{s} - {lag(s)}", dir=f"sign({s})", n7=mean("article_count", 7, 1),
    )
    c.step(
        sentiment_trend_3_7=round4("sentiment_ma3 - sentiment_ma7"),
        sentiment_trend_7_14=round4("sentiment_ma7 - sentiment_ma14"),
        sentiment_regime="CASE WHEN sentiment_ma7 > 0.10 THEN 1.0::DOUBLE WHEN sentiment_ma7 < -0.10 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END",
        sentiment_improving=flag("sentiment_ma3 > sentiment_ma7"),
        sentiment_momentum_3d=round4(mean("sentiment_momentum", 3, 1)),
        sentiment_accel=f"coalesce({round4(f'sentiment_momentum - {lag('sentiment_momentum')}')}, 0)",
        g="CASE WHEN ds > 0 THEN ds WHEN ds IS NOT NULL THEN 0.0::DOUBLE END",
        l_="CASE WHEN ds < 0 THEN -ds WHEN ds IS NOT NULL THEN 0.0::DOUBLE END",
        turn=f"CASE WHEN dir = {lag('dir')} THEN 0 ELSE 1 END",
        article_count_ma7="round_even(n7 * 100, 0) / 100",
        article_count_spike=flag("article_count > n7 * 2"),
        attention_trend=flag(f"n7 > {lag('n7', 3)}"),
    )
    c.step(grp=f"sum(turn) OVER ({W} ROWS UNBOUNDED PRECEDING)", ag=mean("g", 14, 7), al=mean("l_", 14, 7))
    c.step(
        sentiment_rsi="coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50)",
        sentiment_streak="dir * row_number() OVER (PARTITION BY symbol, grp ORDER BY ts)",
    )
    if cross:
        c.step(
            sent_price_confirm="sentiment_regime * sign(coalesce(ret_1d, 0))",
            sent_rsi_diverge=flag("sentiment_regime > 0 AND coalesce(rsi_14, 50) > 70"),
            sent_momentum_align=flag("sign(sentiment_trend_3_7) = sign(coalesce(ret_5d, 0))"),
        )
    return c


def _rolling(doubles: list[str], plain: list[str] = ()) -> str:
    return rolling_sentiment(Chain(MERGED, start="merged")).out(doubles, plain)


ORACLE["rolling_sentiment_means"] = _rolling(
    ["sentiment_ma3", "sentiment_ma7", "sentiment_ma14", "sentiment_vol_3d", "sentiment_vol_7d"])
ORACLE["rolling_sentiment_trend"] = _rolling(
    ["sentiment_trend_3_7", "sentiment_trend_7_14", "sentiment_regime", "sentiment_momentum_3d", "sentiment_accel"],
    ["sentiment_improving"])
ORACLE["rolling_sentiment_rsi"] = _rolling(["sentiment_rsi"])
ORACLE["rolling_sentiment_streak"] = _rolling(["sentiment_streak"])
ORACLE["rolling_sentiment_attention"] = _rolling(["article_count_ma7"], ["article_count_spike", "attention_trend"])
ORACLE["rolling_sentiment_cross"] = rolling_sentiment(
    returns(momentum(Chain(MERGED, start="merged"))), cross=True
).out(["sent_price_confirm"], ["sent_rsi_diverge", "sent_momentum_align"])
ORACLE["sentiment_summary"] = f"""WITH {DAILY_SENTIMENT}, c AS (SELECT *, article_count > 0 AS covered,
    CASE WHEN article_count > 0 THEN sentiment_mean END AS s FROM daily)
    SELECT symbol, count(*) AS total_days, count(*) FILTER (covered) AS days_with_news,
    round_even(count(*) FILTER (covered) * 1000.0 / count(*), 0) / 10 + 0.0 AS coverage_pct,
    coalesce({round4("sum(CAST(round_even(s * 1000000, 0) AS BIGINT))::DOUBLE / (count(s) * 1000000.0::DOUBLE)")}, 0) + 0.0 AS mean_sentiment,
    CASE WHEN count(*) FILTER (covered) = 0 THEN 0 ELSE {round4('stddev_samp(s)')} END AS std_sentiment,
    count(*) FILTER (s > 0.1) AS bullish_days, count(*) FILTER (s < -0.1) AS bearish_days,
    count(*) FILTER (s BETWEEN -0.1 AND 0.1) AS neutral_days,
    round_even(avg(article_count) * 10, 0) / 10 AS avg_articles_day FROM c GROUP BY symbol"""
ORACLE["coverage_report"] = f"""WITH {DAILY_SENTIMENT} SELECT symbol,
    {r6(f"avg({flag('article_count > 0')}) * 100", 'coverage_pct')}, {r6('avg(sentiment_mean)', 'mean_sentiment')},
    {r6('avg(article_count)', 'avg_articles')} FROM daily GROUP BY symbol"""

# ---- headlines ----

FEED = TEXT_FEED
LABELLED = """labelled AS MATERIALIZED (SELECT doc_id AS seq, text,
    CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 0 ELSE 2 END AS label FROM documents JOIN labels USING (doc_id))"""
CHANCES = f"""guessed AS MATERIALIZED (SELECT *, CASE WHEN p >= n AND p >= u THEN 0 WHEN n >= u THEN 1 ELSE 2 END AS prediction
    FROM (SELECT *, {probabilities('k')} FROM (SELECT *, md5(lower({strip('text')})) AS k FROM SOURCE)))"""
ORACLE["headline_union"] = f"""WITH {FEED}, {LABELLED} SELECT seq, text, NULL::INT AS label, NULL::VARCHAR AS source FROM feed
    UNION ALL SELECT seq, text, label, 'documents' FROM labelled"""
ORACLE["headline_titles"] = f"""WITH {ARTICLES}, t AS (SELECT seq, coalesce(nullif(CASE WHEN publisher <> 'src1' THEN title END, ''),
    nullif(publisher, ''), '') AS text FROM articles)
    SELECT seq, text FROM t WHERE text <> '' AND text <> '[Removed]' AND length(text) > 15"""
_DEDUP = f"""dedup AS (SELECT seq, {strip('text')} AS text FROM feed
    QUALIFY row_number() OVER (PARTITION BY md5(lower({strip('text')})) ORDER BY seq) = 1)"""
ORACLE["dedup_headlines"] = f"WITH {FEED}, {_DEDUP} SELECT seq, text FROM dedup"
_NOISE = ["watch this", "see more", "click here", "read more", "subscribe to", "sign up", "breaking news"]
ORACLE["filter_headlines"] = f"""WITH {FEED} SELECT seq, text FROM feed WHERE length(text) >= 15
    AND NOT ({' OR '.join(f"contains(lower(text), '{n}')" for n in _NOISE)})"""
ORACLE["sample_to_target"] = f"WITH {FEED}, {_DEDUP} SELECT seq, text FROM dedup ORDER BY md5('42|' || text), text LIMIT 200"
ORACLE["weak_label"] = f"""WITH {FEED}, {CHANCES.replace('SOURCE', 'feed')}, firsts AS (SELECT * FROM guessed
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1)
    SELECT text, prediction AS label, {r6(round4('greatest(p, n, u)'), 'confidence')}, 'auto' AS source FROM firsts
    WHERE greatest(p, n, u) >= 0.65"""
ORACLE["class_distribution"] = f"""WITH {LABELLED} SELECT label,
    CASE label WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS name, count(*) AS n,
    {r6('count(*) * 100.0 / sum(count(*)) OVER ()', 'pct')} FROM labelled GROUP BY label"""
ORACLE["oversample_gold"] = f"""WITH {LABELLED} SELECT seq, text, label, 'gold' AS source, copy FROM labelled,
    (VALUES (1), (2), (3)) c(copy) WHERE label <> 2"""
_LIST = ", ".join(f"('{x}', {label})" for x, label in GOLD)
DATASET = f"""{FEED}, {CHANCES.replace('SOURCE', 'feed')}, firsts AS (SELECT * FROM guessed
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1), weak AS (SELECT text, prediction AS label,
    {r6(round4('greatest(p, n, u)'), 'confidence')}, 'auto' AS source, k FROM firsts WHERE greatest(p, n, u) >= 0.65),
    gold AS (SELECT text, label, NULL::DOUBLE AS confidence, 'gold' AS source, md5(lower(text)) AS k FROM (VALUES {_LIST}) g(text, label)),
    thrice AS (SELECT *, 1 AS copy FROM weak UNION ALL SELECT *, unnest([1, 2, 3]) FROM gold),
    once AS (SELECT * FROM gold UNION ALL SELECT * FROM weak WHERE k NOT IN (SELECT k FROM gold))"""


def _parts(source: str, digest: str) -> str:
    return f"""placed AS (SELECT *, count(*) OVER (PARTITION BY label) AS size,
        row_number() OVER (PARTITION BY label ORDER BY md5({digest})) AS place FROM {source}),
        parts AS (SELECT *, CASE WHEN place <= size - greatest(1, floor(size * 0.15)) - greatest(1, floor(size * 0.10)) THEN 'train'
        WHEN place <= size - greatest(1, floor(size * 0.15)) THEN 'validation' ELSE 'test' END AS split FROM placed)"""


_EXAMPLE = "text, label, confidence, source"
ORACLE["build_dataset"] = f"WITH {DATASET} SELECT {_EXAMPLE}, copy FROM thrice"
ORACLE["split_dataset"] = f"""WITH {DATASET}, {_parts('once', "'42|' || k")} SELECT {_EXAMPLE}, split,
    unnest(CASE WHEN source = 'gold' AND split = 'train' THEN [1, 2, 3] ELSE [1] END) AS copy FROM parts"""
ORACLE["split_dataset_copies_first"] = f"""WITH {DATASET}, {_parts('thrice', "'42|' || text || '|' || source || '|' || copy")}
    SELECT {_EXAMPLE}, copy, split FROM parts"""
ORACLE["stratified_split"] = f"""WITH {LABELLED}, r AS (SELECT *, count(*) OVER (PARTITION BY label) AS n,
    row_number() OVER (PARTITION BY label ORDER BY md5('42|' || seq || '|' || text)) AS r FROM labelled),
    s AS (SELECT *, greatest(1, floor(n * 0.15)) AS nt, greatest(1, floor(n * 0.10)) AS nv FROM r)
    SELECT seq, text, label, CASE WHEN r <= n - nt - nv THEN 'train' WHEN r <= n - nt THEN 'validation' ELSE 'test' END AS split FROM s"""
WEIGHTS = """weights AS (SELECT c.label, greatest(count(l.seq), 1) AS n,
    (SELECT count(*) FROM labelled) / (3.0 * greatest(count(l.seq), 1)) AS weight
    FROM (VALUES (0), (1), (2)) c(label) LEFT JOIN labelled l ON l.label = c.label GROUP BY c.label)"""
ORACLE["class_weights"] = f"WITH {LABELLED}, {WEIGHTS} SELECT label, n, {r6('weight')} FROM weights"
_GUESSED = f"{LABELLED}, {CHANCES.replace('SOURCE', 'labelled')}"
ORACLE["prf_report"] = f"""WITH {_GUESSED}, c AS (SELECT class,
    count(*) FILTER (label = class AND prediction = class) AS tp,
    count(*) FILTER (label <> class AND prediction = class) AS fp,
    count(*) FILTER (label = class AND prediction <> class) AS fn
    FROM guessed, (VALUES (0), (1), (2)) v(class) GROUP BY class),
    m AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM c)
    SELECT class, CASE class WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS name, tp, fp, fn,
    round_even(p * 1000, 0) / 1000 AS precision, round_even(r * 1000, 0) / 1000 AS recall,
    round_even(2 * p * r / greatest(1e-9, p + r) * 1000, 0) / 1000 AS f1,
    (SELECT {r6(f"avg({flag('label = prediction')})", 'a')} FROM guessed) AS accuracy FROM m"""
ORACLE["weighted_loss"] = f"""WITH {_GUESSED}, {WEIGHTS} SELECT
    {r6("sum(weight * -ln(greatest(CASE g.label WHEN 0 THEN p WHEN 1 THEN g.n ELSE u END, 1e-12))) / sum(weight)", 'loss')},
    {r6(f"avg({flag('g.label = prediction')})", 'accuracy')}, count(*) AS n FROM guessed g JOIN weights w ON w.label = g.label"""
_RIGHT = "EXISTS (FROM guessed g WHERE g.text = l.text AND g.prediction = l.label)"
ORACLE["gold_check"] = f"""WITH {FEED}, {LABELLED}, {CHANCES.replace('SOURCE', 'feed')}
    SELECT count(*) AS n, CAST(sum({flag(_RIGHT)}) AS BIGINT) AS n_right,
    {r6(f"avg({flag(_RIGHT)})", 'gold_accuracy')} FROM labelled l"""

# ---- labels and splits ----

ORACLE["target_label"] = Chain(DAILY).step(
    target=f"CASE WHEN lead(close, 3) OVER ({W}) > close THEN 1 WHEN lead(close, 3) OVER ({W}) IS NOT NULL THEN 0 END"
).out([], ["target"])
ORACLE["target_threshold"] = Chain(DAILY).step(mv=f"lead(close) OVER ({W}) / close - 1").add(
    "SELECT symbol, ts, CASE WHEN mv > 0.003 THEN 1 WHEN mv < -0.003 THEN 0 END AS target FROM s1"
).sql("SELECT * FROM {last} WHERE target IS NOT NULL")
ORACLE["chronological_split"] = f"""WITH {DAILY}, {CUT} SELECT symbol, ts,
    CASE WHEN ts < (SELECT t FROM cut) THEN 'train' ELSE 'test' END AS split FROM bars"""
_BAR6 = ", ".join(r6(c) for c in OHLCV)
for _name, _n in (("latest_row", 1), ("latest_rows", 5)):
    ORACLE[_name] = f"""WITH {DAILY} SELECT symbol, ts, {_BAR6} FROM bars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {_n}"""


def _simple() -> str:
    c = returns(Chain(DAILY))
    c.step(target=f"CASE WHEN lead(close) OVER ({W}) > close THEN 1 WHEN lead(close) OVER ({W}) IS NOT NULL THEN 0 END",
           **{f"ret_1d_lag{k}": lag("ret_1d", k) for k in (1, 2, 3, 5, 10)})
    c.add(f"SELECT * FROM {c.last} WHERE target IS NOT NULL AND ret_20d IS NOT NULL AND ret_std_20d IS NOT NULL "
          "AND ret_skew_5d IS NOT NULL AND ret_1d_lag10 IS NOT NULL")
    return c.out([*OHLCV, *_RETURNS, *[f"ret_1d_lag{k}" for k in (1, 2, 3, 5, 10)]], ["target"])


ORACLE["simple_features"] = _simple()


def _naive() -> Chain:
    c = Chain(DAILY).step(prev=lag("close"), nxt=f"lead(close) OVER ({W})")
    return c.add(f"SELECT symbol, ts, {flag('nxt > close')} AS target, {flag('close > prev')} AS prediction "
                 f"FROM {c.last} WHERE prev IS NOT NULL AND nxt IS NOT NULL")


ORACLE["confusion_matrix"] = _naive().sql(
    "SELECT target, count(*) FILTER (prediction = 0) AS pred_down, count(*) FILTER (prediction = 1) AS pred_up "
    "FROM {last} GROUP BY target")
ORACLE["binary_report"] = _naive().sql(f"""SELECT class, {r6('p', 'precision')}, {r6('r', 'recall')},
    {r6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')}, support, {r6('accuracy')} FROM (
    SELECT class, coalesce(hit / nullif(guessed, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support, accuracy
    FROM (SELECT v.class, count(*) FILTER (target = k AND prediction = k) AS hit,
    count(*) FILTER (prediction = k) AS guessed, count(*) FILTER (target = k) AS support,
    avg({flag('target = prediction')}) AS accuracy FROM {{last}}, (VALUES ('DOWN', 0), ('UP', 1)) v(class, k) GROUP BY v.class))""")

ORACLE["roc_auc"] = Chain(DAILY).step(prev=lag("close"), nxt=f"lead(close) OVER ({W})").add(
    f"SELECT close / prev - 1 AS s, {flag('nxt > close')} AS target FROM s1 WHERE prev IS NOT NULL AND nxt IS NOT NULL"
).sql(f"""SELECT {r6('sum(p * (below - n / 2.0)) / (sum(p) * sum(n)::DOUBLE)', 'roc_auc')} FROM (
    SELECT p, n, sum(n) OVER (ORDER BY s) AS below FROM (
    SELECT s, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM {{last}} GROUP BY s))""")


# ---- from bars and articles to labelled rows ----


def _with_news(c: Chain) -> tuple[Chain, list[str]]:
    """All price modules and rolling sentiment over bars that carry daily sentiment."""
    c, names = everything(c)
    rolling_sentiment(c, cross=True)
    return c, [*names, *DAY_COLUMNS, *registry.ROLLING_SENTIMENT]


_MOVE = f"lead(close) OVER ({W}) / close - 1"


def _assembled(c: Chain, names: list[str]) -> tuple[Chain, list[str]]:
    """Rows without a missing value, labelled by the next of them, without raw levels."""
    c.add(f"SELECT * FROM {c.last} WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}")
    c.step(mv=_MOVE)
    c.add(f"SELECT *, CASE WHEN mv > 0.003 THEN 1 WHEN mv < -0.003 THEN 0 END AS target FROM {c.last}")
    c.add(f"SELECT * FROM {c.last} WHERE target IS NOT NULL")
    return c, [n for n in names if n not in registry.RAW_COLUMNS]


class Finite(Chain):
    """Quotients without a finite value, of bars with a price of 0, are missing."""

    def step(self, **columns: str) -> Chain:
        return super().step(**{n: f"CASE WHEN isfinite({x}) THEN {x} END" if "/" in x else x for n, x in columns.items()})


# Every bar with the news of the trading day before its own.
_OF_EVENTS = DAILY_SENTIMENT.replace(WEEKDAYS, MINUTES) + f""", earlier AS (SELECT symbol, ts,
    {', '.join(f'{lag(x)} AS {x}' for x in DAY_COLUMNS)} FROM daily),
    merged AS MATERIALIZED (SELECT b.*, {', '.join(f'coalesce(d.{x}, 0.0) AS {x}' for x in DAY_COLUMNS)} FROM bars b
    LEFT JOIN earlier d ON d.symbol = b.symbol AND d.ts = CAST(b.ts AS DATE))"""
_MINUTES, _ALL_NAMES = _with_news(Finite(_OF_EVENTS, start="merged"))
# Keltner's position between its two bands: a share of 4 * atr_14 rounds to the other side once in 8,320 rows.
_MINUTES.add(f"""SELECT * REPLACE ({sd('close - (bb_middle - 2 * atr_14)', '(bb_middle + 2 * atr_14) - (bb_middle - 2 * atr_14)')} AS kc_position)
    FROM {_MINUTES.last}""")
ORACLE["assemble"] = select(*_assembled(_MINUTES, _ALL_NAMES), plain=["target"])
_BRAND_ARTICLES = ARTICLES.replace(
    "['click', 'error', 'purchase', 'signup', 'view'][CAST(doc_id % 5 AS INT) + 1]", "'Brand#' || (doc_id % 5 + 1) || ((doc_id // 5) % 5 + 1)"
).replace("DATE '2023-12-30' + CAST((doc_id // 5) % 34 AS INT)", "DATE '1992-06-01' + CAST((doc_id * 37) % 2200 AS INT)")
_BRAND_DAYS = MERGED.replace(ARTICLES, _BRAND_ARTICLES).replace(WEEKDAYS, DAILY)
ORACLE["assemble_news"] = select(*_assembled(*_with_news(Chain(_BRAND_DAYS, start="merged"))), plain=["target"])
_WITHOUT_NEWS = Chain(DAILY).step(**{c: "0.5::DOUBLE" if c == "positive_ratio" else "0.0::DOUBLE" for c in DAY_COLUMNS})
ORACLE["assemble_metadata"] = _assembled(*_with_news(_WITHOUT_NEWS))[0].sql(
    f"SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, {r6('avg(target)', 'up_share')} FROM {{last}} GROUP BY symbol")
