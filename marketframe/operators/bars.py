"""Bars: building them from ticks, cleaning, checking, dropping rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.kernels import flag
from marketframe.operators.panel import Panel, panel_operator

PRICES = ["open", "high", "low", "close"]


def build_bars(
    ticks: DataFrame,
    symbol: Column | str,
    ts: Column | str,
    price: Column,
    volume: Column,
    unit: str,
    sequence: Column,
) -> DataFrame:
    """OHLCV bars of one ``unit`` (hour, day, ...) per symbol.

    ``sequence`` orders ticks and must be unique within a symbol and unit; a number or
    timestamp keeps the aggregation hash-based, so that every task reduces its ticks to
    one row per bar before the shuffle, also for a symbol with most of the ticks.
    ``volume`` is summed.
    """
    start = F.date_trunc(unit, ts).cast("timestamp_ntz")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return (
        ticks.select(
            col(symbol).alias("symbol"),
            start.alias("ts"),
            price.cast("double").alias("__price"),
            volume.cast("double").alias("__volume"),
            sequence.alias("__seq"),
        )
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("__price", "__seq").alias("open"),
            F.max("__price").alias("high"),
            F.min("__price").alias("low"),
            F.max_by("__price", "__seq").alias("close"),
            F.sum("__volume").alias("volume"),
        )
    )


def most_bars(ticks: DataFrame, ts: str, unit: str) -> int:
    """Upper bound of the bars per symbol: the units from the first to the last tick.

    Costs a scan of one column, without a shuffle; pass it to operators as ``longest``.
    """
    number = unit_number(F.col(ts), unit)
    first, last = ticks.agg(F.min(number), F.max(number)).first()
    return 0 if first is None else last - first + 1


def unit_number(ts: Column, unit: str) -> Column:
    """Consecutive whole numbers for consecutive units of time (second, minute, hour, day, week, month)."""
    start = F.date_trunc(unit, ts).cast("timestamp")
    if unit == "month":
        return (F.year(start) * 12 + F.month(start)).cast("bigint")
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}[unit]
    return F.floor(F.unix_timestamp(start) / seconds)  # weeks start on Mondays, all at the same remainder


def normalize_columns(bars: DataFrame) -> DataFrame:
    """Lower-case column names; of a dotted two-level name keep the first level."""
    return bars.toDF(*[c.split(".")[0].lower() for c in bars.columns])


def _measures(bars: DataFrame, symbol: str, ts: str) -> list[str]:
    return [c for c, t in bars.dtypes if t == "double" and c not in (symbol, ts)]


@panel_operator
def fill_forward(p: Panel, columns: list[str]) -> Panel:
    """Replace missing values by the latest earlier value of the same symbol."""
    return p.last_known({c: F.col(c) for c in columns})


def clean_bars(
    bars: DataFrame,
    symbol: str = "symbol",
    ts: str = "ts",
    sequence: str | None = None,
    longest: int | None = None,
    symbols: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Bars fit for features: one per symbol and time, positive consistent prices, no holes.

    Rules, in order: NaN becomes NULL; rows without symbol or time go; of rows with the same
    symbol and time the last stays (by ``sequence``, else the greatest by close and then the other
    columns); rows with a price that is not positive, or a high below the low, go; missing values
    are filled forward, and rows still without prices at a symbol's start go.
    """
    columns = [c for c in bars.columns if c != sequence]
    measures = [c for c in _measures(bars, symbol, ts) if c != sequence]
    others = [c for c in columns if c not in (symbol, ts)]
    order = [c for c in (sequence,) if c] + ["close"]
    key = F.struct(*order, *[c for c in others if c != "close"])
    one_each = (
        bars.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in measures})
        .where(F.col(symbol).isNotNull() & F.col(ts).isNotNull())
        .groupBy(symbol, ts)
        .agg(F.max(key).alias("__bar"))
        .select(symbol, ts, *[F.col("__bar")[c].alias(c) for c in others])
    )
    bad = F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    for c in PRICES:
        bad = bad | F.coalesce(F.col(c) <= 0, F.lit(False))
    size = {"longest": longest, "symbols": symbols, "max_rows": max_rows}
    filled = fill_forward(one_each.where(~bad), measures, symbol=symbol, ts=ts, **size)
    return filled.dropna(subset=PRICES).select(columns)


def validate_timeseries(bars: DataFrame, symbol: str = "symbol", ts: str = "ts", unit: str = "day") -> DataFrame:
    """One row per symbol: what is wrong with its bars, and whether nothing is.

    Missing steps are the units between the first and last bar that have no bar; they are
    reported but do not make a symbol invalid, since markets close.
    """
    per_time = bars.groupBy(symbol, ts).agg(
        F.count("*").alias("__n"),
        *[F.sum(x).alias(n) for n, x in {
            "null_values": sum((F.col(c).isNull().cast("int") for c in PRICES), F.lit(0)),
            "bad_prices": sum((flag(F.col(c) <= 0) for c in PRICES), F.lit(0)),
            "crossed_bars": flag(F.col("high") < F.col("low")),
        }.items()],
    )
    at = unit_number(F.col(ts), unit)
    report = per_time.groupBy(symbol).agg(
        F.sum("__n").alias("n_bars"),
        (F.sum("__n") - F.count("*")).alias("duplicate_times"),
        *[F.sum(c).alias(c) for c in ("null_values", "bad_prices", "crossed_bars")],
        (F.max(at) - F.min(at) + 1 - F.count("*")).alias("missing_steps"),
    )
    faults = F.col("duplicate_times") + F.col("null_values") + F.col("bad_prices") + F.col("crossed_bars")
    return report.withColumn("is_valid", flag(faults == 0))


def drop_zero_volume(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("volume") > 0)


def drop_warmup(features: DataFrame) -> DataFrame:
    """Only rows on which every column has a value.

    From a plain filter on n computed columns the optimizer derives a constraint for each
    subset of them (2^n, see spark.sql.constraintPropagation). The random term is always
    true; a filter that is not deterministic is left alone. It is also not passed by later filters:
    filter symbols and times before calling this.
    """
    complete = reduce(and_, [F.col(f"`{c}`").isNotNull() for c in features.columns])
    return features.where(F.when(F.rand(0) >= 0, complete))


def inf_to_null(df: DataFrame) -> DataFrame:
    """Replace infinities and NaN in floating columns by NULL."""
    return df.select(*[
        finite(c).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def finite(name: str) -> Column:
    """The column, NULL where it is infinite or NaN."""
    return F.expr(f"CASE WHEN abs(`{name}`) < double('Infinity') THEN `{name}` END")
