"""From bars and articles to labelled training rows, for all symbols at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators.bars import clean_bars, drop_warmup
from marketframe.operators.daily_sentiment import (
    add_sentiment_placeholders,
    build_daily_sentiment,
    merge_price_and_sentiment,
    of_earlier_days,
)
from marketframe.operators.memory import add_lag_features, add_return_features
from marketframe.operators.model import target_label, target_threshold
from marketframe.operators.panel import MAX_ROWS, extent
from marketframe.operators.skew import keep
from marketframe.plans.features import build_features
from marketframe.plans.registry import feature_columns
from marketframe.session import kept

# How a named data set is labelled.
CONFIGS = {"default": {"horizon": 1, "threshold": 0.003, "shift_days": 1}}


def simple_features(bars: DataFrame, lags: list[int] = (1, 2, 3, 5, 10), horizon: int = 1) -> DataFrame:
    """Returns, their lags, and the direction label; rows without a value somewhere go."""
    n = extent(bars)
    out = add_lag_features(add_return_features(bars, **n), ["ret_1d"], list(lags), **n)
    return drop_warmup(target_label(settled(out, n["longest"]), horizon, **n))


def settled(df: DataFrame, longest: int) -> DataFrame:
    """Computed once if the next operator will have to read it twice (see ``open_panel``)."""
    return keep(df) if longest > MAX_ROWS else df


def assemble(
    bars: DataFrame,
    articles: DataFrame | None = None,
    scorer: Callable | object | None = None,
    config_name: str = "default",
    modules: list[str] | None = None,
    clean: bool = True,
) -> DataFrame:
    """symbol, ts, the model's feature columns and ``target``, without warm-up rows.

    A bar carries the sentiment of the trading day before its own, also where a day has several bars.
    Without articles the sentiment columns hold the values of a day without news. ``clean=False`` takes
    the bars as they are, also those with a price of 0: for bars built from ticks, one per symbol and time.
    """
    config = CONFIGS[config_name]
    n = extent(bars)
    clean = clean_bars(bars, **n) if clean else bars
    if articles is None:
        merged = add_sentiment_placeholders(clean)
    else:
        earlier = of_earlier_days(build_daily_sentiment(articles, clean, scorer), config["shift_days"])
        # Written once: nothing is scored again, and the optimizer doesn't carry the news through every window.
        merged = kept(merge_price_and_sentiment(clean, earlier, 0, **n))
    built = build_features(settled(merged, n["longest"]), modules=modules, **n)
    # Planning a filter on 360 columns over all windows and the news takes minutes; over a table it is cheap.
    features = drop_warmup(built if articles is None else kept(built))
    labelled = target_threshold(settled(features, n["longest"]), config["horizon"], config["threshold"], **n)
    return labelled.select("symbol", "ts", *feature_columns(labelled), "target")


def metadata(assembled: DataFrame) -> DataFrame:
    """Rows, period and share of UP per symbol."""
    return assembled.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.avg("target").alias("up_share"),
    )


def feature_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns (a, b, corr), 3 places, over rows that have both.

    A first pass takes each column's mean, which is subtracted to keep the sums small. Every task then
    adds up counts, sums, squares and products of all pairs as n x n matrices and sends one row
    per column; the rows of a column meet in one group. Sizes depend on the columns, not on the rows.
    """
    n, names = len(columns), np.array(columns)
    numbers = [F.col(c).cast("double") for c in columns]
    means = df.agg(*[F.avg(F.when(F.abs(x) < float("inf"), x)) for x in numbers]).first()
    centred = F.array(*[x - F.lit(m or 0.0) for x, m in zip(numbers, means)])

    def sums(batches):
        total = np.zeros((6, n, n))
        for b in batches:
            v = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, n)
            there = np.isfinite(v)
            v, t = np.where(there, v, 0.0), there.astype(float)
            total += np.stack([t.T @ t, v.T @ t, t.T @ v, (v * v).T @ t, t.T @ (v * v), v.T @ v])
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([total[:, i].tobytes() for i in range(n)])], ["i", "sums"])

    def row(g: pd.DataFrame) -> pd.DataFrame:
        i = int(g["i"].iloc[0])
        m, sx, sy, xx, yy, xy = np.sum([np.frombuffer(x) for x in g["sums"]], axis=0).reshape(6, n)[:, i:]
        with np.errstate(all="ignore"):
            r = (xy - sx * sy / m) / np.sqrt((xx - sx * sx / m) * (yy - sy * sy / m))
        r = pd.Series(np.rint(r * 1000) / 1000).replace([np.inf, -np.inf], np.nan)
        return pd.DataFrame({"a": names[i], "b": names[i:], "corr": r.astype("Float64").where(r.notna(), pd.NA)})

    per_task = df.select(centred.alias("x")).mapInArrow(sums, "i int, sums binary")
    return per_task.groupBy("i").applyInPandas(row, "a string, b string, corr double")


def feature_consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column of either table: whether each has it, and its share of missing values."""

    def profile(df: DataFrame, side: str) -> DataFrame:
        names = [c for c in df.columns if c not in ("symbol", "ts")]
        rows = [
            F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias(f"{side}_missing"))
            for c in names
        ]
        return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).withColumn(f"in_{side}", F.lit(1))

    both = profile(a, "train").join(profile(b, "test"), "feature", "full")
    return both.fillna(0, ["in_train", "in_test"]).select(
        "feature", "in_train", "in_test", "train_missing", "test_missing"
    )


