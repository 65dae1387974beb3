"""Bars and conversions that several test modules use."""

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def bars_frame(symbol: str, n: int, seed: int, start: str = "2001-01-01") -> pd.DataFrame:
    """Random daily bars with flat bars, repeated closes and zero volumes among them."""
    rng = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(rng.normal(0, 1.5, n)), 1).clip(5)
    open_ = np.round(close + rng.normal(0, 1, n), 1).clip(5)
    high = np.maximum(open_, close) + np.round(rng.exponential(0.7, n), 1)
    low = (np.minimum(open_, close) - np.round(rng.exponential(0.7, n), 1)).clip(1)
    flat = rng.random(n) < 0.05
    for a in (open_, high, low):
        a[flat] = close[flat]
    volume = np.where(rng.random(n) < 0.05, 0.0, rng.integers(100, 5000, n).astype(float))
    return pd.DataFrame({
        "symbol": symbol, "ts": pd.date_range(start, periods=n, freq="D"),
        "open": open_, "high": high, "low": low, "close": close, "volume": volume,
    })


def to_spark(spark, pdf):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def collect(df, by=("symbol", "ts")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
