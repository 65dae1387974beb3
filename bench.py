"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is
built and its whole result is computed and thrown away, best of two runs (of one, if that takes over 60 seconds). A query is
ended after 400 seconds and the whole after BENCH_SECONDS (1,400); the line then names what failed or wasn't reached.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time
import warnings

from pyspark.sql import functions as F

from catalog import tables as t
from catalog.queries import QUERIES, TRAINED
from marketframe.plans.features import build_features
from marketframe.session import local_session


BOUND, AGAIN = 400.0, 60.0


def all_features(bars):
    def run(spark, sf):
        return build_features(bars(spark, sf), longest=t.longest(spark, sf, bars))

    return run


def few_features(spark, sf):
    """Three of all features: what pruning saves."""
    bars = build_features(t.bars_supplier(spark, sf), longest=t.longest(spark, sf, t.bars_supplier))
    return bars.select("symbol", "ts", "rsi_14", "bb_percent", "ret_5d")


def train_eval(spark, sf):
    """Features, training and report, without a model of an earlier run."""
    TRAINED.clear()
    return QUERIES["train_eval"](spark, sf)


HEADLINE = {
    **{n: QUERIES[n] for n in (
        "bars_hourly", "bars_daily", "clean_bars", "trend_ma", "momentum_rsi", "macd_lines", "vol_regime_flags",
        "volume_vwap", "patterns_summary", "return_stats", "sr_proximity", "score_articles",
        "build_daily_sentiment", "rolling_sentiment_cross", "dedup_headlines", "weak_label",
        "stratified_split", "simple_features",
    )},
    "features_all_brands": all_features(t.bars_daily),
    "features_all_suppliers": all_features(t.bars_supplier),
    "features_few_suppliers": few_features,
    "train_eval": train_eval,
}


def main() -> None:
    warnings.simplefilter("ignore")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    deadline = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", 1400))
    took, failed = {}, {}
    only = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]

    def report(*_):
        """The figures so far, whatever ended the run."""
        print(json.dumps({
            "metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
            "sf": sf.rstrip("/").split("sf")[-1], "failed": failed, "not_reached": [n for n in only if n not in took and n not in failed],
        }), flush=True)

    def stop(*_):
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, stop)
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_hourly"](spark, sf).select(F.count("*")).collect()  # start the JVM's engines
    for name in only:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            bound = min(BOUND, deadline - start)
            if bound <= 0 or best > AGAIN and best < float("inf"):
                break
            watch = threading.Timer(bound, spark.sparkContext.cancelAllJobs)
            watch.start()
            try:
                HEADLINE[name](spark, sf).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            except Exception as e:  # noqa: BLE001
                failed[name] = f"after {time.perf_counter() - start:.0f} s: {str(e)[:200]}"
                break
            finally:
                watch.cancel()
                spark.catalog.clearCache()
        if best < float("inf"):
            took[name] = round(best, 3)
            print(name, took[name], file=sys.stderr, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
