"""Tables that later runs add to: merged bars and stored scores."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators.articles import score_once, store_report
from marketframe.session import path_exists
from marketframe.sources.tables import BARS, merge_bars, read_bars

KEYS = "text_key string, text string"


def bars(spark, *rows):
    return spark.createDataFrame([(s, datetime.fromisoformat(t) if t else None, *[float(c)] * 4, 1.0) for s, t, c in rows], BARS)


def closes(spark, path):
    return sorted((r.symbol, f"{r.ts:%Y-%m-%d}", r.close) for r in read_bars(spark, path).collect())


def test_merge_bars(spark, tmp_path):
    path = f"{tmp_path}/bars"
    merge_bars(bars(spark, ("A", "2024-01-30", 1), ("A", "2024-02-01", 2), ("B", "2024-03-01", 3)), path)
    untouched = sorted((tmp_path / "bars" / "month=2024-01").glob("*.parquet"))
    merge_bars(bars(spark, ("A", "2024-02-01", 9), ("A", "2024-02-02", 4), ("A", "2024-02-02", 5), ("C", "2024-04-01", 6)), path)
    assert closes(spark, path) == [("A", "2024-01-30", 1.0), ("A", "2024-02-01", 9.0), ("A", "2024-02-02", 5.0), ("B", "2024-03-01", 3.0), ("C", "2024-04-01", 6.0)]
    assert sorted((tmp_path / "bars" / "month=2024-01").glob("*.parquet")) == untouched
    before = closes(spark, path)
    merge_bars(bars(spark), path)
    merge_bars(bars(spark, ("A", "2024-02-01", 9)), path)
    assert closes(spark, path) == before
    with pytest.raises(ValueError, match="without a time"):
        merge_bars(bars(spark, ("A", None, 1)), path)


def _counting(tmp):
    """A scorer that leaves a file per text it has seen."""

    def load():
        def score(texts):
            for t in texts:
                with open(f"{tmp}/seen", "a") as f:
                    f.write(t + "\n")
            n = texts.str.len() / 100
            return pd.DataFrame({"positive": n, "negative": 0 * n, "neutral": 1 - n})

        return score

    return load


def test_texts_are_scored_once(spark, tmp_path):
    store, scorer = f"{tmp_path}/store", _counting(str(tmp_path))
    first = spark.createDataFrame([("a", "xx"), ("b", "xxx")], KEYS)
    both = spark.createDataFrame([("b", "xxx"), ("c", "xxxx"), ("c", "xxxx"), ("a", "xx")], KEYS).dropDuplicates()
    assert tuple(store_report(first, store).first()) == (2, 0, 2, 0.0)
    got = {r.text_key: r.positive for r in score_once(first, scorer, store).collect()}
    assert got == {"a": 0.02, "b": 0.03} and path_exists(spark, store)
    assert tuple(store_report(both, store).first()) == (3, 2, 1, pytest.approx(2 / 3))
    again = {r.text_key: r.positive for r in score_once(both, scorer, store, partitions=2).collect()}
    assert again == {"a": 0.02, "b": 0.03, "c": 0.04}
    assert sorted((tmp_path / "seen").read_text().split()) == ["xx", "xxx", "xxxx"]
    spark.read.parquet(store).where(F.col("text_key") == "a").write.mode("append").parquet(store)  # two runs at a time
    assert score_once(both, scorer, store).count() == 3
    assert score_once(both.limit(0), scorer, store).count() == 0
