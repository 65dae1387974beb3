"""As-of joins against a nested loop."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from marketframe.operators.asof import asof_join

START = datetime(2024, 1, 1)


def sides(seed, n_left=300, n_right=80):
    rng = np.random.default_rng(seed)
    at = lambda: START + timedelta(minutes=int(rng.integers(0, 12 * 1440) // 30 * 30))
    # one key holds most of the rows, one has no partner, some keys and times are missing
    key = lambda names: names[min(int(rng.exponential(1.0)), len(names) - 1)]
    left = [(i, key(["hot", "b", "alone", None]), None if i % 41 == 0 else at()) for i in range(n_left)]
    right = [(key(["hot", "b", None]), None if i % 29 == 0 else at(), int(rng.integers(0, 5))) for i in range(n_right)]
    return left + left[:5], right


def brute(left, right, forward, limit, keep):
    out = []
    for i, k, t in left:
        near = [(u, v) for s, u, v in right if s is not None and s == k and t and u and (u >= t if forward else u <= t)]
        best = (min(near) if forward else max(near)) if near else (None, None)
        if best[0] and limit and abs(best[0] - t) > limit:
            best = (None, None)
        if best[0] or keep:
            out.append((i, k, t, *best))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction,tolerance,how", [("forward", None, "inner"), ("forward", 90, "left"), ("backward", None, "left"), ("backward", 90, "inner")])
@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_equals_nested_loop(spark, direction, tolerance, how, unit):
    left, right = sides(3)
    a = spark.createDataFrame(left, "id int, symbol string, ts timestamp_ntz")
    b = spark.createDataFrame(right, "symbol string, at timestamp_ntz, v int")
    got = asof_join(a, b, right_ts="at", direction=direction, tolerance=tolerance and f"{tolerance} minutes", unit=unit, how=how)
    want = brute(left, right, direction == "forward", tolerance and timedelta(minutes=tolerance), how == "left")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty_sides_and_names(spark):
    a = spark.createDataFrame([(1, "x", START)], "id int, symbol string, ts timestamp_ntz")
    b = spark.createDataFrame([], "symbol string, ts timestamp_ntz, v int")
    assert asof_join(a, b, columns=["v"]).count() == 0 and asof_join(a, b, columns=["v"], how="left").first().v is None
    assert asof_join(b, a, columns=["id"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(a, b)
