"""Profiles with exact quartiles against numpy."""

import numpy as np
import pandas as pd
import pytest

from marketframe.plans.profiles import at_ranks, feature_profile, from_ordered, to_ordered
from marketframe.session import kept


def test_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    u = to_ordered(x)
    assert (np.diff(u.astype(object)) > 0).all() and [from_ordered(int(v)) for v in u] == x.tolist()
    assert to_ordered(np.array([-0.0]))[0] == to_ordered(np.array([0.0]))[0]


def test_profile_equals_numpy(spark):
    rng = np.random.default_rng(1)
    n = 5000
    x = {
        "normal": rng.normal(0, 1e6, n), "tiny": rng.normal(0, 1e-300, n), "flag": rng.integers(0, 2, n).astype(float),
        "same": np.full(n, -7.25), "near": 1 + rng.integers(0, 50, n) * 2.0**-52, "signs": rng.choice([-1.0, -0.0, 0.0, 1.0], n),
    }
    x["normal"][::7], x["flag"][::11], x["tiny"][:3] = np.inf, np.nan, -np.inf
    x["none"], x["one"] = np.full(n, np.nan), np.where(np.arange(n) == 77, 3.5, np.nan)
    df = spark.createDataFrame(pd.DataFrame(x)).repartition(5)
    got = {r.feature: r for r in feature_profile(df, list(x)).collect()}
    assert list(got) == list(x)
    for name, v in x.items():
        r, ok = got[name], v[np.isfinite(v)]
        assert (r.n_missing, r.n_infinite) == (np.isnan(v).sum(), np.isinf(v).sum())
        if not len(ok):
            assert (r.min, r.q25, r.median, r.q75, r.max, r["mean"], r.std) == (None,) * 7
            continue
        assert (r.min, r.max) == (ok.min(), ok.max())
        assert [r.q25, r.median, r.q75] == pytest.approx(np.quantile(ok, [0.25, 0.5, 0.75]).tolist(), rel=1e-15, abs=0)
        assert r["mean"] == pytest.approx(ok.mean(), rel=1e-9, abs=1e-9)
        assert r.std is None if len(ok) < 2 else r.std == pytest.approx(ok.std(ddof=1), rel=1e-9)


def test_any_rank(spark):
    v = np.random.default_rng(2).choice([-3.0, -2.9999, 0.0, 8.0, 9.0, 1e9], 300)
    rows = kept(spark.createDataFrame([([float(a), float(-a)],) for a in v], "x array<double>").repartition(3))
    asked = [(k, r) for k in (0, 1) for r in range(0, 300, 23)]
    want = {(k, r): np.sort(v if k == 0 else -v)[r] for k, r in asked}
    assert at_ranks(rows, 2, asked) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert [tuple(r) for r in feature_profile(df, ["a", "b"]).collect()] == [(c, 0, 0, *[None] * 7) for c in "ab"]
