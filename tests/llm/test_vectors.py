import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import vectors
from marketframe.llm.common import components, forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(n, dims=64, seed=0):
    """Random directions, near copies in groups of two to many, and copies."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(n // 3, n):
        j = rng.integers(0, n // 3) if i % 2 else 5
        x[i] = x[j] + rng.standard_normal(dims) * rng.choice([0.0, 0.1, 0.2, 0.25, 0.3])
    return x.astype(np.float32)


def brute(x, least=0.95):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero((u @ u.T >= least) & ~np.eye(len(x), dtype=bool))
    return np.bincount(i, minlength=len(x)), forest(i, j, len(x))


@pytest.mark.parametrize("block", [1024, 32])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors.vector_links, "__defaults__", (vectors.LEAST, vectors.MISS, block))
    x = cloud(900)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = sorted(tuple(r) for r in vectors.near_vectors(df).collect())
    n, root = brute(x)
    assert got == [(i, int(n[i]), int(root[i]), bool(root[i] == i)) for i in range(len(x))]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((400, 64))
    unit[200:] = unit[:200] + rng.standard_normal((200, 64)) * 0.3
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned, code, factor = vectors.codes(unit)
    assert np.allclose(vectors.unpack_code(vectors.pack_code(code), 64), code, atol=1e-6)
    error = (code @ turned.T) / factor[:, None] - unit @ unit.T
    assert abs(error[~np.eye(400, dtype=bool)].mean()) < 0.005
    true = unit @ unit.T >= 0.95
    open_ = vectors.candidates(code, factor, turned)
    assert not (true & ~open_).any() and open_.mean() < 0.05


def test_tables_miss_rarely():
    for n in (10, 10_000, 10**9):
        signs, tables = vectors.tables_for(n)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** signs) ** tables <= 1e-4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0),
        (8, [None, 1.0], 0), (None, [1.0, 0.0], 0), (9, [0.0, 1.0], 0), (9, [0.0, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [-1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "node", "times", "n_links", "root", "kept", "least")})
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True), (10, 0, 10, True), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in range(3, 9)]
    assert got == sorted(want, key=repr)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    for edges in ([], [(5, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], rng.integers(0, 80, (70, 2)).tolist()):
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        root = forest(i, j, 100)
        got = dict(components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect())
        assert got == {k: int(root[k]) for e in edges for k in e if e[0] != e[1]}
