import numpy as np
import pytest
from odd import CLASHING
from pyspark.sql import functions as F

from marketframe.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING if c != "label"})


def brute(rows, anchor=lambda i: i % 100 == 0):
    """All pairs with Python's whole numbers."""
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a, (i, la, q) in enumerate(good):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), j, lb) for b, (j, lb, w) in enumerate(good) if b != a)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(-t, j) for t, j, lb in scored if lb != la and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, p, k, j, -s, t) for k, (t, j) in enumerate(fits[:5], 1)]
    return sorted(out)


def got(spark, rows, **kw):
    df = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, negatives.relabelled(), **kw)
    return sorted(tuple(r) for r in df.collect())


def clustered(n, seed, dims=12, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    rows = []
    for i in range(n):
        c = int(rng.integers(12))
        v = centres[c] + rng.normal(0, 0.4, dims)
        rows.append((i, [float(np.float32(x)) for x in v], int(c % 10 if rng.random() < 0.7 else rng.integers(10))))
    return rows + [(n + k, rows[k % 3][1], rows[k % 5][2]) for k in range(copies)]


@pytest.mark.parametrize("block", [16, 512])
def test_equals_all_pairs(spark, block):
    rows = clustered(900, 4, copies=150)
    want = brute(rows)
    assert len(want) > 60 and got(spark, rows, block=block) == want


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, v, 1), (0, v, 1), (100, v, 2), (100, [0.1], 3), (200, [], 1), (None, v, 1), (3, None, 1), (4, v, None),
        (5, [0.5, None, 1.0], 1), (6, [0.5, float("nan"), 1.0], 1), (8, [0.5, float("inf"), 1.0], 1),
        (9, v, 1), (10, v, 2), (11, v, 3), (12, [-x for x in v], 1), (13, [0.45, -0.2, 0.9], 4), (300, [0.0] * 3, 5), (15, [0.0] * 3, 5), (16, [0.0] * 3, 6),
    ]
    assert got(spark, rows) == brute(rows) != []
    assert got(spark, []) == []
    assert got(spark, [(1, v, 1), (2, v, 2)]) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 60_000, 5)], int(i % 3)) for i in range(0, 300, 4)]
    assert got(spark, rows) == brute(rows) != []


def test_curve_visits_each_cell_once_and_steps_to_neighbours():
    side = np.arange(8)
    cells = np.array([(a, b, c) for a in side for b in side for c in side])
    key = negatives.hilbert_keys(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_skip_blocks():
    rng = np.random.default_rng(1)
    a = np.floor(rng.normal(0, 100, (20, 6)))
    block = np.floor(rng.normal(300, 20, (50, 6)))
    low, high = negatives.bounds(a, block.min(axis=0)[None, :], block.max(axis=0)[None, :])
    score = negatives.products(a, block)
    assert (low[:, 0] <= score.min(axis=1)).all() and (high[:, 0] >= score.max(axis=1)).all()


def test_blocks_out_of_reach_are_not_read(spark):
    """Ten far clusters of one label: an anchor's windows read only blocks whose zone maps reach them."""
    rng = np.random.default_rng(6)
    rows = [(100 * i + k, [float(np.float32(x)) for x in np.eye(10)[i] * 4 + rng.normal(0, 0.01, 10)], i % 2) for i in range(10) for k in range(60)]
    usable = frame(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") == 100).alias("is_anchor"), F.col("embedding").cast("array<double>").alias("vector"))
    whole = negatives.blocked(negatives.quantised(usable), 20).cache()
    zones = whole.where("pos < 0").select("block", "label", "v")
    window = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(10_000).cast("long").alias("low"), F.lit(negatives.NO_HIGH).alias("high")))
    asked = whole.where("is_anchor").select((F.col("block") * 512 + F.col("pos")).alias("anchor"), "label", "v", F.lit(0).cast("long").alias("grp"), window.alias("windows"))
    read = negatives.to_read(asked, zones, True, None, 1).count()
    assert zones.count() >= 30 and 1 <= read <= 6
