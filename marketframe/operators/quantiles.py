"""Means and quantiles of many columns in one pass, by summaries that can be merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds before it summarises them, and points of a column's summary.
HELD = 1 << 15
POINTS = 2048


def summary(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """At most so many values with the weight of the rows that each stands for; exact while there are no more values."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= points:
        return values, weights
    # Each point stands for an equal share of the weight, its value being the one in the middle of the share.
    upto = np.cumsum(weights)
    ends = upto[-1] * np.arange(1, points + 1) / points
    middle = np.searchsorted(upto, ends - upto[-1] / points / 2)
    return values[middle], np.full(points, upto[-1] / points)


def quantile_points(values: np.ndarray, weights: np.ndarray, shares: list[float]) -> list[float]:
    """For each share the first value up to which that share of the weight lies."""
    upto = np.cumsum(weights)
    return values[np.minimum(np.searchsorted(upto, np.array(shares) * upto[-1] - 1e-9), len(values) - 1)].tolist()


def column_summaries(df: DataFrame, columns: list[str], shares: list[float], points: int = POINTS) -> dict[int, tuple[int, float, list[float]]]:
    """Number of a column -> (values, mean, quantiles); columns without any value are left out.

    One pass and one aggregation by column. A merged summary's ranks are off by a share of about 1 / ``points`` for
    each merge on its way, and exact for as many rows. NULL and NaN don't count.
    """

    def partial(batches):
        held: list[np.ndarray] = []
        state: list[list] = [[0, 0.0, np.zeros(0), np.zeros(0)] for _ in columns]

        def fold():
            x = np.concatenate(held)
            for k, s in enumerate(state):
                v = x[~np.isnan(x[:, k]), k]
                s[0] += len(v)
                s[1] += float(v.sum())
                s[2], s[3] = summary(np.concatenate([s[2], v]), np.concatenate([s[3], np.ones(len(v))]), points)
            held.clear()

        for b in batches:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(columns)).astype(float))
            if sum(map(len, held)) >= HELD:
                fold()
        if held:
            fold()
        used = [k for k, s in enumerate(state) if s[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([state[k][0] for k in used], pa.int64()), pa.array([state[k][1] for k in used], pa.float64()),
             pa.array([state[k][2].tobytes() for k in used], pa.binary()), pa.array([state[k][3].tobytes() for k in used], pa.binary())],
            ["no", "n", "total", "points", "weights"],
        )

    def merge(t):
        # Parts come in any order; sorted by their bytes the sums and ties come out alike.
        rows = sorted(t.to_pylist(), key=lambda r: (r["points"], r["weights"]))
        values, weights = (np.concatenate([np.frombuffer(r[c]) for r in rows]) for c in ("points", "weights"))
        order = np.argsort(values, kind="stable")
        n = sum(r["n"] for r in rows)
        return pa.table({
            "no": pa.array([rows[0]["no"]], pa.int32()), "n": pa.array([n], pa.int64()), "mean": pa.array([sum(r["total"] for r in rows) / n]),
            "at": pa.array([quantile_points(values[order], weights[order], shares)], pa.list_(pa.float64())),
        })

    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    parts = df.select(values).mapInArrow(partial, "no int, n long, total double, points binary, weights binary")
    found = parts.groupBy("no").applyInArrow(merge, "no int, n long, mean double, at array<double>").collect()  # a row a column
    return {r["no"]: (r["n"], r["mean"], list(r["at"])) for r in found}
