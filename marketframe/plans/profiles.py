"""Statistics and exact quantiles of many columns at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.session import importable, kept

#: Bits of a value that one pass settles, and rows that a task looks at together.
BITS = 11
ROWS = 1 << 15
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
STATS = ["n", "n_missing", "n_infinite", "min", "mean", "max", "m2"]


def to_ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the order of the given doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_ordered(u: int) -> float:
    bits = u & ~(1 << 63) if u >> 63 else ~u & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def matrices(batches, n: int):
    """The array column of Arrow batches as matrices of some ten thousand rows; NULL is NaN."""
    held: list[np.ndarray] = []
    for b in batches:
        held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, n))
        if sum(map(len, held)) >= ROWS:
            yield np.concatenate(held)
            held.clear()
    if held:
        yield np.concatenate(held)


def merged(parts: list[list[float]]) -> list[float]:
    """The statistics of several sets of rows as one; the deviations are merged without taking large sums apart."""
    out = [0.0, 0.0, 0.0, np.nan, 0.0, np.nan, 0.0]
    for n, missing, infinite, low, mean, high, m2 in sorted(parts):
        both = out[0] + n
        if n:
            apart = mean - out[4]
            out[6] += m2 + apart * apart * out[0] * n / both
            out[4] += apart * n / both
            out[3], out[5] = np.fmin(out[3], low), np.fmax(out[5], high)
        out[:3] = both, out[1] + missing, out[2] + infinite
    return out


def column_stats(rows: DataFrame, n: int) -> dict[int, list[float]]:
    """Number of a column -> its ``STATS``, from rows with one array column; a row per task and column is shuffled."""

    def partial(batches):
        parts: list[list[list[float]]] = [[] for _ in range(n)]
        for x in matrices(batches, n):
            missing, infinite = np.isnan(x).sum(axis=0), np.isinf(x).sum(axis=0)
            for k in range(n):
                v = x[np.isfinite(x[:, k]), k]
                mean = float(v.mean()) if len(v) else 0.0
                low, high = (float(v.min()), float(v.max())) if len(v) else (np.nan, np.nan)
                new = [float(len(v)), float(missing[k]), float(infinite[k]), low, mean, high, float(((v - mean) ** 2).sum())]
                parts[k] = [merged([*parts[k], new])]
        done = [(k, *p[0]) for k, p in enumerate(parts) if p]
        columns = [pa.array([r[0] for r in done], pa.int32()), *(pa.array([r[i] for r in done], pa.float64()) for i in range(1, 8))]
        yield pa.RecordBatch.from_arrays(columns, ["no", *STATS])

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[g["no"].iloc[0], *merged(g[STATS].to_numpy().tolist())]], columns=["no", *STATS])

    schema = ", ".join(["no int", *(f"{s} double" for s in STATS)])
    found = rows.mapInArrow(partial, schema).groupBy("no").applyInPandas(merge, schema).collect()  # a row a column
    return {r.no: [r[s] for s in STATS] for r in found}


def at_ranks(rows: DataFrame, n: int, asked: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """(column, rank) -> the column's finite value at that place in ascending order, counted from 0.

    Exact, by settling the values' bits from the top. A pass counts, per column and prefix asked for, the values by their next
    eleven bits, and the bin in which the rank falls gives the next prefix. A task sends at most 2,048 counts a prefix, and there
    are no more prefixes than ranks asked for. A value is found when its bin holds no other, after six passes at most.
    """
    found: dict[tuple[int, int], float] = {}
    open_ = {(no, rank): (0, rank) for no, rank in asked}  # -> prefix, rank within it
    for depth in range(0, 64, BITS):
        if not open_:
            break
        wanted: dict[int, set[int]] = {}
        for (no, _), (prefix, _) in open_.items():
            wanted.setdefault(no, set()).add(prefix)
        shift, mask = max(0, 64 - depth - BITS), (1 << min(BITS, 64 - depth)) - 1

        def cells(batches, depth=depth, wanted=wanted, shift=shift, mask=mask):
            for x in matrices(batches, n):
                out: list[tuple] = []
                for no, prefixes in wanted.items():
                    u = np.sort(to_ordered(x[np.isfinite(x[:, no]), no]))
                    for prefix in prefixes:
                        v = u
                        if depth:
                            first = np.array([prefix << (64 - depth), ((prefix + 1) << (64 - depth)) - 1], np.uint64)
                            v = u[np.searchsorted(u, first[0]):np.searchsorted(u, first[1], side="right")]
                        if len(v):
                            bins, at, count = np.unique((v >> np.uint64(shift)) & np.uint64(mask), return_index=True, return_counts=True)
                            low, high = ((v[i] ^ np.uint64(1 << 63)).view(np.int64) for i in (at, at + count - 1))
                            out.append((np.full(len(bins), no), np.full(len(bins), prefix), bins.astype(np.int64), count, low, high))
                if out:
                    no, prefix, bins, count, low, high = (np.concatenate(c) for c in zip(*out))
                    columns = [pa.array(no.astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in (prefix, bins, count, low, high))]
                    yield pa.RecordBatch.from_arrays(columns, ["no", "prefix", "bin", "n", "low", "high"])

        counted = rows.mapInArrow(cells, "no int, prefix long, bin long, n long, low long, high long").groupBy("no", "prefix", "bin").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("no", "prefix").orderBy("bin"))  # at most 2,048 rows each
        ranks = rows.sparkSession.createDataFrame([(no, rank, *at) for (no, rank), at in open_.items()], "no int, rank long, prefix long, rest long")
        hits = counted.withColumn("upto", upto).join(F.broadcast(ranks), ["no", "prefix"])  # bounded by the ranks asked for
        for r in hits.where("upto > rest AND upto - n <= rest").collect():
            if r.low == r.high:
                found[r.no, r.rank] = from_ordered((r.low & (1 << 64) - 1) ^ (1 << 63))
                del open_[r.no, r.rank]
            else:
                open_[r.no, r.rank] = ((r.prefix << min(BITS, 64 - depth)) | r.bin, r.rest - (r.upto - r.n))
    return found


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: feature, n_missing, n_infinite, min, q25, median, q75, max, mean, std (of the sample).

    NULL and NaN are missing; only finite values count in the rest, which is NULL where there is none (``std``: fewer than two).
    Quartiles are exact and lie between two values by linear interpolation. The columns are written once and read by
    each pass; no pass sends rows. An empty table has 0 missing values.
    """
    importable(df.sparkSession)
    rows = kept(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")))
    stats = column_stats(rows, len(columns))
    places = {(k, q): (s[0] - 1) * share for k, s in stats.items() if s[0] for q, share in QUARTILES.items()}
    asked = {(k, int(end)) for (k, _), p in places.items() for end in (np.floor(p), np.ceil(p))}
    values = at_ranks(rows, len(columns), sorted(asked))

    def quartile(k: int, q: str) -> float | None:
        if (k, q) not in places:
            return None
        low, high = (values[k, int(end(places[k, q]))] for end in (np.floor, np.ceil))
        return float(low + (high - low) * (places[k, q] % 1))

    out = []
    for k, name in enumerate(columns):
        n, missing, infinite, low, mean, high, m2 = stats.get(k, [0, 0, 0, np.nan, 0.0, np.nan, 0.0])
        q25, median, q75 = (quartile(k, q) for q in QUARTILES)
        std = float(np.sqrt(m2 / (n - 1))) if n > 1 else None
        some = (lambda v: float(v)) if n else (lambda v: None)
        out.append((name, int(missing), int(infinite), some(low), q25, median, q75, some(high), some(mean), std))
    schema = "feature string, n_missing long, n_infinite long, min double, q25 double, median double, q75 double, max double, mean double, std double"
    return df.sparkSession.createDataFrame(out, schema)
