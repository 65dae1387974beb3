"""Hard negatives: for each anchor and positive the best rows of other labels within a window of scores.

Candidates are ordered by label and then along a Hilbert curve through the axes of greatest
variance, cut into blocks, and written as Parquet together with each block's zone map: the
least and greatest value of every dimension. An anchor's inner product with any row of a block lies
between two sums over the zone map (interval arithmetic), so the maps alone tell which blocks
an anchor's windows must read; the others are never joined to it.

A window is searched twice. The blocks of the highest bounds give a first fifth-best score;
then every block whose bounds reach that score is read. Scores are whole numbers, exact at any order of
the sums. Anchors come in groups of a bounded size and meet blocks in tasks of a bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import settle

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
SCALE = 256.0
#: Rows of a block, blocks of a task, anchors of a group, zone maps of a task.
BLOCK, BLOCKS, ANCHORS, ZONES = 512, 16, 512, 4096
AXES, BITS = 8, 7
#: Quantised components end here, so that a score of up to 2,048 dimensions fits a long.
MOST = 1 << 26
#: Blocks per window, of the highest bounds, that give the first threshold.
SEEDS = 2
NO_LOW, NO_HIGH = -(1 << 62), 1 << 62
EXACT = float(1 << 53)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of whole coordinates below 2**bits, one column an axis."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def matrix(blobs: list[bytes], dims: int | None = None) -> np.ndarray:
    """Rows of int32 as a matrix of doubles; shorter rows end in zeros."""
    sizes = {len(b) for b in blobs}
    dims = max(sizes, default=0) // 4 if dims is None else dims
    if sizes <= {dims * 4}:
        return np.frombuffer(b"".join(blobs), "<i4").reshape(len(blobs), dims).astype(float)
    out = np.zeros((len(blobs), dims))
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 4] = np.frombuffer(b, "<i4")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of whole numbers in a and b, exactly."""
    greatest = lambda m: float((m * m).sum(axis=1).max(initial=0.0))
    if greatest(a) * greatest(b) < EXACT**2:  # no partial sum is beyond the product of the lengths
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with any vector between low and high."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    least, most = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
    slack = 1e-9 * (np.abs(plus) @ np.maximum(np.abs(low), np.abs(high)).T + np.abs(minus) @ np.maximum(np.abs(low), np.abs(high)).T)
    slack[slack < 1e-9 * EXACT] = 0  # such sums are exact
    return least - slack, most + slack


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, is_anchor and v (binary, int32) of rows vec_id, label, is_anchor, vector."""

    def run(batches):
        for b in batches:
            vectors = b.column(3)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(SCALE * flat), -MOST, MOST).astype("<i4").tobytes()
            ends = np.cumsum(np.diff(vectors.offsets.to_numpy())) * 4
            cuts = [0, *ends.tolist()]
            blobs = [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(blobs, pa.binary())], ["vec_id", "label", "is_anchor", "v"])

    return rows.mapInArrow(run, "vec_id long, label long, is_anchor boolean, v binary")


def curve_axes(rows: DataFrame) -> tuple[list[int], list[float], list[float]]:
    """The axes of greatest variance, and where each axis' cells start and end."""

    def run(batches):
        n, total, square = 0, np.zeros(0), np.zeros(0)
        for b in batches:
            x = matrix(b.column(0).to_pylist())
            size = max(x.shape[1], len(total))
            grow = lambda y: np.pad(y, (0, size - len(y)))
            n, total, square = n + len(x), grow(total) + grow(x.sum(axis=0)), grow(square) + grow((x * x).sum(axis=0))
        k = len(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, n)), pa.array(total), pa.array(square)], ["axis", "n", "total", "square"])

    sums = rows.select("v").mapInArrow(run, "axis long, n long, total double, square double")
    found = sums.groupBy("axis").agg(F.sum("n"), F.sum("total"), F.sum("square")).collect()  # a row a dimension
    spread = []
    for axis, n, total, square in found:
        mean = total / max(n, 1)
        spread.append((-max(square / max(n, 1) - mean * mean, 0.0), axis, mean))
    chosen = sorted(spread)[:AXES]
    return [a for _, a, _ in chosen], [m - 2.5 * (-v) ** 0.5 for v, _, m in chosen], [m + 2.5 * (-v) ** 0.5 + 1e-9 for v, _, m in chosen]


def with_curve_key(rows: DataFrame) -> DataFrame:
    axes, starts, ends = curve_axes(rows)

    def run(batches):
        for b in batches:
            x = matrix(b.column("v").to_pylist())
            x = np.pad(x, ((0, 0), (0, max(0, max(axes, default=-1) + 1 - x.shape[1]))))
            cells = np.floor((x[:, axes] - starts) / (np.array(ends) - starts) * (1 << BITS)) if axes else np.zeros((len(x), 1))
            key = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "key"])

    return rows.mapInArrow(run, "vec_id long, label long, is_anchor boolean, v binary, key long")


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows in blocks of one label each, in order of the curve, and a zone map after each block.

    Adds block and pos; pos is -1 in zone maps, whose v holds the least and then the greatest values.
    """
    names = ["vec_id", "label", "is_anchor", "v", "block", "pos"]

    def run(batches):
        base, nth = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []

        def emit():
            nonlocal held, nth
            no = base + nth
            nth += 1
            x = matrix([r[3] for r in held])
            zone = np.concatenate([x.min(axis=0), x.max(axis=0)]).astype("<i4").tobytes()
            out = [(*r[:4], no, i) for i, r in enumerate(held)] + [(None, held[0][1], False, zone, no, -1)]
            held = []
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

        for b in batches:
            for r in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if held and (len(held) == block or held[0][1] != r[1]):
                    yield emit()
                held.append(r)
        if held:
            yield emit()

    ordered = with_curve_key(rows).repartitionByRange("label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id", "v")
    return ordered.drop("key").mapInArrow(run, "vec_id long, label long, is_anchor boolean, v binary, block long, pos int")


class Requests:
    """What one task gets of a group's anchors: vectors, labels, own places and windows."""

    def __init__(self, t: pa.Table, dims: int | None = None):
        self.anchor = t["anchor"].to_numpy()
        self.label = t["label"].to_numpy()
        self.v = matrix(t["v"].to_pylist(), dims)
        windows = t["windows"].to_pylist()
        width = max((len(w) for w in windows), default=0)
        fill = [[(-1, NO_HIGH, NO_LOW)] * (width - len(w)) for w in windows]
        rows = [[(x["w"], x["low"], x["high"]) for x in w] + f for w, f in zip(windows, fill, strict=True)]
        whole = np.array(rows, np.int64).reshape(len(windows), width, 3)
        self.no, self.low, self.high = whole[:, :, 0], whole[:, :, 1], whole[:, :, 2]


def to_read(requests: DataFrame, zones: DataFrame, same: bool, seeds: int | None, n_groups: int) -> DataFrame:
    """(grp, block): the blocks that some window of a group's anchors must read, by the zone maps alone.

    With ``seeds`` only so many a window and task, those of the highest bounds.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            maps = right["v"].to_pylist()
            dims = max(max(len(m) // 8 for m in maps), max((len(v) // 4 for v in left["v"].to_pylist()), default=0))
            r = Requests(left, dims)
            low, high = matrix([m[: len(m) // 2] for m in maps], dims), matrix([m[len(m) // 2 :] for m in maps], dims)
            least, most = bounds(r.v, low, high)
            fits = (right["label"].to_numpy()[None, :] == r.label[:, None]) == same
            wanted = np.zeros(len(maps), bool)
            for w in range(r.no.shape[1]):
                reach = fits & (most >= r.low[:, w, None]) & (least <= r.high[:, w, None])
                if seeds is not None and len(maps) > seeds:
                    bound = np.where(reach, most, -np.inf)
                    best = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
                    chosen = np.zeros_like(reach)
                    np.put_along_axis(chosen, best, True, axis=1)
                    reach &= chosen
                wanted |= reach.any(axis=0)
            out = right["block"].to_numpy()[wanted]
        return pa.table({"grp": pa.array(np.full(len(out), key[0].as_py()), pa.int64()), "block": pa.array(out, pa.int64())})

    chunks = max(1, -(-zones.count() // ZONES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = requests.select("*", every(chunks).alias("chunk"))
    right = zones.select("*", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).select("*", every(n_groups).alias("grp"))
    return left.groupBy("grp", "chunk").cogroup(right.groupBy("grp", "chunk")).applyInArrow(run, "grp long, block long").distinct()


def best_of(score: np.ndarray, ok: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first n of each row that are ok, by score descending and then id."""
    row, col = np.nonzero(ok)
    if len(row) > n * len(score):
        # Scores below the n-th greatest of a row cannot be among its first n.
        masked = np.where(ok, score, NO_LOW)
        k = min(n, masked.shape[1])
        least = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(ok & (score >= least[:, None]))
    order = np.lexsort((col, ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n]


def search(requests: DataFrame, rows: DataFrame, pairs: DataFrame, same: bool, n: int, n_blocks: int) -> DataFrame:
    """anchor, w, score, vec_id, row: the first n rows of each window among the blocks read for its group."""
    parts = max(1, -(-n_blocks // BLOCKS))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            blobs = right["v"].to_pylist()
            dims = max(max(len(v) for v in blobs), max(len(v) for v in left["v"].to_pylist())) // 4
            r, v = Requests(left, dims), matrix(blobs, dims)
            ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
            place = right["block"].to_numpy() * BLOCK + right["pos"].to_numpy()
            score = products(r.v, v)
            fits = (labels[None, :] == r.label[:, None]) == same
            fits &= place[None, :] != r.anchor[:, None]
            for w in range(r.no.shape[1]):
                ok = fits & (score >= r.low[:, w, None]) & (score <= r.high[:, w, None])
                i, j = best_of(score, ok, ids, n)
                found.append([r.anchor[i], r.no[i, w], score[i, j], ids[j], place[j]])
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(["anchor", "w", "score", "vec_id", "row"], cols, strict=True)})

    part = F.pmod(F.xxhash64("block"), F.lit(parts))
    tasks = pairs.select(F.col("grp").alias("of"), part.alias("part")).distinct()
    left = requests.join(tasks, F.col("grp") == F.col("of")).drop("of")
    right = rows.join(pairs, "block").withColumn("part", part)
    schema = "anchor long, w long, score long, vec_id long, row long"
    partial = left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInArrow(run, schema)
    first = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "vec_id", "row")
    return partial.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def top_in_windows(requests: DataFrame, rows: DataFrame, zones: DataFrame, same: bool, n: int, n_groups: int) -> DataFrame:
    """anchor, w, rank, score, vec_id, row: the first n rows of each window of ``requests``.

    ``same`` tells whether rows of the anchor's own label or of all other labels are searched.
    """
    n_blocks = zones.count()
    read = lambda asked, seeds: to_read(asked, zones, same, seeds, n_groups)
    seen = search(requests, rows, read(requests, SEEDS), same, n, n_blocks)
    least = settle(seen.where(F.col("rank") == n).select("anchor", "w", F.col("score").alias("least")))
    asked = requests.select("anchor", F.explode("windows").alias("x")).select("anchor", "x.*").join(least, ["anchor", "w"], "left")
    window = F.struct("w", F.greatest("low", F.coalesce("least", F.lit(NO_LOW))).alias("low"), "high")
    asked = asked.groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("windows"))  # at most five
    raised = settle(requests.drop("windows").join(asked, "anchor"))
    return search(raised, rows, settle(read(raised, None)), same, n, n_blocks)


def mine(vectors: DataFrame, anchors: Column, label: Column | str = "label", id_col: str = "vec_id", vector_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells which rows are anchors. Components become floor(256 x), at most 2**26 from zero;
    scores are inner products, and a shorter vector counts as one that ends in zeros. A positive is one of an
    anchor's first other rows of its label, a negative one of the first rows of other labels
    whose score is from 80 to 100 % of the positive's; a negative score of a positive leaves none.
    Ties go to the smaller id. Rows with a null id, label or vector, or a null or non-finite component, take no
    part. Repeated rows are rows of their own. Empty tables give none; other columns are ignored.
    """
    value = F.col(vector_col)
    label = F.col(label) if isinstance(label, str) else label
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & value.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"), value.cast("array<double>").alias("vector"),
    )
    whole = settle(blocked(quantised(usable), min(block, BLOCK)))
    rows = whole.where("pos >= 0").select("vec_id", "label", "v", "block", "pos")
    zones = whole.where("pos < 0").select("block", "label", "v")
    asking = whole.where("pos >= 0 AND is_anchor")
    n_groups = max(1, -(-asking.count() // ANCHORS))
    one = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(NO_LOW).alias("low"), F.lit(NO_HIGH).alias("high")))
    row = F.col("block") * BLOCK + F.col("pos")
    asking = asking.select(
        row.alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v",
        F.pmod(F.xxhash64(row), F.lit(n_groups)).alias("grp"), one.alias("windows"),
    )
    asking = settle(asking)
    found = settle(top_in_windows(asking, rows, zones, True, positives, n_groups))
    # The least whole score that is LOW % of the positive's or more; positive scores only, so div rounds down.
    least = F.expr(f"({LOW} * cast(score as decimal(38,0)) + {HIGH - 1}) div {HIGH}").cast("long")
    windows = found.where("score >= 0").groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("w"), least.alias("low"), F.col("score").alias("high")))).alias("windows")
    )
    asked = settle(asking.drop("windows").join(windows, "anchor"))
    hard = top_in_windows(asked, rows, zones, False, negatives, n_groups)
    of = found.select("anchor", F.col("rank").cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    return out.join(of, ["anchor", "w"]).join(asking.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def relabelled(id_col: str = "vec_id", label: str = "label") -> Column:
    """The label, where the id is divisible by 7 the next of ten."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
