"""Boosted trees over histograms of binned columns.

Columns are cut into quantile bins once, and the rows are kept as byte matrices, one *row group* of
bounded size each. A tree grows level by level. Every row group adds up the gradients and Hessians of its rows by
(node, column, bin), these histograms are merged by one aggregation per level, and the best
second-order gain of each node is its split. Of two sisters only the lighter one is measured; the other is
the parent less the first. Gradients are whole multiples of 2**-11, so sums are exact and the trees are the same however
the rows are dealt. Rows of one group need no merging, so there the same loop runs inside one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.quantiles import column_summaries
from marketframe.session import kept

BINS = 32
GROUP = 1 << 16
UNIT = 1 << 11
RIDGE = 1.0
LEAST_WEIGHT = 1.0
#: Trees after which the rows' sums of all trees so far are written.
KEEP_EVERY = 25
#: Columns whose histograms are merged in one task.
MERGED = 32
ROW_SCHEMA = "tree int, node int, feature int, bin int, value double, gain double"


@dataclass
class Tree:
    """Nodes as in a heap: the children of i are 2i + 1 and 2i + 2. feature -1 is a leaf, -2 no node."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        n = (2 << self.depth) - 1
        self.feature, self.bin = np.full(n, -2, np.int32), np.zeros(n, np.int32)
        self.value, self.gain = np.zeros(n), np.zeros(n)
        self.feature[0] = -1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The lowest node of each row of a byte matrix, one column of which is a row."""
        at = np.zeros(bins.shape[1], np.int64)
        for _ in range(self.depth):
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            here = at[inner]
            at[inner] = 2 * here + 1 + (bins[f[inner], inner] > self.bin[here])
        return at


def sampled(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """The rows that a tree sees, by a hash of their keys."""
    with np.errstate(over="ignore"):
        h = keys ^ np.uint64((seed << 20) + tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) < share * 2**53


def columns_of(n: int, seed: int, tree: int, share: float) -> np.ndarray:
    chosen = np.random.default_rng([seed, tree]).permutation(n)[: max(1, round(n * share))]
    return np.sort(chosen)


def slopes(margin: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss in whole units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - target) * UNIT), np.maximum(np.rint(p * (1 - p) * UNIT), 1.0)


def packed(bins: np.ndarray, columns: np.ndarray) -> list[tuple[np.ndarray, list[int], list[int]]]:
    """Columns of few bins joined to codes below ``BINS``: (code of each row, numbers of the columns, their bins)."""
    sizes = bins.max(axis=1, initial=0).astype(int)[columns] + 1
    out: list[tuple[np.ndarray, list[int], list[int]]] = []
    for k in np.argsort(sizes, kind="stable").tolist():
        size = int(sizes[k])
        held = int(np.prod(out[-1][2])) if out else 1
        if out and held * size <= BINS:
            code, members, dims = out[-1]
            out[-1] = code + bins[columns[k]] * np.uint8(held), [*members, k], [*dims, size]
        else:
            out.append((bins[columns[k]], [k], [size]))
    return out


def histograms(packs: list, n_columns: int, slot: np.ndarray, n_slots: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums (slot, column, bin, gradient or Hessian) of the rows whose slot isn't negative."""
    out = np.zeros((n_slots, n_columns, BINS, 2), np.int64)
    rows = np.flatnonzero(slot >= 0)
    for at in range(0, len(rows), GROUP):  # so many rows at a time, so that both sums fit one double
        some = rows[at : at + GROUP]
        base, weight = slot[some] * BINS, h[some] * 2.0**28 + g[some]
        for code, members, dims in packs:
            both = np.bincount(base + code[some], weights=weight, minlength=n_slots * BINS).reshape(n_slots, BINS)
            cube = both[:, : int(np.prod(dims))].reshape(n_slots, *reversed(dims))
            for j, (k, size) in enumerate(zip(members, dims, strict=True)):
                axes = tuple(a for a in range(1, len(dims) + 1) if a != len(dims) - j)
                one = cube.sum(axis=axes) if axes else cube
                upper = np.rint(one / 2.0**28)
                out[:, k, :size, 1] += upper.astype(np.int64)
                out[:, k, :size, 0] += (one - upper * 2.0**28).astype(np.int64)
    return out


def best_split(hist: np.ndarray) -> tuple[float, int, int]:
    """(gain, column number, bin) of one node's histogram; the first of equal ones."""
    left = np.cumsum(hist, axis=1)[:, :-1].astype(float) / UNIT
    total = hist[0].sum(axis=0).astype(float) / UNIT
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + RIDGE)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < LEAST_WEIGHT) | (right[..., 1] < LEAST_WEIGHT)] = -np.inf
    best = int(np.argmax(gain))
    return float(gain.flat[best]), best // gain.shape[1], best % gain.shape[1]


def grow(columns: np.ndarray, settings: dict, measure) -> Tree:
    """One tree. ``measure`` (tree so far, nodes) gives the histograms of nodes over the columns."""
    depth = settings["maxDepth"]
    tree, known = Tree(depth), {}
    leaf = lambda sums: -settings["stepSize"] * sums[0] / (sums[1] + RIDGE * UNIT)
    asked, sisters = [0], {}
    for level in range(depth):
        found = dict(zip(asked, measure(tree, asked), strict=True)) if asked else {}
        here = dict(found)
        for node, (sister, parent) in sisters.items():
            here[node] = known[parent] - found[sister]
        known, asked, sisters = here, [], {}
        for node, hist in sorted(here.items()):
            tree.value[node] = leaf(hist[0].sum(axis=0))
            gain, column, at = best_split(hist)
            if not gain > 1e-6:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = columns[column], at, gain
            sums = [hist[column, : at + 1].sum(axis=0), hist[column, at + 1 :].sum(axis=0)]
            pair = (2 * node + 1, 2 * node + 2)
            for child, s in zip(pair, sums, strict=True):
                tree.feature[child], tree.value[child] = -1, leaf(s)
            light = int(sums[1][1] < sums[0][1])
            asked.append(pair[light])
            sisters[pair[1 - light]] = (pair[light], node)
        if level + 1 == depth or not asked:
            break
    return tree


def measure_rows(bins: np.ndarray, packs: list, n_columns: int, tree: Tree, nodes: list[int], seen: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The histograms of some nodes over the rows of one group that the tree sees."""
    place = np.full(len(tree.feature), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    slot = np.where(seen, place[tree.nodes(bins)], -1)
    return histograms(packs, n_columns, slot, len(nodes), g, h)


def grown_in_one_task(bins: np.ndarray, target: np.ndarray, keys: np.ndarray, settings: dict) -> list[Tree]:
    margin, trees = np.zeros(len(target)), []
    for no in range(settings["maxIter"]):
        g, h = slopes(margin, target)
        seen = sampled(keys, settings["seed"], no, settings["subsamplingRate"])
        columns = columns_of(len(bins), settings["seed"], no, float(settings["featureSubsetStrategy"]))
        packs = packed(bins, columns)
        tree = grow(columns, settings, lambda t, n: measure_rows(bins, packs, len(columns), t, n, seen, g, h))  # noqa: B023
        margin += tree.value[tree.nodes(bins)]
        trees.append(tree)
    return trees


def tree_rows(trees: list[Tree], first: int = 0) -> list[tuple]:
    return [
        (first + no, int(node), int(t.feature[node]), int(t.bin[node]), float(t.value[node]), float(t.gain[node]))
        for no, t in enumerate(trees) for node in np.flatnonzero(t.feature > -2)
    ]


def _arrays(row: dict, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(row["bins"], np.uint8).reshape(n_columns, row["n"])
    return bins, np.frombuffer(row["target"], np.int8).astype(float), np.frombuffer(row["key"], np.uint64), np.frombuffer(row["margin"], float)


def grown_over_groups(groups: DataFrame, n_columns: int, settings: dict) -> list[Tree]:
    """As ``grown_in_one_task`` over many row groups: one aggregation per level.

    What comes to the driver is one merged histogram per level, whose size no number of rows changes.
    """
    trees: list[Tree] = []
    written = 0
    for no in range(settings["maxIter"]):
        columns = columns_of(n_columns, settings["seed"], no, float(settings["featureSubsetStrategy"]))
        if no - written == KEEP_EVERY:
            later = trees[written:]

            def add(batches, later=later):
                for b in batches:
                    rows = b.to_pylist()
                    for r in rows:
                        bins, _, _, margin = _arrays(r, n_columns)
                        r["margin"] = (margin + sum(t.value[t.nodes(bins)] for t in later)).tobytes()
                    yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

            groups, written = kept(groups.mapInArrow(add, groups.schema)), no

        def measure(tree, nodes, columns=columns, later=tuple(trees[written:]), no=no):
            def partial(batches):
                for b in batches:
                    for r in b.to_pylist():
                        bins, target, keys, margin = _arrays(r, n_columns)
                        g, h = slopes(margin + sum((t.value[t.nodes(bins)] for t in later), np.zeros(len(target))), target)
                        seen = sampled(keys, settings["seed"], no, settings["subsamplingRate"])
                        hist = measure_rows(bins, packed(bins, columns), len(columns), tree, nodes, seen, g, h)
                        parts = range(0, len(columns), MERGED)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(parts, pa.int32()), pa.array([np.ascontiguousarray(hist[:, k : k + MERGED]).tobytes() for k in parts], pa.binary())], ["part", "sums"]
                        )

            def merge(key, t):
                total = sum(np.frombuffer(x, np.int64) for x in t["sums"].to_pylist())
                return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

            schema = "part int, sums binary"
            merged = dict(groups.mapInArrow(partial, schema).groupBy("part").applyInArrow(merge, schema).collect())
            out = [np.frombuffer(merged[k], np.int64).reshape(len(nodes), -1, BINS, 2) for k in sorted(merged)]
            return np.concatenate(out, axis=1)

        trees.append(grow(columns, settings, measure))
    return trees


class BoostedTrees:
    """Trees over named columns; missing values count as the column's mean."""

    def __init__(self, features: list[str], means: list[float], edges: list[list[float]], trees: list[Tree]):
        self.features, self.means, self.edges, self.trees = features, means, edges, trees

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Byte matrix, a column a row of x: the number of edges below each value."""
        out = np.empty((x.shape[1], x.shape[0]), np.uint8)
        for k, (mean, edges) in enumerate(zip(self.means, self.edges, strict=True)):
            out[k] = np.searchsorted(edges, np.where(np.isnan(x[:, k]), mean, x[:, k]), side="left")
        return out

    def values(self) -> Column:
        return F.array(*[F.col(c).cast("double") for c in self.features])

    def margin(self) -> Column:
        """Sum of the trees' values for a row, the logit of label 1."""

        @F.pandas_udf("double")
        def run(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            bins = self.binned(np.stack(rows.to_numpy()).astype(float))
            return pd.Series(sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(rows))))

        return run(self.values())

    def importances(self) -> np.ndarray:
        """Mean gain of the splits of each column, as shares of 1."""
        gain, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
            np.add.at(n, t.feature[inner], 1)
        mean = gain / np.maximum(n, 1)
        return mean / mean.sum() if mean.sum() else mean

    def save(self, path: str) -> None:
        """Two small tables: columns with their edges, and the trees' nodes."""
        spark = SparkSession.active()
        columns = [(k, c, float(m), [float(e) for e in edges]) for k, (c, m, edges) in enumerate(zip(self.features, self.means, self.edges, strict=True))]
        spark.createDataFrame(columns, "no int, feature string, mean double, edges array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        depth = self.trees[0].depth if self.trees else 0
        nodes = spark.createDataFrame(tree_rows(self.trees), ROW_SCHEMA).withColumn("depth", F.lit(depth))
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(path: str) -> BoostedTrees:
        spark = SparkSession.active()
        columns = spark.read.parquet(f"{path}/columns").orderBy("no").collect()
        nodes = spark.read.parquet(f"{path}/nodes").collect()
        trees = trees_of(nodes, nodes[0].depth if nodes else 0)
        return BoostedTrees([r.feature for r in columns], [r["mean"] for r in columns], [r.edges for r in columns], trees)


def trees_of(rows, depth: int) -> list[Tree]:
    trees = [Tree(depth) for _ in range(max((r.tree for r in rows), default=-1) + 1)]
    for r in rows:
        t = trees[r.tree]
        t.feature[r.node], t.bin[r.node], t.value[r.node], t.gain[r.node] = r.feature, r.bin, r.value, r.gain
    return trees


def fit(rows: DataFrame, features: list[str], settings: dict, target: str = "target", group: int = GROUP) -> BoostedTrees:
    """Boosted trees for a 0/1 target, from rows that are read twice (a table, not a long plan).

    A column's bins end at its quantiles (``column_summaries``), at most 32; missing values get the column's mean. A column without
    values has one bin and never splits. Without rows there are trees of a single leaf of value 0.
    """
    places = [k / BINS for k in range(1, BINS)]
    stats = column_summaries(rows, features, places)
    nothing = (0, 0.0, [])
    means = [stats.get(k, nothing)[1] for k in range(len(features))]
    edges = [sorted(set(stats.get(k, nothing)[2])) for k in range(len(features))]
    model = BoostedTrees(list(features), means, edges, [])

    def pack(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            packed = np.ascontiguousarray(model.binned(x).T)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([r.tobytes() for r in packed], pa.binary())], ["target", "key", "bins"])

    values = model.values()
    narrow = rows.select(values.alias("x"), F.col(target).cast("int").alias("target"), F.xxhash64(values).alias("key"))
    narrow = kept(narrow.mapInArrow(pack, "target int, key long, bins binary"))
    n = narrow.count()
    if not n:
        model.trees = [Tree(settings["maxDepth"]) for _ in range(settings["maxIter"])]
        return model
    n_groups = -(-n // group)

    def gather(t):
        t = t.sort_by([("key", "ascending"), ("target", "ascending")])
        bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(t.num_rows, len(features))
        one = {
            "n": t.num_rows, "bins": np.ascontiguousarray(bins.T).tobytes(), "target": t["target"].to_numpy().astype(np.int8).tobytes(),
            "key": t["key"].to_numpy().astype(np.int64).tobytes(), "margin": np.zeros(t.num_rows).tobytes(),
        }
        return pa.table({k: pa.array([v], pa.int64() if k == "n" else pa.binary()) for k, v in one.items()})

    # Equal rows share a key; they are spread by their number within the partition.
    spread = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(n_groups))
    schema = "n long, bins binary, target binary, key binary, margin binary"
    groups = kept(narrow.withColumn("grp", spread).groupBy("grp").applyInArrow(gather, schema))
    if n_groups > 1:
        model.trees = grown_over_groups(groups, len(features), settings)
        return model

    def whole(batches):
        for b in batches:
            for r in b.to_pylist():
                bins, target_, keys, _ = _arrays(r, len(features))
                rows_ = tree_rows(grown_in_one_task(bins, target_, keys, settings))
                cols = list(zip(*rows_, strict=True))
                kinds = [pa.int32()] * 4 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in ROW_SCHEMA.split(", ")])

    model.trees = trees_of(groups.mapInArrow(whole, ROW_SCHEMA).collect(), settings["maxDepth"])
    return model
