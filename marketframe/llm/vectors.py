"""Embedding near-duplicates with rotated binary codes.

Unit vectors are turned by a random rotation; the signs are a vector's code, and the inner product of
a vector with its own code is the stored correction factor. The inner product of one
vector's code with another vector, divided by that factor, is an unbiased estimate of their cosine,
with a known spread: pairs whose upper confidence bound is below the threshold are ruled
out, and only the others are computed exactly, in double precision, from the vectors themselves.

Pairs are sought where the first signs of some rotation agree. The number of signs grows with the
logarithm of the number of vectors, so buckets keep their size, and the number of tables is what
it takes to miss a pair at the threshold with a chance of ``MISS``; closer pairs are missed less.
A pair counts in the first table that brings it together. Large buckets are compared in blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import components, forest, into_units, settle

LEAST = 0.95
MISS = 1e-4
#: Mean number of vectors of a bucket, rows of a block, rows handled in one go.
BUCKET, BLOCK, CHUNK = 128, 1024, 8192
#: Standard deviations of the estimate that the confidence bound allows.
BOUND = 4.5
SEED = 20


@lru_cache(maxsize=64)
def rotation(dims: int, no: int, seed: int = SEED) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, no]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def tables_for(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(signs of a key, number of tables) for n vectors."""
    signs = min(62, max(1, round(math.log2(max(n, 2 * BUCKET) / BUCKET))))
    together = (1.0 - math.acos(least) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def sign_keys(unit: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """(row, table): the keys. A rotation's coordinates serve several tables."""
    dims = unit.shape[1]
    signs = min(signs, dims)
    per = max(1, dims // signs)
    out = np.empty((len(unit), tables), np.int64)
    for no in range(-(-tables // per)):
        bits = unit @ rotation(dims, no + 1) > 0
        for k in range(min(per, tables - no * per)):
            out[:, no * per + k] = bits[:, k * signs : (k + 1) * signs] @ (1 << np.arange(signs, dtype=np.int64))
    return out


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: rotated, sign codes (scaled to unit length), correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, code, np.einsum("ij,ij->i", code, turned)


def pack_code(code: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits(code > 0, axis=1)]


def unpack_code(raw: list[bytes], dims: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)[:, :dims]
    return np.where(bits > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dims))


def candidates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, least: float = LEAST, bound: float = BOUND) -> np.ndarray:
    """(row, row): True where the estimate of the cosine can't be told to be below ``least``."""
    dims = code.shape[1]
    estimate = (code @ turned.T) / factor[:, None]
    spread = np.sqrt(np.maximum(0.0, 1.0 - factor**2)) / factor / math.sqrt(max(1, dims - 1))
    open_ = estimate + bound * spread[:, None] + 1e-6 >= least
    return open_ & open_.T


def usable(column: str) -> str:
    """SQL: the vector has components, all finite, not all zero."""
    finite = f"forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return f"coalesce(size({column}) > 0 AND {finite} AND exists({column}, x -> x <> 0), false)"


def vector_links(distinct: DataFrame, least: float = LEAST, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(node, root, links): what each unit of a bucket adds to a vector's links, and an edge to its smallest node there.

    ``distinct`` (node, v, times) has one row per different vector; links count ``times``.
    """
    signs, tables = tables_for(distinct.count(), least, miss)

    def keyed(batches):
        for b in batches:
            node, vectors, times = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = np.array([vectors[i] for i in rows], np.float64)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                keys = sign_keys(unit, signs, tables)
                _, code, factor = codes(unit)
                packed, raw = pack_code(code), [v.tobytes() for v in x.astype("<f8")]
                own = [k.tobytes() for k in keys.astype("<i8")]
                for t in range(tables):
                    n = len(rows)
                    cols = [node[rows], times[rows], np.full(n, d), np.full(n, t), keys[:, t]]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in cols), pa.array(packed), pa.array(factor), pa.array(own), pa.array(raw)], names
                    )

    names = ["node", "times", "dims", "t", "key", "code", "factor", "keys", "raw"]
    schema = "node long, times long, dims long, t long, key long, code binary, factor double, keys binary, raw binary"
    unit = ["dims", "t", "key", "unit_lo", "unit_hi"]
    dealt = into_units(distinct.select("node", "v", "times").mapInArrow(keyed, schema), ["dims", "t", "key"], "node", block)

    def compare(rows: dict[str, list]):
        """Links of one unit."""
        dims, t = rows["dims"][0], rows["t"][0]
        node, times = np.array(rows["node"]), np.array(rows["times"])
        x = np.frombuffer(b"".join(rows["raw"]), "<f8").reshape(len(node), dims)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        turned = (unit @ rotation(dims, 0)).astype(np.float32)
        open_ = candidates(unpack_code(rows["code"], dims), np.array(rows["factor"], np.float32), turned, least)
        lo, hi, at = rows["unit_lo"][0], rows["unit_hi"][0], np.array(rows["block_no"])
        if lo != hi:  # two blocks: the pairs inside a block count in its first unit only
            if lo > 0:
                open_[np.ix_(at == hi, at == hi)] = False
            if lo > 0 or hi > 1:
                open_[np.ix_(at == lo, at == lo)] = False
        i, j = np.nonzero(np.triu(open_, 1))
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            keep[s : s + (1 << 16)] = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        i, j = i[keep], j[keep]
        if t and len(i):  # not if an earlier table has them together
            keys = np.frombuffer(b"".join(rows["keys"]), "<i8").reshape(len(node), -1)
            fresh = np.ones(len(i), bool)
            for k in range(t):
                fresh &= keys[i, k] != keys[j, k]
            i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        links = np.bincount(i, times[j], len(node)) + np.bincount(j, times[i], len(node))
        by_node = np.argsort(node, kind="stable")
        place = np.empty_like(by_node)
        place[by_node] = np.arange(len(node))
        root = by_node[forest(place[i], place[j], len(node))][place]
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some].astype(np.int64))], ["node", "root", "links"])

    def link(batches):
        held, at = None, None
        for b in batches:
            cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)}
            ids = list(zip(*(cols[c] for c in unit), strict=True))
            start = 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[start]:
                    continue
                part = {n: c[start:i] for n, c in cols.items()}
                if held is not None and at == ids[start]:
                    for n, c in part.items():
                        held[n].extend(c)
                else:
                    if held is not None and (out := compare(held)) is not None:
                        yield out
                    held, at = part, ids[start]
                start = i
        if held is not None and (out := compare(held)) is not None:
            yield out

    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(link, "node long, root long, links long")


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, miss: float = MISS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors of equal length link if their cosine in double precision is at least ``least``. Equal
    vectors are compared once and count each. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. component_id is the smallest id that links reach (null ids
    are never the smallest), kept is whether it is the vector's own. Repeated rows are vectors of
    their own that share an id; a null id is never kept. Other columns are ignored.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.expr(usable("v")), F.col("v")))
    distinct = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    distinct = settle(distinct.withColumn("node", F.monotonically_increasing_id()))
    links = settle(vector_links(distinct, least, miss))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = distinct.join(counts, "node", "left").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "root").select("v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.join(classes, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
