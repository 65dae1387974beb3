"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has 64 bits. Two fingerprints that differ in at most r bits agree on at least
c - r of any c bands of bits, so every choice of c - r bands is a table, and the fingerprints
that agree on it are a bucket: no pair is missed. Inside a bucket the 64 bit planes are stored
vertically (one machine word holds one bit of 64 fingerprints), the planes are compared with
themselves shifted by s rows, and two carry-save counters add up 64 distances at once.
Words in which all distances exceed the radius are abandoned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import components, forest, into_units, settle, text_key

BITS = 64
RADIUS = 2
BLOCK = 4096
#: Rows compared in one go, a whole number of units.
CHUNK = 32768


def fingerprint(text: str | None, n: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the n-word shingles of a text (all words, A-Z in lower case).

    Fewer words than n are one shingle; no words (also null) give 0. Repeats count.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        h = np.array([digest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
        h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - n + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(h)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def near_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of the same bucket whose fingerprints differ in at most ``radius`` bits.

    ``bucket`` must be sorted. The counters saturate: ``radius`` is at most 2.
    """
    if not 0 <= radius <= 2:
        raise ValueError("two carry-save counters hold distances up to 2")
    n = len(fps)
    size = -(-n // 64) * 64
    padded = np.zeros(size, dtype="<u8")
    padded[:n] = fps.astype(np.uint64)
    planes = np.unpackbits(padded.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").T
    planes = np.ascontiguousarray(np.packbits(planes, axis=1, bitorder="little")).view("<u8")
    planes = np.concatenate([planes, np.zeros((BITS, 1), np.uint64)], axis=1)  # what lies beyond the end
    ends = np.searchsorted(bucket, bucket, side="right")
    row_no = np.arange(n)
    longest = int((ends - row_no).max(initial=1))
    left, right = [], []
    for word in range(-(-longest // 64)):
        # 64 shifts at once: entry (b, w) compares rows 64 w ... 64 w + 63 with those 64 word + b further on.
        shifts = np.arange(64 * word, min(64 * word + 64, longest))
        same = np.zeros((len(shifts), size), dtype=np.uint8)
        same[:, :n] = (row_no + shifts[:, None] < ends) & (shifts[:, None] > 0)
        alive = np.packbits(same, axis=1, bitorder="little").view("<u8")
        shift, at = np.nonzero(alive)
        alive, bit = alive[shift, at], shift.astype(np.uint64)
        ones, twos = np.zeros_like(alive), np.zeros_like(alive)
        end = planes.shape[1] - 1
        for p in range(BITS):
            row = planes[p]
            other = row[np.minimum(at + word, end)] >> bit
            other |= (row[np.minimum(at + word + 1, end)] << (np.uint64(63) - bit)) << np.uint64(1)
            other ^= row[at]
            carry = ones & other
            ones ^= other
            alive &= ~(twos & carry)
            twos ^= carry
            if p % 8 == 7:
                alive &= ~{0: ones | twos, 1: twos, 2: twos & ones}[radius]
                live = np.flatnonzero(alive)
                if len(live) < len(at):
                    at, bit, alive, ones, twos = at[live], bit[live], alive[live], ones[live], twos[live]
                if not len(live):
                    break
        if len(at):
            found = np.unpackbits(alive.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            w, b = np.nonzero(found)
            i = at[w] * 64 + b
            left.append(i)
            right.append(i + 64 * word + bit[w].astype(np.int64))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def band_tables(n_distinct: int, radius: int = RADIUS, per_bucket: int = 64) -> list[list[tuple[int, int]]]:
    """Tables, each a list of (first bit, width), for so many fingerprints.

    More bands make longer keys and more tables; the pairs found are the same for any number.
    """
    for c in range(radius + 1, 9):
        cuts = [round(k * BITS / c) for k in range(c + 1)]
        bands = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(c)]
        tables = [list(x) for x in combinations(bands, c - radius)]
        if n_distinct <= per_bucket << min(sum(w for _, w in t) for t in tables):
            break
    return tables


def link(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column fp) at most ``radius`` bits apart."""
    tables = band_tables(distinct.count(), radius)

    def masked(table: list[tuple[int, int]]) -> int:
        mask = sum(((1 << w) - 1) << at for at, w in table)
        return mask - (1 << 64) if mask >> 63 else mask

    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(masked(t))).alias("key")) for i, t in enumerate(tables)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    unit = ["t", "key", "unit_lo", "unit_hi"]
    units = into_units(rows, ["t", "key"], "fp", block).select("fp", *unit)

    def run(batches):
        def edges(cols):
            fps = cols[0].view(np.uint64)
            change = np.any([np.diff(c) != 0 for c in cols[1:]], axis=0)
            bucket = np.concatenate([[0], np.cumsum(change)])
            i, j = near_pairs(fps, bucket, radius)
            root = forest(i, j, len(fps))
            node = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(cols[0][node]), pa.array(cols[0][root[node]])], ["a", "b"])

        held = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]) >= CHUNK:  # all but the last unit, which may go on
                last = np.all([c == c[-1] for c in held[1:]], axis=0)
                cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
                if cut:
                    yield edges([c[:cut] for c in held])
                    held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield edges(held)

    return units.repartition(*unit).sortWithinPartitions(*unit, "fp").mapInArrow(run, "a long, b long")


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every document's doc_id, text_key, fp, root (smallest fp of its component) and component_id."""
    fps = settle(add_fingerprints(docs, id_col, text_col))
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(link(distinct, radius)).withColumnRenamed("node", "fp")
    classes = distinct.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(classes.select("fp", "root").join(least, "root"), "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that a document reaches by links between fingerprints
    at most ``radius`` bits apart. Null and empty texts have fingerprint zero and link like
    others. Null ids are never the smallest; a component of null ids alone has component_id null.
    Repeated rows give repeated rows, an empty table none. Other columns are ignored.
    """
    return classified(docs, id_col, text_col, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id.

    Among equal ids the smallest text_key decides, null ids come last, and of rows equal in
    id and text one stays. All columns are kept.
    """
    groups = settle(classified(docs, id_col, text_col, radius))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    chosen = groups.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_key")
    times = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    same = "x.doc_id <=> y.doc_id AND x.text_key <=> y.text_key"
    stay = settle(chosen.alias("x").join(times.alias("y"), F.expr(same)).select("x.doc_id", "x.text_key", "times"))
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("times").alias("__times"))
    mine = (F.col(id_col).cast("long").eqNullSafe(F.col("__id"))) & text_key(text_col).eqNullSafe(F.col("__key"))
    kept = docs.join(stay.where("__times = 1"), mine, "left_semi")
    repeated = stay.where("__times > 1")
    if not repeated.isEmpty():
        again = docs.join(repeated, mine, "left_semi")
        kept = kept.union(again.withColumn("__key", text_key(text_col)).dropDuplicates([id_col, "__key"]).drop("__key"))
    return kept
