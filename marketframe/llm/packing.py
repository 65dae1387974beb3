"""Packing documents into training sequences: best-fit decreasing.

A document's ids, with an end id after them, are cut into full windows and a remainder.
Full windows are sequences of their own. The remainders are dealt into groups of about
``GROUP`` pieces, and in each group, longest first, a piece goes to the open window with the
least room that still holds it; a segment tree over the capacities finds that room in log steps.
A group's padding is a part of its last few windows, so groups cost next to nothing and make
the work parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm import tokens
from marketframe.llm.common import settle, slices, text_or_empty
from marketframe.llm.tokens import tokenizer_path

WINDOW = 1024
GROUP = 4096
END_ID = 0


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids if they are kept."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            doc, start, length, crc, total, kept = [], [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.ids(path, text), END_ID).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    doc.append(doc_id)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


class Room:
    """Open windows by the room left, with a segment tree that finds the tightest one."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._count(room, 1)

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open window has."""
        at = need + self.size
        while not self.tree[at]:
            while at & 1:  # a right child: what follows it is to the right of its parent
                at >>= 1
                if at == 0:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each of ``lengths`` (given longest first, none above window)."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room, n = Room(window), 0
    for i, need in enumerate(lengths.tolist()):
        left = room.tightest(need)
        if left is None:
            at, left, n = n, window, n + 1
        else:
            at = room.take(left)
        sequence[i], offset[i] = at, window - left
        if left > need:
            room.add(left - need, at)
    return sequence, offset


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, group: int = GROUP, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to (and ids).

    Each id of each document lies in exactly one piece; pieces of a sequence follow each other
    from offset 0. ``padded_to`` is the sequence's length with padding: its own if that is a
    power of two, else ``window``. Null and empty texts are the end id alone. Ids may be null
    or repeat: every row is packed on its own. An empty table gives none. Other columns are ignored.
    """
    rows = settle(pieces(docs, path or tokenizer_path("byte_bpe_50k.json"), window, id_col, text_col, keep_ids))
    groups = max(1, -(-rows.count() // group))
    in_group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(g["length"].to_numpy(), window)
        used = np.bincount(sequence, weights=g["length"].to_numpy()).astype(np.int64)
        padded = np.where(used & (used - 1) == 0, used, window)
        return g.assign(sequence_id=(g["grp"].to_numpy() << 32) + sequence, offset=offset, padded_to=padded[sequence]).drop(columns="grp")

    names = [f.name for f in rows.schema]
    kinds = [f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in [*names, "sequence_id", "offset", "padded_to"]]
    return rows.withColumn("grp", in_group).groupBy("grp").applyInPandas(run, ", ".join(kinds))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the padded ids of each sequence and where its pieces begin.

    ``packed`` is the result of ``pack`` with ids kept.
    """
    part = F.struct("offset", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"), F.max("padded_to").alias("n"))
    ids = F.flatten(F.col("p.ids"))
    return whole.select(
        "sequence_id", F.concat(ids, F.array_repeat(F.lit(END_ID), (F.col("n") - F.size(ids)).cast("int"))).alias("ids"),
        F.col("p.offset").alias("starts"),
    )
