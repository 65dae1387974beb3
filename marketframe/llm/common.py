"""Helpers that several operators share: kept tables, connected components, blocks of hot groups."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.session import checkpoint_dir

#: What counts as white space between words: space, tab, line feed, vertical tab, form feed, return.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def work_folder(spark: SparkSession) -> str:
    """A new path for one kept table, in the folder that ``spark.checkpoint.dir`` names.

    Where none is named (tests, one machine) a folder of this machine is set; on a cluster that
    would be lost with its executor, so there the setting is required.
    """
    folder = checkpoint_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it, whatever folder they start in.

    On a cluster that doesn't share the folder the package must be installed or sent with the job.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: it is computed once and outlives lost executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def slices(rows: pa.RecordBatch | pa.Array, size: int = 2 << 20):
    """``rows`` in parts of about ``size`` bytes, at least one row each, so that no more of them are Python's own at a time."""
    step = max(1, len(rows) * size // max(1, rows.nbytes))
    for at in range(0, len(rows), step):
        yield rows.slice(at, step)


def text_key(text: str = "text") -> Column:
    """Together with the id, what tells rows of one id apart; equal rows share it."""
    return F.xxhash64(F.col(text))


def n_words(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    body = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, BLANK))).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b: long) reaches.

    Large and small stars by turns: each step hangs nodes on the smallest node in reach, by
    one aggregation and one join, so a hub's edges never meet in one group. Every step's
    edges are a kept table. Ends when the edges are stars around their smallest nodes.
    Nodes without edges aren't in the result.
    """
    e = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    while True:
        several = e.groupBy("hi").count().where("count > 1").limit(1)
        chained = e.join(e.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").limit(1)
        if several.isEmpty() and chained.isEmpty():
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = settle(small.union(least.select("hi", "m")).distinct())
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        e.select("lo", "lo").distinct()
    )


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links i-j reach."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def into_units(rows: DataFrame, keys: list[str], spread_by: str, block: int) -> DataFrame:
    """Deal the rows of each group (``keys``) into units in which any two rows of a group meet.

    Groups of one row go. A group of up to ``block`` rows is one unit. A larger one is cut
    into blocks by a hash, and each two blocks are a unit, so a unit has about twice
    ``block`` rows however large its group. Adds block_no, unit_lo and unit_hi.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / block).cast("int")
    dealt = rows.join(sizes, keys).withColumn("__blocks", blocks)
    dealt = dealt.withColumn("block_no", F.pmod(F.xxhash64(F.col(spread_by), F.lit(7)), F.col("__blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda x: x != F.col("block_no"))
    return (
        dealt.withColumn("__other", F.explode(F.when(F.col("__blocks") == 1, F.array(F.lit(0))).otherwise(others)))
        .withColumn("unit_lo", F.least("block_no", "__other"))
        .withColumn("unit_hi", F.greatest("block_no", "__other"))
        .drop("__n", "__blocks", "__other")
    )


#: Bits of a sieve's table: 16 MB, whatever the size of what it holds.
SIEVE_BITS, SLICES = 27, 64


class Sieve:
    """A table of bits of a fixed size that tells of a hash (a long) whether it may be among given ones.

    It spares work and decides nothing: an exact join or count follows, and a table that is too full lets more through.
    """

    def __init__(self, keys: DataFrame, name: str):
        """From the hashes in column ``name``; each slice of the table is made in a task of its own."""
        part_bits = (1 << SIEVE_BITS) // SLICES

        def run(key, t):
            bits = np.zeros(part_bits, np.uint8)
            bits[t["at"].to_numpy() % part_bits] = 1
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        places = keys.select(F.pmod(F.col(name), F.lit(1 << SIEVE_BITS)).alias("at")).distinct()
        places = places.withColumn("slice", F.floor(F.col("at") / part_bits).cast("int"))
        whole = np.zeros((1 << SIEVE_BITS) // 8, np.uint8)
        for no, bits in places.groupBy("slice").applyInArrow(run, "slice int, bits binary").collect():  # 64 rows of 256 KB
            whole[no * part_bits // 8 : (no + 1) * part_bits // 8] = np.frombuffer(bits, np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(whole)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Whether each hash (int64 or uint64) may be among the sieve's."""
        at = keys.view(np.uint64) & np.uint64((1 << SIEVE_BITS) - 1)
        return (self.table.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)

    def lets_through(self, name: str) -> Column:
        """Whether the hash in a column may be among the sieve's."""

        @F.pandas_udf("boolean")
        def look(keys: pd.Series) -> pd.Series:
            return pd.Series(self.look(keys.to_numpy(np.int64)))

        return look(F.col(name))
