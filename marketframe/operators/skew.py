"""Joins and ranks that stay balanced when one key holds much of the data."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.session import checkpoint_dir

MAX_HOT = 256
SALTS = 64


def skew_safe_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: Column,
    how: str = "inner",
) -> DataFrame:
    """Join ``fact`` to ``dim`` (unique on ``on``) with the hot keys of ``fact`` salted.

    A key is hot if it holds more than 1/256 of the rows, so there are fewer than 256 of
    them: that list, and only that list, is broadcast. Rows of a hot key go to 64
    salts by a hash of ``spread_by``, and its one row of ``dim`` is copied to each. Rows
    with a NULL key match nothing and are spread too.
    """
    counts = fact.groupBy(*on).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = counts.where(F.col("__n") * MAX_HOT > total).select(*on, F.lit(True).alias("__hot"))
    some_null = reduce(or_, [F.col(k).isNull() for k in on])
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    left = (
        fact.join(F.broadcast(hot), on, "left")
        .withColumn("__salt", F.when(F.col("__hot") | some_null, salt).otherwise(0))
        .drop("__hot")
    )
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def first_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group.

    Spark applies the row limit of such a filter already before the shuffle, so each task
    sends at most n rows of a group, also of one that holds much of the data.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def hash_ranks(df: DataFrame, by: str, hash_hex: str) -> DataFrame:
    """Add ``rank`` (1-based, by hash within ``by``) and ``group_size``.

    ``by`` has few values, so one sort per value would be one task each. Instead, rows are
    ranked within 4,096 buckets of the hash prefix, and each bucket is offset by the
    sizes of those before it: a list of at most 4,096 rows per value.
    """
    bucket = F.substring(hash_hex, 1, 3)
    sizes = df.groupBy(by, bucket.alias("__bucket")).agg(F.count("*").alias("__n"))
    of_group = Window.partitionBy(by)
    before = of_group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        by,
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(of_group).alias("group_size"),
    )
    within = Window.partitionBy(by, "__bucket").orderBy(hash_hex)
    return (
        df.withColumn("__bucket", bucket)
        .join(sizes, [by, "__bucket"])
        .withColumn("rank", F.col("__before") + F.row_number().over(within))
        .drop("__bucket", "__before")
    )


def keep(df: DataFrame) -> DataFrame:
    """A result that several later steps read, computed once.

    Checkpointed where the cluster (or a test) names a checkpoint folder, so that a lost executor
    costs no recomputation; otherwise cached, and recomputed where it is lost.
    """
    return df.checkpoint() if checkpoint_dir(df.sparkSession) else df.persist()
