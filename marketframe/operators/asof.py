"""Joins of rows with the nearest row in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.bars import unit_number


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str = "symbol",
    left_ts: str = "ts",
    right_ts: str = "ts",
    columns: list[str] | None = None,
    direction: str = "forward",
    tolerance: str | None = None,
    unit: str = "day",
    how: str = "inner",
    prefix: str = "",
) -> DataFrame:
    """Rows of ``left`` with ``columns`` of the first row of ``right`` at or after their time (``backward``: the last at or before it).

    Both sides meet in ranges of time: each (``by``, ``unit``) is sorted on its own, so a key that holds much of the
    data is many tasks. What lies beyond a range's border is handed over from a table of one row per key and
    range, the only thing that is put in order per key. Of several rows of ``right`` at one time the smallest by ``columns`` counts
    (backward: the greatest). With a ``tolerance`` such as ``2 days``, rows further away don't match. Rows without a match, or with a NULL
    key or time, go; ``how="left"`` keeps them with NULLs. Repeated rows of ``left`` stay. Names that clash need a ``prefix``.
    """
    if direction not in ("forward", "backward") or how not in ("inner", "left"):
        raise ValueError(f"unknown {direction=} or {how=}")
    columns = [c for c in right.columns if c != by] if columns is None else list(columns)
    clash = {f"{prefix}{c}" for c in columns} & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    forward = direction == "forward"
    nearest = F.min if forward else F.max
    places = [f"c{i}" for i in range(len(columns))]
    record = F.struct(F.col(right_ts).alias("at"), *[F.col(c).alias(p) for c, p in zip(columns, places)])
    asked = left.select(F.col(by).alias("k"), F.col(left_ts).alias("t"), F.struct(*left.columns).alias("l"))
    offered = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(by).alias("k"), F.col(right_ts).alias("t"), record.alias("r"))
    both = asked.unionByName(offered, allowMissingColumns=True).withColumn("range", unit_number(F.col("t"), unit))
    time = F.col("t").desc() if forward else F.col("t").asc()
    # Rows of one time are peers, so a row also sees those of its own time.
    inside = Window.partitionBy("k", "range").orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("own", nearest("r").over(inside)).where("l IS NOT NULL")
    ranges = both.where("range IS NOT NULL").groupBy("k", "range").agg(nearest("r").alias("r"))
    order = F.col("range").desc() if forward else F.col("range").asc()
    earlier = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    handed = ranges.select("k", "range", nearest("r").over(earlier).alias("next"))
    found = within.join(handed, ["k", "range"], "left").withColumn("hit", F.when(F.col("t").isNotNull() & F.col("k").isNotNull(), F.coalesce("own", "next")))
    if tolerance is not None:
        span = F.expr(f"interval {tolerance}")
        near = F.col("hit.at") <= F.col("t") + span if forward else F.col("hit.at") >= F.col("t") - span
        found = found.withColumn("hit", F.when(near, F.col("hit")))
    if how == "inner":
        found = found.where("hit IS NOT NULL")
    return found.select("l.*", *[F.col(f"hit.{p}").alias(f"{prefix}{c}") for c, p in zip(columns, places)])
