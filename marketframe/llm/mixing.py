"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, Exp(1) divided by its quality weight; taking documents
by ascending key is sampling without replacement with probability proportional to the weights.
A source's target is a number of whole epochs, which all its documents take, and a rest,
which is filled from the ascending keys up to the token budget.

Sorting a whole source would put a hot one into one task. Keys are therefore cut into many
slices; sums per source and slice find the one slice in which the budget ends, and only that slice
is sorted, one row per distinct key. Rows equal in id and text share a key; where the budget ends
among them, sums per task and then the rows of one task find the row at which it does. The
result is one limit per source, so a document is decided by its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import n_words, settle, text_or_empty

#: Weights of the sources in order, repeating.
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: No slice holds more than 10 of so many parts of the rows (see ``keyed``).
SLICES = 4096
LEAST_WEIGHT = 0.1
#: Shares of the code points that lower a document's weight: digits and ASCII marks.
MARKS = "0123456789!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"


def quality_weight(text_col: str = "text") -> Column:
    """1 for plain prose, less with the share of digits and marks, at least 0.1."""
    text = text_or_empty(text_col)
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    share = F.when(F.length(text) > 0, marks / F.length(text)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) - F.lit(3.0) * share)


def draw(id_col: str, text_col: str, seed: int = 42) -> Column:
    """Uniform in (0, 1), from the id and the text: 52 bits of their MD5."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty(text_col)))
    bits = F.conv(F.substring(F.md5(whole), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with what decides about a row: __size, __source, __key, __slice, __row.

    The slice grows with the key: it is cut from u ** (0.1 / weight), u being the row's draw. At the least weight
    that is even; at weight 1 a slice near one end has ten times the even share, which is the most there is.
    ``__row`` tells equal rows apart; it holds once the table is written.
    """
    key = -F.log(draw(id_col, text_col)) / quality_weight(text_col)
    docs = docs.withColumns({"__size": n_words(text_col), "__source": F.col(source_col), "__key": key, "__row": F.monotonically_increasing_id()})
    return docs.withColumn("__slice", F.floor((F.lit(1.0) - F.exp(F.lit(-LEAST_WEIGHT) * F.col("__key"))) * SLICES))


def targets(sizes: DataFrame, cycle: tuple = CYCLE, share: float = SHARE) -> DataFrame:
    """(__source, source_size, target): what each source is to give.

    ``sizes`` is one row per source, and so is what is sorted here. Raising a common level,
    each source gets level x weight up to twice its size: the level at which the targets add up
    is found by prefix sums over the sources in the order in which they reach their bound.
    """
    by_name = Window.orderBy(F.col("__source").isNull(), F.col("__source"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    s = sizes.withColumn("w", weights[((F.row_number().over(by_name) - 1) % len(cycle)).cast("int")])
    everything = Window.partitionBy()
    s = s.withColumn("bound", F.col("source_size") * F.lit(MOST_EPOCHS)).withColumn("reach", F.col("bound") / F.col("w"))
    by_reach = Window.orderBy("reach", F.col("__source").isNull(), "__source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "all_w": F.sum("w").over(everything), "total": F.sum("source_size").over(everything) * F.lit(share),
        "w_before": F.coalesce(F.sum("w").over(by_reach), F.lit(0.0)),
        "bound_before": F.coalesce(F.sum("bound").over(by_reach), F.lit(0.0)),
    })
    # With all sources before it at their bounds, the level that would spend the rest.
    s = s.withColumn("level", (F.col("total") - F.col("bound_before")) / (F.col("all_w") - F.col("w_before")))
    level = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everything)
    return s.withColumn("level", level).select(
        "__source", "source_size",
        F.when(F.col("level").isNull() | (F.col("reach") <= F.col("level")), F.col("bound")).otherwise(F.col("level") * F.col("w")).alias("target"),
    )


def limits(rows: DataFrame, cycle: tuple = CYCLE, share: float = SHARE) -> DataFrame:
    """One row per source (__of): __source_size, __target, __epochs, and where the rest ends: __last_slice, __last_key, __last_row.

    ``rows`` (__source, __size, __key, __slice, __row) are read several times: keep them in a table.
    """
    by_slice = rows.groupBy("__source", "__slice").agg(F.sum("__size").alias("n"))
    plan = settle(targets(rows.groupBy("__source").agg(F.sum("__size").alias("source_size")), cycle, share))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", F.least(epochs, F.lit(int(MOST_EPOCHS))).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    named = plan.where("rest > 0").select(F.col("__source").alias("src"), "rest")
    last = (
        by_slice.join(named, F.col("__source").eqNullSafe(F.col("src")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        .select("src", F.col("__slice").alias("last_slice"), F.col("rest") - F.col("before"))
        .toDF("src", "last_slice", "left")
    )
    inside = rows.join(last, F.col("__source").eqNullSafe(F.col("src")) & (F.col("__slice") == F.col("last_slice")))
    # Equal rows are counted before they are sorted; of those at the end, as many are taken as have their middle in the budget.
    keys = inside.groupBy("src", "last_slice", "left", "__key").agg(F.first("__size").alias("size"), F.count("*").alias("n_rows"))
    keys_before = Window.partitionBy("src").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("n_rows")).over(keys_before), F.lit(0))
    fits = F.when(F.col("size") > 0, F.floor(left / F.col("size") + F.lit(0.5))).when(left >= 0, F.col("n_rows")).otherwise(F.lit(0))
    keys = keys.withColumn("n_taken", F.least("n_rows", fits)).where("n_taken > 0")
    end = keys.groupBy("src", "last_slice").agg(F.max_by(F.struct("__key", "n_rows", "n_taken"), "__key").alias("k"))
    end = settle(end.select("src", "last_slice", F.col("k.__key").alias("last_key"), F.col("k.n_rows").alias("n_rows"), F.col("k.n_taken").alias("n_taken")))
    cut = last_rows(rows, end.where("n_taken < n_rows"))
    last = last.alias("a").join(end.alias("b"), F.expr("a.src <=> b.src"), "left").join(cut.alias("c"), F.expr("a.src <=> c.src"), "left")
    last = last.select("a.src", "a.last_slice", "b.last_key", "c.last_row")
    return plan.alias("p").join(last.alias("l"), F.expr("p.__source <=> l.src"), "left").select(
        F.col("p.__source").alias("__of"),
        *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "last_slice", "last_key", "last_row")],
    )


def last_rows(rows: DataFrame, end: DataFrame) -> DataFrame:
    """(src, last_row): of the rows with the key at which a budget ends, the number of the ``n_taken``th.

    Rows are counted by the task that numbered them; only the rows of the task in which the count is reached are put in order.
    """
    ties = rows.join(end, F.expr("__source <=> src and __slice = last_slice and __key = last_key"))
    ties = ties.select("src", "n_taken", F.shiftright("__row", 33).alias("task"), "__row")
    by_task = ties.groupBy("src", "n_taken", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = by_task.where((F.col("before") < F.col("n_taken")) & (F.col("n_taken") <= F.col("before") + F.col("n")))
    at = at.select(F.col("src").alias("s"), F.col("task").alias("at_task"), (F.col("n_taken") - F.col("before")).alias("place"))
    there = ties.join(at, F.expr("src <=> s and task = at_task"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("__row"))
    return there.withColumn("nth", place).where("nth = place").select("src", F.col("__row").alias("last_row"))


def times_taken() -> Column:
    """How often the mix takes a row of ``keyed`` joined with its source's limits."""
    at_end = (F.col("__key") == F.col("__last_key")) & F.coalesce(F.col("__row") <= F.col("__last_row"), F.lit(True))
    below = (F.col("__slice") < F.col("__last_slice")) | (
        (F.col("__slice") == F.col("__last_slice")) & ((F.col("__key") < F.col("__last_key")) | at_end)
    )
    return F.col("__epochs") + F.coalesce(below, F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cycle: tuple = CYCLE, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, times.

    Sizes are words. Sources, by code point with null as the last, weigh ``cycle`` in turn and
    share ``share`` times all sizes; none gets more than twice its size. The fractional part of
    a target ends at the document whose middle lies on the budget, so a source's taken words
    miss its target by at most half a document, also where it lies among rows equal in id and
    text, of which some are then taken once more than others. Null and empty texts have size 0;
    a budget of whole epochs takes them no further. Other columns are ignored.
    """
    rows = settle(keyed(docs, id_col, text_col, source_col).select(
        F.col(id_col).cast("long").alias("doc_id"), "__size", "__source", "__key", "__slice", "__row"
    ))
    limit = settle(limits(rows.drop("doc_id"), cycle, share))
    both = rows.join(limit, F.col("__source").eqNullSafe(F.col("__of")))
    return both.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (times_taken() * F.col("__size")).alias("taken"),
        times_taken().alias("times"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          cycle: tuple = CYCLE, share: float = SHARE) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    rows = settle(keyed(docs, id_col, text_col, source_col))
    limit = settle(limits(rows.select("__size", "__source", "__key", "__slice", "__row"), cycle, share))
    both = rows.join(limit, F.col("__source").eqNullSafe(F.col("__of")))
    both = both.withColumn("__times", times_taken().cast("int")).where("__times > 0")
    return both.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
