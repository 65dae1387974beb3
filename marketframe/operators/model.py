"""Labels, time-ordered splits, direction classifiers and their reports."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    HashingTF,
    IDF,
    Imputer,
    RegexTokenizer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.functions.kernels import flag
from marketframe.operators import boosting
from marketframe.operators.boosting import BoostedTrees
from marketframe.operators.panel import close_panel, open_panel
from marketframe.operators.skew import first_per_group
from marketframe.session import importable, kept

# Boosted-tree settings (fixed values).
TREES = {
    "maxIter": 300, "stepSize": 0.05, "maxDepth": 6,
    "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42,
}


def target_label(
    features: DataFrame,
    horizon: int = 1,
    symbol: str = "symbol",
    ts: str = "ts",
    longest: int | None = None,
    symbols: int | None = None,
) -> DataFrame:
    """Add ``target``: 1 if the close is higher ``horizon`` rows ahead, else 0; NULL without them."""
    p = open_panel(features, symbol, ts, newest_first=True, longest=longest, symbols=symbols)
    later = p.frames.lag("close", horizon)
    return close_panel(p.add({"target": F.when(later.isNotNull(), flag(later > F.col("close")))}))


def target_threshold(
    features: DataFrame,
    horizon: int = 1,
    threshold: float = 0.003,
    symbol: str = "symbol",
    ts: str = "ts",
    longest: int | None = None,
    symbols: int | None = None,
) -> DataFrame:
    """Keep rows that move by more than ``threshold`` within ``horizon`` rows, labelled 1 or 0.

    A move away from a close of 0 is without bounds; from 0 to 0 there is none.
    """
    p = open_panel(features, symbol, ts, newest_first=True, longest=longest, symbols=symbols)
    later = p.frames.lag("close", horizon)
    from_zero = F.when(later != 0, F.signum(later) * float("inf"))
    p = p.add({"__move": F.when(F.col("close") == 0, from_zero).otherwise(F.try_divide(later, F.col("close")) - 1)})
    move = F.col("__move")
    p = p.add({"target": F.when(move > threshold, 1).when(move < -threshold, 0)})
    return close_panel(p).where(F.col("target").isNotNull())


def split_time(df: DataFrame, train_ratio: float = 0.8, ts: str = "ts") -> DataFrame:
    """One row, ``cut``: the first time of the test part, over all symbols.

    That is the distinct time number floor(ratio * n), from 0. Months are counted first and
    only the month that holds the cut is ranked, so no task sorts all times.
    """
    times = df.select(F.col(ts).alias("t")).distinct().withColumn("month", F.date_trunc("month", "t"))
    w = Window.orderBy("month")  # one row per month
    months = times.groupBy("month").agg(F.count("*").alias("n"))
    months = months.select(
        "month",
        "n",
        (F.sum("n").over(w) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    place = F.floor(F.col("total") * train_ratio)
    here = months.where((place >= F.col("before")) & (place < F.col("before") + F.col("n"))).select(
        "month", (place - F.col("before") + 1).alias("nth")
    )
    ranked = times.join(F.broadcast(here), "month")  # one month
    at = F.row_number().over(Window.partitionBy("month").orderBy("t"))
    return ranked.withColumn("row", at).where(F.col("row") == F.col("nth")).select(F.col("t").alias("cut"))


def chronological_split(df: DataFrame, train_ratio: float = 0.8, ts: str = "ts") -> DataFrame:
    """Add ``split``: train before the cut, test from it on. No shuffling, no overlap in time."""
    cut = split_time(df, train_ratio, ts).agg(F.max("cut")).scalar()
    return df.withColumn("split", F.when(F.col(ts) < cut, "train").otherwise("test"))


def latest_rows(df: DataFrame, n: int = 1, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """The last n rows of each symbol."""
    return first_per_group(df, [symbol], [F.col(ts).desc()], n)


def direction_pipeline(features: list[str], **trees) -> Pipeline:
    """Mean imputer, standard scaler and Spark's own boosted trees, stage by stage. ``trees`` overrides ``TREES``.

    ``train`` doesn't use it: scaling changes no split, and Spark's trees take several jobs per level.
    """
    filled = [f"{c}__filled" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="mean", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="assembled"),
        StandardScaler(withMean=True, inputCol="assembled", outputCol="features"),
        GBTClassifier(labelCol="target", featuresCol="features", checkpointInterval=10, **{**TREES, **trees}),
    ])


def train(df: DataFrame, features: list[str], train_ratio: float = 0.8, **trees) -> tuple[BoostedTrees, DataFrame, DataFrame]:
    """Fit on the earlier part of the rows with a target: (model, train, test).

    The labelled rows are written once, and everything after reads that table: the cut, the bins of the
    columns, both parts that are returned. ``trees`` overrides ``TREES``; see ``boosting`` for the method.
    """
    importable(df.sparkSession)
    parts = chronological_split(kept(df.where(F.col("target").isNotNull())), train_ratio)
    early, late = (parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return boosting.fit(early, features, {**TREES, **trees}), early, late


def predict(model: BoostedTrees | PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Rows plus prediction, prob_down and prob_up, and rawPrediction, the logit of UP (of a pipeline: its own)."""
    if isinstance(model, BoostedTrees):
        importable(df.sparkSession)
        up = 1.0 / (1.0 + F.exp(-F.col("rawPrediction")))
        scored = df.select("*", model.margin().alias("rawPrediction")).select("*", up.alias("prob_up"))
        return scored.select(
            *df.columns, (F.col("prob_up") > 0.5).cast("int").alias("prediction"), (1.0 - F.col("prob_up")).alias("prob_down"), "prob_up", "rawPrediction",
        )
    as_double = [F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in df.columns]
    chances = vector_to_array("probability")
    return model.transform(df.select(*as_double)).select(
        *df.columns, F.col("prediction").cast("int").alias("prediction"),
        chances[0].alias("prob_down"), chances[1].alias("prob_up"), "rawPrediction",
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Rows by target (DOWN, UP) with the counts predicted down and up."""
    p = F.col("prediction")
    return predictions.groupBy("target").agg(
        F.count(F.when(p == 0, 1)).alias("pred_down"), F.count(F.when(p == 1, 1)).alias("pred_up")
    )


def binary_report(predictions: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall, F1 and support of DOWN and UP, from target and prediction."""
    count = lambda t, p: F.count(F.when((F.col("target") == t) & (F.col("prediction") == p), 1))
    cells = predictions.agg(*[count(t, p).alias(f"c{t}{p}") for t in (0, 1) for p in (0, 1)])
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def report(name: str, k: int):
        hit, support = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1")
        precision, recall = ratio(hit, F.col(f"c0{k}") + F.col(f"c1{k}")), ratio(hit, support)
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            ratio(2 * precision * recall, precision + recall).alias("f1"), support.alias("support"),
            ratio(F.col("c00") + F.col("c11"), total).alias("accuracy"),
        )

    return cells.select(F.inline(F.array(report("DOWN", 0), report("UP", 1))))


def roc_auc_row(predictions: DataFrame, score: str = "prob_up", target: str = "target") -> DataFrame:
    """One row, ``roc_auc``: the chance that a positive row scores above a negative one, ties count half.

    Exact: rows are counted by score, the scores ranged over partitions, and each range adds the negatives of the
    ranges before it, so no task sorts all scores. NULL without rows of both kinds; rows without a score or target don't count.
    """
    known = predictions.where(F.col(score).isNotNull() & F.col(target).isin(0, 1))
    up = F.col(target) == 1
    counts = known.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.when(up, 1)).alias("p"), F.count(F.when(~up, 1)).alias("n"))
    ranged = kept(counts.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = ranged.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    below = F.sum("n").over(Window.partitionBy("part").orderBy("s")) - F.col("n") / 2 + F.col("before")
    pairs = ranged.join(parts, "part").select("p", "n", (F.col("p") * below).alias("above"))
    return pairs.agg(F.try_divide(F.sum("above"), F.sum("p") * F.sum("n").cast("double")).alias("roc_auc"))


def roc_auc(predictions: DataFrame, score: str = "prob_up") -> float | None:
    """The value of ``roc_auc_row``."""
    return roc_auc_row(predictions, score).first()[0]


def feature_importance(model: BoostedTrees | PipelineModel, features: list[str], top_n: int = 15) -> DataFrame:
    """The ``top_n`` most important features, descending (one value per feature, not per row)."""
    weights = model.importances() if isinstance(model, BoostedTrees) else model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(features, weights)]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    ).limit(top_n)


def predict_latest(model: BoostedTrees | PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Direction of each symbol from its last row: date, prediction, confidence, probabilities."""
    scored = predict(model, latest_rows(df), features)
    up = F.col("prediction") == 1
    return scored.select(
        "symbol",
        F.to_date("ts").alias("date"),
        F.when(up, "UP").otherwise("DOWN").alias("prediction"),
        F.when(up, F.col("prob_up")).otherwise(F.col("prob_down")).alias("confidence"),
        "prob_up",
        "prob_down",
    )


def headline_classifier(n_features: int = 1 << 16, max_iter: int = 50) -> Pipeline:
    """Text to positive / negative / neutral: weighted multinomial regression on TF-IDF.

    Fit it on text, label and weight (see ``with_class_weight``). The fitted model is a scorer for
    ``score_articles``.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern="\\W+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=n_features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(
            family="multinomial", labelCol="label", weightCol="weight", maxIter=max_iter, regParam=0.01
        ),
    ])
