"""The weakly labelled headline data set: cleaning, labels, splits, weights, metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.kernels import round4
from marketframe.functions.scalars import LABEL_IDS, LABEL_NAMES, label_name, strip, text_key
from marketframe.operators.articles import score_texts
from marketframe.operators.skew import first_per_group, hash_ranks
from marketframe.session import kept

MIN_LENGTH = 15
MIN_CONFIDENCE = 0.65
TARGET_SIZE = 1200
TEST_SHARE, VALIDATION_SHARE = 0.15, 0.10
GOLD_COPIES = 3

# Phrases that mark a headline as noise (fixed values).
NOISE = [
    "watch this", "see more", "click here", "read more",
    "subscribe to", "sign up", "breaking news",
]

# Hand-labelled anchors, label 0 positive, 1 negative, 2 neutral (fixed values).
GOLD = [
    ("Revenue declined less than feared, shares rally", 0),
    ("Loss narrowed more than expected, stock jumps", 0),
    ("Earnings fell but beat lowered analyst expectations", 0),
    ("Sales dropped less than feared in challenging quarter", 0),
    ("Profit decline smaller than consensus estimate", 0),
    ("Results better than feared as margins held up", 0),
    ("Stock surges after smaller than expected loss reported", 0),
    ("Quarterly revenue topped reduced Wall Street estimates", 0),
    ("Company guides below analyst consensus next quarter", 1),
    ("Sales fell short of already lowered expectations", 1),
    ("Beat on revenue but missed badly on profit margins", 1),
    ("Raised guidance still below what analysts had hoped", 1),
    ("Results in line but forward outlook disappoints market", 1),
    ("Topped estimates but shares fall on weak guidance", 1),
    ("Management reaffirms full year guidance unchanged", 2),
    ("Stock maintains steady performance amid volatility", 0),
    ("Company holds dividend steady at current level", 2),
    ("Board reiterates long term growth targets", 2),
    ("Apple beats Q4 earnings expectations by wide margin", 0),
    ("Revenue exceeds analyst forecasts on strong demand", 0),
    ("Dividend increased for 10th consecutive year", 0),
    ("Company raises full year guidance above consensus", 0),
    ("Record quarterly profit driven by strong iPhone sales", 0),
    ("Stock hits all time high after blowout earnings report", 0),
    ("iPhone sales decline sharply in China trade tensions", 1),
    ("Operating margins decline sharply on rising costs", 1),
    ("Profits fall well below market consensus estimates", 1),
    ("Company slashes dividend amid cash flow concerns", 1),
    ("Revenue misses estimates as consumer demand weakens", 1),
    ("CEO resigns amid accounting irregularities investigation", 1),
    ("Layoffs announced as company restructures operations", 1),
]


def gold_examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GOLD, "text string, label int")


def headline_text(nested: Column, flat: Column) -> Column:
    """The nested title if there is one, else the flat one, else empty."""
    return F.coalesce(F.nullif(nested, F.lit("")), F.nullif(flat, F.lit("")), F.lit(""))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Headlines of several feeds; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def drop_removed_titles(headlines: DataFrame, text: str = "text") -> DataFrame:
    """Titles longer than 15 characters that were not taken down."""
    t = F.col(text)
    return headlines.where((t != "") & (t != "[Removed]") & (F.length(t) > MIN_LENGTH))


def dedup_headlines(headlines: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """First headline (lowest ``seq``) of each text key, trimmed: columns seq, text."""
    return (
        headlines.groupBy(text_key(F.col(text)).alias("text_key"))
        .agg(F.min(seq).alias("seq"), F.min_by(strip(F.col(text)), seq).alias("text"))
        .select("seq", "text")
    )


def filter_headlines(headlines: DataFrame, text: str = "text") -> DataFrame:
    """At least 15 characters and none of the noise phrases in any case."""
    noisy = F.lower(text).rlike("|".join(NOISE))
    return headlines.where((F.length(text) >= MIN_LENGTH) & ~noisy)


def sample_to_target(headlines: DataFrame, n: int = TARGET_SIZE, text: str = "text", seed: int = 42) -> DataFrame:
    """At most n rows in an order that looks random but only depends on text and seed."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(text)))
    return headlines.orderBy(order, text).limit(n)


def weak_label(
    headlines: DataFrame,
    scorer: Callable | object,
    threshold: float = MIN_CONFIDENCE,
    batch_size: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """Label distinct headlines by the scorer's likeliest class, dropping unsure ones.

    Returns text, label, confidence (4 places) and source ``auto``. A text is scored as it
    stands, however short.
    """
    texts = headlines.groupBy(text_key(F.col("text")).alias("text_key")).agg(F.min_by("text", "seq").alias("text"))
    p = score_texts(texts, scorer, batch_size, partitions, carry_text=True)
    best = F.greatest(*LABEL_IDS)
    label = reduce(
        lambda rest, name: F.when(F.col(name) == best, LABEL_IDS[name]).otherwise(rest),
        reversed(list(LABEL_IDS)),
        F.lit(None).cast("int"),
    )
    return p.where(best >= threshold).select(
        "text", label.alias("label"), round4(best).alias("confidence"), F.lit("auto").alias("source")
    )


def oversample_gold(gold: DataFrame, copies: int = GOLD_COPIES) -> DataFrame:
    """Each gold row ``copies`` times, numbered by ``copy`` from 1, source ``gold``."""
    return gold.select(
        *gold.columns,
        F.lit("gold").alias("source"),
        F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"),
    )


def build_dataset(labelled: DataFrame, gold: DataFrame, copies: int = GOLD_COPIES) -> DataFrame:
    """Weak labels and oversampled gold in one table (order carries no meaning in Spark)."""
    return union_feeds(labelled, oversample_gold(gold, copies)).fillna({"copy": 1})


def class_distribution(examples: DataFrame) -> DataFrame:
    """Rows and percentage per label."""
    counts = examples.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", label_name(F.col("label")).alias("name"), "n", (F.col("n") * 100.0 / total).alias("pct"))


def class_weights(train: DataFrame, classes: list[int] = tuple(LABEL_NAMES)) -> DataFrame:
    """label, n, weight = rows / (classes * n); a class without rows counts as one row."""
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    every = train.sparkSession.createDataFrame([(int(c),) for c in classes], "label int")
    n = F.coalesce("n", F.lit(1).cast("bigint"))
    weight = total / (F.lit(float(len(classes))) * n)
    # one row per class: broadcasting the counts is bounded by the number of labels
    return every.join(F.broadcast(counts), "label", "left").select("label", n.alias("n"), weight.alias("weight"))


def stratified_split(examples: DataFrame, seed: int = 42, key: list[str] = ("text",)) -> DataFrame:
    """Add ``split``: train, validation or test, with exact shares within each label.

    Per label of n rows, ``max(1, int(.15 n))`` go to test and ``max(1, int(.10 n))`` to
    validation. The order is a hash of ``key``, which must identify a row.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    ranked = hash_ranks(examples.withColumn("__hash", digest), "label", "__hash")
    n, r = F.col("group_size"), F.col("rank")
    n_test = F.greatest(F.lit(1), F.floor(n * TEST_SHARE))
    n_val = F.greatest(F.lit(1), F.floor(n * VALIDATION_SHARE))
    split = (
        F.when(r <= n - n_test - n_val, "train").when(r <= n - n_test, "validation").otherwise("test")
    )
    return ranked.select(*examples.columns, split.alias("split"))


def split_dataset(
    labelled: DataFrame, gold: DataFrame, seed: int = 42, copies: int = GOLD_COPIES, reference_order: bool = False
) -> DataFrame:
    """Split weak labels plus gold, and oversample gold.

    Distinct texts are split first and only training gold is copied, so that no sentence is in
    two splits. Sentences are equal up to case and surrounding white space; where the gold list has
    one, its label counts and weak labels of it go, and of several rows of one kind the first by text
    and label stays. ``reference_order`` copies first and splits the copies, repeats included.
    The labels are written once, since ranks are counted first and then joined back: nothing is scored twice.
    """
    labelled = kept(labelled)
    if reference_order:
        return stratified_split(build_dataset(labelled, gold, copies), seed, ["text", "source", "copy"])
    key = text_key(F.col("text")).alias("__key")
    first = lambda df: first_per_group(df.withColumn("__key", key), ["__key"], [F.col("text"), F.col("label")])
    sure = first(gold)
    weak = first(labelled).join(sure.select("__key"), "__key", "left_anti")
    parts = stratified_split(build_dataset(weak, sure, 1), seed, ["__key"]).drop("copy", "__key")
    times = F.when((F.col("source") == "gold") & (F.col("split") == "train"), copies).otherwise(1)
    return parts.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def with_class_weight(train: DataFrame) -> DataFrame:
    """Rows plus ``weight`` of their class."""
    return train.join(F.broadcast(class_weights(train).drop("n")), "label")


def precision_recall_f1(predictions: DataFrame, classes: list[int] = tuple(LABEL_NAMES)) -> DataFrame:
    """Accuracy and per-class precision, recall and F1, from columns label and prediction.

    Denominators have a floor of 1 (counts) or 1e-9 (F1). Three decimals, but for accuracy.
    """
    label, pred = F.col("label"), F.col("prediction").cast("int")
    pairs = predictions.groupBy(label.cast("int").alias("label"), pred.alias("prediction")).agg(
        F.count("*").alias("n")
    )
    every = predictions.sparkSession.createDataFrame([(int(c),) for c in classes], "class int")
    hit = F.col("label") == F.col("prediction")
    total = pairs.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.greatest(F.lit(1), F.sum("n"))).scalar()
    # A pair counts for its label (hit or missed) and, if they differ, for its prediction.
    role = lambda cls, kind: F.struct(cls.alias("class"), F.lit(kind).alias("kind"))
    roles = F.when(hit, F.array(role(F.col("label"), "tp"))).otherwise(
        F.array(role(F.col("label"), "fn"), role(F.col("prediction"), "fp"))
    )
    counts = pairs.select("n", F.inline(roles)).groupBy("class").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("tp", "fp", "fn")]
    )
    # one row per class on both sides
    per_class = every.join(F.broadcast(counts), "class", "left").fillna(0, ["tp", "fp", "fn"])
    at_least_one = lambda x: F.greatest(F.lit(1), x)
    per_class = per_class.withColumn("p", F.col("tp") / at_least_one(F.col("tp") + F.col("fp"))).withColumn(
        "r", F.col("tp") / at_least_one(F.col("tp") + F.col("fn"))
    )
    p, r = F.col("p"), F.col("r")
    round3 = lambda x: F.rint(x * 1000.0) / 1000.0
    return per_class.select(
        "class",
        label_name(F.col("class")).alias("name"),
        "tp", "fp", "fn",
        round3(p).alias("precision"),
        round3(r).alias("recall"),
        round3(2 * p * r / F.greatest(F.lit(1e-9), p + r)).alias("f1"),
        total.alias("accuracy"),
    )


def weighted_loss_accuracy(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Class-weighted cross entropy and accuracy over label, prediction, positive, negative, neutral."""
    chances = F.array(*LABEL_IDS)
    rows = predictions.join(F.broadcast(weights.select("label", "weight")), "label")
    loss = -F.ln(F.greatest(F.get(chances, F.col("label")), F.lit(1e-12)))
    return rows.agg(
        (F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss"),
        F.avg((F.col("label") == F.col("prediction").cast("int")).cast("int")).alias("accuracy"),
        F.count("*").alias("n"),
    )


def gold_check(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """How many gold sentences (by text) the predictions (text, prediction) get right."""
    guess = F.col("prediction").cast("int")
    # The gold list is the small side (Spark checks that before it broadcasts it): the predictions are
    # cut down to its texts where they are, and one row per text is left to join back. A text predicted
    # in several ways counts as right if one of them is.
    asked = gold.select("text", F.col("label").cast("int").alias("label"))
    about = predictions.select("text", guess.alias("prediction")).join(asked.select("text").distinct(), "text", "left_semi")
    found = about.groupBy("text").agg(F.collect_set("prediction").alias("predictions"))
    hit = F.coalesce(F.array_contains("predictions", F.col("label")), F.lit(False)).cast("int")
    return asked.join(found, "text", "left").agg(
        F.count("*").alias("n"), F.sum(hit).alias("n_right"), F.avg(hit).alias("gold_accuracy")
    )
