"""Scalar expressions on text, dates and label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketframe.functions.kernels import round4

# A day without news (fixed values).
NEUTRAL_DAY: dict[str, float] = {
    "sentiment_mean": 0.0,
    "sentiment_max": 0.0,
    "sentiment_min": 0.0,
    "sentiment_std": 0.0,
    "sentiment_momentum": 0.0,
    "article_count": 0.0,
    "positive_ratio": 0.5,
    "confidence_mean": 0.0,
}
# Label numbers of the headline classifier (fixed values).
LABEL_IDS = {"positive": 0, "negative": 1, "neutral": 2}
LABEL_NAMES = {i: n for n, i in LABEL_IDS.items()}
# Texts that stand for no text (fixed values).
PLACEHOLDERS = ["[removed]", "n/a", "null", "none", ""]
MIN_SCORABLE = 10


# White space at either end of a text that does not count (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(x: Column) -> Column:
    """Trim all white space, line breaks and tabs included; NULL becomes empty."""
    return F.btrim(F.coalesce(x, F.lit("")), F.lit(WHITE_SPACE))


def clean_text(title: Column, description: Column, max_description: int | None = None) -> Column:
    """The text to score: title and description, or the first ``max_description`` characters of it."""

    def known(x: Column) -> Column:
        x = strip(x)
        return F.when(F.lower(x).isin(PLACEHOLDERS), F.lit("")).otherwise(x)

    head, rest = known(title), known(description)
    if max_description is not None:
        rest = F.substring(rest, 1, max_description)
    both = (head != "") & (rest != "")
    return F.when(both, F.concat(head, F.lit(". "), rest)).otherwise(F.concat(head, rest))


def text_key(x: Column) -> Column:
    """Equal texts, up to case and surrounding white space, have equal keys."""
    return F.md5(F.lower(strip(x)))


def is_scorable(x: Column) -> Column:
    return F.length(strip(x)) >= MIN_SCORABLE


def label_id(name: Column) -> Column:
    pairs = [F.lit(v) for kv in LABEL_IDS.items() for v in kv]
    return F.create_map(*pairs)[F.lower(name)]


def label_name(number: Column) -> Column:
    pairs = [F.lit(v) for kv in LABEL_NAMES.items() for v in kv]
    return F.create_map(*pairs)[number]


def score_struct(positive: Column, negative: Column, neutral: Column) -> Column:
    """score = P(positive) - P(negative), probabilities to 4 places, label of the largest."""
    label = (
        F.when((positive >= negative) & (positive >= neutral), F.lit("positive"))
        .when(negative >= neutral, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )
    return F.struct(
        round4(positive - negative).alias("score"),
        round4(positive).alias("positive"),
        round4(negative).alias("negative"),
        round4(neutral).alias("neutral"),
        label.alias("label"),
    )


def parse_day(x: Column) -> Column:
    """Calendar day of a date text; NULL if it cannot be read."""
    return F.to_date(F.try_to_timestamp(x))
