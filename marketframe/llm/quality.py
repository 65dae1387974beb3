"""Quality classifier on random-indexing word vectors.

Every word and every word shape (its kinds of characters) has a slot with a fixed sparse random
index vector. Over the whole corpus a slot sums the index vectors of its neighbours; these sums
are the word vectors. A document is the mean of its words' vectors, frequent words weighing
less, beside the same mean over shapes, and a two-layer network with a calibrated temperature
scores it. The sums are of whole numbers, so they don't depend on partitions or retries, and
their table has a fixed size however large the corpus.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import slices, text_or_empty
from marketframe.llm.learn import SAMPLE, fitted, labelled

#: Slots of words and of shapes, dimensions, entries that are not zero in an index vector.
WORDS, SHAPES, DIMS, ENTRIES = 4096, 1024, 32, 4
SLOTS = WORDS + SHAPES
WINDOW = 2
KEEP = 0.3
#: Frequency at which a word weighs half.
HALF = 1e-3
CHUNK = 64
MEMO = 200_000
TEXT = 2 << 20
#: Words of a text that are pooled at a time.
ROWS = 1 << 16

_ASCII = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """The kinds of characters in a word, runs as one: The -> Aa, THE!! -> A!, the%%% -> a%."""
    word = word.translate(_ASCII)
    if not word.isascii():
        word = "".join("a" if c.islower() else "A" if c.isalpha() else c for c in word)
    return _RUNS.sub(r"\1", word)[:8]


class Slots(dict):
    """word -> word slot and shape slot in one number, worked out once per word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        # Most new words are of small letters only, whose shape needs no look at them.
        known = _SMALL if word.isascii() and word.isalpha() and word.islower() else 1 + _digest(shape(word), SHAPES - 1)
        self[word] = both = _digest(word.lower(), WORDS) << 16 | known
        return both


def _digest(s: str, n: int) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "replace")) % n


_SMALL = 1 + _digest("a", SHAPES - 1)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the entries of each slot's index vector; the last slot is none."""
    rng = np.random.default_rng(seed)
    at = np.argsort(rng.random((SLOTS + 1, DIMS)), axis=1)[:, :ENTRIES]
    sign = rng.choice([-1.0, 1.0], (SLOTS + 1, ENTRIES))
    sign[SLOTS] = 0
    return at, sign


def in_blocks(texts: list[str], slots: Slots):
    """Blocks of texts as (number of words of each, word slots, shape slots) of all of them.

    A word that repeats the one before it has the shape "again", slot 0 of the shapes.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TEXT):
            size += len(texts[end])
            end += 1
        words = [t.split() for t in texts[at:end]]
        n = np.array([len(w) for w in words], np.int64)
        both = np.fromiter(map(slots.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        first = np.zeros(len(both), bool)
        starts = np.cumsum(n) - n
        first[starts[n > 0]] = True
        again = np.concatenate([[False], both[1:] == both[:-1]])[: len(both)] & ~first
        yield n, both >> 16, WORDS + np.where(again, 0, both & 0xFFFF)
        at = end


def neighbours(n: np.ndarray, seq: np.ndarray, vectors: tuple[np.ndarray, np.ndarray], sums: np.ndarray) -> None:
    """Add the index vectors of the neighbours (in the same document) to each slot's sum, and count it."""
    at, sign = vectors
    gap = np.full(len(seq) + WINDOW * len(n), SLOTS, np.int64)  # documents stand apart
    gap[np.arange(len(seq)) + WINDOW * np.repeat(np.arange(len(n)), n)] = seq
    flat = sums.reshape(-1)
    width = sums.shape[1]
    for off in range(1, WINDOW + 1):
        for a, b in ((gap[:-off], gap[off:]), (gap[off:], gap[:-off])):
            for k in range(ENTRIES):
                flat += np.bincount(a * width + at[b, k], weights=sign[b, k], minlength=len(flat)).astype(np.int64)
    sums[:, DIMS] += np.bincount(gap, minlength=SLOTS + 1)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(slot, DIMS + 1): the sums of neighbours over all documents, and how often the slot occurs."""

    def run(batches):
        slots, vectors, sums, any_row = Slots(), index_vectors(), np.zeros((SLOTS + 1, DIMS + 1), np.int64), False
        for b in batches:
            for part in slices(b.column(0)):
                for n, words, shapes in in_blocks(part.to_pylist(), slots):
                    any_row = True
                    neighbours(n, words, vectors, sums)
                    neighbours(n, shapes, vectors, sums)
        if any_row:
            parts = [zlib.compress(sums[i : i + CHUNK].astype("<i8").tobytes(), 1) for i in range(0, SLOTS, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in g["sums"])
        return pd.DataFrame({"part": [g["part"].iloc[0]], "sums": [zlib.compress(total.tobytes(), 1)]})

    parts = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "part int, sums binary")
    out = np.zeros((SLOTS, DIMS + 1))
    # A table of a fixed size: SLOTS / CHUNK rows.
    for part, sums in parts.groupBy("part").applyInPandas(add, "part int, sums binary").collect():
        out[part * CHUNK : (part + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(sums)), "<i8").reshape(-1, DIMS + 1)
    return out


class WordVectors:
    """Unit vectors and weights of all slots, and the pooling of documents."""

    def __init__(self, sums: np.ndarray):
        v = sums[:, :DIMS]
        self.vectors = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
        n = sums[:, DIMS]
        share = np.concatenate([part / max(part.sum(), 1) for part in (n[:WORDS], n[WORDS:])])
        self.weights = (HALF / (HALF + share)).astype(np.float32)
        self._derive()

    def _derive(self) -> None:
        """What isn't sent to the workers: the memo of words, and each slot's weighted vector with its weight behind it."""
        self.slots = Slots()
        self.weighted = np.column_stack([self.vectors * self.weights[:, None], self.weights]).astype(np.float64)

    def __getstate__(self):
        return {"vectors": self.vectors, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._derive()

    def pooled(self, seq: np.ndarray) -> np.ndarray:
        """Sum of the weighted vectors and of the weights of a text's slots, so many rows at a time."""
        total = np.zeros(DIMS + 1)
        for at in range(0, len(seq), ROWS):
            total += self.weighted.take(seq[at : at + ROWS], axis=0).sum(axis=0)
        return total

    def pool(self, texts: list[str] | pa.Array) -> np.ndarray:
        """A row per text: mean vector of words, mean vector of shapes, log of the number of words."""
        if isinstance(texts, pa.Array):
            rows = [self.pool(part.to_pylist()) for part in slices(texts)]
            return np.concatenate(rows) if rows else self.pool([])
        out = []
        for n, words, shapes in in_blocks(texts, self.slots):
            rows = np.zeros((len(n), 2 * DIMS + 1), np.float64)
            ends = np.cumsum(n).tolist()
            for i in np.flatnonzero(n).tolist():
                for k, seq in enumerate((words, shapes)):
                    total = self.pooled(seq[ends[i] - int(n[i]) : ends[i]])
                    rows[i, k * DIMS : (k + 1) * DIMS] = total[:DIMS] / total[DIMS]
            rows[:, -1] = np.log1p(n)
            out.append(rows)
        return np.concatenate(out) if out else np.zeros((0, 2 * DIMS + 1))


class QualityModel:
    def __init__(self, vectors: WordVectors, network):
        self.vectors, self.network = vectors, network

    def scores(self, texts: list[str] | pa.Array) -> np.ndarray:
        return self.network(self.vectors.pool(texts)) if len(texts) else np.zeros(0)

    def column(self, text_col: str = "text") -> Column:
        """The score of a text as a column."""

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(self.scores(texts), pa.float64())

        return score(text_or_empty(text_col))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors of all ``docs``, and a network fitted on at most ``most`` labelled rows not held out.

    The network sees texts only. Without labels of both kinds every score is the share of label 1,
    one half if there are none. A document that repeats counts once.
    """
    vectors = WordVectors(context_sums(docs, text_col))

    def features(batches):
        for b in batches:
            x = vectors.pool(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sample = F.broadcast(labelled(labels, label, most, id_col))  # at most ``most`` rows of two numbers
    rows = rows.join(sample, "doc_id").select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x array<double>")
    pdf = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack(pdf["x"].to_list()) if len(pdf) else np.zeros((0, 2 * DIMS + 1))
    return QualityModel(vectors, fitted(x, pdf["label"].to_numpy(np.int64)))


def accepted(docs: DataFrame, model: QualityModel, least: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    return docs.withColumn("__score", model.column(text_col)).where(F.col("__score") >= least).drop("__score")
