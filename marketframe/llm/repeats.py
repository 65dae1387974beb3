"""Repeated byte strings: a run-length index of the places where texts may agree.

A string of WIDTH bytes is kept together with its *leader*, the k bytes in it that have the
smallest hash, so equal strings have equal leaders wherever they start. Neighbouring strings with one
leader form a *stretch* of the text, a few hundred bytes. Equal stretches count together, and
stretches meet only where leaders agree: a string is repeated if and only if it occurs
twice among the stretches of its leader.

The stretches that meet go to shards by leader. A shard's texts are suffix-sorted into a Burrows-Wheeler
transform, which is kept as runs of equal letters. Copies make long runs, and between the ends
of a run nothing has to be stored: walking through a text, the length of the match with the
suffix before (or after) it in sorted order shrinks by one at each step until the row is at the start (or end) of
a run. So only the run ends are sampled, each with its match in the text, and the matching
statistics are streamed from the samples. A match of WIDTH bytes or more is marked.

A leader with very many different stretches is shared by strings that differ elsewhere (a common
phrase between unlike neighbours). Its stretches are cut into single strings, whose hashes are counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import Sieve, settle, text_or_empty

#: Bytes that must repeat, bytes of a leader.
WIDTH = 200
LEADER = 64
#: Bytes of a text that are hashed at a time, and of a shard.
PIECE = 1 << 18
SHARD = 1 << 19
#: Different stretches of one leader that are compared in one shard.
CROWD = 1000

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for every place of a piece."""
    inverse = pow(int(BASE), -1, 1 << 64)
    grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + 1, b, np.uint64)]))
    with np.errstate(over="ignore"):
        return grow(BASE), grow(np.uint64(inverse))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def leader_hashes(data: np.ndarray, k: int = LEADER) -> np.ndarray:
    """A hash of the k bytes from each place of at most a piece on."""
    if not _POWERS:
        _POWERS.append(_powers())
    up, down = _POWERS[0]
    n = len(data) - k + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        h = (sums[k:] - sums[:-k]) * down[:n]
        h ^= h >> np.uint64(31)
        h *= MIX
        h ^= h >> np.uint64(29)
    return h


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the first of equal ones."""
    n = len(h)
    place_bits = np.uint64(21)
    key = (h >> place_bits << place_bits) | np.arange(n, dtype=np.uint64)
    least, done = key, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return (least & np.uint64((1 << 21) - 1)).astype(np.int64)


def stretches(texts: list[bytes], width: int = WIDTH, k: int = LEADER):
    """(number of the text, start, end, leader hash) arrays: each string of ``width`` bytes lies in exactly one stretch.

    Short texts are hashed together, long ones a piece at a time.
    """
    out = [[np.zeros(0, np.int64)] * 4]

    def add(numbers: np.ndarray, starts: np.ndarray, offsets: np.ndarray, whole: np.ndarray):
        """Texts in a row: their numbers, where each starts, and what to add to places in each."""
        if len(whole) < width:
            return
        leader = window_least(hashes := leader_hashes(whole, k), width - k + 1)
        text = np.searchsorted(starts, np.arange(len(leader)), side="right") - 1
        at = np.flatnonzero(np.arange(len(leader)) + width <= np.append(starts[1:], len(whole))[text])
        if not len(at):
            return
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(leader[at]) != 0)])
        first, last = at[new], at[np.concatenate([new[1:], [True]])]
        of = text[first]
        out.append([numbers[of], first - starts[of] + offsets[of], last + width - starts[of] + offsets[of], hashes[leader[first]].view(np.int64)])

    held: list[int] = []

    def flush():
        if held:
            sizes = np.array([len(texts[i]) for i in held])
            add(np.array(held), np.cumsum(sizes) - sizes, np.zeros(len(held), np.int64), np.frombuffer(b"".join([texts[i] for i in held]), np.uint8))
            held.clear()

    n_held, step = 0, PIECE - width
    for i, t in enumerate(texts):
        if len(t) < width:
            continue
        if n_held + len(t) > PIECE:
            flush()
            n_held = 0
        if len(t) <= PIECE:
            held.append(i)
            n_held += len(t)
            continue
        whole = np.frombuffer(t, np.uint8)
        for at in range(0, len(t) - width + 1, step):
            add(np.array([i]), np.zeros(1, np.int64), np.array([at]), whole[at : at + step + width - 1])
    flush()
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def halves(text: bytes) -> tuple[int, int]:
    """128 bits of a text's hash as two longs."""
    h = xxhash.xxh3_128_intdigest(text)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted order of the suffixes of texts in a row, each closed by a mark of its own.

    ``data`` holds the letters from 1 on and a 0 at every place of ``ends``; marks are in order of their places.
    Suffixes are told apart by the first letters that fit 63 bits, and then by twice as many each turn;
    only suffixes that are still equal to others are sorted again.
    """
    n = len(data)
    letter, place = data.astype(np.int64), np.arange(n)
    # Letters after a mark belong to another text and must not be compared.
    left = ends[np.searchsorted(ends, place)] - place
    used = np.flatnonzero(np.bincount(letter, minlength=1))
    code = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.int64)
    code[used] = np.arange(1, len(used) + 1)
    letter = code[letter]
    key, size = np.zeros(n, np.int64), 63 // int(len(used) + 1).bit_length()
    for i in range(size):
        key = key << (63 // size) | np.where(left > i, letter[np.minimum(place + i, n - 1)], 0)
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[order] = start
    # Suffixes that ended within the compared letters are equal up to their marks, which are in order of place.
    group = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]]))
    while len(group):
        rows = order[group]
        head = rank[rows]
        # What follows the compared letters: its rank, or for a suffix that ended its place before all of them.
        follow = np.where(left[rows] >= size, rank[np.minimum(rows + size, n - 1)], rows - n)
        again = np.argsort(head * (2 * n) + follow + n)
        rows, head, follow = rows[again], head[again], follow[again]
        order[group] = rows
        differs = np.concatenate([[True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])])
        begin = np.maximum.accumulate(np.where(differs, group, 0))
        rank[rows] = begin
        alone = differs & np.concatenate([differs[1:], [True]])
        group = group[~alone]
        size *= 2
    return order


class RunIndex:
    """A run-length Burrows-Wheeler transform of texts, with the matches at both ends of every run."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        ends = self.starts + sizes
        self.n = int(ends[-1]) + 1 if len(texts) else 0
        data = np.zeros(self.n, np.int16)
        letters = np.ones(self.n, bool)
        letters[ends] = False
        data[letters] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
        self.data, self.ends = data, ends
        order = suffix_array(data, ends)
        before = data[order - 1].astype(np.int32)  # the letter before the first one is the last mark
        marks = before == 0
        before[marks] = -1 - np.arange(marks.sum(), dtype=np.int32)  # no two marks are equal
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        tail = np.concatenate([head[1:], [self.n]]) - 1
        self.letters, self.lengths = before[head], tail - head + 1  # the runs
        self.sampled = [self._sample(order, head[head > 0], -1), self._sample(order, tail[tail < self.n - 1], 1)]

    def _sample(self, order: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, length): how far the suffixes at run ends and their neighbours in sorted order agree, one letter before included.

        The letters before differ there, so the sample is where the walk through the text starts anew.
        """
        a, b = order[rows], order[rows + step]
        return a, self._agree(a, b)

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of letters that the suffixes from a and b share before the first mark."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        size = 64
        reach = np.arange(size)
        while len(live):
            x = np.minimum(a[live, None] + out[live, None] + reach, self.n - 1)
            y = np.minimum(b[live, None] + out[live, None] + reach, self.n - 1)
            same = (self.data[x] == self.data[y]) & (self.data[x] > 0)
            more = np.where(same.all(axis=1), size, np.argmin(same, axis=1))
            out[live] += more
            live = live[more == size]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest match of what starts there with what starts at any other place.

        Streamed from the samples: a match ends where the sample's match ended until the next sample.
        """
        best = np.zeros(self.n, np.int64)
        for place, length in self.sampled:
            end = np.zeros(self.n, np.int64)
            end[place] = place + length
            last = np.zeros(self.n, np.int64)
            last[place] = place
            # The latest sample at or before each place rules; each text's start is a sample (its mark differs).
            last = np.maximum.accumulate(last)
            best = np.maximum(best, end[last] - np.arange(self.n))
        return np.maximum(best, 0)

    def marked(self, width: int) -> list[tuple[int, int, int]]:
        """(number of the text, start, end) of the stretches covered by matches of ``width`` letters or more."""
        long = self.matching_statistics() >= width
        if not long.any():
            return []
        first = np.flatnonzero(long & ~np.concatenate([[False], long[:-1]]))
        last = np.flatnonzero(long & ~np.concatenate([long[1:], [False]]))
        text = np.searchsorted(self.starts, first, side="right") - 1
        at = self.starts[text]
        return list(zip(text.tolist(), (first - at).tolist(), (last + width - at).tolist(), strict=True))


def _same_text(a: str, b: str) -> str:
    return f"{a}.doc_id <=> {b}.doc_id AND {a}.text_key = {b}.text_key"


def _places(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, start, size, leader, hash of every stretch of doc_id, text_key, text."""
    names = ["doc_id", "text_key", "start", "size", "leader", "hash"]

    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b.column(2).to_pylist()]
            for lot in range(0, len(texts), 2000):
                some = [memoryview(t) for t in texts[lot : lot + 2000]]
                text, start, end, leader = stretches(some)
                found = [xxhash.xxh3_64_intdigest(some[i][x:y]) for i, x, y in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)]
                rows = pa.array(text + lot)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(start), pa.array((end - start).astype(np.int32)),
                     pa.array(leader), pa.array(np.array(found, np.uint64).view(np.int64))], names)

    return rows.mapInArrow(run, "doc_id long, text_key long, start long, size int, leader long, hash long")


def _texts_of(rows: DataFrame, wanted: DataFrame, cut, schema: str) -> DataFrame:
    """``cut`` (bytes of a stretch, leader, hash -> rows) applied to the wanted places, each in the text that holds it."""
    per_text = settle(wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size", "leader", "hash")).alias("at")))
    texts = rows.where(Sieve(per_text, "text_key").lets_through("text_key"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            for text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                out = [x for p in at for x in cut(data[p["start"] : p["start"] + p["size"]], p["leader"], p["hash"])]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "text" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

    return texts.alias("x").join(per_text.alias("y"), F.expr(_same_text("x", "y"))).select("x.text", "y.at").mapInArrow(run, schema)


def _in_shards(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """leader, hash, start, end: what the run indexes of the shards mark."""
    total = wanted.agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, -(-total // SHARD))

    def run(t):
        keys = list(zip(t["leader"].to_pylist(), t["hash"].to_pylist(), strict=True))
        texts = dict(zip(keys, t["text"].to_pylist(), strict=True))  # repeated rows gave a stretch several times
        keys = sorted(texts)
        found = RunIndex([texts[k] for k in keys]).marked(width)
        cols = [[keys[i][0] for i, _, _ in found], [keys[i][1] for i, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["leader", "hash", "start", "end"], cols, strict=True)})

    texts = _texts_of(rows, wanted, lambda data, leader, h: [(leader, h, data)], "leader long, hash long, text binary")
    shard = F.pmod(F.xxhash64("leader", F.lit(5)), F.lit(n_shards))
    return texts.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "leader long, hash long, start long, end long")


def _by_strings(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """leader, hash, start, end of each string in crowded stretches that occurs twice, by 128 bits of hash."""

    def strings(data: bytes, leader: int, h: int):
        view = memoryview(data)
        return [(leader, h, i, *halves(view[i : i + width])) for i in range(len(data) - width + 1)]

    each = _texts_of(rows, wanted, strings, "leader long, hash long, start long, h1 long, h2 long").distinct()
    each = settle(each)
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return each.join(twice, ["h1", "h2"], "left_semi").select("leader", "hash", "start", (F.col("start") + width).alias("end"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, spans (array of start, end in bytes): what is covered by strings of ``width`` bytes that start twice or more.

    One row for each different id and text with any span; spans may overlap. text_key is ``xxhash64`` of the text.
    """
    if width != WIDTH:
        raise ValueError(f"stretches are cut for strings of {WIDTH} bytes")
    rows = _keyed(docs, id_col, text_col)
    places = settle(_places(rows))
    leaders = places.groupBy("leader").agg(F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    leaders = settle(leaders.where("n > 1").select("leader", (F.col("lo") != F.col("hi")).alias("mixed")))
    met = settle(places.where(Sieve(leaders, "leader").lets_through("leader")).join(leaders, "leader"))
    place = F.struct("doc_id", "text_key", "start", "size")
    distinct = settle(met.groupBy("leader", "hash", "mixed").agg(F.count("*").alias("n"), F.min(place).alias("p")))
    whole = distinct.where("n > 1").select("leader", "hash", F.lit(0).cast("long").alias("start"), F.col("p.size").cast("long").alias("end"))
    mixed = distinct.where("mixed")
    sizes = mixed.groupBy("leader").agg(F.count("*").alias("d"))
    mixed = settle(mixed.join(sizes, "leader").select("leader", "hash", "p.*", "d"))
    marks = whole.union(_in_shards(rows, mixed.where(F.col("d") <= crowd), width))
    marks = marks.union(_by_strings(rows, mixed.where(F.col("d") > crowd), width))
    marks = settle(marks.groupBy("leader", "hash").agg(F.collect_list(F.struct("start", "end")).alias("marks")))
    found = met.join(marks, ["leader", "hash"]).select("doc_id", "text_key", "start", F.explode("marks").alias("m"))
    span = F.struct((F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"))
    return found.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("spans"))


def kept_mask(n: int, spans: list) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [s["start"] for s in spans], 1)
    np.add.at(change, [s["end"] for s in spans], -1)
    return np.cumsum(change[:-1]) == 0


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte of a text (UTF-8) covered by a string of 200 bytes that also starts anywhere else, in the
    same text or in another row. Null texts count as empty, shorter texts keep all. Repeated rows are
    copies of one another: both lose what they share. Ids may be null or repeat. Empty tables give none; other columns are ignored.
    """
    rows = _keyed(docs, id_col, text_col)
    spans = settle(repeated_spans(docs, id_col, text_col))
    hit = Sieve(spans, "text_key").lets_through("text_key")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches:
            out = []
            for i, text, at in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                data = text.encode()
                kept = kept_mask(len(data), at or [])
                gone = ~kept
                n_spans = int(gone[:1].sum() + (gone[1:] & kept[:-1]).sum())
                out.append((i, len(data), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(data, np.uint8)[kept].tobytes()).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    zero = F.lit(0).cast("long")
    clean = rows.where(~hit).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    joined = rows.where(hit).alias("x").join(spans.alias("y"), F.expr(_same_text("x", "y")), "left").select("x.doc_id", "x.text", "y.spans")
    return clean.union(joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the texts without repeated bytes; characters that lost a byte go whole."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, at):
            if text is None or at is None or not len(at):
                return text
            data = np.frombuffer(text.encode(), np.uint8)
            return data[kept_mask(len(data), at)].tobytes().decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    spans = repeated_spans(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    mine = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("__key"))
    joined = docs.join(spans, mine, "left")
    return joined.select(*[cut(F.col(c), F.col("__spans")).alias(c) if c == text_col else docs[c] for c in docs.columns])
