"""Phrases that occur together more often than their parts, counted in burstable tries.

One pass over the texts counts the words, the next the pairs, then three and four words; a phrase is
counted only where both phrases of one word less may be frequent, which a table of bits of a fixed size tells.
A task keeps counts in a HAT-trie: a shallow trie over word numbers whose leaves are hash
containers of packed rests. A container that grows too large bursts into one container
per next word. When the trie is full, whole subtrees, the largest first, leave it as sorted runs, and
the runs of all tasks are merged per prefix partition.

Every part of a frequent phrase is frequent, so scores need only the frequent tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import Sieve, settle, slices, text_or_empty

LEAST = 30
WORDS = 4
CLOSED = (100, 80)
TOP = 2000
SCALE = 2_000_000
#: Bytes of text handled at a time, rests of a container before it bursts, rests that the tries of a task hold before subtrees are spilt.
LOT = 2 << 20
BURST = 4096
ROOM = 500_000
#: Different words that a task knows by number, of all languages, before it spills all it holds and forgets them.
KNOWN = 400_000
#: Words, of all languages, whose hashes a task remembers before it forgets them.
MEMO = 100_000
BITS = 21
SALTS = 16

_END = b"\xff"  # never part of UTF-8
_BYTES = bytearray(range(256))
for _c in range(65, 91):
    _BYTES[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _BYTES[_c] = 255
_BYTES[9] = 32
_BYTES = bytes(_BYTES)


class HatTrie:
    """Counts of rows of word numbers, all of one length."""

    def __init__(self, length: int, burst: int = BURST, room: int = ROOM):
        self.length, self.burst, self.room = length, burst, room
        self.top: dict[int, dict] = Counter() if length == 1 else {}  # first word -> container, or node after a burst; its count where phrases have one word
        self.size: dict[int, int] = {}  # first word -> rests below
        self.total = 0

    def add(self, first: np.ndarray, rest: np.ndarray, times: np.ndarray) -> None:
        """Different rows in order: the first word, the other words packed by ``BITS``, how often."""
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist() if len(first) else []
        if self.length == 1:  # a word ends at the root, so its count stands there
            top, get = self.top, self.top.get
            for w, k in zip(first.tolist(), times.tolist(), strict=True):
                top[w] = get(w, 0) + k
            self.total = len(top)
            return
        rests, n, words = rest.tolist(), times.tolist(), first[cuts].tolist()
        for w, a, b in zip(words, cuts, [*cuts[1:], len(rests)], strict=True):
            tree = self.top.get(w)
            if tree is None:
                tree = self.top[w] = {"burst": 0}
                self.size[w] = 0
            grown = self._put(tree, rests[a:b], n[a:b], self.length - 1)
            self.size[w] += grown
            self.total += grown

    def _put(self, tree: dict, rests: list[int], n: list[int], words: int) -> int:
        """Add rests of so many words to a container or node; returns how many are new."""
        if tree["burst"]:
            shift = BITS * (words - 1)
            grown, a = 0, 0
            while a < len(rests):
                w, b = rests[a] >> shift, a
                while b < len(rests) and rests[b] >> shift == w:
                    b += 1
                child = tree.setdefault(w, {"burst": 0})
                low = (1 << shift) - 1
                grown += self._put(child, [r & low for r in rests[a:b]], n[a:b], words - 1)
                a = b
            return grown
        before = len(tree)
        get = tree.get
        for r, k in zip(rests, n, strict=True):
            tree[r] = get(r, 0) + k
        grown = len(tree) - before
        if len(tree) > self.burst and words > 1:
            self._burst(tree, words)
        return grown

    def _burst(self, tree: dict, words: int) -> None:
        """Replace a container by a node with a container for each next word."""
        shift = BITS * (words - 1)
        low = (1 << shift) - 1
        del tree["burst"]
        held = list(tree.items())
        tree.clear()
        tree["burst"] = 1
        for r, k in held:
            tree.setdefault(r >> shift, {"burst": 0})[r & low] = k

    def _rows(self, tree: dict, words: int, above: int = 0) -> tuple[list[int], list[int]]:
        """The rests below in order, and their counts. The tree is used up."""
        if not tree.pop("burst"):
            rests = sorted(tree)
            times = list(map(tree.__getitem__, rests))
            high = above << BITS * words
            return ([high | r for r in rests] if above else rests), times
        rests, times = [], []
        for w in sorted(tree):
            r, t = self._rows(tree[w], words - 1, above << BITS | w)
            rests += r
            times += t
        return rests, times

    def full(self) -> bool:
        return self.total > self.room

    def spill(self, keep: int = 0):
        """(first word, rests, counts) of whole subtrees, the largest first, until at most ``keep`` rests stay."""
        if self.length == 1:
            for w in sorted(self.top):
                if self.total <= keep and keep:
                    break
                self.total -= 1
                yield w, [0], [self.top.pop(w)]
            return
        for w in sorted(self.size, key=lambda w: (-self.size[w], w)):
            if self.total <= keep and keep:
                break
            rests, times = self._rows(self.top.pop(w), self.length - 1)
            self.total -= self.size.pop(w)
            yield w, rests, times


class Hashes(dict):
    """word -> its hash, worked out once per word; 0 is what stands between pieces, and no word's."""

    def __init__(self, lang: str):
        super().__init__({_END: 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed) or 1
        return h


class Numbers(dict):
    """word -> its number, counted from 0 in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_hashes(lang: str, words: Collection[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in words), np.uint64, len(words))


def phrase_hashes(hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their first, second, ... words."""
    out = np.zeros_like(hashes[0])
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def lots(langs: list[str], texts: list[bytes], size: int):
    """(lang, bytes of its texts joined) in lots of about ``size`` bytes; a longer text is a lot of its own."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for lang, data in zip(langs, texts, strict=True):
        parts, n = held.get(lang, ([], 0))
        if parts and n + len(data) > size:
            yield lang, _END.join(parts)
            parts, n = [], 0
        parts.append(data)
        held[lang] = parts, n + len(data)
    for lang, (parts, _) in held.items():
        yield lang, _END.join(parts)


def counted(rows: DataFrame, length: int, sieve: Sieve | None, burst: int = BURST, room: int = ROOM, lot: int = LOT) -> DataFrame:
    """lang, phrase, f of all phrases of so many words whose shorter ones pass the sieve, in rows lang, text."""
    names = ["lang", "phrase", "f"] if length == 1 else ["lang", "first", "salt", "rests", "times"]
    salts = SALTS * 4 ** max(0, length - 2)

    def words_of(batches):
        """Words end at the root, so they are counted as they are, by their bytes."""
        tries: dict[str, HatTrie] = {}

        def runs():
            for lang, trie in tries.items():
                words, times = pa.array(list(trie.top), pa.binary()).cast(pa.string()), pa.array(trie.top.values(), pa.int64())
                trie.top.clear()
                for at in range(0, len(words), 50_000):
                    some = words.slice(at, 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, times.slice(at, 50_000)], names)

        for b in (part for whole in batches for part in slices(whole, lot)):
            for lang, data in lots(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), lot):
                tries.setdefault(lang, HatTrie(1, burst, room)).top.update(data.translate(_BYTES).replace(_END, b" ").split())
                if sum(len(t.top) for t in tries.values()) >= min(room, KNOWN):
                    yield from runs()
        yield from runs()

    def run(batches):
        tries: dict[str, HatTrie] = {}
        numbers: dict[str, Numbers] = {}
        hashes: dict[str, Hashes] = {}

        def runs(lang: str, keep: int):
            words, mask = pa.array(list(numbers[lang]), pa.binary()).cast(pa.string()), (1 << BITS) - 1
            heads, sizes, rests, times = [], [], [], []

            marks = word_hashes("", numbers[lang])

            def batch():
                rest, tree = np.array(rests, np.int64), np.repeat(np.arange(len(heads)), sizes)
                after = [rest >> k & mask for k in range(BITS * (length - 2), -1, -BITS)]
                group = tree * salts + (phrase_hashes([marks[x] for x in after]) % np.uint64(salts)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                group = group[order]
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                parts = [words.take(pa.array(x[order])) for x in after]
                ends = pa.array(np.append(starts, len(group)), pa.int32())
                group = group[starts]
                cols = [
                    pa.array([lang] * len(group), pa.string()),
                    words.take(pa.array(np.array(heads, np.int64)[group // salts])),
                    pa.array(group % salts, pa.int32()),
                    pc.binary_join(pa.ListArray.from_arrays(ends, pc.binary_join_element_wise(*parts, " ") if length > 2 else parts[0]), "\n"),
                    pa.ListArray.from_arrays(ends, pa.array(np.array(times, np.int64)[order])),
                ]
                return pa.RecordBatch.from_arrays(cols, names)

            for first, some, n in tries[lang].spill(keep):
                heads.append(first)
                sizes.append(len(some))
                rests += some
                times += n
                if len(rests) > 50_000:
                    yield batch()
                    heads, sizes, rests, times = [], [], [], []
            if rests:
                yield batch()

        for b in (part for whole in batches for part in slices(whole, lot)):
            for lang, data in lots(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), lot):
                words = data.translate(_BYTES).replace(_END, b" \xff ").split()
                if not words:
                    continue
                h = np.fromiter(map(hashes.setdefault(lang, Hashes(lang)).__getitem__, words), np.uint64, len(words))
                if sum(map(len, hashes.values())) > MEMO:
                    hashes.clear()
                at, wanted = np.arange(len(h) - length + 1), h != 0
                ok = np.ones(len(at), bool)
                for k in range(length):
                    ok &= wanted[k : k + len(at)]
                if len(at):
                    short = sieve.look(phrase_hashes([h[k : len(h) - length + 2 + k] for k in range(length - 1)]))
                    ok &= short[:-1] & short[1:]
                at = at[ok]
                if not len(at):
                    continue
                known = numbers.setdefault(lang, Numbers())
                trie = tries.setdefault(lang, HatTrie(length, burst, room))
                used = np.zeros(len(words), bool)
                for k in range(length):
                    used[at + k] = True
                n_used = int(used.sum())
                if sum(map(len, numbers.values())) >= min(room, KNOWN) or len(known) + n_used >= 1 << BITS:
                    for other in tries:
                        yield from runs(other, 0)
                        numbers[other].clear()
                number = np.fromiter(map(known.__getitem__, compress(words, used.tolist())), np.int64, n_used)
                del words
                at = (np.cumsum(used) - 1)[at]  # what isn't used is left out; a phrase's words stay neighbours
                first, rest = number[at], np.zeros(len(at), np.int64)
                for k in range(1, length):
                    rest = rest << BITS | number[at + k]
                order = np.lexsort((rest, first)) if length == WORDS else np.argsort(first << BITS * (length - 1) | rest)
                first, rest = first[order], rest[order]
                head = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
                trie.add(first[head], rest[head], np.diff(np.append(head, len(first))))
                # The tries of all languages share the room; the largest gives way.
                if sum(t.total for t in tries.values()) > room:
                    largest = max(tries, key=lambda x: tries[x].total)
                    yield from runs(largest, max(1, tries[largest].total - room // 2))
        for lang in tries:
            yield from runs(lang, 0)

    if length == 1:
        found = rows.mapInArrow(words_of, "lang string, phrase string, f long").repartition("lang", "phrase")
        return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    # A subtree's rests travel as one text (no word has a line end) without their prefix, the first word. A hot prefix is split by a hash of the rest; a phrase stays in one partition.
    found = rows.mapInArrow(run, "lang string, first string, salt int, rests string, times array<long>")
    dealt = found.repartition("lang", "first", "salt").select("lang", "first", "salt", "times", F.posexplode(F.split("rests", "\n")).alias("at", "rest"))
    dealt = dealt.select("lang", "first", "salt", "rest", F.col("times")[F.col("at")].alias("f"))
    merged = dealt.groupBy("lang", "first", "salt", "rest").agg(F.sum("f").alias("f"))
    return merged.select("lang", F.concat_ws(" ", "first", "rest").alias("phrase"), "f")


def sieve_of(phrases: DataFrame) -> Sieve:
    """The sieve of rows lang, phrase."""

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                out[i] = phrase_hashes([word_hashes(lang, [w]) for w in phrase.encode().split(b" ")])[0]
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["key"])

    return Sieve(phrases.select("lang", "phrase").mapInArrow(run, "key long"), "key")


def _part(at, n):
    return F.array_join(F.slice("words", at, n), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
                 burst: int = BURST, room: int = ROOM, lot: int = LOT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two to four words.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, those at spaces and tabs into words; a phrase lies
    within a piece. a counts a phrase, at least ``least``; l and r its parts at the cut of the lowest
    score floor(2,000,000 a / (l + r)), the earlier of equal ones; n all words of the language. Phrases inside a longer
    one with at least 80 % of their count are dropped. Order: score, then a, both descending, then
    the phrase by its bytes. Null texts are empty, a null language is ``und``; repeated rows count as
    often. A language without words has no rows, nor has an empty table; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    words = settle(counted(rows, 1, None, burst, room, lot))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    tables = [words.where(F.col("f") >= least)]
    for length in range(2, WORDS + 1):
        level = counted(rows, length, sieve_of(tables[-1]), burst, room, lot)
        tables.append(settle(level.where(F.col("f") >= least)))
    frequent = tables[0]
    for t in tables[1:]:
        frequent = frequent.union(t)
    wide = "decimal(38,0)"
    candidates = tables[1]
    for t in tables[2:]:
        candidates = candidates.union(t)
    candidates = candidates.withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    size = F.size("words")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, size - F.col("k")).alias("tail"))
    of = lambda part, f: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    score = F.expr(f"cast(({SCALE} * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide})) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = candidates.where(size > 2)
    inner = F.explode(F.transform(
        F.filter(
            F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda at: F.transform(F.sequence(F.lit(2), size), lambda n: F.struct(at.alias("at"), n.alias("n"))))),
            lambda x: (x.n < F.size("words")) & (x.at + x.n <= F.size("words") + 1),
        ),
        lambda x: F.array_join(F.slice(F.col("words"), x.at, x.n), " "),
    )).alias("phrase")
    around = longer.select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    closed = F.lit(CLOSED[0]).cast(wide) * F.coalesce("around", F.lit(0)).cast(wide) >= F.lit(CLOSED[1]).cast(wide) * F.col("a").cast(wide)
    kept = best.join(around, ["lang", "phrase"], "left").where(~closed).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
