"""Line dedup by pairwise alignment.

Lines that several documents share bring documents together. A line's hash covers the lines
after it too, as far as it takes to reach the least size of a block, so it is rare unless a whole
passage is common. Every document is aligned with the first document that holds such a hash. That
serves hashes in any number of documents, since the first holder keeps its copy: a document
gets at most one partner per line, and a passage that a third of all documents hold gives
that many pairs, not their square. A pair is aligned by patience diff: lines that occur once in
both are anchors, the longest common order of the anchors is kept, and matches grow from the
anchors over equal neighbours. Aligned blocks with enough words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import settle, text_key, text_or_empty

#: Least words of an aligned block for its deletion.
LEAST_WORDS = 20


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of lines that occur once in both, in their longest common order."""
    in_a, in_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if in_b[x] == 1}
    both = [(i, place[x]) for i, x in enumerate(a) if in_a[x] == 1 and x in place]
    tails: list[int] = []
    top: list[int] = []
    back = [-1] * len(both)
    for k, (_, j) in enumerate(both):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            top.append(k)
        else:
            tails[at], top[at] = j, k
        back[k] = top[at - 1] if at else -1
    out, k = [], top[-1] if top else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences of lines, rising in both.

    Between anchors the sequences are aligned in turn, from both ends inwards and then by the
    anchors that the shorter stretch has of its own.
    """
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        found = anchors(a[a0:a1], b[b0:b1])
        if not found:
            continue
        at_a, at_b = a0, b0
        for i, j in found:
            out.append((a0 + i, b0 + j))
            todo.append((at_a, a0 + i, at_b, b0 + j))
            at_a, at_b = a0 + i + 1, b0 + j + 1
        todo.append((at_a, a1, at_b, b1))
    return sorted(out)


def aligned_blocks(a: list[int], b: list[int], words: list[int], least_words: int = LEAST_WORDS) -> list[int]:
    """Places in ``a`` (the later document) of the aligned blocks with at least so many words."""
    out, block, size, last = [], [], 0, None
    for i, j in patience(a, b):
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if size >= least_words:
                out += block
            block, size = [], 0
        block.append(i)
        size += words[i]
        last = (i, j)
    return out + block if size >= least_words else out


def left_spans(a: list[int], b: list[int], words: list[int], aligned: list[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """The stretches of ``a`` in which lines that ``b`` holds aren't in an aligned block.

    Each goes on over its neighbours until these have ``least_words`` words: as far as
    the shortest stretch that covers one of its lines can reach.
    """
    gone, there, out = set(aligned), set(b), []
    i = 0
    while i < len(a):
        if i in gone or a[i] not in there:
            i += 1
            continue
        start = end = i
        while end < len(a) and end not in gone and a[end] in there:
            end += 1
        i = end
        size = 0
        while start and size < least_words and a[start - 1] in there:
            start -= 1
            size += words[start]
        size = 0
        while end < len(a) and size < least_words and a[end] in there:
            size += words[end]
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], least_words: int = LEAST_WORDS) -> list[int]:
    """Places in ``a`` (the later document) of all stretches with at least so many words that ``b`` holds too.

    The aligned blocks go. Only in what they leave are repeated or reordered stretches looked for, anywhere in ``b``.
    """
    out = aligned_blocks(a, b, words, least_words)
    spans = left_spans(a, b, words, out, least_words)
    return sorted({*out, *held_stretches(a, b, words, least_words, spans)}) if spans else out


def automaton(b: list[int | None]) -> tuple[list[dict], list[int], list[int]]:
    """Suffix automaton of ``b``: of each state the next states, the suffix link, and the longest length."""
    following, link, longest, last = [{}], [-1], [0], 0
    for x in b:
        new = len(following)
        following.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and x not in following[at]:
            following[at][x] = new
            at = link[at]
        if at >= 0:
            to = following[at][x]
            if longest[to] != longest[at] + 1:
                copy = len(following)
                following.append(dict(following[to]))
                link.append(link[to])
                longest.append(longest[at] + 1)
                while at >= 0 and following[at].get(x) == to:
                    following[at][x] = copy
                    at = link[at]
                link[to] = copy
                to = copy
            link[new] = to
        last = new
    return following, link, longest


def held_stretches(
    a: list[int], b: list[int], words: list[int], least_words: int = LEAST_WORDS, spans: list[tuple[int, int]] | None = None
) -> list[int]:
    """Places in ``a`` of all stretches with at least so many words that occur anywhere in ``b``.

    Stretches lie inside one of ``spans`` (start, end), in order, or anywhere if none are given. For each end
    the longest such stretch is known from the automaton, in steps linear in both.
    """
    spans = [(0, len(a))] if spans is None else spans
    in_a, parts = {x for start, end in spans for x in a[start:end]}, []
    for x in b:
        if x in in_a:
            parts.append(x)
        elif parts and parts[-1] is not None:
            parts.append(None)  # lines that aren't in ``a`` part what is
    following, link, longest = automaton(parts)
    before = [0, *accumulate(words)]
    starts = [len(a)] * len(a)
    for first, end in spans:
        state, n = 0, 0
        for i in range(first, end):
            while state and a[i] not in following[state]:
                state = link[state]
                n = longest[state]
            if a[i] in following[state]:
                state, n = following[state][a[i]], n + 1
            if before[i + 1] - before[i + 1 - n] >= least_words:
                starts[i] = i + 1 - n
    out, start = [], len(a)
    for i in range(len(a) - 1, -1, -1):
        start = min(start, starts[i])
        if start <= i:
            out.append(i)
        else:
            start = len(a)
    return out[::-1]


def line_hashes(text: str, least_words: int = LEAST_WORDS) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of the lines with words: place, hash, number of words, and the hashes of runs of lines.

    White space around a line doesn't count. A run starts at each line and ends where it has
    ``least_words`` words; the last lines may start none.
    """
    places, hashes, words = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        body = line.strip()
        if body:
            places.append(i)
            hashes.append(xxhash.xxh64_intdigest(body) - (1 << 63))
            words.append(len(body.split()))
    return places, hashes, words, [run for _, _, run in line_runs(hashes, words, least_words)]


def line_runs(hashes: list[int], words: list[int], least_words: int = LEAST_WORDS):
    """(start, end, hash) of the run of lines that starts at each line."""
    end, held = 0, 0
    for start in range(len(hashes)):
        while end < len(hashes) and held < least_words:
            held += words[end]
            end += 1
        if held < least_words:
            break
        run = hashes[start] if end == start + 1 else xxhash.xxh64_intdigest(np.array(hashes[start:end], "<i8").tobytes()) - (1 << 63)
        yield start, end, run
        held -= words[start]


def left_of(places: list[int], h: list[int], w: list[int], gone: list[int]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Places, hashes and words of the lines that are left, and whether lines are gone between each and the last one."""
    out, gap, gone = ([], [], [], []), False, set(gone)
    for row in zip(places, h, w, strict=True):
        if row[0] in gone:
            gap = True
        else:
            for col, x in zip(out, (*row, gap), strict=True):
                col.append(x)
            gap = False
    return out


def closed_runs(h: list[int], w: list[int], gap: list[bool], least_words: int = LEAST_WORDS) -> list[int]:
    """The runs of what is left that go over a gap."""
    gaps = [0, *accumulate(gap)]
    return [run for start, end, run in line_runs(h, w, least_words) if gaps[end] > gaps[start + 1]]


def deletions(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, places): documents that lose lines, and which (from 0).

    Documents are told apart by (doc_id, key), the key being a hash of the text. Order is by doc_id,
    then key; null ids come last. Rows equal in both are one document and lose the same lines.
    """

    def read(batches):
        for b in batches:
            cols = list(zip(*(line_hashes(t, least_words) for t in b.column(2).to_pylist()), strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            lists = [pa.array(c, pa.list_(k)) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "key", "places", "h", "w", "runs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), text_or_empty(text_col).alias("text"))
    doc = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").alias("doc")
    seqs = rows.mapInArrow(read, "doc_id long, key long, places array<int>, h array<long>, w array<int>, runs array<long>")
    seqs = settle(seqs.where(F.size("runs") > 0).select(doc, "places", "h", "w", "runs"))
    held = seqs.select("doc", F.explode("runs").alias("run"))
    first = held.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("run", "first")
    pairs = settle(held.join(first, "run").where("first < doc").select("doc", "first").distinct())
    once = lambda docs: seqs.join(docs.distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    list_of = lambda kind: pa.list_(kind())

    def align(batches):
        for b in batches:
            out = []
            for doc, places, h, w, fh in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                gone = common_blocks(h, fh, w, least_words)
                if gone:
                    out.append((doc, [places[i] for i in gone]))
            cols = [pa.array([x[0] for x in out], b.schema.field(0).type), pa.array([x[1] for x in out], list_of(pa.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "places"])

    def aligned(pairs: DataFrame, later: DataFrame) -> DataFrame:
        earlier = once(pairs.select(F.col("first").alias("doc"))).select(F.col("doc").alias("first"), F.col("h").alias("fh"))
        both = pairs.join(later, "doc").join(earlier, "first")
        return both.select("doc", "places", "h", "w", "fh").mapInArrow(align, gone_type)

    def leave(batches):
        for b in batches:
            rows = [left_of(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            cols = [[x[k] for x in rows] for k in range(3)] + [[closed_runs(*x[1:], least_words) for x in rows]]
            kinds = (pa.int32, pa.int64, pa.int32, pa.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, list_of(k)) for c, k in zip(cols, kinds, strict=True))], ["doc", "places", "h", "w", "runs"])

    of = seqs.schema["doc"].dataType.simpleString()
    gone_type, left_type = f"doc {of}, places array<int>", f"doc {of}, places array<int>, h array<bigint>, w array<int>, runs array<bigint>"
    as_one = lambda gone: gone.groupBy("doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    gone = settle(as_one(aligned(pairs, once(pairs.select("doc")).select("doc", "places", "h", "w"))))
    changed = gone
    while True:
        # What is left of the documents that lost lines last; each turn deletes lines, so this ends.
        cut = once(changed.select("doc")).join(gone.withColumnRenamed("places", "gone"), "doc").select("doc", "places", "h", "w", "gone")
        left = cut.mapInArrow(leave, left_type)
        closed = settle(left.select("doc", F.explode("runs").alias("run")))
        first = held.join(closed.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.min("doc").alias("first"))
        pairs = settle(closed.join(first, "run").where("first < doc").select("doc", "first").distinct())
        if pairs.isEmpty():
            break
        later = left.join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", "places", "h", "w")
        changed = settle(as_one(aligned(pairs, later)))
        gone = settle(as_one(gone.union(changed)))
    return gone.select("doc.doc_id", "doc.key", "places")


def without_common_lines(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the aligned common lines deleted from the later documents.

    All columns are kept, also ones with clashing names; __places (null: nothing was deleted) is
    added. A null or empty text stays as it is; a document all of whose lines go has an empty
    text. Ids may be null or repeat (see ``deletions``); every row stays.
    """
    gone = deletions(docs, least_words, id_col, text_col).select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("places").alias("__places")
    )
    # The deletions grow with the documents: no broadcast, whatever a small table's size suggests.
    gone = gone.hint("merge")
    mine = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & text_key(text_col).eqNullSafe(F.col("__key"))
    lines = F.split(F.col(text_col), "\n", -1)
    # One flag per line, so that the lines are filtered in one pass.
    at = F.map_from_arrays("__places", F.array_repeat(F.lit(True), F.size("__places")))
    kept = F.array_join(F.filter(lines, lambda x, i: F.element_at(F.col("__at"), i).isNull()), "\n")
    joined = docs.join(gone, mine, "left").withColumn("__at", at)
    joined = joined.withColumn(text_col, F.when(F.col("__places").isNotNull(), kept).otherwise(F.col(text_col)))
    return joined.select(*docs.columns, "__places")


def line_report(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed (their places), kept_text."""
    lines = F.size(F.split(text_or_empty(text_col), "\n", -1))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("kept_text"), lines.alias("n_lines"))
    out = without_common_lines(whole, least_words, "doc_id", "kept_text")
    removed = F.coalesce(F.size(F.when(F.col("__places").isNotNull(), F.col("__places"))), F.lit(0))
    return out.select("doc_id", "n_lines", F.greatest(removed, F.lit(0)).alias("n_removed"), F.array_join("__places", ",").alias("removed"), "kept_text")
