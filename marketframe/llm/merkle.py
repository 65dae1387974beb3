"""Document fingerprints: Merkle trees over sections, paragraphs and their pieces.

A text is cut into pieces that together are the text: sentences, long ones into runs of words, and
single words near its start, so that short texts have several pieces too.
A paragraph is the pieces up to a line's end; a section is the paragraphs up to one whose hash
is divisible by 4, so an edit moves no border but its own. A node's hash is that of its
children's hashes, 128 bits each up to the root. Equal roots mean equal texts; where roots differ,
equal sections and paragraphs count whole and are skipped, and the leaves of the rest locate the
edit. A fingerprint holds the root's hash whole and the first digits of the other nodes'.

``neighbour_report`` sets each document beside the next one in descending order of ids. Sorting
the texts by ranges of ids puts neighbours side by side; each range also gets the first text
of the next range, so that ranges need nothing from each other.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import settle, text_key, text_or_empty

_SENTENCES = re.compile(r"[^\n.!?]*[.!?\n]+|[^\n.!?]+")
_WORDS = re.compile(r"(?:\S*\s+){1,6}|\S+|\s+")
_WORD = re.compile(r"\S*\s+|\S+")
#: Sentences of more characters are cut into runs of words; in a text's first characters into words.
LONG, HEAD = 40, 256
#: Hex digits of the root, of inner nodes, and of leaves in a fingerprint.
ROOT, NODE, LEAF = 32, 8, 6
#: Rows of a range, and most ranges.
RANGE_ROWS, MOST_RANGES = 512, 16384


def leaf_pieces(text: str) -> list[str]:
    """Consecutive pieces of a text; joined they are the text."""
    out, at = [], 0
    for s in _SENTENCES.findall(text):
        if at < HEAD:
            out += _WORD.findall(s)
            at += len(s)
        elif len(s) <= LONG:
            out.append(s)
        else:
            out += _WORDS.findall(s)
    return out


def tree(text: str) -> tuple[str, list]:
    """A text's root and its sections: (hash, number of leaves, paragraphs), a paragraph being (hash, leaves)."""
    digest = xxhash.xxh128_digest
    sections, section, paragraph = [], [], []

    def close_paragraph() -> bool:
        node = digest(b"".join(paragraph))
        section.append((node, [x.hex()[:LEAF] for x in paragraph]))
        paragraph.clear()
        return node[-1] % 4 == 0

    def close_section() -> None:
        node = digest(b"".join([n for n, _ in section]))
        sections.append((node, sum(len(x) for _, x in section), [(n.hex()[:NODE], x) for n, x in section]))
        section.clear()

    for piece in leaf_pieces(text):
        paragraph.append(digest(piece.encode()))
        if piece[-1] == "\n" and close_paragraph():
            close_section()
    if paragraph:
        close_paragraph()
    if section:
        close_section()
    root = digest(b"".join([n for n, _, _ in sections])).hex()
    return root, [(n.hex()[:NODE], size, parts) for n, size, parts in sections]


def spell(root: str, sections: list) -> str:
    """The fingerprint ``root;section:paragraph=leaves,...;section:...`` of a tree."""
    return ";".join([root, *[f"{node}:{','.join([f'{n}={"".join(x)}' for n, x in parts])}" for node, _, parts in sections]])


def fingerprint(text: str) -> str:
    return spell(*tree(text))


def parse(fp: str) -> tuple[str, list]:
    """The tree (see ``tree``) of a fingerprint."""
    root, *rest = fp.split(";")
    out = []
    for section in rest:
        node, _, paragraphs = section.partition(":")
        parts = [p.split("=") for p in paragraphs.split(",")]
        parts = [(h, [x[i : i + LEAF] for i in range(0, len(x), LEAF)]) for h, x in parts]
        out.append((node, sum(len(x) for _, x in parts), parts))
    return root, out


def leaves_of(fp: str) -> list[str]:
    return [leaf for _, _, parts in parse(fp)[1] for _, leaves in parts for leaf in leaves]


def unmatched(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The nodes of each side that the other doesn't have, as often as they are missing there."""
    in_a, in_b = Counter(x[0] for x in a), Counter(x[0] for x in b)

    def rest(nodes: list[tuple], more: Counter) -> list[tuple]:
        out = []
        for x in nodes:
            if more[x[0]] > 0:
                more[x[0]] -= 1
                out.append(x)
        return out

    return rest(a, in_a - in_b), rest(b, in_b - in_a)


def tree_likeness(a: tuple[str, list], b: tuple[str, list]) -> float:
    """How like two trees are, from 0 to 1: twice the leaves in common (as often as in both) by all leaves.

    Equal roots are 1, whatever is below. Equal sections count whole, then equal paragraphs of the
    other sections; only leaves of paragraphs that the other side doesn't have are looked at.
    """
    if a[0] == b[0]:
        return 1.0
    count = lambda sections: sum(size for _, size, _ in sections)
    every = count(a[1]) + count(b[1])
    x, y = unmatched(a[1], b[1])
    x, y = unmatched([p for _, _, parts in x for p in parts], [p for _, _, parts in y for p in parts])
    x, y = ([leaf for _, leaves in side for leaf in leaves] for side in (x, y))
    # What isn't looked at is in common: equally many leaves on both sides.
    return (every - len(x) - len(y) + 2 * (Counter(x) & Counter(y)).total()) / every


def likeness(a: str, b: str) -> float:
    """``tree_likeness`` of two fingerprints."""
    return 1.0 if a.split(";", 1)[0] == b.split(";", 1)[0] else tree_likeness(parse(a), parse(b))


def changed(a: str, b: str) -> list[int]:
    """Numbers of the leaves of ``a`` in paragraphs that ``b`` doesn't have and that ``b`` doesn't have as leaves either.

    Sections and paragraphs that are equal are skipped whole.
    """
    sections, paragraphs = Counter(), Counter()
    for node, _, parts in parse(b)[1]:
        sections[node] += 1
        paragraphs.update(h for h, _ in parts)
    other, at, out = Counter(leaves_of(b)), 0, []
    for node, _, parts in parse(a)[1]:
        same = sections[node] > 0
        sections[node] -= same
        for h, leaves in parts:
            kept = same or paragraphs[h] > 0
            paragraphs[h] -= kept
            for leaf in leaves:
                if not kept and other[leaf] <= 0:
                    out.append(at)
                other[leaf] -= 1
                at += 1
    return out


def add_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text (null: empty)."""

    @F.pandas_udf("string")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return docs.withColumn(name, fp(text_or_empty(text_col)))


def ranges(ids: DataFrame, n_rows: int) -> np.ndarray:
    """Cuts of the column ``d`` into ranges of about RANGE_ROWS rows; a value that repeats more is cut several times."""
    n = min(MOST_RANGES, -(-n_rows // RANGE_ROWS))
    if n < 2:
        return np.empty(0, np.int64)
    at = F.array(*[F.lit(k / n) for k in range(1, n)])
    return np.array(ids.agg(F.percentile_approx("d", at, F.lit(4 * n)).alias("c")).first()["c"], np.int64)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, tail, doc_id, text) such that within a part a document's next one follows it.

    The order is descending ids, null ids last, then a hash of the text. The parts' rows are in
    order if sorted by the hidden columns d, no_id and key. A row with tail 1 closes each part:
    it holds the first text of the next part, and of the first part in the last one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    last = F.lit((1 << 63) - 1)
    order = [F.coalesce(F.bitwise_not("doc_id"), last).alias("d"), F.col("doc_id").isNull().alias("no_id"), text_key().alias("key")]
    rows = rows.select("doc_id", "text", *order)
    ids = settle(rows.select("d", "no_id", "key"))
    cuts = ranges(ids, ids.count())

    @F.pandas_udf("long")
    def part_of(d: pd.Series, key: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cuts, d, "left"), np.searchsorted(cuts, d, "right")
        share = (key.to_numpy() >> 11) / float(1 << 53) + 0.5  # of a value that is cut several times, by its hash
        return pd.Series(low + np.floor(share * (high - low + 1)).astype(np.int64))

    part = part_of("d", "key").alias("part")
    # One row per part: at most MOST_RANGES.
    firsts = ids.select("*", part).groupBy("part").agg(F.min(F.struct("d", "no_id", "key")).alias("o"))
    by_part = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(F.lead("o").over(by_part), F.first("o").over(by_part)).alias("o"))
    following = F.broadcast(settle(following).select("part", "o.d", "o.no_id", "o.key"))
    tails = rows.join(following, ["d", "no_id", "key"]).dropDuplicates(["part"])
    rows = rows.select(part, F.lit(0).alias("tail"), "doc_id", "text", "d", "no_id", "key")
    tails = tails.select("part", F.lit(1).alias("tail"), "doc_id", "text", "d", "no_id", "key")
    return rows.union(tails).repartition("part").sortWithinPartitions("part", "tail", "d", "no_id", "key")


def neighbour_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, each beside an edit of it and beside the next document.

    The edited text's last third (rounded down, code points) is replaced by the first as many
    code points (or all) of the next document in descending doc_id, after the last one the
    first. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A null text is empty. Null ids come last; of equal ids the hash of the text
    decides. A single document is its own next one; an empty table gives none.
    """

    def run(batches):
        held = None
        for b in batches:
            out = []
            for tail, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                whole = tree(text)
                if held is not None:
                    h_id, h_text, h_tree = held
                    third = len(h_text) // 3
                    edited = h_text[: len(h_text) - third] + text[:third]
                    e_tree = tree(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((h_id, len(h_text), sha, spell(*h_tree), spell(*e_tree), tree_likeness(h_tree, e_tree), tree_likeness(h_tree, whole)))
                held = None if tail else (doc_id, text, whole)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id_col, text_col).select("tail", "doc_id", "text").mapInArrow(run, schema)
