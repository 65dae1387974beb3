"""Token counts without token ids.

Text is cut into pre-tokens, over whose borders no merge goes. Each block of documents gives
one row per distinct pre-token: its text and the block's documents that hold it, with
frequencies. These rows meet by pre-token, where its pieces are counted once and joined to all
its frequencies; the products are summed by block and then by document. A pre-token that
every document holds is one row per block of documents, so no key is hot.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import text_or_empty
from marketframe.llm.tokens import counts, load, tokenizer_path

LIMIT = 2048
#: Bytes of text and number of documents in a block, and sums held by a task before it sends them.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 1 << 16
HELD = 1 << 21
#: In place of a pre-token in the row that lists a block's documents: (id, id is null, bytes) of each.
DOCS = "\ndocs"

#: The pre-tokens of the word BPE (fixed pattern), for text that its normalizer only lower-cases.
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The pre-tokens of byte-level BPE, which include white space.
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def drops_space(path: str) -> bool:
    """True if the tokenizer of a file gives white space no piece, so that each word stands alone."""
    tokenizer = load(path)
    if path.endswith(".model") or tokenizer.pre_tokenizer is None:
        raise ValueError(f"{path}: merges may go over any border, there are no pre-tokens")
    return all(not piece.startswith(("Ġ", " ")) for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str("a b"))


def of_word(word: bytes) -> list[str]:
    """The pre-tokens of a run without ASCII white space.

    Finer ones than the run itself only where that is safe: normalized text below U+0250 whose
    lower case goes letter by letter, without a special token's opening mark. Otherwise the run.
    """
    text = word.decode()
    if "<|" in text or (not text.isascii() and (max(text) >= "ɐ" or "İ" in text or not unicodedata.is_normalized("NFC", text))):
        return [text]
    return WORD_PIECES.findall(text.lower())


def block_rows(texts: list[str], words_only: bool, special: list[str]) -> tuple[list[str], list[bytes]]:
    """The distinct pre-tokens of a block, and for each its (document, frequency) as int32 pairs."""
    border = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else regex.compile("(?!)()")
    of = defaultdict(count().__next__)
    parts, n = [], []
    for t in texts:
        if words_only:
            found = t.encode().split()
        else:
            found = [x for i, s in enumerate(border.split(t)) for x in ([s] if i % 2 else BYTE_PIECES.findall(s))]
        n.append(len(found))
        parts.append(np.fromiter(map(of.__getitem__, found), np.int64, len(found)))
    word, doc = np.concatenate(parts), np.repeat(np.arange(len(texts)), n)
    key, times = np.unique(word * len(texts) + doc, return_counts=True)
    word, doc = np.divmod(key, len(texts))
    if words_only:
        piece_no = defaultdict(count().__next__)
        split = [[piece_no[p] for p in of_word(w)] for w in of]
        size = np.array([len(x) for x in split], np.int64)
        flat, first = np.array([p for x in split for p in x], np.int64), np.cumsum(size) - size
        each = size[word]
        at = np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        key, back = np.unique(flat[at] * len(texts) + np.repeat(doc, each), return_inverse=True)
        times = np.bincount(back, weights=np.repeat(times, each), minlength=len(key)).astype(np.int64)
        word, doc = np.divmod(key, len(texts))
        of = piece_no
    pairs = np.stack([doc, times], axis=1).astype("<i4")
    ends = np.searchsorted(word, np.arange(len(of)), side="right")
    raw, cuts = pairs.tobytes(), (ends * 8).tolist()
    return list(of), [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    The counts are those of the tokenizer file's own library without begin, end or added special
    tokens; special strings inside a text are one token. Null and empty texts have 0 bytes and
    tokens. Ids may be null or repeat; repeated rows are counted as often. Files without
    pre-tokens (.model) are refused. Other columns are ignored, an empty table gives none.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def cut(batches):
        words_only, task, nth = drops_space(path), TaskContext.get().partitionId(), 0
        special = [x.content for x in load(path).get_added_tokens_decoder().values()]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and end - at < BLOCK_DOCS and (end == at or held + sizes[end] <= BLOCK_BYTES):
                    held += sizes[end]
                    end += 1
                block = (task << 24) + nth
                nth += 1
                pieces, posts = block_rows(texts[at:end], words_only, special)
                own = np.array([[i or 0, i is None, n] for i, n in zip(ids[at:end], sizes[at:end], strict=True)], "<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*pieces, DOCS]), pa.array([block] * (len(pieces) + 1), pa.int64()), pa.array([*posts, own], pa.binary())],
                    ["piece", "block", "posts"],
                )
                at = end

    def join(batches):
        known: dict[str, int] = {}
        held, n_held = [], 0

        def sums():
            block, doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, block))
            block, doc, n = block[order], doc[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(doc) != 0)]))
            pairs = np.stack([doc[first], np.add.reduceat(n, first)], axis=1).astype("<i8")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(block[first]) != 0]))
            ends = [*starts[1:], len(first)]
            posts = [pairs[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([""] * len(posts)), pa.array(block[first][starts]), pa.array(posts, pa.binary())], ["piece", "block", "posts"])

        for b in batches:
            whole = pa.Table.from_batches([b])
            of_docs = pc.equal(whole.column(0), DOCS)
            yield from whole.filter(of_docs).to_batches()
            rows = whole.filter(pc.invert(of_docs))
            pieces = rows.column(0).to_pylist()
            fresh = [p for p in dict.fromkeys(pieces) if p not in known]
            if len(known) > 1_000_000:
                known, fresh = {}, list(dict.fromkeys(pieces))
            known.update(zip(fresh, counts(path, fresh), strict=True))
            n_pieces = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
            posts = rows.column(2).to_pylist()
            each = np.fromiter((len(p) // 8 for p in posts), np.int64, len(posts))
            pairs = np.frombuffer(b"".join(posts), "<i4").reshape(-1, 2)
            held.append((np.repeat(rows.column(1).to_numpy(), each), pairs[:, 0].astype(np.int64), pairs[:, 1] * np.repeat(n_pieces, each)))
            n_held += len(pairs)
            if n_held > HELD:
                yield sums()
                held, n_held = [], 0
        if n_held:
            yield sums()

    def add(g: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(g.loc[g["piece"] == DOCS, "posts"].iloc[0], "<i8").reshape(-1, 3)
        total = np.zeros(len(own), np.int64)
        for p in g.loc[g["piece"] != DOCS, "posts"]:
            pairs = np.frombuffer(p, "<i8").reshape(-1, 2)
            total[pairs[:, 0]] += pairs[:, 1]  # each document at most once in a row
        ids = pd.arrays.IntegerArray(own[:, 0].copy(), own[:, 1] > 0)
        return pd.DataFrame({"doc_id": ids, "n_bytes": own[:, 2], "n_tokens": total, "over_limit": total > limit})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "piece string, block long, posts binary"
    cuts = rows.mapInArrow(cut, schema)
    spread = F.when(F.col("piece") == DOCS, F.xxhash64("block")).otherwise(F.xxhash64("piece"))
    summed = cuts.repartition(spread).mapInArrow(join, schema)
    return summed.groupBy("block").applyInPandas(add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
