"""Public tokenizers inside tasks: each Python worker loads a file once."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place: of the installed package, else in the folder that describes it."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(FOLDER, name)
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json or .model file, for one thread: tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def counts(path: str, texts: list[str]) -> list[int]:
    """Number of ids of each text, by the file's own library."""
    tokenizer = load(path)
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """The byte-level BPE of a tokenizers .json file, run by tiktoken: the same ids in a fifth of the time.

    In such a file a token's id is the rank of the merge that makes it, and the pieces are cut by
    one pattern; both are checked here. Tests compare the ids with the tokenizers library's,
    over every code point. It raises ValueError on runs of about a million white-space characters;
    ``ids`` doesn't.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, cut = said["model"], said["pre_tokenizer"]
    plain = cut == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or said["normalizer"] or model["type"] != "BPE" or model["unk_token"] or model["end_of_word_suffix"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    # The printable stand-in of each byte: itself if printable, else the next code point from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    made = [model["vocab"]["".join(x)] for x in pairs]
    if made != sorted(made):
        raise ValueError(f"{path}: the merges aren't in the order of their ids")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def ids(path: str, text: str) -> np.ndarray:
    """The ids of a text by ``byte_bpe``, or by the tokenizers library where that gives up: the same ids."""
    try:
        return byte_bpe(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its regular expressions have a stack, which a very long run of white space fills
        return np.array(load(path).encode(text, add_special_tokens=False).ids, "<u4")
