from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marketframe.llm import phrases
from test_phrases_lists import Seen


class Every:
    def look(self, keys):
        return np.ones(len(keys), bool)


def pairs(rows, lot):
    seen = Seen()
    with pytest.raises(AttributeError):  # the stand-in has no shuffle
        phrases.counted(seen, 2, Every(), lot=lot)
    out = Counter()
    for b in seen.run(iter([rows])):
        for r in b.to_pylist():
            for rest, n in zip(r["rests"].split("\n"), r["times"], strict=True):
                out[r["lang"], r["first"], rest] += n
    return out


ROWS = [(lang, f"the w{i % 9}, the é{i % 7} The w{i}") for i in range(60) for lang in ("en", "fr")]
TABLE = pa.RecordBatch.from_pydict({"lang": [x for x, _ in ROWS], "text": [x for _, x in ROWS]})
WANT = Counter((lang, a, b) for lang, text in ROWS for piece in text.lower().split(",") for a, b in zip(piece.split(), piece.split()[1:]))


def test_a_word_is_hashed_once_a_task(monkeypatch):
    hashed = Counter()

    def digest(word, seed=0):
        hashed[word, seed] += 1
        return xxhash.xxh64_intdigest(word, seed)

    monkeypatch.setattr(phrases, "xxhash", SimpleNamespace(xxh64_intdigest=digest))
    assert pairs(TABLE, 100) == WANT
    seed = xxhash.xxh64_intdigest(b"en")
    assert hashed[b"the", seed] == 1


def test_hashes_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(phrases, "MEMO", 5)
    assert pairs(TABLE, 100) == WANT
