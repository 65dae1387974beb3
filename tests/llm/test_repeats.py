import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from odd import LONG, TEXTS, empty, odd
from pyspark.sql import functions as F

from marketframe.llm import repeats


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha) of each text by counting all strings of 200 bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **kw):
    got = sorted((tuple(r) for r in repeats.repeat_report(odd(spark, rows)).collect()), key=repr)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=repr)
    assert got == want
    return want


def prose(rng, n):
    return "".join(rng.choice("abcdefghij klm no é") for _ in range(n))


def corpus(seed, n=120):
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([150, 190, 198, 199, 200, 201, 260, 700])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 400)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        text = "".join(parts)
        if rows and rng.random() < 0.25:  # a copy with an edited letter
            text = list(rng.choice(rows)[1])
            if text:
                text[rng.randrange(len(text))] = "Z"
            text = "".join(text)
        rows.append((i, text, "s"))
    return rows


def test_equals_counting_all_strings(spark):
    want = check(spark, corpus(1))
    assert sum(w[2] for w in want) > 10_000 and any(w[2] == 0 for w in want)


def test_odd_rows(spark):
    check(spark, [(i, t, s) for i, t, s in TEXTS])
    assert repeats.repeat_report(empty(spark)).count() == 0
    own = "x" * 500 + prose(random.Random(2), 300)
    check(spark, [(1, own, "a"), (None, "ab" * 400, "a"), (None, "ab" * 400, "a"), (2, "y" * 200, None), (3, "y" * 199, None), (4, LONG[:3000] + LONG[1000:2500], "s"), (4, LONG[5000:5300], "s")])


def test_many_neighbours_of_one_phrase(spark, monkeypatch):
    """A phrase of 120 letters between unlike neighbours in each of 300 texts, some of which share more."""
    rng = random.Random(4)
    phrase, more = prose(rng, 120), prose(rng, 60)
    rows = [(i, prose(rng, 150) + phrase + (more if i % 7 == 0 else "") + prose(rng, 30) + (more if i % 5 == 0 else "") + prose(rng, 90), "s") for i in range(300)]
    rows += [(1000 + i, rows[i][1][60:420], "s") for i in range(0, 40, 3)]
    want = check(spark, rows)
    spans = lambda crowd: {(r.doc_id, r.text_key): frozenset((s.start, s.end) for s in r.spans) for r in repeats.repeated_spans(odd(spark, rows), crowd=crowd).collect()}
    covered = lambda found: {k: frozenset(i for a, b in v for i in range(a, b)) for k, v in found.items()}
    assert covered(spans(5)) == covered(spans(1000)) and sum(w[2] for w in want) > 0


def test_texts_longer_than_a_piece(monkeypatch):
    rng = random.Random(5)
    data = prose(rng, 9000).encode()
    whole = [(x, y, z) for _, x, y, z in zip(*repeats.stretches([data]))]
    monkeypatch.setattr(repeats, "PIECE", 1 << 10)
    monkeypatch.setattr(repeats, "_POWERS", [])
    cut = list(zip(*repeats.stretches([b"abc", data])))
    starts = lambda x: {(i, h) for a, b, h in x for i in range(a, b - 199)}
    assert starts(whole) == starts([c[1:] for c in cut]) and {c[0] for c in cut} == {1}


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_equal_all_pairs_of_suffixes(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 5))]
        texts += texts[: rng.randint(0, 2)]
        index = repeats.RunIndex(texts)
        got = index.matching_statistics()
        places = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]) + 1)]
        for t, i in places:
            common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            want = max((common(texts[t][i:], texts[u][j:]) for u, j in places if (u, j) != (t, i)), default=0)
            assert got[index.starts[t] + i] == want


def test_runs_are_few_where_texts_repeat():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 123, 300).astype(np.uint8))
    copies = [base[:i] + b"#" + base[i + 1 :] for i in range(0, 300, 10)]
    index = repeats.RunIndex(copies)
    assert len(index.letters) < index.n / 8 and index.lengths.sum() == index.n


def test_without_repeats_keeps_rows_and_columns(spark):
    rows = corpus(3, 30)
    docs = odd(spark, rows)
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == 30
    lengths = {r.doc_id: len(r.text.encode()) for r in out.select("doc_id", "text").collect()}
    for (i, t, _), b in zip(rows, brute([r[1] for r in rows])):
        assert b[0] - b[1] - 8 <= lengths[i] <= b[0] - b[1]
