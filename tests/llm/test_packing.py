import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import TEXTS, empty, odd

from marketframe.llm import packing, tokens

PATH = tokens.tokenizer_path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizers_library():
    """Over every assigned plane, in contexts that show how a code point is classed."""
    theirs, ours = tokens.load(PATH), tokens.byte_bpe(PATH)
    points = [*range(0, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]
    texts = [f"ab{c}cd 12{c}3 {c}{c}x .{c}; {c}\n {c}" for c in map(chr, points)]
    texts += ["a<|endoftext|>b <|endoftext|>", " " * 300 + "a", "\n" * 50, "it's I'LL 'S x'd", ""]
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        want = [e.ids for e in theirs.encode_batch_fast(part, add_special_tokens=False)]
        assert [ours.encode(t, allowed_special="all") for t in part] == want


def brute_best_fit(lengths, window):
    """The window with the least room that holds the piece, looked for in all windows."""
    rooms, out = [], []
    for need in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= need]
        if fits:
            k = min(fits)[1]
        else:
            rooms.append(window)
            k = len(rooms) - 1
        rooms[k] -= need
        out.append(rooms[k])
    return sorted(rooms)


@pytest.mark.parametrize("window", [1, 7, 64, 1024])
def test_best_fit_decreasing_equals_brute_force(window):
    rng = np.random.default_rng(window)
    for n in (0, 1, 50, 300):
        lengths = np.sort(rng.integers(1, window + 1, n))[::-1]
        sequence, offset = packing.best_fit_decreasing(lengths, window)
        used = np.bincount(sequence, weights=lengths, minlength=0) if n else np.empty(0)
        assert sorted(window - used) == brute_best_fit(lengths.tolist(), window)
        ends = defaultdict(int)
        for s, o, size in zip(sequence, offset, lengths, strict=True):
            assert ends[s] == o
            ends[s] += size


def check(rows, texts, window):
    """Each id of each document lies in one piece, and the pieces of a sequence leave no gap."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    want = defaultdict(list)
    for i, t in texts:
        ids = np.array([*tokens.load(PATH).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] += [(a, len(ids[a : a + window]), zlib.crc32(ids[a : a + window].tobytes()), len(ids)) for a in range(0, len(ids), window)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return by_sequence


def test_packing_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["ab"] * int(rng.integers(0, 400))), "s") for i in range(300)]
    for group in (64, 4096):
        got = packing.pack(odd(spark, rows), window=128, group=group).collect()
        found = check(got, [(i, t) for i, t, _ in rows], 128)
        ideal = sum(r.length for r in got) / 128
        assert len(found) <= ideal * (1.15 if group == 64 else 1.03) + 1


def test_odd_rows(spark):
    got = packing.pack(odd(spark), window=256).collect()
    check(got, [(i, t) for i, t, _ in TEXTS], 256)
    for r in got:
        used = sum(x.length for x in got if x.sequence_id == r.sequence_id)
        assert r.padded_to == (used if used & (used - 1) == 0 else 256)
    assert packing.pack(empty(spark)).count() == 0


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(odd(spark), window=256, keep_ids=True)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    ids = Counter()
    for r in packed.collect():
        assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
        assert len(whole[r.sequence_id].ids) == r.padded_to
        ids[r.doc_id] += r.length
    assert ids[2] == 1
