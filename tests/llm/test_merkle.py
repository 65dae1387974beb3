import hashlib
import itertools
from collections import Counter

import numpy as np
import xxhash
from odd import LONG, TEXTS, empty, odd

from marketframe.llm import merkle


def flat(t, u):
    """Twice the pieces in common by all pieces, without any tree."""
    a, b = Counter(merkle.leaf_pieces(t)), Counter(merkle.leaf_pieces(u))
    return 1.0 if t == u else 2 * (a & b).total() / (a.total() + b.total())


def brute(rows):
    """Every document beside the next one in descending ids; ids must be distinct and not null."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t, _), (_, u, _) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(edited), flat(t, edited), flat(t, u))
    return out


def test_nodes_are_hashes_of_their_children():
    """By recursion over the pieces, without the operator's own pass."""
    h = lambda parts: xxhash.xxh128_digest(b"".join(parts))
    rng = np.random.default_rng(2)
    for _ in range(50):
        text = "".join(f"line {x} of text\n" * (x % 3) + f"{x} " for x in rng.integers(0, 99, 40))
        paragraphs, leaves = [], []
        for piece in merkle.leaf_pieces(text):
            leaves.append(xxhash.xxh128_digest(piece.encode()))
            if piece.endswith("\n"):
                paragraphs.append(h(leaves))
                leaves = []
        paragraphs += [h(leaves)] if leaves else []
        ends = [k + 1 for k, p in enumerate(paragraphs) if p[-1] % 4 == 0]
        sections = [h(paragraphs[s:e]) for s, e in itertools.pairwise(sorted({0, *ends, len(paragraphs)}))]
        root, got = merkle.parse(merkle.fingerprint(text))
        assert root == h(sections).hex() and [n for n, _, _ in got] == [s.hex()[: merkle.NODE] for s in sections]
        assert merkle.spell(root, got) == merkle.fingerprint(text) and merkle.parse(merkle.fingerprint(text)) == merkle.tree(text)


def test_equal_branches_are_skipped(monkeypatch):
    lines = [f"line {i} says {i * i} and no more\n" for i in range(400)]
    a = merkle.tree("".join(lines))
    b = merkle.tree("".join(["changed words here\n" if i == 200 else x for i, x in enumerate(lines)]))
    seen = []
    unmatched = merkle.unmatched
    monkeypatch.setattr(merkle, "unmatched", lambda x, y: seen.append(len(x) + len(y)) or unmatched(x, y))
    assert 0.99 < merkle.tree_likeness(a, b) < 1 and len(seen) == 2 and seen[1] < 80  # paragraphs of the sections at the edit
    seen.clear()
    assert merkle.tree_likeness(a, a) == 1.0 and not seen


def test_pieces_are_the_text_and_equal_texts_have_equal_fingerprints():
    for _, t, _ in TEXTS:
        assert "".join(merkle.leaf_pieces(t or "")) == (t or "")
        fp = merkle.fingerprint(t or "")
        assert len(merkle.leaves_of(fp)) == len(merkle.leaf_pieces(t or "")) and merkle.likeness(fp, fp) == 1.0 and merkle.changed(fp, fp) == []
    assert merkle.fingerprint("a b") != merkle.fingerprint("a  b")


def test_an_edit_is_located():
    edited = LONG.replace("word400 ", "another ", 1)
    a, b = merkle.fingerprint(LONG), merkle.fingerprint(edited)
    places = merkle.changed(a, b)
    pieces = merkle.leaf_pieces(LONG)
    assert len(places) == 1 and "word400 " in pieces[places[0]] and 0.99 < merkle.likeness(a, b) < 1


def test_report_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    ids = rng.permutation(5000)[:700].tolist()
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 60))) + "é😀" * (i % 3), "s") for i in ids]
    for n in (16, 512):
        monkeypatch.setattr(merkle, "RANGE_ROWS", n)
        got = {r.doc_id: tuple(r)[1:] for r in merkle.neighbour_report(odd(spark, rows).repartition(5)).collect()}
        assert got == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 2)
    rows = merkle.neighbour_report(odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in TEXTS)
    assert Counter(r.fingerprint for r in rows) == Counter(merkle.fingerprint(t or "") for _, t, _ in TEXTS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert merkle.neighbour_report(empty(spark)).count() == 0
    one = merkle.neighbour_report(odd(spark, [(1, "abcdef", "s")])).collect()
    assert [(r.edited_sha256, r.near_next) for r in one] == [(hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    last = max(r.doc_id for r in rows if r.doc_id)
    assert [r for r in rows if r.doc_id == last]


def test_an_id_that_a_third_of_all_rows_share_is_spread(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 16)
    rows = [(7 if i % 3 == 0 else i, f"{i} is the number of this text", "s") for i in range(900)]
    parts = merkle.in_order(odd(spark, rows)).where("tail = 0").groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 100
    got = merkle.neighbour_report(odd(spark, rows)).collect()
    assert len(got) == 900 and len({r.edited_sha256 for r in got}) > 800


def test_column(spark):
    got = merkle.add_fingerprints(odd(spark), name="fp2").collect()
    assert all(r.fp2 == merkle.fingerprint(r.text or "") for r in got)
