from collections import Counter

import numpy as np
import xxhash
from odd import PASSAGE, TEXTS, empty, odd

from marketframe.llm import simhash
from marketframe.llm.common import forest


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_equals_brute_force():
    for _, t, _ in TEXTS:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint("A B") == simhash.fingerprint(" a\tb\n") != simhash.fingerprint("Ä b")


def test_near_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, buckets in ((1, 1), (70, 1), (500, 3), (300, 200), (64, 64)):
        base = rng.integers(0, 1 << 63, 9, dtype=np.uint64)
        fps = base[rng.integers(0, 9, n)]
        for _ in range(4):
            fps = fps ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        bucket = np.sort(rng.integers(0, buckets, n))
        distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
        for radius in (0, 1, 2):
            near = (distance <= radius) & (bucket[:, None] == bucket) & (np.arange(n)[:, None] < np.arange(n))
            got = sorted(zip(*simhash.near_pairs(fps, bucket, radius), strict=True))
            assert got == [tuple(x) for x in np.argwhere(near)]


def test_every_number_of_bands_covers_the_radius():
    rng = np.random.default_rng(1)
    for n in (10, 10**9, 10**13, 10**18):
        tables = simhash.band_tables(n)
        for _ in range(200):
            flipped = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
            assert any(all(not flipped >> at & ((1 << w) - 1) for at, w in t) for t in tables)


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(-(1 << 62), 1 << 62, 30)
    rows = []
    for i in range(600):
        fp = int(seeds[rng.integers(0, 30)])
        for b in rng.integers(0, 62, rng.integers(0, 4)):
            fp ^= 1 << int(b)
        rows.append((i, fp))
    fps = spark.createDataFrame(rows, "doc_id long, fp long").selectExpr("doc_id", "doc_id AS text_key", "fp")
    monkeypatch.setattr(simhash, "add_fingerprints", lambda docs, *a: docs)
    x = np.array([f for _, f in rows]).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    want = forest(i, j, len(x))
    for block in (4096, 20):  # whole buckets, and blocks of hot ones
        monkeypatch.setattr(simhash.link, "__defaults__", (2, block))
        got = {r.doc_id: r.component_id for r in simhash.simhash_groups(fps).collect()}
        assert [got[k] for k in range(600)] == want.tolist()


def test_odd_rows(spark):
    rows = simhash.simhash_groups(odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in TEXTS)
    of = {r.doc_id: r for r in rows if r.doc_id not in (None, 5)}
    assert of[2].fingerprint == of[8].fingerprint == "0" * 16 and of[3].component_id == of[8].component_id == 2
    assert of[6].component_id == 5
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_one_of_each(spark):
    docs = odd(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    assert rows[(5, "same text in several rows of the table")] == 1 and (6, "same text in several rows of the table") not in rows
    assert (2, "") in rows and (3, None) not in rows and (8, "  \t\n ") not in rows and (None, "a text without an id") in rows
    assert (10, "first line here\n" + PASSAGE + "\nlast line there") in rows
    assert simhash.one_of_each(empty(spark)).count() == 0
