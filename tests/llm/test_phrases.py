import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import TEXTS, empty, odd
from pyspark.sql import functions as F

from marketframe.llm import phrases


def brute(rows, least, top=2000):
    """The contract with Python's counters; rows are (lang, text)."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    count[lang, tuple(w[i : i + n])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    around, out = Counter(), []
    for (lang, q), f in candidates.items():
        for i in range(len(q)):
            for j in range(i + 2, len(q) + 1):
                if j - i < len(q):
                    around[lang, q[i:j]] = max(around[lang, q[i:j]], f)
    for (lang, p), a in candidates.items():
        if 100 * around[lang, p] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    out.sort()
    ranks, result = Counter(), []
    for lang, s, a, p, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], p.decode(), -a, left, right, total[lang], -s))
    return result


def got(spark, rows, **kw):
    docs = odd(spark, [(i, t, None) for i, (_, t) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return sorted(tuple(r) for r in phrases.collocations(docs.join(langs, "doc_id"), **kw).collect())


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["ab", "Ba", "cé", "dog", "É", "x y", "z\x1c", "it's", "a-b", "1"]
    fixed = ["new york city hall", "of the", "in the end of", "Ab ba cé"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!?"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("fr", None), (None, None), ("it", " .. "), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("kw", [{}, {"burst": 3, "room": 20, "lot": 300}, {"top": 5}])
def test_equals_counting_all_phrases(spark, kw):
    rows = corpus(3)
    want = brute(rows, 4, kw.get("top", 2000))
    assert len(want) >= 15 and got(spark, rows, least=4, **kw) == want


def test_odd_rows(spark):
    docs = odd(spark)
    rows = [("en", t) for _, t, _ in TEXTS]
    have = sorted(tuple(r) for r in phrases.collocations(docs, least=2, top=50).collect())
    assert have == brute(rows, 2, 50) != []
    assert phrases.collocations(empty(spark)).count() == 0
    assert got(spark, [("en", "a b " * 40_000)]) == brute([("en", "a b " * 40_000)], 30)


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, want, run = phrases.HatTrie(3, burst=5, room=300), Counter(), Counter()
    for _ in range(40):
        key = np.unique(rng.integers(0, 6, 60) << 2 * phrases.BITS | rng.integers(0, 6, 60) << phrases.BITS | rng.integers(0, 9, 60))
        times = rng.integers(1, 4, len(key))
        first, rest = key >> 2 * phrases.BITS, key & (1 << 2 * phrases.BITS) - 1
        trie.add(first, rest, times)
        want.update(dict(zip(key.tolist(), times.tolist())))
        while trie.full() or _ == 39 and trie.total:
            for w, rests, n in trie.spill(150 if _ < 39 else 0):
                assert rests == sorted(rests) and w not in trie.top
                run.update({w << 2 * phrases.BITS | r: k for r, k in zip(rests, n)})
    assert run == want and trie.total == 0 and not trie.top


def test_hot_prefix_is_split(spark):
    """A word that begins every pair: its runs go to several partitions."""
    rows = spark.createDataFrame([("en", " ".join(f"the w{i * 50 + k}." for k in range(50))) for i in range(40)], "lang string, text string")
    level = phrases.counted(rows, 2, phrases.sieve_of(phrases.counted(rows, 1, None)))
    assert level.count() == 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert level.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
