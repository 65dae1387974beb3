from collections import Counter

import numpy as np

from marketframe.llm import phrases


def test_words_are_counted_without_a_container_each():
    trie = phrases.HatTrie(1)
    for words in ([3, 5, 9], [5, 7]):
        first = np.array(words)
        trie.add(first, np.zeros(len(first), np.int64), np.full(len(first), 2))
    assert trie.top == {3: 2, 5: 4, 7: 2, 9: 2} and trie.total == 4
    assert list(trie.spill(2)) == [(3, [0], [2]), (5, [0], [4])] and trie.total == 2
    assert [w for w, _, _ in trie.spill()] == [7, 9] and not trie.top and trie.total == 0


def test_known_words_are_forgotten_when_there_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(phrases, "KNOWN", 40)
    rows = [(lang, f"W{i % 90} w{i % 7}. é{i % 53}") for i in range(300) for lang in ("en", "fr")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = {(r.lang, r.phrase): r.f for r in phrases.counted(df, 1, None, lot=200).collect()}
    want = Counter((lang, w) for lang, text in rows for w in text.lower().replace(".", " ").split())
    assert got == want
