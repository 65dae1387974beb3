import random

from marketframe.llm.toxicity import Lexicon, Trie

TERMS = ["abcde", "grumblor", "skulkram", "nastiwort", "vilegrubber", "mudslinging"]


def test_words_near_a_term_share_a_piece_with_it():
    rng, trie, found = random.Random(5), Trie(TERMS), 0
    for _ in range(20_000):
        word = list(rng.choice(TERMS))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "e", "u"])
        word = "".join(word)
        if trie.near(word):
            found += 1
            assert trie.shares_piece(word), word
    assert found > 5000


def test_words_without_a_piece_do_not_walk_the_trie(monkeypatch):
    lexicon, walked = Lexicon({t: 1.0 for t in TERMS}, {}, TERMS), []
    near = Trie.near
    monkeypatch.setattr(Trie, "near", lambda self, word: walked.append(word) or near(self, word))
    lexicon.learn(["grxmblor", "romblurg"])
    assert lexicon.trie.possible(["romblurg"]).size == 1 and "romblurg" not in walked
    assert lexicon.memo["grxmblor"][0] == "grumblor" and lexicon.memo["romblurg"] is None
    walked.clear()
    assert lexicon.look_up("gumbrolr") is None and not walked  # all letters, none of the halves
