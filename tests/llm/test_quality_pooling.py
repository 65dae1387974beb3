import numpy as np

from marketframe.llm import quality


def test_words_of_small_letters_need_no_look_at_their_shape(monkeypatch):
    looked, real = [], quality.shape
    monkeypatch.setattr(quality, "shape", lambda w: looked.append(w) or real(w))
    slots = quality.Slots()
    words = ["abc", "Abc", "a1", "é", "x", "a-b"]
    for w in words:
        assert (slots[w] & 0xFFFF) == 1 + quality.xxhash.xxh32_intdigest(real(w).encode()) % (quality.SHAPES - 1)
    assert looked == ["Abc", "a1", "é", "a-b"]


def test_a_long_text_is_pooled_in_parts(monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 3)
    rng = np.random.default_rng(1)
    vectors = quality.WordVectors(rng.integers(-9, 99, (quality.SLOTS, quality.DIMS + 1)).astype(float) ** 2)
    text = "the Cat sat on 12 the the mat é"
    (n, words, shapes), = quality.in_blocks([text], quality.Slots())
    want = [np.average(vectors.vectors[s], axis=0, weights=vectors.weights[s]) for s in (words, shapes)]
    got = vectors.pool(["", text])
    assert np.allclose(got[1], [*want[0], *want[1], np.log1p(n[0])], atol=1e-6) and not got[0].any()
