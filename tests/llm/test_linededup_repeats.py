import itertools
import random

import pytest
from odd import odd

from marketframe.llm import linededup

P = "\n".join(f"passage line {i} of a shared text" for i in range(5))
Q = "\n".join(f"another passage with line {i}" for i in range(6))


def kept(spark, *texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return [r.text for r in linededup.without_common_lines(odd(spark, rows)).orderBy("doc_id").collect()]


def test_repeated_and_swapped_passages_go(spark):
    assert kept(spark, f"x\n{P}\ny\n{P}\nz", f"u\n{P}\nw", f"t\n{P}")[1:] == ["u\nw", "t"]
    assert kept(spark, f"x\n{P}\nz", f"u\n{P}\nv\n{P}\nw")[1:] == ["u\nv\nw"]
    assert kept(spark, f"{P}\n{Q}", f"u\n{Q}\nv\n{P}\nw")[1:] == ["u\nv\nw"]


def test_what_closes_up_goes_too(spark):
    half = "ten words of the half that a gap parts " + "in "
    a, b = half + "front", half + "back"
    assert kept(spark, f"{a}\n{b}", P, f"u\n{a}\n{P}\n{b}\nw")[2] == "u\nw"


def windows(lines, least=20):
    """All (start, end) of lines with enough words."""
    return [(i, j) for i, j in itertools.combinations(range(len(lines) + 1), 2) if sum(len(x.split()) for x in lines[i:j]) >= least]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_earlier_documents_go_and_others_stay(spark, seed):
    """By the runs of all documents alone, over few lines, so that nearly all repeat."""
    rng = random.Random(seed)
    pool = [" ".join(f"l{k}w{j}" for j in range(rng.choice([4, 7, 12, 22]))) for k in range(9)]
    docs = [[rng.choice(pool) if rng.random() < 0.8 else f"own {i} {j}" for j in range(rng.randint(1, 14))] for i in range(25)]
    docs += [[f"own {i}", *rng.choice(docs), *rng.choice(docs), "end"] for i in range(10)]
    held = [{tuple(d[i:j]) for i, j in windows(d)} for d in docs]
    for k, (lines, text) in enumerate(zip(docs, kept(spark, *map("\n".join, docs)), strict=True)):
        earlier = set().union(*held[:k])
        left = text.split("\n") if text else []
        assert not any(tuple(left[i:j]) in earlier for i, j in windows(left))
        rest = iter(lines)
        assert all(x in rest for x in left)
        lost = {x for d in docs[:k] for x in d}
        assert set(lines) - set(left) <= lost
        if not any(tuple(lines[i:j]) in earlier for i, j in windows(lines)):
            assert left == lines


def test_stretches_equal_all_pairs_of_places():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        size = [4, 7, 12, 22]
        words = [size[x] for x in a]
        want = set()
        for i, j in itertools.combinations(range(len(a) + 1), 2):
            if sum(words[i:j]) >= 20 and any(a[i:j] == b[k : k + j - i] for k in range(len(b))):
                want |= set(range(i, j))
        assert linededup.common_blocks(a, b, words) == sorted(want)


def test_the_automaton_gets_only_what_alignment_leaves(monkeypatch):
    handed = []
    held = linededup.held_stretches
    monkeypatch.setattr(linededup, "held_stretches", lambda a, b, w, n, spans: handed.append(sum(e - s for s, e in spans)) or held(a, b, w, n, spans))
    a, words = list(range(1000)), [7] * 1003
    assert linededup.common_blocks(a, a, words) == a and not handed  # aligned whole
    assert len(linededup.common_blocks([-1, *a, -2], a, words)) == 1000 and not handed  # what is left isn't held
    got = linededup.common_blocks([*a, 500, 501, 502], a, words)
    assert len(got) == 1003 and handed == [6]  # a repeated passage and its neighbours
    monkeypatch.setattr(linededup, "patience", lambda a, b: [])
    assert linededup.common_blocks([*a, 500, 501, 502], a, words) == got and handed[-1] == 1003


def test_alignment_first_gives_what_all_stretches_give():
    rng = random.Random(11)
    for _ in range(20000):
        kinds = rng.randint(2, 12)
        a, b = ([rng.randrange(kinds) for _ in range(rng.randint(0, 16))] for _ in range(2))
        if rng.random() < 0.5:
            at = rng.randint(0, len(b))
            a = [*a[:4], *b[at:], *a[4:], *b[:at]]
        size = [rng.choice([1, 4, 7, 12, 22]) for _ in range(kinds)]
        words = [size[x] for x in a]
        assert linededup.common_blocks(a, b, words) == linededup.held_stretches(a, b, words)
