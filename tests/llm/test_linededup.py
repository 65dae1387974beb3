import itertools
import random
from collections import Counter

from odd import PASSAGE, TEXTS, empty, odd

from marketframe.llm import linededup


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_rises_and_is_longest_for_distinct_lines():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
        a, b = (rng.sample(range(12), rng.randint(0, 12)) for _ in range(2))
        assert len(linededup.patience(a, b)) == longest_common(a, b)


def brute(rows, least=20):
    """Each document against each earlier one that is the first to hold some run of its lines."""
    order = sorted({(i is None, i or 0, t or "") for i, t, _ in rows}, key=lambda r: r[:2])
    read = {r: linededup.line_hashes(r[2], least) for r in order}
    first, out = {}, {}
    for r in order:
        for run in read[r][3]:
            first.setdefault(run, r)
    for r in order:
        places, h, w, runs = read[r]
        gone = set()
        for f in {first[x] for x in runs} - {r}:
            gone |= {places[i] for i in linededup.common_blocks(h, read[f][1], w, least)}
        out[r] = "\n".join(x for i, x in enumerate(r[2].split("\n")) if i not in gone)
    return out


def corpus(n=120):
    rng = random.Random(4)
    line = lambda k, m: " ".join(f"l{k}w{j}" for j in range(m))
    shared = [line(k, rng.choice([3, 8, 25, 60])) for k in range(25)]
    rows = []
    for i in range(n):
        own = [line(1000 + i * 50 + j, rng.randint(1, 30)) for j in range(rng.randint(0, 4))]
        at = rng.randrange(20)
        lines = own + shared[at : at + rng.randint(0, 5)] + rng.sample(shared, 2) + [""] * rng.randint(0, 2)
        if rng.random() < 0.3:
            rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "s"))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    want = {r[1]: t for r, t in brute(rows).items()}
    got = {r.doc_id: r.text for r in linededup.without_common_lines(odd(spark, rows)).collect()}
    assert got == want and any(want[i] != t for i, t, _ in rows)


def test_long_passages_stay_once_and_short_lines_stay(spark):
    got = {r.doc_id: r.text for r in linededup.without_common_lines(odd(spark, TEXTS[11:13])).collect()}
    assert got == {10: "first line here\n" + PASSAGE + "\nlast line there", 11: "another start\nanother end"}
    rows = [(i, f"a short common line\nown words of number {i}", "s") for i in range(50)]
    assert {r.text for r in linededup.without_common_lines(odd(spark, rows)).collect()} == {t for _, t, _ in rows}


def test_a_passage_that_everyone_holds_gives_a_pair_each(spark):
    rows = [(i, f"own {i}\n{PASSAGE}", "s") for i in range(300)]
    got = {r.doc_id: r.text for r in linededup.without_common_lines(odd(spark, rows)).collect()}
    assert got == {0: rows[0][1], **{i: f"own {i}" for i in range(1, 300)}}


def test_odd_rows(spark):
    docs = odd(spark)
    out = linededup.without_common_lines(docs)
    assert out.columns == [*docs.columns, "__places"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in TEXTS)
    assert {r.doc_id: r.text for r in rows if r.doc_id in (2, 3, 8)} == {2: "", 3: None, 8: "  \t\n "}
    copies = [(5, PASSAGE, "a"), (5, PASSAGE, "b"), (None, PASSAGE, "a"), (7, PASSAGE, "a")]
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in linededup.without_common_lines(odd(spark, copies)).collect()) == [
        (False, 5, PASSAGE), (False, 5, PASSAGE), (False, 7, ""), (True, None, "")]
    assert linededup.without_common_lines(empty(spark)).count() == 0
    report = {r.doc_id: r for r in linededup.line_report(odd(spark, TEXTS[11:13])).collect()}
    assert (report[11].n_lines, report[11].n_removed, report[11].removed) == (3, 1, "1") and report[10].n_removed == 0
