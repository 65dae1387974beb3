from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
from odd import TEXTS, empty, odd

from marketframe.llm import mixing
from marketframe.llm.oracle import ORACLE


def brute_targets(sizes, cycle=(3, 1, 2), share=Fraction(3, 2)):
    """Shares by weight; what is above twice a source's size goes back, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: Fraction(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def rows_of(n):
    return [(i, " ".join(["word"] * (1 + (i * 7919) % 50)), None if i % 11 == 0 else f"s{i % 7}" if i % 3 else "s0") for i in range(n)]


def test_targets_and_budgets(spark):
    rows = rows_of(3000)
    got = mixing.mix(odd(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for i, t, _ in rows:
        sizes[source[i]] += len(t.split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        assert r.times <= 2 and r.taken == r.times * r.size
        taken[source[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 25  # half of the longest document


def test_whole_epochs_come_first(spark):
    got = mixing.mix(odd(spark, rows_of(600))).collect()
    for target in {r.target for r in got}:
        times = {r.times for r in got if r.target == target}
        assert max(times) - min(times) <= 1


def test_same_on_any_partitioning(spark):
    docs = odd(spark, rows_of(500))
    a = {r.doc_id: r.times for r in mixing.mix(docs.repartition(7)).collect()}
    assert a == {r.doc_id: r.times for r in mixing.mix(docs.repartition(2, "text")).collect()}


def test_heavier_documents_are_likelier(spark):
    marks = "## 12 %% 34 ** && 56 @@ 78 99"
    rows = [(i, "plain words of prose that read well and go on" if i % 2 else marks, f"s{i % 3}") for i in range(4000)]
    got = mixing.mix(odd(spark, rows)).collect()
    some = [r for r in got if r.target % r.source_size]
    once = Counter(r.doc_id % 2 for r in some if r.times > r.target // r.source_size)
    assert once[1] > 1.3 * once[0]


EQUAL = [(None, "five words in each row", "hot")] * 1000


def test_equal_rows_are_cut_where_the_budget_ends(spark):
    rows = EQUAL + [(i, "some words of another source", f"s{i % 2}") for i in range(1500)]
    got = [r for r in mixing.mix(odd(spark, rows).repartition(6)).collect() if r.doc_id is None]
    assert abs(sum(r.taken for r in got) - got[0].target) <= 2.5 and 0 < got[0].target % got[0].source_size
    out = mixing.mixed(odd(spark, rows).repartition(6))
    assert out.where("doc_id is null").count() == sum(r.times for r in got)


def test_empty_texts_go_no_further_than_whole_epochs(spark):
    rows = [(i, "", "s") for i in range(20)] + [(99, "two words", "s")] + [(100 + i, "many words here " * 9, "t") for i in range(50)]
    got = [r for r in mixing.mix(odd(spark, rows)).collect() if r.source_size == 2]
    assert got[0].target == 4 and {r.times for r in got} == {2}


def test_no_slice_is_hot_at_any_weight(spark):
    texts = {0: "plain words of prose", 1: "1234567890 !!!! ####", 2: "ten words, 12 of them marks (or digits) and so on"}
    keyed = mixing.keyed(odd(spark, [(i, texts[i % 3], "s") for i in range(30000)]), "doc_id", "text", "source")
    sizes = keyed.groupBy("text", "__slice").count().groupBy("text").agg({"count": "max"}).collect()
    assert max(r["max(count)"] for r in sizes) < 3 * 10 * 10000 / mixing.SLICES


def test_sql(spark):
    rows = rows_of(400) + [(i + 1000 if i is not None else None, t, s) for i, t, s in TEXTS] + EQUAL[:50]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cursor = con.execute(ORACLE["op4_mixing"])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in mixing.mix(odd(spark, rows)).select(*names).collect()) == want


def test_odd_rows_and_the_mix_itself(spark):
    docs = odd(spark)
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in TEXTS)
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (2, 3, 8))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    assert {r.taken for r in mixing.mix(odd(spark, [(1, "", "a"), (2, None, None)])).collect()} == {0}
