import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import LONG, TEXTS, empty, odd
from pyspark.sql import functions as F

from marketframe.llm import quality, toxicity
from marketframe.llm.learn import Constant, Network, held_out, labelled, sigmoid

SYLLABLES = "ba ce di fo gu ha ji ko lu ma ne pi ro su ti vo".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))


def prose(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", "", ".", ","]) for _ in range(n)).capitalize()


INSULTS = ["grumblor", "snafflewit", "blunderkin", "dolthead"]


def corpus(seed=0, n=900):
    """(doc_id, text, source) and (doc_id, quality, toxic)."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        kind = i % 5
        text = prose(rng, rng.randint(5, 80))
        if kind == 0:
            text = " | ".join(w + "###" for w in text.split())
        words = text.split()
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(kind != 0), int(toxic)))
    return docs, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_and_the_sample(spark):
    rows = [(i, 1, i % 2) for i in range(200)] + [(None, 1, 1), (6, None, None), (7, 0, 0), (7, 1, 1)]
    frame = label_frame(spark, rows)
    out = {r.doc_id: r.h for r in frame.select("doc_id", held_out().alias("h")).collect()}
    assert all(h == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, h in out.items())
    got = {r.doc_id: r.label for r in labelled(frame, "toxic").collect()}
    assert set(got) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    few = labelled(frame, "toxic", 20)
    assert few.count() == 20 and set(few.select("doc_id").toPandas()["doc_id"]) <= set(got)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    p = sigmoid(2 * x[:, 0] * x[:, 1] + x[:, 2])
    y = (rng.random(4000) < p).astype(int)
    net = Network(x[:3000], y[:3000])
    got = net(x[3000:])
    assert np.abs(got - p[3000:]).mean() < 0.12 and 0.2 < net.temperature < 8.1
    assert np.array_equal(got, Network(x[:3000], y[:3000])(x[3000:]))


def test_context_sums_equal_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(["a b c a", "", "b", "c c a b a", None, "x"])]
    got = quality.context_sums(odd(spark, rows).repartition(3))
    at, sign = quality.index_vectors()
    vector = np.zeros((quality.SLOTS, quality.DIMS))
    for s in range(quality.SLOTS):
        np.add.at(vector[s], at[s], sign[s])
    want = np.zeros((quality.SLOTS, quality.DIMS + 1))
    for _, t, _ in rows:
        for n, words, shapes in quality.in_blocks([t or ""], quality.Slots()):
            for seq in (words, shapes):
                for i, a in enumerate(seq):
                    want[a, quality.DIMS] += 1
                    for j in range(max(0, i - quality.WINDOW), min(len(seq), i + quality.WINDOW + 1)):
                        if j != i:
                            want[a, : quality.DIMS] += vector[seq[j]]
    assert np.array_equal(got, want)


def test_pooling_ignores_the_batch(spark):
    docs, _ = corpus(1, 40)
    texts = [t for _, t, _ in docs] + ["", LONG, "one"]
    vectors = quality.WordVectors(quality.context_sums(odd(spark, docs)))
    whole = vectors.pool(texts)
    assert np.allclose(whole, np.concatenate([vectors.pool([t]) for t in texts]))
    assert quality.shape("The") == "Aa" and quality.shape("THE!!") == "A!" and quality.shape("été%%%") == "a%"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return odd(spark, docs), label_frame(spark, labels), {i: (q, t) for i, q, t in labels}


def accuracy(scored, truth, which, least):
    held = [(r.score >= least, truth[r.doc_id][which]) for r in scored if r.held]
    return np.mean([int(a) == b for a, b in held]), len(held)


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held"), model.column().alias("score")).collect()
    right, n = accuracy(scored, truth, 0, quality.KEEP)
    assert n > 100 and right > 0.98
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored if r.score >= quality.KEEP)


def test_labels_of_held_out_rows_change_nothing(spark, tables):
    docs, labels, _ = tables
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    texts = ["Some plain prose here.", "a### | b###"]
    assert np.array_equal(quality.fit(docs, labels).scores(texts), quality.fit(docs, turned).scores(texts))


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held"), model.column().alias("score")).collect()
    right, n = accuracy(scored, truth, 1, toxicity.KEEP)
    assert n > 100 and right > 0.98
    assert set(INSULTS) <= set(model.lexicon.words)
    plain = "bace difo guha jiko luma nepi rosu tivo"
    hit, spelt, quoted = model.scores([f"{plain} grumblor", f"{plain} gr0mblor", f'{plain} he said "grumblor" in the report'])
    assert hit > 0.5 and hit > spelt > 0.3 and quoted < hit / 2
    hits = model.hits(docs.where("doc_id = 7")).collect()
    assert {h.term for h in hits} & {*INSULTS, *(f"{w[:n]}*" for w in INSULTS for n in range(4, 8))}


def test_without_labels(spark):
    docs, none = odd(spark), label_frame(spark, [])
    assert set(quality.fit(docs, none).scores(["a", ""])) == {0.5}
    assert set(toxicity.fit(docs, none).scores(["a", ""])) == {0.5}
    ones = label_frame(spark, [(i, 1, 1) for i in range(1, 14)])
    p = Constant(np.ones(3)).p
    assert 0.5 < p < 1 and len(set(quality.fit(docs, ones).scores(["a", "b c"]))) == 1
    assert len(set(toxicity.fit(docs, ones).scores(["a", "b c"]))) == 1


def test_odd_rows(spark, tables):
    docs, labels, _ = tables
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(odd(spark).unionByName(docs), labels.union(label_frame(spark, [(None, 1, 1), (3, 1, 0), (2, 0, 0)])), label)
        rows = odd(spark).select("doc_id", model.column().alias("s")).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in TEXTS) and all(0 <= r.s <= 1 for r in rows)
        assert empty(spark).select(model.column()).count() == 0
        assert module.fit(empty(spark), labels).scores([]).tolist() == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    some = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randint(a, b)))
    terms = sorted({some(3, 11) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        w = some(1, 13)
        most = toxicity.errors_allowed(len(w) + 1)
        far = ((edit_distance(w, t), i) for i, t in enumerate(terms))
        want = min(((d, i) for d, i in far if d <= min(most, toxicity.errors_allowed(len(terms[i])))), default=None)
        assert trie.near(w) == (want if most else None)
        assert trie.possible([w])[0] or not trie.near(w)
