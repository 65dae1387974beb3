import random

from odd import odd
from test_learned import label_frame, prose

from marketframe.llm import toxicity


def test_every_telling_term_is_kept_however_many(spark):
    """500 insults, each in few of the toxic rows: more terms than any fixed number of the commonest."""
    rng = random.Random(5)
    insults = sorted({"".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(12)) for _ in range(500)})
    docs, labels = [], []
    for i in range(1600):
        words, toxic = prose(rng, 30).split(), i % 4 == 0
        for k in range(15 * toxic):
            words.insert(rng.randrange(len(words) + 1), insults[(i // 4 * 15 + k) % len(insults)])
        docs.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(odd(spark, docs), label_frame(spark, labels))
    counted = [w for w in insults if w in model.lexicon.words]
    assert len(counted) > 0.95 * len(insults)
    assert set(model.lexicon.fuzzy) >= set(counted)
    assert all(model.lexicon.look_up("0" + w[1:])[0] == w for w in counted)
