import random
from collections import Counter

import numpy as np
import test_learned
import test_linededup
from odd import CLASHING
from pyspark.sql import functions as F

import corpus_pipeline
from marketframe.llm import mixing, packing, queries, quality, simhash, tokens
from marketframe.llm.common import forest


def test_stages_equal_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows, labels = test_learned.corpus(3, 300)
    rows = [(i, t, rng.choice(["a", "b", "c", None])) for i, t, _ in rows]
    rows += [(300 + k, rows[k][1] + "\n" + " ".join(f"p{j}" for j in range(60)), "a") for k in range(1, 60) if k % 5]
    rows += [(400, None, "a"), (401, "", "b"), (None, "Some prose with no id at all.", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    test_learned.label_frame(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))

    model = quality.fit(docs, test_learned.label_frame(spark, labels))
    kept = [r for r in rows if model.scores([r[1] or ""])[0] >= quality.KEEP]
    assert 100 < len(kept) < len(rows)
    cut = test_linededup.brute(kept)
    kept = [(i, None if t is None else cut[(i is None, i or 0, t)], s) for i, t, s in kept]
    fps = np.array([simhash.fingerprint(t) for _, t, _ in kept], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    best = {}
    for root, r in zip(forest(a, b, len(fps)), kept, strict=True):
        best[root] = min(best.get(root, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    kept = list(best.values())
    mixed = mixing.mix(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()
    times = {r.doc_id: r.times for r in mixed}
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    want = Counter()
    for i, t, _ in kept:
        n = len(tokens.byte_bpe(path).encode(t or "", allowed_special="all")) + 1
        for at in range(0, n, packing.WINDOW):
            want[(i, at, min(packing.WINDOW, n - at))] += times[i]
    got = Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs, labels = test_learned.corpus(5, 60)
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    docs = docs.withColumns({c: F.lit("clash") for c in CLASHING})
    test_learned.label_frame(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert stage(spark, docs.select("doc_id", "text", "source", "lang", "n_chars"), str(tmp_path)).count() > 0


def test_registry():
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "packing"]
