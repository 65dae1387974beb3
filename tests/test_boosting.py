import numpy as np
import pandas as pd
import pytest

from marketframe.operators import boosting, model

SETTINGS = {**model.TREES, "maxIter": 6, "maxDepth": 3}


def data(n=700, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9))
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0) ^ (x[:, 1] + 0.3 * x[:, 2] > 0.2)) | (rng.random(n) < 0.1)
    x[rng.random(x.shape) < 0.05] = np.nan
    return pd.DataFrame(x, columns=[f"c{k}" for k in range(9)]).assign(target=y.astype(int))


def brute_tree(bins, rows, g, h, columns, depth, node=0, out=None):
    """Split the rows themselves, node by node, trying every column and bin."""
    out = {} if out is None else out
    total = (sum(g[rows]), sum(h[rows]))
    unit, ridge = boosting.UNIT, boosting.RIDGE
    score = lambda a, b: (a / unit) ** 2 / (b / unit + ridge)
    best = (1e-6, None)
    for c in columns if depth else []:
        for b in range(boosting.BINS - 1):
            left = rows[bins[c, rows] <= b]
            a, w = sum(g[left]), sum(h[left])
            if w / unit < 1 or (total[1] - w) / unit < 1:
                continue
            gain = score(a, w) + score(total[0] - a, total[1] - w) - score(*total)
            if gain > best[0] + 1e-12:
                best = (gain, (int(c), b))
    out[node] = (*(best[1] or (-1, 0)), -SETTINGS["stepSize"] * total[0] / (total[1] + ridge * unit))
    if best[1]:
        c, b = best[1]
        brute_tree(bins, rows[bins[c, rows] <= b], g, h, columns, depth - 1, 2 * node + 1, out)
        brute_tree(bins, rows[bins[c, rows] > b], g, h, columns, depth - 1, 2 * node + 2, out)
    return out


def test_trees_equal_brute_force():
    pdf = data(300)
    names = list(pdf.columns[:-1])
    edges = [sorted(set(pdf[c].quantile(np.arange(1, 32) / 32, interpolation="lower"))) for c in names]
    shell = boosting.BoostedTrees(names, [float(pdf[c].mean()) for c in names], edges, [])
    bins, y = shell.binned(pdf[names].to_numpy()), pdf.target.to_numpy(float)
    keys = np.arange(300, dtype=np.uint64) * np.uint64(7919)
    margin = np.zeros(300)
    for no, tree in enumerate(boosting.grown_in_one_task(bins, y, keys, SETTINGS)):
        g, h = boosting.slopes(margin, y)
        seen = np.flatnonzero(boosting.sampled(keys, 42, no, 0.8))
        want = brute_tree(bins, seen, g, h, boosting.columns_of(9, 42, no, 0.8), 3)
        got = {int(i): (int(tree.feature[i]), int(tree.bin[i]) if tree.feature[i] >= 0 else 0, tree.value[i]) for i in np.flatnonzero(tree.feature > -2)}
        assert set(got) == set(want) and all(got[i][:2] == want[i][:2] and abs(got[i][2] - want[i][2]) < 1e-9 for i in want)
        margin += tree.value[tree.nodes(bins)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(data()).repartition(3)
    names = [f"c{k}" for k in range(9)]
    return rows, names, boosting.fit(rows, names, SETTINGS)


def test_many_row_groups_give_the_same_trees(spark, fitted, monkeypatch):
    """Levels merged over four groups by Spark, sums of all trees rewritten every second tree."""
    rows, names, one = fitted
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    monkeypatch.setattr(boosting, "MERGED", 3)
    many = boosting.fit(rows, names, SETTINGS, group=200)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value, rtol=0, atol=1e-12)


def test_it_learns_and_survives_files(spark, fitted, tmp_path):
    rows, names, one = fitted
    strong = boosting.fit(rows, names, {**SETTINGS, "maxIter": 60, "stepSize": 0.2})
    scored = model.predict(strong, rows, names)
    report = model.binary_report(scored).first()
    assert report.accuracy > 0.85 and model.roc_auc(scored) > 0.9
    assert {r.feature for r in model.feature_importance(strong, names, 2).collect()} == {"c0", "c1"}
    assert abs(strong.importances().sum() - 1) < 1e-9
    strong.save(str(tmp_path / "m"))
    again = boosting.BoostedTrees.load(str(tmp_path / "m"))
    a, b = (model.predict(m, rows, names).select("target", "prob_up").toPandas() for m in (strong, again))
    assert np.allclose(np.sort(a.prob_up), np.sort(b.prob_up), rtol=0, atol=1e-12)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1.0, None, 0), (1.0, None, 1), (None, None, 1)], "a double, b double, target int")
    odd = boosting.fit(rows, ["a", "b"], SETTINGS)
    assert all((t.feature[1:] == -2).all() for t in odd.trees)
    none = boosting.fit(rows.limit(0), ["a", "b"], SETTINGS)
    assert {r.prob_up for r in model.predict(none, rows, ["a", "b"]).collect()} == {0.5}


def test_roc_auc_is_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"prob_up": np.round(rng.random(800), 2), "target": rng.integers(0, 2, 800)})
    pdf.loc[::50, "prob_up"] = np.nan
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "prob_up double, target int")
    p, n = (pdf[pdf.target == k].prob_up.dropna().to_numpy() for k in (1, 0))
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert abs(model.roc_auc(rows.repartition(5)) - want) < 1e-12
    assert model.roc_auc(rows.where("target = 1")) is None


def test_column_summaries(spark):
    """Exact below the number of points, else within a few ranks of a thousand, in parts that meet in any order."""
    from marketframe.operators.quantiles import column_summaries

    pdf = data(5000)
    pdf["none"] = np.nan
    rows = spark.createDataFrame(pdf).repartition(4)
    names = [*pdf.columns[:4], "none"]
    for points, off in ((8000, 0.0002), (256, 0.01)):
        got = column_summaries(rows, names, [0.0, 0.25, 0.5, 0.75, 1.0], points)
        assert set(got) == {0, 1, 2, 3}
        for k in got:
            x = np.sort(pdf[names[k]].dropna().to_numpy())
            n, mean, at = got[k]
            assert n == len(x) and abs(mean - x.mean()) < 1e-9
            for share, v in zip([0.0, 0.25, 0.5, 0.75, 1.0], at):
                low, high = np.searchsorted(x, v, "left") / n, np.searchsorted(x, v, "right") / n
                assert low - off <= share <= high + off
