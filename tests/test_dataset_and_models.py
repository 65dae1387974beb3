"""Headline data set, labels, splits, models, sources."""

import json

import numpy as np
import pandas as pd
import pytest
from bar_helpers import bars_frame, collect, to_spark
from pyspark.sql import functions as F

from catalog import tables as t
from marketframe.operators import articles as news
from marketframe.operators import headlines, model
from marketframe.operators.bars import build_bars, inf_to_null, normalize_columns, validate_timeseries
from marketframe.plans.assemble import assemble, feature_consistency, feature_correlation, metadata, simple_features
from marketframe.plans.profiles import feature_profile
from marketframe.plans.features import build_features
from marketframe.sources import tables as sources


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq bigint, text string")


def test_dedup_and_filter(spark):
    feed = texts(spark, [" Profit rises again today ", "PROFIT RISES AGAIN TODAY", "Watch This video of a bull", "short one", "fifteen chars!!"])
    got = headlines.dedup_headlines(feed).orderBy("seq").collect()
    assert [r.text for r in got] == ["Profit rises again today", "Watch This video of a bull", "short one", "fifteen chars!!"]
    assert [r.seq for r in headlines.filter_headlines(feed).orderBy("seq").collect()] == [0, 1, 4]
    assert [r.seq for r in headlines.drop_removed_titles(feed).orderBy("seq").collect()] == [0, 1, 2]


def test_gold_list(spark):
    gold = headlines.gold_examples(spark)
    assert gold.count() == 31
    assert {r.label: r["count"] for r in gold.groupBy("label").count().collect()} == {0: 15, 1: 13, 2: 3}
    copies = headlines.oversample_gold(gold)
    assert copies.count() == 93 and copies.select("text").distinct().count() == 31


def test_weak_label(spark):
    def load():
        def score(x):
            p = x.str.len() / 100
            return pd.DataFrame({"positive": p, "negative": (1 - p) * 0.9, "neutral": (1 - p) * 0.1})

        return score

    feed = texts(spark, ["x" * 70, "X" * 70, "y" * 64, "z" * 5])
    got = {r.text[0]: (r.label, r.confidence, r.source) for r in headlines.weak_label(feed, load).collect()}
    assert got == {"x": (0, 0.7, "auto"), "z": (1, 0.855, "auto")}


def test_stratified_split_is_exact(spark):
    rows = [(f"text {i}", 0 if i % 10 < 6 else 1 if i % 10 < 9 else 2) for i in range(230)] + [("only one", 3)]
    df = spark.createDataFrame(rows, "text string, label int")
    out = headlines.stratified_split(df).toPandas()
    assert len(out) == 231 and out.text.is_unique
    for label, n in out.groupby("label").size().items():
        split = out[out.label == label].groupby("split").size()
        n_test, n_val = max(1, int(n * 0.15)), max(1, int(n * 0.10))
        if n > 2:
            assert split["test"] == n_test and split["validation"] == n_val and split["train"] == n - n_test - n_val
    again = headlines.stratified_split(df.repartition(5)).toPandas()
    assert set(zip(out.text, out.split)) == set(zip(again.text, again.split))
    other = headlines.stratified_split(df, seed=7).toPandas()
    assert set(zip(out.text, out.split)) != set(zip(other.text, other.split))


def test_no_gold_sentence_in_two_splits(spark):
    auto = spark.createDataFrame([(f"headline {i}", i % 3, 0.8, "auto") for i in range(90)], "text string, label int, confidence double, source string")
    gold = headlines.gold_examples(spark)
    out = headlines.split_dataset(auto, gold).toPandas()
    assert (out.groupby("text").split.nunique() == 1).all()
    golden = out[out.source == "gold"].groupby(["split", "text"]).size()
    assert (golden["train"] == 3).all() and (golden["test"] == 1).all()
    copied = headlines.split_dataset(auto, gold, reference_order=True).toPandas()
    assert len(copied) == 90 + 93


def test_weights_and_distribution(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {r.label: r.weight for r in headlines.class_weights(df).collect()} == pytest.approx({0: 8 / 18, 1: 8 / 6, 2: 8 / 3})
    assert {r.label: (r.name, r.n, r.pct) for r in headlines.class_distribution(df).collect()} == {
        0: ("positive", 6, 75.0), 1: ("negative", 2, 25.0)}


def test_metrics(spark):
    rng = np.random.default_rng(0)
    label, pred = rng.integers(0, 2, 300), rng.integers(0, 3, 300)
    df = spark.createDataFrame(pd.DataFrame({"label": label, "prediction": pred.astype(float)}))
    got = {r["class"]: r for r in headlines.precision_recall_f1(df).collect()}
    for k in range(3):
        tp = int(((label == k) & (pred == k)).sum())
        p, r = tp / max(1, (pred == k).sum()), tp / max(1, (label == k).sum())
        assert (got[k].tp, got[k].fp, got[k].fn) == (tp, (pred == k).sum() - tp, (label == k).sum() - tp)
        assert got[k].precision == pytest.approx(round(p, 3)) and got[k].f1 == pytest.approx(2 * p * r / max(1e-9, p + r), abs=5e-4)
        assert got[k].accuracy == pytest.approx((label == pred).mean())


def test_gold_check(spark):
    gold = headlines.gold_examples(spark)
    predictions = gold.select("text", F.when(F.col("label") == 2, 0).otherwise(F.col("label")).alias("prediction"))
    assert headlines.gold_check(predictions, gold).first().gold_accuracy == pytest.approx(28 / 31)


def test_classifier_is_a_scorer(spark):
    up = [(f"profit beats record gain strong {i}", 0) for i in range(30)]
    down = [(f"loss misses weak decline cuts {i}", 1) for i in range(20)]
    same = [(f"company holds meeting calendar note {i}", 2) for i in range(10)]
    train = headlines.with_class_weight(spark.createDataFrame(up + down + same, "text string, label int"))
    fitted = model.headline_classifier().fit(train)
    rows = [("S", 1, "strong profit beats", None, "p", "2024-01-02"), ("S", 2, "weak loss, misses", None, "p", "2024-01-02")]
    scored = news.score_articles(spark.createDataFrame(rows, sources.ARTICLES), fitted).orderBy("seq").collect()
    assert [r.label for r in scored] == ["positive", "negative"] and scored[0].score > 0 > scored[1].score


def test_target_labels(spark):
    pdf = bars_frame("A", 50, 4)
    pdf["close"] = [10, 11, 11, 10.99, 12, *([12.0] * 45)]
    bars = to_spark(spark, pdf)
    got = collect(model.target_label(bars, 1))
    assert got.target[:5].tolist() == [1, 0, 0, 1, 0] and pd.isna(got.target[49])
    moved = collect(model.target_threshold(bars, 1, 0.003))
    assert moved.target.tolist() == [1, 1] and moved.close.tolist() == [10, 10.99]


def test_chronological_split(spark):
    pdf = pd.concat([bars_frame("A", 100, 1), bars_frame("B", 40, 2, "2001-03-01")])
    out = collect(model.chronological_split(to_spark(spark, pdf)))
    times = sorted(pdf.ts.unique())
    cut = times[int(0.8 * len(times))]
    assert ((out.split == "train") == (out.ts < cut)).all()


def test_train_predict_report(spark, panel):
    rows = simple_features(panel)
    inputs = ["ret_1d", "ret_5d", "ret_std_10d", "ret_1d_lag1"]
    fitted, early, late = model.train(rows, inputs, maxIter=2, maxDepth=2)
    assert early.agg(F.max("ts")).first()[0] < late.agg(F.min("ts")).first()[0]
    predictions = model.predict(fitted, late, inputs).cache()
    report = {r["class"]: r for r in model.binary_report(predictions).collect()}
    pdf = predictions.toPandas()
    assert report["UP"].support == (pdf.target == 1).sum()
    assert report["UP"].accuracy == pytest.approx((pdf.target == pdf.prediction).mean())
    cells = {r.target: (r.pred_down, r.pred_up) for r in model.confusion_matrix(predictions).collect()}
    assert sum(map(sum, cells.values())) == len(pdf)
    assert 0 <= model.roc_auc(predictions) <= 1
    top = model.feature_importance(fitted, inputs, 3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    last = model.predict_latest(fitted, rows, inputs).collect()
    assert {r.symbol for r in last} == {"AAA", "BBB"}
    for r in last:
        assert r.prob_up + r.prob_down == pytest.approx(1) and r.confidence == pytest.approx(max(r.prob_up, r.prob_down))


def test_assemble(spark, sf):
    out = assemble(t.bars_weekdays(spark, sf), t.articles(spark, sf), t.hash_scorer, modules=["sr_proximity"])
    assert {"sentiment_mean", "sentiment_ma7", "target", "range_pos_20"} <= set(out.columns) and "close" not in out.columns
    pdf = out.toPandas()
    assert len(pdf) > 50 and not pdf.isna().any().any() and set(pdf.target) <= {0, 1}
    meta = metadata(out).toPandas()
    assert meta.n_rows.sum() == len(pdf)


def test_profile_correlation_consistency(spark):
    pdf = pd.DataFrame({"symbol": "S", "x": [1.0, 2.0, np.inf, np.nan, 4.0], "y": [2.0, 4.0, 1.0, 1.0, 8.0]})
    df = spark.createDataFrame(pdf)
    x = feature_profile(df, ["x", "y"]).where("feature = 'x'").first()
    assert (x.n_missing, x.n_infinite, x.min, x.max) == (1, 1, 1.0, 4.0) and x["mean"] == pytest.approx(7 / 3)
    clean = inf_to_null(df)
    assert [r.x for r in clean.collect()] == [1.0, 2.0, None, None, 4.0]
    assert feature_correlation(clean, ["x", "y"]).where("a = 'x' and b = 'y'").first()["corr"] == 1.0
    both = {r.feature: (r.in_train, r.in_test) for r in feature_consistency(df, df.drop("y")).collect()}
    assert both == {"x": (1, 1), "y": (1, 0)}


def test_build_and_validate_bars(spark):
    ticks = spark.createDataFrame(
        [("S", "2024-01-01 10:05:00", 2, 5.0), ("S", "2024-01-01 10:01:00", 1, 7.0), ("S", "2024-01-01 10:59:00", 3, 6.0),
         ("S", "2024-01-01 12:00:00", 4, 1.0)], "s string, ts string, id int, price double")
    bars = build_bars(ticks, "s", F.col("ts").cast("timestamp_ntz"), F.col("price"), F.lit(1.0), "hour", F.col("id"))
    rows = bars.orderBy("ts").collect()
    assert [tuple(r)[2:] for r in rows] == [(7.0, 7.0, 5.0, 6.0, 3.0), (1.0, 1.0, 1.0, 1.0, 1.0)]
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
    report = validate_timeseries(bars.unionAll(bars.limit(1)), unit="hour").first()
    assert (report.n_bars, report.duplicate_times, report.missing_steps, report.is_valid) == (3, 1, 1, 0)
    assert normalize_columns(spark.range(1).toDF("Close.AAPL")).columns == ["close"]


def test_bar_files(spark, panel, tmp_path):
    for fmt in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / fmt)
        writer = panel.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
        back = sources.read_bars(spark, path, fmt, symbols=["AAA", "ONE"])
        assert back.count() == 331 and dict(back.dtypes)["ts"] == "timestamp_ntz"
    recent = sources.read_bars(spark, str(tmp_path / "parquet"), period="1 month").toPandas()
    assert recent.ts.min() >= panel.toPandas().ts.max() - pd.DateOffset(months=1)
    sources.write_bars(panel, str(tmp_path / "by_month"))
    stored = sources.read_bars(spark, str(tmp_path / "by_month"))
    assert stored.drop("month").select(panel.columns).exceptAll(panel).count() == 0
    sources.write_features(panel, str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).count() == panel.count()


def test_article_and_headline_files(spark, tmp_path):
    items = [
        {"symbol": "S", "seq": i, "title": f"t{i}", "description": None, "publisher": "p", "date": f"2024-01-{i + 1:02d}"}
        for i in range(20)
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, items)))
    got = sources.read_articles(spark, str(tmp_path / "a.json"), days_back=10, max_articles=5)
    assert sorted(r.seq for r in got.collect()) == [15, 16, 17, 18, 19]
    feed = [{"seq": 1, "content": {"title": "nested"}, "title": "flat"}, {"seq": 2, "title": "flat"}, {"seq": 3}]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, feed)))
    assert [r.text for r in sources.read_headlines(spark, str(tmp_path / "h.json")).orderBy("seq").collect()] == ["nested", "flat", ""]


def test_model_files(spark, panel, tmp_path):
    rows = simple_features(panel)
    fitted, _, late = model.train(rows, ["ret_1d", "ret_5d"], maxIter=1, maxDepth=1)
    sources.save_model(fitted, str(tmp_path / "m"))
    again = sources.load_model(str(tmp_path / "m"))
    a, b = (model.predict(m, late, ["ret_1d", "ret_5d"]).select("symbol", "ts", "prob_up") for m in (fitted, again))
    assert a.exceptAll(b).count() == 0


def test_no_sentence_in_two_splits_where_gold_and_weak_labels_overlap(spark):
    gold = spark.createDataFrame([(f"Sentence {i} of the list", i % 3) for i in range(40)], "text string, label int")
    weak = spark.createDataFrame(
        [(f"  sentence {i} OF the list ", 0, 0.9, "auto") for i in range(20)]
        + [(f"weak text number {i}", i % 3, 0.8, "auto") for i in range(100)],
        "text string, label int, confidence double, source string",
    )
    rows = headlines.split_dataset(weak, gold).toPandas()
    rows["key"] = rows.text.str.strip().str.lower()
    assert rows.groupby("key").split.nunique().max() == 1
    assert rows[rows.key.str.startswith("sentence")].source.eq("gold").all() and rows.key.nunique() == 140
    copies = rows[rows.source == "gold"].groupby("key").size()
    assert set(copies) == {1, headlines.GOLD_COPIES}


def test_training_keeps_nothing(spark, panel):
    panel.count()  # the fixture is cached with its first use
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = model.target_label(build_features(panel, modules=["returns"]))
    fitted, early, late = model.train(rows, ["ret_1d", "ret_5d"], maxIter=2)
    assert early.count() > late.count() > 0 and model.predict(fitted, late, ["ret_1d", "ret_5d"]).count() == late.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_gold_check_broadcasts_no_predictions(spark):
    gold = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "text string, label int")
    said = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("x", 2)], "text string, prediction int")
    assert tuple(headlines.gold_check(said, gold).first()) == (3, 1, 1 / 3)


def test_a_period_reads_its_months_only(spark, panel, tmp_path):
    from marketframe.sources.tables import read_bars, write_bars, write_features

    write_bars(panel, str(tmp_path / "bars"))
    recent = read_bars(spark, str(tmp_path / "bars"), period="2 months")
    assert recent.columns == panel.columns and 0 < recent.count() < panel.count()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    write_features(panel, str(tmp_path / "features"))
    assert not [x for x in (tmp_path / "features").iterdir() if x.is_dir()]
    assert spark.read.parquet(str(tmp_path / "features")).count() == panel.count()


def test_correlations_of_many_columns_with_missing_values(spark, panel):
    from marketframe.plans.assemble import feature_correlation

    df = build_features(panel, modules=["returns", "sr_proximity"])
    columns = ["close", "ret_1d", "ret_20d", "range_pos_20", "ret_skew_5d"]
    want = df.toPandas()[columns].corr()
    got = feature_correlation(df.repartition(3), columns).collect()
    assert len(got) == 15 and all(abs(r["corr"] - want.loc[r["a"], r["b"]]) <= 0.00051 for r in got)


def test_weeks_and_months(spark, panel):
    from marketframe.operators.bars import most_bars, validate_timeseries

    days = panel.select("ts").distinct()
    assert most_bars(days, "ts", "week") == 48 and most_bars(days, "ts", "month") == 11
    monthly = panel.where("symbol = 'AAA'").where("day(ts) = 1")
    assert validate_timeseries(monthly, unit="month").first()["missing_steps"] == 0
