import pandas as pd

from marketframe.operators.articles import align_to_trading_day, score_texts


def test_articles_of_one_symbol_do_not_meet_in_one_task(spark):
    """Dealt by symbol alone, all articles of a symbol were read by one task, here by the join and after it."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        bars = spark.sql("SELECT 'S' AS symbol, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(2 * id AS int)) AS ts FROM range(10)")
        articles = spark.sql("SELECT 'S' AS symbol, id AS seq, date_format(date_add(date'2023-12-28', cast(id % 20 AS int)), 'yyyy-MM-dd') AS date FROM range(4000)")
        out = align_to_trading_day(articles, bars)
        sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 4000 and max(sizes) < 2500
        days = {r.date: str(r.trading_day) for r in out.select("date", "trading_day").distinct().collect()}
        assert days["2023-12-28"] == "2024-01-01" and days["2024-01-02"] == "2024-01-03" and len(days) == 20
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_texts_are_scored_some_at_a_time(spark):
    """What a task sends back comes in small batches, whatever the size of those it gets."""

    def scorer():
        def score(texts):
            assert len(texts) <= 32
            return pd.DataFrame({"positive": texts.str.len() / 100, "negative": 0.0, "neutral": None}, dtype="float64").reset_index(drop=True)

        return score

    texts = spark.range(3000).selectExpr("cast(id AS string) AS text_key", "repeat('x', cast(id % 90 AS int)) AS text")
    scored = score_texts(texts, scorer, partitions=1, carry_text=True)

    rows = scored.collect()
    assert len(rows) == 3000 and all(r.positive == len(r.text) / 100 == int(r.text_key) % 90 / 100 and r.neutral is None for r in rows)
    assert "MapInArrow" in scored._jdf.queryExecution().executedPlan().toString()
