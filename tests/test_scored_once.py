import pandas as pd

from marketframe.operators.headlines import gold_examples, split_dataset, weak_label


def test_a_split_scores_each_text_once(spark, tmp_path):
    path = str(tmp_path / "scored")

    def scorer():
        def score(texts):
            with open(path, "a") as f:
                f.write("x" * len(texts))
            return pd.DataFrame({"positive": [0.9] * len(texts), "negative": 0.1, "neutral": 0.0})

        return score

    feed = spark.range(200).selectExpr("id AS seq", "concat('a headline number ', id) AS text")
    out = split_dataset(weak_label(feed, scorer, partitions=2), gold_examples(spark), reference_order=True)
    assert out.where("source = 'auto'").count() == 200
    assert len(open(path).read()) == 200
