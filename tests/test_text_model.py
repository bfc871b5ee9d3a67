"""The classifier with its vocabulary as a table, and joins that split both sides."""

import random

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import model, skew, text_model


def test_it_predicts_like_the_pipeline(spark, tmp_path):
    rng = random.Random(2)
    words = {"a": "printer tray paper", "b": "vpn tunnel gateway", "c": "mail inbox sender"}
    rows = [(i, " ".join(rng.choices((words[k] + " the status page is very slow").split(), k=6)), k)
            for i, k in enumerate(rng.choices("abc", k=150))]
    train = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    one = model.train_classifier(train, "text", "label")
    two = text_model.TextClassifier.fit(train, "id", "text", "label")
    two.save(str(tmp_path / "m"))
    two = text_model.TextClassifier.load(spark, str(tmp_path / "m"))
    asked = spark.createDataFrame(
        [(i, t) for i, t in enumerate([r[1] for r in rows[:60]] + [None, "", "unknown words"])],
        "id long, text string")
    got = {r.id: r.predicted for r in two.predict(asked, "id", "text").collect()}
    want = {r.id: r.predicted for r in model.predict(asked, one, "text").collect()}
    assert got == want and len(got) == 63
    assert two.terms.count() == len(one.stages[2].vocabulary)


def test_the_most_frequent_terms_are_kept(spark):
    train = spark.createDataFrame([(1, "aa aa bb cc", "x"), (2, "bb dd", "y")],
                                  "id long, text string, label string")
    fitted = text_model.TextClassifier.fit(train, "id", "text", "label", max_terms=3)
    assert [(r.term, r.number) for r in fitted.terms.orderBy("number").collect()] == [
        ("aa", 0), ("bb", 1), ("cc", 2)]


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    calls = []
    rows = text_model.term_counts
    monkeypatch.setattr(text_model, "term_counts", lambda *a, **k: calls.append(1) or rows(*a, **k))
    train = spark.createDataFrame([(1, "aa bb", "x"), (2, "cc", "y")],
                                  "id long, text string, label string")
    text_model.TextClassifier.fit(train, "id", "text", "label")
    assert calls == [1]


@pytest.mark.parametrize("hot", [True, False])
def test_both_sides_of_a_hot_key_are_split(spark, hot):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        share = 0.6 if hot else 0.0
        facts = spark.range(900).select(
            F.col("id").alias("q"), F.when(F.col("id") < 900 * share, "hot").otherwise(
                (F.col("id") % 50).cast("string")).alias("t"))
        side = spark.range(600).select(
            F.col("id").alias("d"), F.when(F.col("id") < 600 * share, "hot").otherwise(
                (F.col("id") % 50).cast("string")).alias("t"))
        got = skew.spread_join(facts, side, ["t"], "t", ["q"], side_salt_by=["d"], spread=4)
        want = facts.join(side, "t")
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and got.count() == want.count()
        with pytest.raises(ValueError, match="inner"):
            skew.spread_join(facts, side, ["t"], "t", ["q"], "left", side_salt_by=["d"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
