import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import (
    classification,
    clean,
    feedback,
    metrics,
    outbox,
    profile,
    sampling,
)
from ticketloom.operators.skew import running_number, spread_join
from ticketloom.sources import schemas, tables

NOON = dt.datetime(2024, 1, 1, 12)


def test_profile_of_rows_with_nulls_and_copies(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 1.0), (1, "a", None)]
    df = spark.createDataFrame(rows, "x int, y string, z double")
    assert profile.duplicate_rows(df).first()[0] == 2
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("x", 0), ("y", 1), ("z", 3)}
    assert {tuple(r) for r in profile.distinct_counts(df).collect()} == {
        ("x", 2), ("y", 1), ("z", 1)}
    assert tuple(profile.shape(df).first()) == (4, 3)
    assert [r["column_name"] for r in profile.column_names(df).collect()] == ["x", "y", "z"]
    assert profile.first_rows(df, "x", 2).count() == 2


def test_keep_first_and_running_number(spark):
    rows = [(o, "c", f"s{o % 7}", str(o)) for o in range(100, 0, -3)]
    df = spark.createDataFrame(rows, "ord long, category string, subcategory string, p string")
    first = profile.keep_first(df, ["category", "subcategory"], "ord")
    numbered = running_number(first, "ord", "id").orderBy("id").collect()
    assert [r["id"] for r in numbered] == list(range(1, 8))
    assert [r["ord"] for r in numbered] == sorted(r["ord"] for r in numbered)
    assert {r["ord"] for r in numbered} == {
        min(o for o, _, s, _ in rows if s == f"s{k}") for k in range(7)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_keeps_rows_of_a_hot_key(spark, how):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = spark.range(3000).select("id", F.when(
            F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"))
        side = facts.where("id % 2 = 0").select("key").distinct().withColumn(
            "value", F.length("key"))
        joined = spread_join(facts, side, ["key"], "key", ["id"], how)
        plain = facts.join(side, "key", how).select(joined.columns)
        assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_metrics_of_empty_tables(spark):
    no_metrics = spark.createDataFrame([], schemas.METRICS)
    no_tickets = spark.createDataFrame([], schemas.TICKETS)
    row = metrics.dashboard(no_tickets, no_metrics).first()
    assert row["total_tickets"] == row["evaluated_tickets"] == 0
    assert row["ai_resolution_rate"] == row["customer_satisfaction"] == 0
    assert row["classification_accuracy"] is None
    live = metrics.live_ticket_metrics(
        no_metrics.withColumn("response_time", F.lit(0.0))).first()
    assert live["classification_accuracy"] == 0 and live["average_resolution_time"] == 0
    assert metrics.live_feedback_metrics(
        spark.createDataFrame([], "resolved boolean, rating double")).first()[1] == 0
    assert tables.retrieval_accuracy(
        spark.createDataFrame([], "correct string")).first()["retrieval_accuracy"] is None


def test_averages_differ_as_specified(spark):
    rows = [(True, 2.0, 0.0, 4.0), (None, 0.0, 3.0, None), (False, None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "flag boolean, t double, a double, r double")
    row = df.agg(metrics.rate("flag").alias("rate"), metrics.positive_average("t").alias("pos"),
                 metrics.mean_over_all("t").alias("all"), metrics.nonzero_average("a").alias("a"),
                 metrics.known_accuracy("flag").alias("known")).first()
    assert row["rate"] == pytest.approx(100 / 3) and row["known"] == 50.0
    assert (row["pos"], row["a"]) == (2.0, 2.0) and row["all"] == pytest.approx(2 / 3)


def test_weekly_volume_fills_days(spark):
    rows = [(dt.datetime(2024, 1, 3, 23, 59), "Closed"), (dt.datetime(2024, 1, 7), "open"),
            (dt.datetime(2024, 1, 8), "Closed"), (dt.datetime(2023, 12, 31), "Closed")]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, status string")
    week = metrics.weekly_volume(df, dt.datetime(2024, 1, 4)).orderBy("day").collect()
    assert [(r["received"], r["resolved"]) for r in week] == [
        (0, 0), (0, 0), (1, 1), (0, 0), (0, 0), (0, 0), (1, 0)]
    assert [r["day_name"] for r in week][0] == "Monday"


def brute_feedback(given, records):
    ratings = {r[0]: None for r in records}
    done, targets = set(), {}
    for key, when, ticket, resolved, rating in sorted(given, key=lambda g: (g[1], g[0])):
        seen = [r for r in records if r[2] <= when]
        own = [r for r in seen if r[1] == ticket]
        chosen = max(own or seen, default=None)
        targets[key] = chosen[0] if chosen else None
        if chosen:
            ratings[chosen[0]] = rating
            if resolved:
                done.add(chosen[1])
    return targets, ratings, done


def test_feedback_equals_brute_force(spark):
    rng = random.Random(5)

    def when():
        return NOON + dt.timedelta(seconds=rng.randint(0, 400))

    # A third of all feedback is about ticket 1, which also has many records.
    records = [(i, 1 if rng.random() < 0.4 else rng.randint(2, 9), when()) for i in range(60)]
    given = [(i, when(), rng.choice([1, 1, 2, 3, 8, 77, None]), rng.random() < 0.4,
              rng.choice([None, 1.0, 3.0, 5.0])) for i in range(200)]
    given.append((900, NOON - dt.timedelta(hours=1), 1, True, 2.0))
    metric_rows = spark.createDataFrame(
        [(i, t, w, None) for i, t, w in records],
        "metric_id long, ticket_id long, created_at timestamp_ntz, customer_rating double")
    asked = spark.createDataFrame(
        given, "feedback_id long, feedback_ts timestamp_ntz, ticket_id long, resolved boolean, "
        "rating double")
    targets = feedback.feedback_targets(asked, metric_rows)
    wanted, ratings, done = brute_feedback(given, records)
    assert {r["feedback_id"]: r["metric_id"] for r in targets.collect()} == wanted
    rated = feedback.rate_metrics(metric_rows, targets)
    assert {r["metric_id"]: r["customer_rating"] for r in rated.collect()} == ratings
    assert {r[0] for r in feedback.resolved_tickets(metric_rows, targets).collect()} == done


def test_blank_rating_overwrites(spark):
    records = spark.createDataFrame(
        [(1, 1, NOON, 4.0)],
        "metric_id long, ticket_id long, created_at timestamp_ntz, customer_rating double")
    given = spark.createDataFrame(
        [(1, NOON, "1", "yes", "5"), (2, NOON, "1", "no", ""), (3, NOON, "1", "yes", "9")],
        "feedback_id long, feedback_ts timestamp_ntz, ticket_id string, resolved string, "
        "rating string")
    tickets = spark.createDataFrame([(1, "Open")], "ticket_id long, status string")
    changed, rated = feedback.apply_feedback(given, tickets, records)
    assert changed.first()["status"] == "Customer Resolved"
    assert rated.first()["customer_rating"] is None


def test_required_text_and_audit(spark):
    df = spark.createDataFrame([(1, " x "), (2, "\t \n"), (3, None)], "id int, description string")
    accepted, rejected = clean.split_required(df)
    assert [tuple(r) for r in accepted.collect()] == [(1, "x")]
    assert clean.audit(accepted, rejected).where("error is null").count() == 1
    assert rejected.count() == 2


def test_customer_cleaning(spark):
    rows = [("N", "e", "Re: VPN!", "It's down.", None, "Net")] * 3
    df = spark.createDataFrame(rows, schemas.CUSTOMER_TICKETS)
    done = clean.clean_customer_tickets(df).collect()
    assert len(done) == 1 and "Customer Name" not in done[0].asDict()
    assert done[0]["customer_query"] == "re vpn its down" and done[0]["Resolution"] == ""


def test_classification_report(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(pairs, "y string, p string")
    rows = {r["label"]: r for r in classification.classification_report(df, "y", "p").collect()}
    assert rows["accuracy"]["f1"] == 0.6 and rows["c"]["precision"] == 0.0
    assert rows["b"]["precision"] == pytest.approx(2 / 3, abs=1e-6)
    assert rows["weighted avg"]["recall"] == pytest.approx(0.6)
    assert rows["macro avg"]["support"] == 5


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise(
        "often").alias("label"))
    sample = sampling.balanced_sample(df, "label", "id", 60)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {
        "rare": 60, "often": 60}
    again = sampling.balanced_sample(df.repartition(7), "label", "id", 60)
    assert sample.exceptAll(again).isEmpty()
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, "label", "id", 101)
    split = sampling.stratified_split(df, "label", "id")
    counts = {(r["label"], r["part"]): r["count"]
              for r in split.groupBy("label", "part").count().collect()}
    assert counts == {("rare", "test"): 20, ("rare", "train"): 80,
                      ("often", "test"): 180, ("often", "train"): 720}


def test_tracker_priority(spark):
    records = spark.createDataFrame([("P1",), ("P2",), ("P4",), ("odd",)], "priority string")
    offered = spark.createDataFrame(
        [("1", "Highest"), ("2", "P2"), ("9", "High"), ("4", "Low")], "id string, name string")
    got = {r["priority"]: (r["tracker_id"], r["tracker_name"])
           for r in outbox.tracker_priority(records, offered).collect()}
    assert got == {"P1": ("1", "Highest"), "P2": ("2", "P2"), "P4": ("4", "Low"),
                   "odd": ("4", "Low")}
    few = outbox.tracker_priority(records, offered.where("id = '9'"))
    assert {r["priority"]: r["tracker_name"] for r in few.collect()} == {
        "P1": None, "P2": "High", "P4": None, "odd": None}


def test_plans(spark, sf_dir):
    from ticketloom.plans import queries
    recent = queries.recent_tickets(spark, sf_dir)._jdf.queryExecution().executedPlan()
    assert "TakeOrderedAndProject" in recent.toString()
    first = queries.first_rows_per_category(spark, sf_dir)._jdf.queryExecution().executedPlan()
    assert "WindowGroupLimit" in first.toString()
    summary = queries.dashboard_summary(spark, sf_dir)._jdf.queryExecution().executedPlan()
    text = summary.toString()
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text
    assert "props" not in text  # columns that are not used are not read


def test_low_cardinality_is_exact_at_the_limit(spark):
    df = spark.range(500).select(
        (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).alias("more"), "id",
        F.when(F.col("id") % 2 == 0, "x").alias("half"))
    got = profile.low_cardinality_values(df).groupBy("column_name").agg(
        F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    assert {tuple(r) for r in got} == {("twenty", 20, 500), ("half", 1, 250)}
