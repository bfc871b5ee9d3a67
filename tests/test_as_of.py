"""As-of lookup of the latest metric: three levels, stored marks, no task with all minutes."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import feedback
from ticketloom.sources import tables


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)

    def moment():
        return start + dt.timedelta(seconds=rng.choice([60, 7]) * rng.randrange(9 * 1440))

    values = [(rng.choice("ab"), moment(), rng.randrange(1000)) for _ in range(400)]
    asks = [(rng.choice("abc"), moment(), i) for i in range(300)]
    asks += [("a", ts, 1000 + i) for i, (_, ts, _) in enumerate(values[:40])]  # ties
    asks.append(("a", start - dt.timedelta(days=3), 5000))
    return values, asks, [
        spark.createDataFrame(values, "k string, ts timestamp_ntz, value long").repartition(4),
        spark.createDataFrame(asks, "k string, ts timestamp_ntz, id long").repartition(4)]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_latest_before_equals_looking_at_every_value(given, keys):
    values, asks, (value_rows, ask_rows) = given
    got = {r.id: r.latest for r in feedback.latest_before(ask_rows, value_rows, keys, "id").collect()}
    want = {i: max((v for own, at, v in values if at <= ts and (not keys or own == k)), default=None)
            for k, ts, i in asks}
    assert got == want


def test_with_marks_only_the_days_asked_for_are_needed(spark, given):
    values, asks, (value_rows, ask_rows) = given
    marks = feedback.day_marks(value_rows)
    some = ask_rows.where("day(ts) in (3, 5)")
    days = value_rows.where("day(ts) in (3, 5)")
    whole = feedback.latest_before(some, value_rows, [], "id")
    pruned = feedback.latest_before(some, days.select("ts", "value"), [], "id", marks=marks)
    assert sorted(whole.collect()) == sorted(pruned.collect())


def test_one_task_sees_days_only(given):
    _, _, (value_rows, ask_rows) = given
    plan = plan_of(feedback.latest_before(ask_rows, value_rows, [], "id"))
    tree = plan[:plan.index("\n(1) ")]
    assert tree.count("Window") == 3
    single = re.findall(r"\((\d+)\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]\s*\nArguments: SinglePartition", plan)
    assert len(single) == 1 and "_bucket" not in single[0][1] and "ts#" not in single[0][1]


def test_a_batch_reads_the_metrics_of_its_days(spark, tmp_path):
    metrics = spark.range(200).select(
        F.col("id").alias("metric_id"), F.col("id").alias("ticket_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int))").alias("created_at"))
    tables.append_rows(metrics, str(tmp_path / "metrics"))
    for part in range(2):  # stored in two goes, one of them marked twice
        feedback.extend_marks(metrics.where(F.col("metric_id") % 2 == part), str(tmp_path / "marks"))
    feedback.extend_marks(metrics.where("metric_id < 50"), str(tmp_path / "marks"))
    stored = spark.read.parquet(str(tmp_path / "metrics"))
    marks = feedback.read_marks(spark, str(tmp_path / "marks"))
    asked = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 4, 0, 30), None), (2, dt.datetime(2024, 1, 4, 7, 59), 9999),
         (3, dt.datetime(2023, 1, 1), None), (4, dt.datetime(2025, 1, 1), None),
         (5, dt.datetime(2024, 1, 9), 3)],
        "feedback_id long, feedback_ts timestamp_ntz, ticket_id long")
    targets = feedback.feedback_targets(asked, stored, marks)
    got = {r.feedback_id: r.metric_id for r in targets.collect()}
    assert got == {1: 72, 2: 79, 3: None, 4: 199, 5: 3}
    plain = {r.feedback_id: r.metric_id for r in feedback.feedback_targets(asked, stored).collect()}
    assert plain == got
    filters = [line for line in plan_of(targets).splitlines() if "PartitionFilters: [" in line]
    assert any("2024-01-04" in line or "19726" in line for line in filters)
