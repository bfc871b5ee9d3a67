"""Mergeable column summaries against counting everything."""

import random

from pyspark.sql import functions as F

from ticketloom.operators import summaries


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_merged_days_equal_the_whole(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice(["", "a", "b", None]), rng.randrange(21 if d == 3 else 5), d,
             rng.randrange(10 ** 6), None) for d in range(8) for _ in range(300)]
    df = spark.createDataFrame(
        rows, "day int, few string, burst int, steady int, many int, nothing string").repartition(5)
    stored = summaries.summarise(df, F.col("day"))
    parts = stored.collect()
    assert len(parts) == 8 * 6 and all(r.n_rows == 300 for r in parts)
    assert {r.part for r in parts if r.column_name == "burst" and r["values"] is None} <= {"3"}
    assert all(r["values"] is None for r in parts if r.column_name == "many")
    assert all(r["values"] == [] for r in parts if r.column_name == "nothing")
    merged, whole = (summaries.merged_values(s) for s in (stored, summaries.summarise(df)))
    got = sorted(map(tuple, merged.collect()))
    assert got == sorted(map(tuple, whole.collect()))
    want = set()
    for name in ("day", "few", "burst", "steady"):
        counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string")).count().collect()
        if len(counts) <= 20:
            want |= {(name, r[0], r[1]) for r in counts}
    assert set(got) == want
    counts = {r.column_name: r for r in summaries.merged_counts(stored).collect()}
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first()
    assert all(abs(counts[c].n_distinct - exact[c]) <= 0.05 * exact[c] for c in df.columns)
    assert all(r.n_rows == 2400 for r in counts.values())


def test_a_limit_is_exact_however_rows_are_dealt(spark):
    for n, kept in ((20, True), (21, False)):
        df = spark.range(400).select((F.col("id") % n).alias("v")).repartition(7)
        assert summaries.merged_values(summaries.summarise(df)).count() == (n if kept else 0)
    assert summaries.merged_values(summaries.summarise(spark.range(0))).collect() == []


def test_no_row_is_copied_per_column(spark):
    plan = plan_of(summaries.merged_values(summaries.summarise(spark.range(10).withColumn("b", F.lit(1)))))
    assert "Expand" not in plan and "Window" not in plan
