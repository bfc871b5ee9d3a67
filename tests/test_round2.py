"""Refusals, batch order, exact limits and sparse ids."""

import random

from pyspark.sql import functions as F

from ticketloom.operators import feedback, profile
from ticketloom.operators.skew import running_number
from ticketloom.sources import schemas, tables
from ticketloom.streaming import upserts


def test_append_returns_what_it_refuses(spark, tmp_path):
    given = spark.createDataFrame([(1, "a"), (2, None)], "ticket_id long, description string")
    refused = tables.append_tickets(given, str(tmp_path / "t"))
    assert [r["ticket_id"] for r in refused.collect()] == [2]
    stored = tables.read_table(spark, str(tmp_path / "t"), schemas.TICKETS)
    assert [r["ticket_id"] for r in stored.collect()] == [1]


def test_unreadable_metric_values_get_their_default(spark, tmp_path):
    given = spark.createDataFrame(
        [(1, 1, "abc", "yes"), (2, 2, "1.5", "maybe")],
        "metric_id long, ticket_id long, resolution_time string, escalated string")
    tables.append_metrics(given, str(tmp_path / "m"))
    rows = tables.read_table(spark, str(tmp_path / "m"), schemas.METRICS).orderBy("metric_id").collect()
    assert [(r["resolution_time"], r["escalated"]) for r in rows] == [(0.0, True), (1.5, False)]


def test_order_of_feedback_batches_does_not_matter(spark):
    metrics = spark.sql("""SELECT id AS metric_id, id AS ticket_id,
        timestamp_ntz'2024-01-01' AS created_at, cast(NULL AS double) AS customer_rating
        FROM range(5)""")
    given = spark.sql("""SELECT id AS feedback_id, timestamp_ntz'2024-01-02' +
        make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS feedback_ts,
        cast(id % 5 AS string) AS ticket_id, 'no' AS resolved,
        cast(1 + id * 7 % 5 AS string) AS rating FROM range(40)""")

    def rated(metrics, batch):
        targets = feedback.feedback_targets(feedback.accepted_feedback(batch), metrics)
        return spark.createDataFrame(feedback.rate_metrics(metrics, targets).collect(), schema)

    at_once = feedback.rate_metrics(metrics, feedback.feedback_targets(
        feedback.accepted_feedback(given), metrics))
    schema = at_once.schema
    wanted = sorted(at_once.collect())
    for seed in (1, 2):
        parts = [given.where(F.col("feedback_id") % 3 == k) for k in range(3)]
        random.Random(seed).shuffle(parts)
        table = metrics.withColumn("rating_mark", F.lit(None).cast(
            schema["rating_mark"].dataType))
        for part in [*parts, parts[0]]:
            table = rated(table, part)
        assert sorted(table.collect()) == wanted


def test_days_are_written_once_over_the_table_they_are_read_from(spark, tmp_path, monkeypatch):
    written, materialise = [], upserts.materialise
    monkeypatch.setattr(upserts, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    path = str(tmp_path / "t")
    spark.range(3000).selectExpr("id", "0 AS n", "concat('d', id % 5) AS day").write.partitionBy(
        "day").parquet(path)
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "day=d0").glob("*.parquet")}
    days = spark.createDataFrame([("d1",), ("d3",)], "day string")
    for _ in range(2):
        stored = spark.read.parquet(path)
        total = stored.groupBy("day").agg(F.sum("n").alias("_all"))
        upserts.overwrite_days(stored.join(total, "day").withColumn(
            "n", F.col("n") + F.col("_all").cast("int") + 1).drop("_all"), path, days, "day")
    got = {(r.day, r.n): r["count"] for r in spark.read.parquet(path).groupBy("day", "n").count().collect()}
    assert got == {("d0", 0): 600, ("d1", 602): 600, ("d2", 0): 600, ("d3", 602): 600, ("d4", 0): 600}
    assert kept == {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "day=d0").glob("*.parquet")}
    assert written == []


def test_sparse_ids_are_numbered(spark):
    rng = random.Random(3)
    ids = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)})
    df = spark.createDataFrame([(i,) for i in ids], "ord long").repartition(5)
    rows = running_number(df, "ord", "n").orderBy("n").collect()
    assert [(r["ord"], r["n"]) for r in rows] == list(zip(ids, range(1, len(ids) + 1), strict=True))


def test_low_cardinality_beyond_the_proof_rows(spark):
    df = spark.range(5000).select(
        (F.col("id") % 20).alias("few"), F.least(F.col("id"), F.lit(20)).alias("many"),
        F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("late"))
    got = {r["column_name"] for r in profile.low_cardinality_values(df).collect()}
    assert got == {"few"}
