"""Customer feedback: parse, find the metric row it refers to, apply it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.functions import fixed_values as fixed
from ticketloom.functions.coercion import rating_accepted, rating_value, truth
from ticketloom.session import materialise

RATING_ERROR = "Invalid rating."
#: Days of a batch that are named in the scan's partition filter, at most; more are joined.
FEW_DAYS = 366
RATING_RANGE_ERROR = "Rating must be between 1 and 5."


def parse_feedback(feedback: DataFrame) -> DataFrame:
    """Typed feedback with an error text for records that are refused as a whole."""
    number = F.col("rating").try_cast("double")
    return feedback.select(
        "feedback_id", "feedback_ts",
        F.col("ticket_id").try_cast("bigint").alias("ticket_id"),
        truth(F.col("resolved"), "resolved").alias("resolved"),
        F.when(rating_accepted(F.col("rating")), rating_value(F.col("rating"))).alias("rating"),
        F.when(rating_accepted(F.col("rating")), F.lit(None))
        .when(number.isNull(), RATING_ERROR).otherwise(RATING_RANGE_ERROR).alias("error"))


def accepted_feedback(feedback: DataFrame) -> DataFrame:
    return parse_feedback(feedback).where(F.col("error").isNull()).drop("error")


def day_marks(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, value): the highest value(keys, ts, value) of each day."""
    return values.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))


def metric_marks(metrics: DataFrame) -> DataFrame:
    """(day, value): the latest metric of each day."""
    return day_marks(metrics.select(F.col("created_at").alias("ts"),
                                    F.col("metric_id").alias("value")))


def extend_marks(metrics: DataFrame, path: str) -> None:
    """Add the marks of newly stored metrics to a table of marks; a repeated call does no harm."""
    metric_marks(metrics).coalesce(1).write.mode("append").parquet(path)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("day date, value bigint").parquet(path).groupBy("day").agg(
        F.max("value").alias("value"))


def latest_before(asks: DataFrame, values: DataFrame, keys: Sequence[str], ask_id: str,
                  bucket: str = "minute", marks: DataFrame | None = None) -> DataFrame:
    """(ask_id, latest): per ask(keys, ts, ask_id) the highest value(keys, ts, value) so far.

    A value counts if it is not later than the ask. Three running maxima give it: over the days
    before, with one row per day (marks, by default of the values); over the buckets of the
    day; and inside the bucket. So no task sorts more than a day's buckets or a bucket's rows
    of a key, not even with no key at all. With marks, values need only hold the days of the asks.
    """
    def timed(df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.date_trunc(bucket, "ts")).withColumn(
            "_day", F.to_date("ts"))

    def carried(df: DataFrame, wanted: DataFrame, by: Sequence[str], order: str, name: str):
        """The highest value before each row(by, order) of wanted."""
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.unionByName(wanted, allowMissingColumns=True).groupBy(*by, order).agg(
            F.max("value").alias("value")).select(*by, order, F.max("value").over(before).alias(name))

    marks = day_marks(values, keys) if marks is None else marks
    values = timed(values).groupBy(*keys, "_day", "_bucket", "ts").agg(
        F.max("value").alias("value"))
    asks = timed(asks)
    events = values.withColumn("_ask", F.lit(None).cast("bigint")).unionByName(
        asks.select(*keys, "_day", "_bucket", "ts", F.col(ask_id).alias("_ask")),
        allowMissingColumns=True)
    # The default frame of an ordered window includes rows with an equal time.
    within = events.withColumn("_inside", F.max("value").over(
        Window.partitionBy(*keys, "_day", "_bucket").orderBy("ts")))
    day = [*keys, "_day"]
    buckets = carried(values.groupBy(*day, "_bucket").agg(F.max("value").alias("value")),
                      asks.select(*day, "_bucket").distinct(), day, "_bucket", "_today")
    days = carried(marks.select(*keys, F.col("day").alias("_day"), "value"),
                   asks.select(*day).distinct(), keys, "_day", "_before")
    asked = within.where(F.col("_ask").isNotNull())
    return asked.join(buckets, [*day, "_bucket"], "left").join(days, day, "left").select(
        F.col("_ask").alias(ask_id), F.greatest("_inside", "_today", "_before").alias("latest"))


def feedback_targets(feedback: DataFrame, metrics: DataFrame, marks: DataFrame | None = None,
                     day: str = "created_date") -> DataFrame:
    """Accepted feedback with metric_id: the ticket's latest metric so far, else the latest of all.

    Feedback given before any metric exists has no target and changes nothing. With marks
    (metric_marks of all metrics) the latest of all is looked for in the metrics of the
    feedback's own days only; a day column of the metrics prunes their partitions.
    """
    asks = feedback.withColumnRenamed("feedback_ts", "ts")
    values = metrics.select("ticket_id", F.col("created_at").alias("ts"),
                            F.col("metric_id").alias("value"))
    named = asks.where(F.col("ticket_id").isNotNull()).select("ticket_id", "ts", "feedback_id")
    asked = values.join(named.select("ticket_id").distinct(), "ticket_id", "left_semi")
    own = latest_before(named, asked, ["ticket_id"], "feedback_id").withColumnRenamed(
        "latest", "_own")
    found = materialise(feedback.join(own, "feedback_id", "left"), "feedback")
    lost = found.where(F.col("_own").isNull()).select(
        F.col("feedback_ts").alias("ts"), "feedback_id")
    if marks is not None:
        held = metrics if day in metrics.columns else metrics.withColumn(
            day, F.to_date("created_at"))
        days = materialise(lost.select(F.to_date("ts").alias(day)).distinct(), "feedback-days")
        few = [row[0] for row in days.limit(FEW_DAYS + 1).collect()]
        own_days = (held.where(F.col(day).isin(few)) if len(few) <= FEW_DAYS
                    else held.join(days, day, "left_semi"))
        values = own_days.select(
            F.col("created_at").alias("ts"), F.col("metric_id").alias("value"))
    newest = latest_before(lost, values.select("ts", "value"), [], "feedback_id", marks=marks)
    return found.join(newest, "feedback_id", "left").withColumn(
        "metric_id", F.coalesce("_own", "latest")).drop("_own", "latest")


def last_ratings(targets: DataFrame) -> DataFrame:
    """(metric_id, new_rating, new_mark): the last rating per metric; a blank one overwrites too.

    The mark says which feedback gave it: its time, then its id.
    """
    mark = F.struct("feedback_ts", "feedback_id")
    return targets.where(F.col("metric_id").isNotNull()).groupBy("metric_id").agg(
        F.max_by(F.struct("rating"), mark).alias("_last"), F.max(mark).alias("new_mark")).select(
        "metric_id", F.col("_last.rating").alias("new_rating"), "new_mark")


def rate_metrics(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics with the customer ratings of newer feedback written over them.

    rating_mark, added where it is missing, keeps the feedback that gave the rating.
    """
    changes = last_ratings(targets)
    if "rating_mark" not in metrics.columns:
        metrics = metrics.withColumn(
            "rating_mark", F.lit(None).cast(changes.schema["new_mark"].dataType))
    newer = F.col("new_mark").isNotNull() & (
        F.col("rating_mark").isNull() | (F.col("new_mark") > F.col("rating_mark")))
    return metrics.join(changes, "metric_id", "left").withColumn(
        "_newer", newer).withColumn("customer_rating", F.when(
            F.col("_newer"), F.col("new_rating")).otherwise(F.col("customer_rating"))).withColumn(
        "rating_mark", F.when(F.col("_newer"), F.col("new_mark")).otherwise(
            F.col("rating_mark"))).drop("new_rating", "new_mark", "_newer")


def resolved_tickets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """(ticket_id) of the metrics that any accepted feedback reports as resolved."""
    confirmed = targets.where(F.col("resolved") & F.col("metric_id").isNotNull()).select(
        "metric_id").distinct()
    return metrics.select("metric_id", "ticket_id").join(
        confirmed, "metric_id", "left_semi").select("ticket_id").distinct()


def resolve_tickets(tickets: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tickets with the confirmed ones marked; feedback never takes the mark back."""
    marked = resolved.withColumn("_resolved", F.lit(True))
    return tickets.join(marked, "ticket_id", "left").withColumn(
        "status", F.when(F.col("_resolved"), fixed.STATUS_CUSTOMER_RESOLVED).otherwise(
            F.col("status"))).drop("_resolved")


def apply_feedback(feedback: DataFrame, tickets: DataFrame, metrics: DataFrame,
                   ) -> tuple[DataFrame, DataFrame]:
    """(tickets, metrics) after all feedback; refused records have no effect."""
    targets = materialise(feedback_targets(accepted_feedback(feedback), metrics), "targets")
    return (resolve_tickets(tickets, resolved_tickets(metrics, targets)),
            rate_metrics(metrics, targets))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The latest metric row of each ticket, as an aggregate."""
    row = F.struct(*[F.col(name) for name in metrics.columns])
    return metrics.groupBy("ticket_id").agg(F.max_by(row, "metric_id").alias("_row")).select(
        "_row.*")
