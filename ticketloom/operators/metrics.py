"""Operational metrics, each as one aggregate over its table.

Rounded columns are for display; the unrounded functions are exposed too, so
that they can be grouped or fed to further sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: ticket states that count as resolved in weekly volumes ---
RESOLVED_STATES = ["resolved", "closed", "customer resolved", "ai resolved"]
WEEK_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def rate(flag: str) -> Column:
    """Percentage of rows with the flag; unknown counts as no, no rows give 0."""
    return F.coalesce(
        100.0 * F.count_if(F.coalesce(F.col(flag), F.lit(False))) / F.nullif(
            F.count("*"), F.lit(0)), F.lit(0.0))


def positive_average(column: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(column) > 0, F.col(column))), F.lit(0.0))


def nonzero_average(column: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(column) != 0, F.col(column))), F.lit(0.0))


def mean_over_all(column: str) -> Column:
    """Sum over the number of rows, unknown counting as zero."""
    return F.coalesce(
        F.sum(F.coalesce(F.col(column), F.lit(0.0))) / F.nullif(F.count("*"), F.lit(0)),
        F.lit(0.0))


def known_accuracy(flag: str) -> Column:
    """Percentage of true values among the known ones; NULL when none is known."""
    return 100.0 * F.count_if(F.col(flag)) / F.nullif(F.count(flag), F.lit(0))


def ticket_counts(tickets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tickets.groupBy(*by).agg(
        F.count("*").alias("total_tickets"),
        F.count_if(F.lower("severity") == "critical").alias("critical_tickets"),
        F.count_if(F.lower("severity") == "high").alias("high_tickets"),
        F.count_if(F.col("status") == "Open").alias("open_tickets"))


def metric_summary(metrics: DataFrame, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Dashboard rates and averages of stored metrics, optionally per group."""
    def shown(value: Column, name: str) -> Column:
        return F.round(value, digits).alias(name)

    return metrics.groupBy(*by).agg(
        F.count("*").alias("evaluated_tickets"),
        F.count_if("escalated").alias("escalated_tickets"),
        shown(rate("ai_resolved"), "ai_resolution_rate"),
        shown(rate("resolution_success"), "resolution_success_rate"),
        shown(rate("kb_found"), "kb_coverage"),
        shown(positive_average("resolution_time"), "average_resolution_time"),
        shown(positive_average("ai_response_time"), "average_ai_response_time"),
        shown(positive_average("customer_rating"), "customer_satisfaction"),
        shown(known_accuracy("classification_correct"), "classification_accuracy"))


def dashboard(tickets: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: two one-row aggregates side by side."""
    one = F.lit(1).alias("one")
    return ticket_counts(tickets).select(one, "*").join(
        metric_summary(metrics).select(one, "*"), "one").drop("one")


def live_ticket_metrics(records: DataFrame, digits: int = 2) -> DataFrame:
    """Running totals of finished tickets; zeros count in the plain averages."""
    def shown(value: Column, name: str) -> Column:
        return F.round(value, digits).alias(name)

    return records.agg(
        F.count("*").alias("total_tickets"),
        F.count_if("escalated").alias("escalated_tickets"),
        shown(rate("ai_resolved"), "ai_resolution_rate"),
        shown(rate("resolution_success"), "resolution_success_rate"),
        shown(rate("kb_found"), "kb_coverage"),
        shown(F.coalesce(known_accuracy("classification_correct"), F.lit(0.0)),
              "classification_accuracy"),
        shown(mean_over_all("resolution_time"), "average_resolution_time"),
        shown(mean_over_all("response_time"), "average_response_time"),
        shown(nonzero_average("ai_response_time"), "average_ai_response_time"))


def live_feedback_metrics(feedback: DataFrame, digits: int = 2) -> DataFrame:
    """Running totals of accepted feedback(resolved boolean, rating double)."""
    return feedback.agg(
        F.count("*").alias("feedback_count"),
        F.round(rate("resolved"), digits).alias("feedback_resolution_rate"),
        F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), digits).alias("customer_satisfaction"))


def daily_volume(tickets: DataFrame, resolved: Sequence[str] = RESOLVED_STATES) -> DataFrame:
    """(day, received, resolved) by creation day."""
    done = F.lower(F.coalesce(F.col("status"), F.lit(""))).isin(*resolved)
    return tickets.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("received"), F.count_if(done).alias("resolved"))


def weekly_volume(tickets: DataFrame, as_of, resolved: Sequence[str] = RESOLVED_STATES,
                  ) -> DataFrame:
    """Monday to Sunday of the week holding the date `as_of`, days without tickets as 0.

    The range on the raw time column lets parquet skip other weeks.
    """
    spark = tickets.sparkSession
    monday = F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz")).cast("date")
    days = spark.range(7).select(
        F.date_add(monday, F.col("id").cast("int")).alias("day"),
        F.element_at(F.array(*[F.lit(name) for name in WEEK_DAYS]),
                     F.col("id").cast("int") + 1).alias("day_name"))
    created = F.col("created_at")
    week = tickets.where((created >= monday) & (created < F.date_add(monday, 7)))
    return days.join(daily_volume(week, resolved), "day", "left").select(
        "day", "day_name", F.coalesce("received", F.lit(0)).alias("received"),
        F.coalesce("resolved", F.lit(0)).alias("resolved"))


# --- Fixed values: columns of the recent-tickets list -----------------------
RECENT_COLUMNS = ["ticket_id", "employee_name", "department", "category", "severity",
                  "priority", "status", "created_at"]


def recent_tickets(tickets: DataFrame, n: int = 15) -> DataFrame:
    """The newest tickets by id; each task keeps only its own top n."""
    return tickets.select(*RECENT_COLUMNS).orderBy(F.desc("ticket_id")).limit(n)
