"""Streaming aggregates: live metrics, volumes and repeated attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.fixed_values import MAX_ATTEMPTS
from ticketloom.operators.feedback import accepted_feedback
from ticketloom.operators.metrics import (
    RESOLVED_STATES,
    live_feedback_metrics,
    live_ticket_metrics,
)


def ticket_metrics(records: DataFrame) -> DataFrame:
    """One row of running totals; use output mode complete."""
    return live_ticket_metrics(records)


def feedback_metrics(feedback: DataFrame) -> DataFrame:
    """Running totals of the feedback that is not refused."""
    return live_feedback_metrics(accepted_feedback(feedback))


def volume(tickets: DataFrame, delay: str = "1 day", size: str = "1 day",
           resolved: Sequence[str] = RESOLVED_STATES) -> DataFrame:
    """(day, received, resolved) in tumbling event-time windows.

    Tickets later than the delay are dropped once their window is closed.
    Mode append gives closed windows only, update and complete all of them.
    """
    done = F.lower(F.coalesce(F.col("status"), F.lit(""))).isin(*resolved)
    timed = tickets.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", delay).groupBy(
        F.window("created_at", size)).agg(
        F.count("*").alias("received"), F.count_if(done).alias("resolved")).select(
        F.to_date("window.start").alias("day"), "received", "resolved")


def repeated_attempts(tickets: DataFrame, least: int = MAX_ATTEMPTS) -> DataFrame:
    """(employee_name, attempts, too_many); counters are the only state kept per user."""
    return tickets.groupBy("employee_name").agg(F.count("*").alias("attempts")).withColumn(
        "too_many", F.col("attempts") >= least)
