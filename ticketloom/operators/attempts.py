"""How often a user has asked before, at the time of each ticket: in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticketloom.functions.fixed_values import MAX_ATTEMPTS


def attempts_before(tickets: DataFrame, user: str = "employee_name", time: str = "created_at",
                    key: str = "ticket_id", bucket: str = "hour") -> DataFrame:
    """Tickets with `attempts`: the user's tickets before this one, in order of (time, key).

    Tickets are counted per time bucket first. A running sum over a user's buckets, one row
    each, is carried into the bucket, and only there are tickets put in order: so a user
    with a large share of all tickets is dealt out by time.
    """
    bucketed = tickets.withColumn("_bucket", F.date_trunc(bucket, F.col(time)))
    earlier = Window.partitionBy(user).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = bucketed.groupBy(user, "_bucket").agg(F.count("*").alias("_n")).select(
        F.col(user).alias("_user"), F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(user, "_bucket").orderBy(time, key)
    placed = bucketed.withColumn("_place", F.row_number().over(inside) - 1)
    joined = placed.join(carried, F.col(user).eqNullSafe(F.col("_user"))
                         & F.col("_bucket").eqNullSafe(F.col("_at")))
    return joined.withColumn("attempts", F.col("_before") + F.col("_place")).drop(
        "_bucket", "_user", "_at", "_before", "_place")


def too_many(attempts: str = "attempts", least: int = MAX_ATTEMPTS):
    return F.col(attempts) >= least


def stream_attempts(tickets: DataFrame, user: str = "employee_name", time: str = "created_at",
                    key: str = "ticket_id", delay: str = "1 day", forget_days: int = 365) -> DataFrame:
    """(user, key, attempts) of a stream of tickets, append mode.

    State per user is one counter. Tickets of a batch are counted in order of (time, key); a timer
    forgets a user who was quiet for so many days, so the state does not grow for ever.
    """
    timed = tickets.select(user, F.col(time).cast("timestamp").alias("_at"), key).withWatermark(
        "_at", delay)

    def count(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["_at", key], kind="stable")
        state.update((before + len(rows),))
        last = max(int(rows["_at"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + forget_days * 86_400_000)
        yield pd.DataFrame({user: keys[0], key: rows[key],
                            "attempts": range(before, before + len(rows))})

    kinds = dict(timed.dtypes)
    return timed.groupBy(user).applyInPandasWithState(
        count, f"{user} {kinds[user]}, {key} {kinds[key]}, attempts long", "n long", "append",
        GroupStateTimeout.EventTimeTimeout)
