"""Outbox tables for issue trackers and mail: records to send, nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import fixed_values as fixed
from ticketloom.functions.text import strip

PRODUCT = "Help Desk"


def numbered(steps: Column) -> Column:
    """'1. first\\n2. second\\n...', '' without steps."""
    lines = F.transform(steps, lambda step, place: F.concat(
        (place + 1).cast("string"), F.lit(". "), step, F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def tracker_priority(records: DataFrame, available: DataFrame) -> DataFrame:
    """Add tracker_id and tracker_name from available(id, name), a tracker's short list.

    A priority of the same name wins over the usual mapping, unknown
    priorities map like P4, and both are NULL when neither name exists.
    """
    names = F.create_map(*[F.lit(text) for pair in fixed.TRACKER_PRIORITIES for text in pair])
    usual = F.coalesce(names[F.col("priority")], F.lit(dict(fixed.TRACKER_PRIORITIES)["P4"]))
    offered = available.groupBy("name").agg(F.min("id").alias("id"))
    same = offered.select(F.col("name").alias("priority"), F.col("id").alias("_same_id"))
    mapped = offered.select(F.col("name").alias("_usual"), F.col("id").alias("_usual_id"))
    return records.withColumn("_usual", usual).join(same, "priority", "left").join(
        mapped, "_usual", "left").withColumns({
            "tracker_id": F.coalesce("_same_id", "_usual_id"),
            "tracker_name": F.when(F.col("_same_id").isNotNull(), F.col("priority")).when(
                F.col("_usual_id").isNotNull(), F.col("_usual"))}).drop(
        "_usual", "_same_id", "_usual_id")


def escalation_outbox(triaged: DataFrame, available: DataFrame, project: str = "HELP",
                      product: str = PRODUCT) -> DataFrame:
    """(ticket_id, success, summary, description, payload) per escalated ticket.

    triaged(ticket_id, description, priority, diagnosis, agent_resolution,
    escalation) comes from the agent chain.  Tickets whose priority the
    tracker does not offer keep a row without a payload.
    """
    escalated = tracker_priority(triaged.where(F.col("escalation.escalate")), available)
    summary = F.concat(F.col("diagnosis.category"), F.lit(f" (handed over by {product})"))
    facts = F.concat_ws(
        " | ", F.concat(F.lit("diagnosed as "), F.col("diagnosis.diagnosis"), F.format_string(
            ", %.2f%% sure", F.col("diagnosis.confidence") * 100)),
        F.concat(F.lit("our priority "), F.col("priority")),
        F.concat(F.lit("filed as "), F.col("tracker_name")))
    body = F.concat(
        F.coalesce("description", F.lit("")), F.lit("\n\n"), facts, F.lit("\n\n"),
        F.col("agent_resolution.response"), F.lit("\n"),
        numbered(F.col("agent_resolution.steps")))
    offered = F.col("tracker_id").isNotNull()
    built = escalated.select(
        "ticket_id", "priority", "tracker_id", "tracker_name", summary.alias("summary"),
        body.alias("body"))
    text = F.struct(F.lit("text").alias("type"), F.col("body").alias("text"))
    paragraph = F.struct(F.lit("paragraph").alias("type"), F.array(text).alias("content"))
    document = F.struct(F.lit("doc").alias("type"), F.lit(1).alias("version"),
                        F.array(paragraph).alias("content"))
    fields = F.struct(
        F.struct(F.lit(project).alias("key")).alias("project"), F.col("summary"),
        document.alias("description"), F.struct(F.lit("Task").alias("name")).alias("issuetype"),
        F.struct(F.col("tracker_id").alias("id")).alias("priority"))
    return built.select(
        "ticket_id", "priority", "tracker_id", "tracker_name", offered.alias("success"),
        "summary", F.col("body").alias("description"),
        F.when(offered, F.to_json(F.struct(fields.alias("fields")))).alias("payload"))


def notice_outbox(submitted: DataFrame, product: str = PRODUCT) -> DataFrame:
    """(ticket_id, recipient, subject, body) per automatically resolved ticket with an address."""
    recipient = strip(F.coalesce("email", F.lit("")))
    body = F.concat(
        F.lit(f"{product} found an answer to what you wrote to us:\n> "),
        F.coalesce("description", F.lit("")), F.lit("\n\nThis should help:\n"),
        numbered(F.col("resolution_steps")),
        F.lit("\nDid it not? Reply to this message and a colleague takes over."))
    return submitted.where(F.col("ai_resolved")).withColumn("recipient", recipient).where(
        F.col("recipient") != "").select(
        "ticket_id", "recipient", F.lit(f"Your request to {product}: an answer").alias("subject"),
        body.alias("body"))
