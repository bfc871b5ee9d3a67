"""Help-desk views over the given tables: tickets, metrics, feedback, articles, queries.

Every view keeps all rows of its table.  The phrases and the twelve short
articles are reference data of a few rows; everything else is computed from
the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.sources.schemas import ARTICLES

PHRASES = [
    "Complete outage in building two", "Data breach suspected on file share",
    "Urgent: laptop keyboard broken", "Multiple users report vpn failure",
    "Cannot work because outlook is frozen", "Printer is not working",
    "Password reset needed", "Account locked after travel", "Wi-fi drops every hour",
    "Ethernet socket has no signal", "Gmail rules vanished", "Screen flickers at login",
    "Program freezes on start", "App not responding after update",
    "Please change my desk number", "Ransomware note on desktop", "Server down in rack four",
    "Touchpad is slow", "Happy with the new chair", "System down for entire company",
]
IMPACTS = ["Organization-wide", "Multiple users", "Limited users", "Single user", "", None]
DEPARTMENTS = ["IT", "HR", None, "Sales"]
STATES = ["Open", "Resolved", "AI Resolved", "Escalated", "Closed", "Customer Resolved", "Open",
          "In Progress"]
SHORT_ARTICLES = [
    (1, "Hardware", "Printer is not working", "Low", "Printer does not print",
     "Work through the list.\n- Check that the printer has power and paper.\n"
     "- Look at the queue and remove stuck jobs.\n* Install the driver again."),
    (2, "VPN / Network", "vpn failure", "High", "VPN fails for multiple users",
     "1. Test the internet connection.\n2) Open the vpn client again.\n"
     "3. Report the failure with the time it began."),
    (3, "Password / Access", "Password reset", "Medium", "Password reset needed by a user",
     "Open the portal and follow the reset link. A new password is active at once."),
    (4, "Password / Access", "Account locked", "Medium", "Account locked after too many logins",
     "- Wait fifteen minutes.\n- Ask the desk to unlock the account."),
    (5, "Hardware", "Screen flickers", "Low", "Screen flickers or stays dark",
     "Check the cable, then the refresh rate of the screen."),
    (6, "Email", "Gmail rules", "Low", "Gmail rules vanished after sync",
     "1. Export the rules.\n2. Import the rules again."),
    (7, "Software", "Program freezes", "Medium", "Program freezes on start",
     "Start the program in safe mode and remove add-ons one by one."),
    (8, "Software", "App not responding", "Medium", "App not responding after update",
     "- Close the app.\n- Clear its cache.\n- Start the app.\n- Install the update again.\n"
     "- Restart the device.\n- Roll the update back.\n- Call the vendor."),
    (9, "VPN / Network", "Wi-fi drops", "Medium", "Wi-fi drops every hour",
     "Renew the address lease and test another access point."),
    (10, "Hardware", "Server down", "Critical", "Server down in a rack",
     "* Check the power of the rack.\n* Check the console for errors."),
    (11, "Security", "Ransomware note", "Critical", "Ransomware note found on a desktop",
     "1. Unplug the network cable.\n2. Leave the machine on.\n3. Call security."),
    (12, "Facilities", "Parking permit", "Low", "Parking permit for the garage",
     "Permits are issued at the front gate every Monday."),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, place: Column) -> Column:
    """The value at a 1-based place of a short constant list."""
    return F.element_at(F.array(*[F.lit(value) for value in values]), place.cast("int"))


def tickets_of(events: DataFrame) -> DataFrame:
    """Tickets made from events, batch or stream."""
    event, user = F.col("event_id"), F.col("user_id")
    return events.select(
        (event + 1).alias("ticket_id"),
        F.concat(pick(PHRASES, event % 20 + 1), F.lit(" ("), "event_type", F.lit(")"))
        .alias("description"),
        pick(IMPACTS, user % 6 + 1).alias("impact"),
        F.concat(F.lit("user"), user.cast("string")).alias("employee_name"),
        pick(DEPARTMENTS, user % 4 + 1).alias("department"),
        pick(STATES, event % 8 + 1).alias("status"),
        F.when(event % 2 == 0, F.concat(F.lit("user"), user.cast("string"),
                                        F.lit("@example.org"))).alias("email"),
        F.col("ts").alias("created_at"),
        (F.col("value") / 100.0).alias("rag_time"),
        (F.col("value") / 90.0).alias("rag_elapsed"),
        (F.col("value") / 1000.0).alias("agent_time"),
        (F.col("value") / 80.0).alias("total_time"),
        (event % 11 == 0).alias("customer_requested_human"),
        (event % 5).cast("int").alias("repeated_attempts"),
        F.when(event % 4 == 0, F.lit("")).otherwise(F.col("event_type"))
        .alias("actual_category"),
        pick(["yes", "no", "null", "Correct"], event % 4 + 1).alias("stated_correct"),
        F.when(event % 3 == 0, F.lit("click")).otherwise(F.upper("event_type"))
        .alias("predicted"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets_of(table(spark, sf_dir, "events"))


def metrics_of(events: DataFrame) -> DataFrame:
    """Finished-ticket records made from events."""
    event, value = F.col("event_id"), F.col("value")
    return events.select(
        (event + 1).alias("metric_id"), (event + 1).alias("ticket_id"),
        (event % 3 != 0).alias("ai_resolved"),
        ((event % 3 != 0) & (event % 5 != 0)).alias("resolution_success"),
        (event % 7 != 0).alias("kb_found"),
        F.when(event % 4 != 0, event % 9 != 0).alias("classification_correct"),
        F.when(event % 10 == 0, 0.0).otherwise(value / 50.0).alias("resolution_time"),
        F.when(event % 10 == 1, 0.0).otherwise(value / 70.0).alias("ai_response_time"),
        (value / 60.0).alias("response_time"),
        F.when(event % 6 == 0, (event % 5 + 1).cast("double")).alias("customer_rating"),
        (event % 3 == 0).alias("escalated"), F.col("ts").alias("created_at"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_of(table(spark, sf_dir, "events"))


def feedback_of(events: DataFrame) -> DataFrame:
    """One text-typed feedback per event; some name no ticket, a later one, or bad ratings."""
    event = F.col("event_id")
    return events.select(
        event.alias("feedback_id"), F.col("ts").alias("feedback_ts"),
        F.when(event % 13 == 0, "x").when(event % 17 == 0, F.lit(None))
        .when(event % 29 == 0, (event + 51).cast("string"))
        .otherwise((event - event % 10 + 1).cast("string")).alias("ticket_id"),
        F.when(event % 3 == 0, "yes").when(event % 3 == 1, "Resolved").otherwise("no")
        .alias("resolved"),
        F.when(event % 7 == 0, "").when(event % 19 == 0, "6").when(event % 23 == 0, "abc")
        .otherwise((event % 5 + 1).cast("string")).alias("rating"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_of(table(spark, sf_dir, "events"))


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; the title is the document's first line."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + 1).alias("id"), F.col("lang").alias("category"),
        F.col("source").alias("subcategory"), F.lit("Low").alias("priority"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("content"))


def short_articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHORT_ARTICLES, ARTICLES)


def support_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve short articles and all documents, whose ids follow theirs."""
    more = document_articles(spark, sf_dir).withColumn("id", F.col("id") + len(SHORT_ARTICLES))
    return short_articles(spark).unionByName(more)


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ticket_id"), F.col("text").alias("description"))


def spoken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in conversations, all turns, as tickets."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select((F.col("conv_id") * 10000 + F.col("turn")).alias("ticket_id"),
                        F.col("text").alias("description"))


def labelled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per document, worded like a ticket about the document's title."""
    return document_articles(spark, sf_dir).select(
        F.col("id").alias("ticket_id"), F.concat(
            F.lit("User reported "), F.col("title"),
            F.lit(". Further investigation needed.")).alias("description"),
        "category", "subcategory")


def stepped_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are turned into steps, by language in three styles."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ticket_id"), F.struct(
            F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
            F.when(F.col("lang") == "en", F.replace(text, F.lit("\n"), F.lit("\n- ")))
            .when(F.col("lang") == "de", F.replace(text, F.lit("\n"), F.lit("\n 2. ")))
            .when(F.col("lang") == "fr", F.replace(text, F.lit("\n"), F.lit("\n10) * ")))
            .otherwise(text).alias("content")).alias("article"))


def attempt_log(tickets_view: DataFrame) -> DataFrame:
    """(ticket_id, attempt, answer, error): what each call of an external scorer gave.

    One ticket in five fails three times, one was never tried, one succeeds at the second
    attempt, the others at once; the texts are those of generated_answers.
    """
    ticket = F.col("ticket_id")
    known = generated_answers(tickets_view)
    tries = F.when(ticket % 5 == 0, F.array(*[F.struct(
        F.lit(number).alias("attempt"), F.lit(text).alias("answer"), F.lit(error).alias("error"))
        for number, text, error in ((1, None, "Timed out."), (2, "", None), (3, "  ", None))])
    ).when(ticket % 5 == 2, F.array(
        F.struct(F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("answer"),
                 F.lit(None).cast("string").alias("error")),
        F.struct(F.lit(2).alias("attempt"), F.col("answer"),
                 F.lit(None).cast("string").alias("error")))
    ).when(ticket % 5 > 2, F.array(F.struct(
        F.lit(1).alias("attempt"), F.col("answer"), F.lit(None).cast("string").alias("error"))))
    return known.select("ticket_id", F.explode(tries).alias("_try")).select("ticket_id", "_try.*")


def generated_answers(tickets_view: DataFrame) -> DataFrame:
    """Stand-in for an external scorer's answers: texts, blanks and missing rows."""
    ticket = F.col("ticket_id")
    return tickets_view.select("ticket_id", F.when(ticket % 5 == 0, F.lit("  ")).when(
        ticket % 5 == 1, F.lit(None)).when(ticket % 5 == 2, F.concat(
            F.lit(" Likely cause unknown.\n- Look into: "), F.col("description"),
            F.lit("\n12 Close the ticket.\n1. Wait. "))).otherwise(F.concat(
                F.lit("Answer for "), F.col("description"))).alias("answer"))
