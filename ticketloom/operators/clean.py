"""Cleaning of ticket tables: duplicates, personal columns, text, required fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.text import clean_text, joined_text, lowered_text, strip

# --- Fixed values: columns that identify a customer -------------------------
PERSONAL_COLUMNS = ["Customer Name", "Customer Email"]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of each identical row; equal copies are combined before the shuffle."""
    return df.dropDuplicates()


def drop_personal(df: DataFrame, columns: Sequence[str] = PERSONAL_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def clean_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: clean_text(F.col(f"`{name}`")) for name in columns})


def clean_customer_tickets(tickets: DataFrame) -> DataFrame:
    """Deduplicate, drop personal data, clean the texts and add customer_query."""
    cleaned = clean_columns(
        drop_personal(drop_duplicate_rows(tickets)),
        ["Ticket Subject", "Ticket Description", "Resolution"])
    return cleaned.withColumn("customer_query", F.concat(
        F.col("`Ticket Subject`"), F.lit(" "), F.col("`Ticket Description`")))


def training_text(tickets: DataFrame, columns: Sequence[str] = (
        "Ticket Subject", "Ticket Description", "customer_query")) -> DataFrame:
    """Add `text`: the named columns joined by a space, NULL counting as empty."""
    return tickets.withColumn("text", joined_text(*[F.col(f"`{name}`") for name in columns]))


def lower_description(tickets: DataFrame, column: str = "Description") -> DataFrame:
    return tickets.withColumn(column, lowered_text(F.col(column)))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def split_required(df: DataFrame, column: str = "description",
                   error: str = "Ticket description is required.",
                   ) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with a non-blank text, trimmed, and the others."""
    trimmed = df.withColumn(column, strip(F.coalesce(F.col(column), F.lit(""))))
    present = F.col(column) != ""
    return trimmed.where(present), trimmed.where(~present).withColumn("error", F.lit(error))


def audit(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted and rejected records in one table; accepted ones have no error."""
    return accepted.unionByName(rejected, allowMissingColumns=True)
