"""Knowledge articles made from tickets: one per issue, in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.rules import article_content, article_title
from ticketloom.operators.profile import keep_first
from ticketloom.operators.skew import running_number


def build_articles(tickets: DataFrame, order: str) -> DataFrame:
    """Articles from tickets(category, subcategory, priority) with a unique order column."""
    issues = keep_first(
        tickets.select("category", "subcategory", "priority", order),
        ["category", "subcategory"], order)
    return running_number(issues, order, "id").select(
        "id", "category", "subcategory", "priority",
        article_title(F.col("subcategory")).alias("title"),
        article_content(F.col("subcategory")).alias("content"))


def article_count(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("n_articles"))
