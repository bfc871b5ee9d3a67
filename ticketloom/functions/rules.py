"""Ordered keyword rules as CASE expressions: severity, priority, diagnosis, articles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions import fixed_values as fixed


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Substring test, as in "change" containing "hang"."""
    return reduce(Column.__or__, [F.contains(text, F.lit(word)) for word in keywords])


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]],
                default: str) -> Column:
    """The label of the first rule with a keyword inside the lower-cased text."""
    lowered = F.lower(text)
    branches = [(contains_any(lowered, keywords), F.lit(label)) for label, keywords in rules]
    result = F.when(*branches[0])
    for condition, label in branches[1:]:
        result = result.when(condition, label)
    return result.otherwise(F.lit(default))


def severity(description: Column, rules=fixed.SEVERITY_RULES) -> Column:
    return first_match(description, rules, fixed.DEFAULT_SEVERITY)


def priority(severity_level: Column, impact: Column) -> Column:
    """P1 to P4 from severity and business impact; unknown impact is always P4."""
    level, reach = F.lower(severity_level), F.lower(impact)
    return (
        F.when(severity_level.isNull() | impact.isNull(), "P4")
        .when((level == "critical") & (reach == "organization-wide"), "P1")
        .when((level == "high") | (reach == "multiple users"), "P2")
        .when((level == "medium") | (reach == "limited users"), "P3")
        .otherwise("P4"))


def diagnosis(description: Column, rules=fixed.DIAGNOSIS_RULES) -> Column:
    return first_match(description, rules, fixed.DEFAULT_DIAGNOSIS)


def diagnosis_record(description: Column, rules=fixed.DIAGNOSIS_RULES) -> Column:
    """struct<diagnosis, category, confidence, message>"""
    category = diagnosis(description, rules)
    before, after = fixed.DIAGNOSIS_MESSAGE.split("{category}")
    message = F.when(
        category == fixed.DEFAULT_DIAGNOSIS, F.lit(fixed.DEFAULT_DIAGNOSIS_MESSAGE),
    ).otherwise(F.concat(F.lit(before), category, F.lit(after)))
    return F.struct(
        category.alias("diagnosis"), category.alias("category"),
        F.lit(fixed.DIAGNOSIS_CONFIDENCE).alias("confidence"), message.alias("message"))


def article_content(subcategory: Column, rules=fixed.ARTICLE_RULES,
                    fallback: str = fixed.ARTICLE_FALLBACK) -> Column:
    """Troubleshooting text chosen by the first rule that matches the subcategory."""
    body = first_match(subcategory, [(text, words) for words, text in rules], fallback)
    before, after = fixed.ARTICLE_OPENING.split("{subcategory}")
    return F.concat(F.lit(before), subcategory, F.lit(after), body)


def article_title(subcategory: Column) -> Column:
    return F.concat(subcategory, F.lit(fixed.ARTICLE_TITLE.replace("{subcategory}", "")))
