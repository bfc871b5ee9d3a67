"""Table profiles: shape, missing values, duplicates, value counts, first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators.summaries import MOST, merged_values, summarise


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns)"""
    return df.agg(F.count("*").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def column_names(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type), from the schema alone."""
    return df.sparkSession.createDataFrame(
        [(place, field.name, field.dataType.simpleString())
         for place, field in enumerate(df.schema, start=1)],
        "position long, column_name string, data_type string")


def first_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def _unpivot(one_row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(
        F.lit(name).alias("column_name"), F.col(f"`{name}`").cast("bigint").alias(value))
        for name in columns])
    return one_row.select(F.inline(pairs))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null), all columns in one pass."""
    counts = df.agg(*[
        F.count_if(F.col(f"`{name}`").isNull()).alias(name) for name in df.columns])
    return _unpivot(counts, df.columns, "n_null")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows are beyond the first of their identical copies (NULLs are equal).

    Copies are counted per row value and combined before the shuffle, so many
    copies of one row cost no more than one.
    """
    copies = df.groupBy(*[F.col(f"`{name}`") for name in df.columns]).agg(
        F.count("*").alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, n_distinct), NULLs not counted."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(*[count(F.col(f"`{name}`")).alias(name) for name in df.columns])
    return _unpivot(counts, df.columns, "n_distinct")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def low_cardinality_values(df: DataFrame, most: int = MOST) -> DataFrame:
    """(column_name, value, n) of each column with at most `most` distinct values, NULL not counted.

    Exact and in one pass: see summaries.
    """
    return merged_values(summarise(df, most=most), most)


def first_seen_values(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, first_seen): distinct values by the place of their first row."""
    return df.groupBy(F.col(column).alias("value")).agg(
        F.min(order).alias("first_seen")).orderBy("first_seen")


def first_per_group(df: DataFrame, group: str, order: str, k: int = 5) -> DataFrame:
    """The first k rows of each group; tasks keep k rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key combination, as an aggregate rather than a sort."""
    row = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")
