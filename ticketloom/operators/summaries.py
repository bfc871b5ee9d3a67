"""Mergeable column summaries: few values exactly, many values by a sketch.

A part of a table (a day, say) is summarised once: for each column either its values with their
counts, as long as there are few, or only a sketch of how many there are. Summaries are small
rows that can be stored and merged: a column with too many values in any part has too many in
all, so "at most 20 values" is decided exactly without ever counting the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 20
SUMMARY = ("part string, column_name string, n_rows bigint, "
           "values array<struct<value:string,n:bigint>>, sketch binary")


def few_values(df: DataFrame, names: Sequence[str], most: int) -> DataFrame:
    """(part, column_name, value, n, over) of df(part, names), strings: partial counts of tasks.

    A task keeps at most `most` values per part and column; over marks a column that has more.
    """
    def run(batches):
        counts: dict[tuple, Counter | None] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for name in names:
                found = table.select(["part", name]).group_by(["part", name]).aggregate([([], "count_all")])
                if len(found) > most:  # only then may a part have too many
                    sizes = found.filter(pc.is_valid(found[name])).group_by("part").aggregate(
                        [(name, "count")])
                    over = sizes.filter(pc.greater(sizes[f"{name}_count"], most))["part"].to_pylist()
                    for part in over:
                        counts[part, name] = None
                    if over:
                        wide = pa.array(over, pa.string())
                        found = found.filter(pc.invert(pc.is_in(found["part"], value_set=wide)))
                for part, value, n in zip(found["part"].to_pylist(), found[name].to_pylist(),
                                          found["count_all"].to_pylist(), strict=True):
                    own = counts.setdefault((part, name), Counter())
                    if own is not None and value is not None:
                        own[value] += n
                        if len(own) > most:
                            counts[part, name] = None
        rows = [(part, name, value, n, False) for (part, name), own in counts.items()
                if own is not None for value, n in own.items()]
        rows += [(part, name, None, 0, True) for (part, name), own in counts.items() if own is None]
        rows += [(part, name, None, 0, False) for (part, name), own in counts.items() if own == {}]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)],
            ["part", "column_name", "value", "n", "over"])

    return df.mapInArrow(run, "part string, column_name string, value string, n long, over boolean")


def summarise(df: DataFrame, part: Column | None = None, columns: Sequence[str] | None = None,
              most: int = MOST) -> DataFrame:
    """One row (part, column_name, n_rows, values, sketch) per part and column.

    values is NULL for a column with more than `most`; NULLs are no values. Without a part the
    whole table is one.
    """
    names = list(columns or df.columns)
    places = {f"c{place}": name for place, name in enumerate(names)}
    texts = df.select(
        (F.lit("") if part is None else F.coalesce(part.cast("string"), F.lit(""))).alias("part"),
        *[F.col(f"`{name}`").cast("string").alias(place) for place, name in places.items()])
    merged = few_values(texts, list(places), most).groupBy("part", "column_name", "value").agg(
        F.sum("n").alias("n"), F.bool_or("over").alias("over"))
    listed = merged.groupBy("part", "column_name").agg(
        F.bool_or("over").alias("over"), F.sort_array(F.collect_list(F.when(
            F.col("value").isNotNull(), F.struct("value", "n")))).alias("values"))
    # Sketches do not take empty texts, so every value gets a mark in front.
    sketches = texts.groupBy("part").agg(F.count("*").alias("n_rows"), *[
        F.hll_sketch_agg(F.concat(F.lit("="), place)).alias(place) for place in places]).select(
        "part", "n_rows", F.inline(F.array(*[F.struct(
            F.lit(place).alias("column_name"), F.col(place).alias("sketch")) for place in places])))
    named = F.create_map(*[F.lit(text) for pair in places.items() for text in pair])
    return listed.join(sketches, ["part", "column_name"]).select(
        "part", named[F.col("column_name")].alias("column_name"), "n_rows", F.when(
            ~F.col("over") & (F.size("values") <= most), F.col("values")).alias("values"), "sketch")


def merged_values(summaries: DataFrame, most: int = MOST) -> DataFrame:
    """(column_name, value, n) of the columns that have at most `most` values in all parts."""
    whole = summaries.groupBy("column_name").agg(
        F.bool_or(F.col("values").isNull()).alias("over")).where("not over").select("column_name")
    counts = summaries.join(whole, "column_name", "left_semi").select(
        "column_name", F.inline("values")).groupBy("column_name", "value").agg(
        F.sum("n").alias("n"))
    few = counts.groupBy("column_name").agg(F.count("*").alias("n_values")).where(
        F.col("n_values") <= most).select("column_name")
    return counts.join(few, "column_name", "left_semi")


def merged_counts(summaries: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_distinct): about how many distinct values all parts have."""
    return summaries.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
