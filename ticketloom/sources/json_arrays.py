"""A JSON array of objects in one huge file, read by many tasks.

Spark's multiLine option makes a file one task. Here the file is cut at every "}", which any split
can do for itself, and the cut records are repaired. Whether a piece begins inside a string follows
from the number of quotes before it, and how deep from the braces outside strings before it. Both are
running sums: inside a split over its pieces, and over the splits of a file. A record ends where
the depth returns to zero; its pieces are joined again and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.session import materialise


def running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of the values of all pieces of the file before this one."""
    inside = Window.partitionBy("file", "start").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("start").rowsBetween(
        Window.unboundedPreceding, -1)
    valued = df.withColumn("_value", value)
    totals = valued.groupBy("file", "start").agg(F.sum("_value").alias("_sum")).select(
        "file", "start", F.coalesce(F.sum("_sum").over(splits), F.lit(0)).alias("_before"))
    own = valued.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return own.join(totals, ["file", "start"]).withColumn(
        name, F.col("_own") + F.col("_before")).drop("_value", "_own", "_before")


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, json) of the objects of the arrays below a path, numbered from 0 by file."""
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), "value")
    # What stands before is read from the written pieces: their places must not change.
    pieces = materialise(pieces, "json-pieces")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = running(pieces, count_of(plain, '"'), "quotes")
    begins = F.col("quotes") % 2
    outside = F.array_join(F.filter(
        F.split(plain, '"', -1), lambda part, place: place % 2 == begins), "")
    closes = ((F.col("quotes") + count_of(plain, '"')) % 2 == 0).cast("int")
    stepped = quoted.withColumn("opens", count_of(outside, "{")).withColumn("closes", closes)
    deep = running(stepped, F.col("opens") - F.col("closes"), "depth")
    ends = ((F.col("closes") == 1) & (F.col("depth") + F.col("opens") <= 1)).cast("int")
    counted = running(deep.withColumn("ends", ends), F.col("ends"), "record")
    joined = counted.groupBy("file", "record").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("start", "place", "value"))), lambda piece: piece["value"]), "}")
        .alias("text"))
    return joined.where(F.contains("text", F.lit("{"))).select(
        "file", "record", F.concat(
            F.expr("substring(text, instr(text, '{'))"), F.lit("}")).alias("json"))


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of the JSON arrays below a path, with the columns of the schema."""
    return records(spark, path).select(F.from_json("json", schema).alias("row")).select("row.*")
