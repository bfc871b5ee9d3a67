"""Small helpers of the text operators: reading, Arrow slices, unique row numbers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.session import materialise

#: Text bytes that one step of a Python task works on; a longer text is one step by itself.
SLICE_BYTES = 2 << 20
#: The same where texts are encoded: the more text, the more often a word repeats in it.
ENCODED_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def slices(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about max_bytes of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        first, done = 0, 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(ends, done + max_bytes, "right")), first + 1)
            yield batch.slice(first, last - first)
            done, first = int(ends[last - 1]), last


def encoded(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow whose workers can import this package, wherever they were started."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = df.sparkSession.sparkContext.environment
    if home not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join([home, *filter(None, [paths.get("PYTHONPATH")])])
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, step: Callable, schema, text: str = "text",
                max_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow in bounded slices; step turns one record batch into one."""
    def run(batches):
        for piece in slices(batches, text, max_bytes):
            out = step(piece)
            if out is not None and out.num_rows:
                yield out
    return map_arrow(df, run, schema)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row bigint, id, text) with a unique row number that ascends with the id.

    Whole-number ids that are unique and never null are used as they are.
    Otherwise rows are ordered by (id, text hash), null ids last, and the
    numbered table is written, so that every later read sees the same numbers.
    """
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if dict(pair.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        repeated = pair.groupBy("id").agg(F.count("*").alias("n")).where(
            "id is null or n > 1").limit(1).count()
        if not repeated:
            return pair.select(F.col("id").cast("bigint").alias("row"), "id", "text")
    order = [F.col("id").isNull(), F.col("id"), F.xxhash64("text")]
    placed = pair.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(placed.select(
        F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
