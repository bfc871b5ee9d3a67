"""Joins and ids that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.session import materialise

HOT_SHARE = 0.001
SPREAD = 32
#: Bits a key in a filter of keys, and the most that such a filter may hold (8 MB).
BITS_PER_KEY, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 26


def hot_keys(counts: DataFrame, key: str, count: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding at least this share of the rows.

    At most 1/share keys can qualify, so the result is small for any input.
    """
    total = counts.agg(F.sum(count)).scalar()
    return counts.where(F.col(count) >= F.greatest(total * share, F.lit(2))).select(key)


def planned_bytes(df: DataFrame) -> int:
    """The size Catalyst plans with; for a written table that is its real file size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= threshold


def spread_join(facts: DataFrame, side: DataFrame, on: Sequence[str], hot_on: str,
                salt_by: Sequence[str], how: str = "inner",
                counts: DataFrame | None = None, spread: int = SPREAD,
                side_salt_by: Sequence[str] | None = None,
                side_counts: DataFrame | None = None, hash_side: bool = False) -> DataFrame:
    """Join on keys whose hot values are split over several tasks.

    If one side is small enough for Catalyst to broadcast, nothing is shuffled
    by key and this is a plain join.  Otherwise the hot values of the column
    `hot_on` are counted (or taken from `counts(hot_on, n)`).  Rows with such
    a value get a salt from their own columns, and the matching rows of the
    other side are repeated once per salt value.  Nothing is dropped, and the
    rows of all other keys are joined as usual.  With side_salt_by (inner joins
    only) the side's own hot values are split in the same way, so a value that
    is hot on both sides is dealt out as a grid.  With hash_side each task holds
    its part of the side in a hash table, so the facts need no sort; for sides
    with one row per key that are much smaller than the facts.
    """
    if side_salt_by is not None and how != "inner":
        raise ValueError("only inner joins can split both sides")
    if fits_broadcast(side) or (how == "inner" and fits_broadcast(facts)):
        return facts.join(side, list(on), how)
    if counts is None:
        counts = facts.groupBy(hot_on).agg(F.count("*").alias("n"))
    marked = F.broadcast(hot_keys(counts, hot_on, "n").withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*[F.col(name) for name in salt_by]), F.lit(spread)).cast("int")
    left = facts.join(marked, hot_on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(
        F.array(F.lit(0)))
    right = side.join(marked, hot_on, "left").withColumn(
        "_salt", F.explode(copies)).drop("_hot")
    if hash_side:
        right = right.hint("shuffle_hash")
    if side_salt_by is None:
        return left.join(right, [*on, "_salt"], how).drop("_salt")
    if side_counts is None:
        side_counts = side.groupBy(hot_on).agg(F.count("*").alias("n"))
    marked = F.broadcast(hot_keys(side_counts, hot_on, "n").withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*[F.col(name) for name in side_salt_by]), F.lit(spread)).cast("int")
    left = left.join(marked, hot_on, "left").withColumn("_side_salt", F.explode(copies)).drop("_hot")
    right = right.join(marked, hot_on, "left").withColumn(
        "_side_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    return left.join(right, [*on, "_salt", "_side_salt"]).drop("_salt", "_side_salt")


def key_bits(keys: DataFrame, key: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """One row with an array of bits, those of the hashes of the keys set, and its test.

    The test names the column to look up in a row that carries `bits`; it is true for every key
    and for few other values; several columns are named with commas between. The array grows with the number of keys up to MAX_BITS, so it
    may be broadcast; with more keys it lets more values pass, and never fewer.
    """
    size = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))

    def bit(name: str) -> str:
        return f"pmod(xxhash64({name}), {size}L)"

    own = keys.select(F.expr(f"cast({bit(key)} div 64 as int)").alias("at"),
                      F.expr(f"shiftleft(1L, cast({bit(key)} % 64 as int))").alias("bits"))
    blank = keys.sparkSession.range(size // 64).select(
        F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    table_ = own.union(blank).groupBy("at").agg(F.bit_or("bits").alias("bits")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "bits"))), lambda s: s["bits"]).alias("bits"))
    return table_, lambda name: F.expr(
        f"(shiftright(get(bits, cast({bit(name)} div 64 as int)), cast({bit(name)} % 64 as int)) & 1) = 1")


def may_match(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of df whose columns `on` are in keys, and few others; df is not shuffled for it.

    Keys may repeat.
    """
    key = ", ".join(on)
    bits, may_be = key_bits(keys, key)
    return df.crossJoin(F.broadcast(bits)).where(may_be(key)).drop("bits")


def join_by_text(facts: DataFrame, side: DataFrame, text: str,
                 salt_by: Sequence[str], how: str = "left") -> DataFrame:
    """Join on a long text column; hot texts are found by a hash of the text."""
    digest = F.xxhash64(F.col(text))
    return spread_join(
        facts.withColumn("_digest", digest), side.withColumn("_digest", digest),
        ["_digest", text], "_digest", salt_by, how).drop("_digest")


def running_number(df: DataFrame, order: str, name: str) -> DataFrame:
    """1, 2, 3, ... by a unique column, without one global sort.

    Rows are dealt by ranges of the column, sorted inside their partition and
    written with their place in it.  The offset of a partition is a running
    sum over one count per partition, however sparse the column's values are.
    """
    placed = materialise(df.repartitionByRange(order).sortWithinPartitions(order).withColumn(
        "_place", F.monotonically_increasing_id()), "numbered")
    # The upper bits of these numbers are the partition, the lower ones the place in it.
    part = F.shiftright("_place", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(
        name, (F.col("_offset") + inside).cast("bigint")).drop("_place", "_part", "_offset")
