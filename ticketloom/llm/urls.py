"""URL filter: host rules first, then a list of canonical URLs behind a blocked Bloom filter.

The listed URLs set bits in a split-block Bloom filter: a URL's hash names one block of
512 bits, eight words of 64, and sets one bit in each word. The filter is a table with a row
per block, so it grows with the list and is never gathered on the driver. Pages join their
block; those whose eight bits are all set are possible hits, and an exact hash join with the
listed URLs removes the false positives.

Edge cases: a null URL, or one without ://, has an empty host and path, no rule and
verdict allow; a null in the list is ignored, repeated ones count once; an empty list blocks
nothing, nor does an empty key; repeated pages keep their rows; the result has its own columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
WORDS = 8


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, ASCII letters in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(host_: Column, path_: Column) -> Column:
    """Host without www., blog. or m., then the path without slashes at its end; no query."""
    bare = F.regexp_replace(host_, r"^(www|blog|m)\.", "")
    return F.concat(bare, F.regexp_replace(path_, "/+$", ""))


def rule_for(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule (action, host/path) that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = rule.partition("/")
        fits = (F.concat(F.lit("."), host_).endswith("." + name)
                & path_.startswith(slash + rest))
        found = F.when(fits, F.struct(
            F.lit(rule).alias("rule"), F.lit(action).alias("verdict"))).otherwise(found)
    return found


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def masks(key: Column) -> list[Column]:
    """A word for each of the eight, with the one bit that the URL sets in it."""
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(
        F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the listed keys."""
    key = F.col("key")
    words = listed.select(block_of(key, blocks), *[
        mask.alias(f"w{i}") for i, mask in enumerate(masks(key))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]],
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed; `listed` is a table of canonical URLs (key)."""
    keys = listed.select(F.col("key").cast("string").alias("key")).where(
        "key is not null").distinct()
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    url = F.col(url_col).cast("string")
    found = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"),
                         path(url).alias("path")).withColumn(
        "key", canonical(F.col("host"), F.col("path")))
    in_block = F.lit(True)
    for i, mask in enumerate(masks(F.col("key"))):
        in_block = in_block & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    # Pages without a URL are in no list; they would all meet in one block.
    named = F.col("key") != ""
    seen = found.where(named).withColumn("block", block_of(F.col("key"), blocks)).join(
        bloom_table(keys, blocks), "block", "left").select(
        "page_id", "host", "path", "key", F.coalesce(in_block, F.lit(False)).alias("possible"))
    exact = keys.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = seen.where("possible").join(exact, "key", "left").select(
        "page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    # What the filter clears never meets the list.
    cleared = seen.where("not possible").unionByName(
        found.where(~named), allowMissingColumns=True).select(
        "page_id", "host", "path", F.lit(False).alias("listed"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return hits.unionByName(cleared).select(
        "page_id", "host", "path", "listed", rule.alias("r")).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias(
            "verdict"), "listed")
