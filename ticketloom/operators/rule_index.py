"""Many ordered keyword rules against many texts: the first rule whose keyword a text contains.

A CASE with a branch per keyword tests every keyword on every text. Here a keyword is found
through one piece of it: its rarest run of PIECE characters, rarest by the number of texts that
hold it. Texts meet rules on equal pieces, the whole keyword is verified, and the least rule order
wins. A rule is therefore looked at only for texts that hold its rarest piece.

Rules are taken in waves by their order, each larger than the one before: a text that fits a rule
of a wave needs none of a later one, so only texts without a rule so far meet the many others.
What a text may fit is gathered by the text's hash, and meets the text itself once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.operators.skew import fits_broadcast, join_by_text, spread_join
from ticketloom.session import materialise

PIECE = 3
FIRST_WAVE = 100
GROWTH = 8


def pieces(text: Column, size: int) -> Column:
    """The distinct runs of so many characters, overlapping; [] for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def piece_sizes(rules: DataFrame) -> list[int]:
    """The sizes of pieces that the keywords need: PIECE, and less for shorter keywords."""
    rows = rules.select(F.least(F.char_length("keyword"), F.lit(PIECE)).alias("n")).distinct()
    return sorted(row.n for row in rows.collect() if row.n)


def all_pieces(text: Column, sizes: list[int]) -> Column:
    return F.concat(*[pieces(text, size) for size in sizes])


def piece_counts(texts: DataFrame, rules: DataFrame, sizes: list[int]) -> DataFrame:
    """(_piece, _n): how many texts hold each piece of the rules' keywords."""
    asked = materialise(rules.select(F.explode(own_pieces()).alias("_piece")).distinct(),
                        "rule-pieces")
    held = texts.select(F.explode(all_pieces(F.col("_text"), sizes)).alias("_piece"))
    return materialise(held.groupBy("_piece").agg(F.count("*").alias("_n")).join(
        asked, "_piece"), "piece-counts")


def own_pieces() -> Column:
    return F.when(F.char_length("keyword") >= PIECE, pieces(F.col("keyword"), PIECE)).otherwise(
        F.array("keyword"))


def keyed_rules(texts: DataFrame, rules: DataFrame, sizes: list[int],
                counts: DataFrame | None = None) -> DataFrame:
    """Rules with the piece by which they are found; those without a text to be in are left out.

    counts are the piece_counts, if they are known.
    """
    if counts is None:
        counts = piece_counts(texts, rules, sizes)
    own = rules.withColumn("_piece", F.explode(own_pieces()))
    chosen = own.join(counts, "_piece", "left").groupBy("rule_ord", "keyword", "label").agg(
        F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"),
        F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    return materialise(chosen.where("_n > 0").drop("_n"), "keyed-rules")


def waves(rules: DataFrame) -> Iterator[DataFrame]:
    """The rules by their order, FIRST_WAVE of them, then GROWTH times as many, and so on."""
    left, size = rules, FIRST_WAVE
    while True:
        first = left.orderBy("rule_ord").limit(size + 1).agg(
            F.count("*").alias("n"), F.max("rule_ord").alias("last")).first()
        if first.n <= size:
            yield left
            return
        # Rules of equal order belong together; without an order they come first.
        early = F.col("rule_ord").isNull()
        if first.last is not None:
            early = early | (F.col("rule_ord") <= F.lit(first.last))
        yield left.where(early)
        left, size = left.where(~early), size * GROWTH


def fitting(texts: DataFrame, keyed: DataFrame, sizes: list[int]) -> DataFrame:
    """(_original, _best): the first rule of the keyed ones that each text fits."""
    held = texts.select("_id", F.explode(all_pieces(F.col("_text"), sizes)).alias("_piece"))
    if fits_broadcast(keyed):
        found = held.join(F.broadcast(keyed), "_piece")
    else:
        found = spread_join(held, keyed, ["_piece"], "_piece", ["_id"])
    listed = found.groupBy("_id").agg(
        F.collect_set(F.struct("rule_ord", "keyword", "label")).alias("_rules"))
    return texts.join(listed, "_id").select("_original", F.array_min(F.filter(
        "_rules", lambda rule: F.contains("_text", rule["keyword"]))).alias("_best")).where(
        "_best is not null")


def first_rules(df: DataFrame, text: str, rules: DataFrame, default: str | None = None) -> DataFrame:
    """df with rule_ord and label of the first rule(rule_ord, keyword, label) that fits.

    A keyword fits if the lower-cased text contains it; the empty keyword fits every text, null
    keywords none. Without a rule rule_ord is NULL and label is the default; so it is for NULL
    texts. A rule order should name one rule; of several the least keyword's label is taken.
    """
    spark = df.sparkSession
    # Of rules with the same keyword only the first can win.
    given = materialise(rules.where("keyword is not null").groupBy("keyword").agg(F.min(F.struct(
        "rule_ord", "label")).alias("_rule")).select("_rule.rule_ord", "keyword", "_rule.label"),
        "rules")
    always = given.where("keyword = ''").first()
    worded = given.where("keyword != ''")
    sizes = piece_sizes(worded)
    texts = df.select(F.col(text).alias("_original")).where("_original is not null").distinct()
    texts = materialise(texts.select("_original", F.lower("_original").alias("_text"),
                                     F.xxhash64("_original").alias("_id")), "rule-texts")
    best = spark.createDataFrame([], T.StructType([
        T.StructField("_original", T.StringType()), T.StructField("_best", worded.schema)]))
    if sizes:
        counts = piece_counts(texts, worded, sizes)
        left, done = texts, []
        for wave in waves(worded):
            keyed = keyed_rules(left, wave, sizes, counts)
            done.append(materialise(fitting(left, keyed, sizes), "fitting"))
            left = materialise(left.join(
                done[-1].select(F.xxhash64("_original").alias("_id"), "_original"),
                ["_id", "_original"], "left_anti"), "rule-texts")
        best = reduce(DataFrame.unionByName, done)
    if always is not None:
        best = best.unionByName(texts.select("_original", F.struct(
            F.lit(always.rule_ord).cast(worded.schema["rule_ord"].dataType).alias("rule_ord"),
            F.lit("").alias("keyword"), F.lit(always.label).cast(
                worded.schema["label"].dataType).alias("label")).alias("_best")))
    best = materialise(best.groupBy(F.xxhash64("_original"), "_original").agg(
        F.min("_best").alias("_best")).select(
        F.col("_original").alias(text), "_best.rule_ord", "_best.label"), "first-rules")
    marked = join_by_text(df, best, text, [name for name in df.columns if name != text] or [text])
    return marked.withColumn("label", F.coalesce("label", F.lit(default)))
