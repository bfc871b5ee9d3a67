"""Benchmark passages in documents: a prefix-filtered join on windows of item words.

A window is `size` consecutive words of an item (all words of a shorter one). A document
that holds a window holds all of its words, so one of them is enough to find it: the
words of each window are ordered by rarity in the documents, and the rarest, its necessary
prefix, is joined with the documents' words. The position of a word in document and window gives
the place where the window would start; it must lie inside the document (positional and
length bounds), and there the words are compared exactly.

All steps are built-in functions. A document's words are exploded, joined with the prefix
words and compared in one compiled stage, so nothing but hits is shuffled, and the array of
a document's words is not copied for each of them. (A lambda would end that: it is not
compiled, and each exploded row would carry a copy of the whole document.) At most BLOCK_WINDOWS
windows are broadcast. Of a larger benchmark a bit array of bounded size is, which lets the
prefix words pass and few others; these are written with the words around them, and meet the
windows in a join by word that splits hot words. The documents are searched once either way.
Likewise the benchmark's words are broadcast for their counts only if they are few.

Edge cases: null and empty texts have no words and are clean; an item without words has no
window; a null item id counts for hits but is not listed; equal item ids are one item;
repeated documents keep their rows; words are compared with ASCII letters in lower case
only; empty tables give clean documents, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.skew import fits_broadcast, key_bits, spread_join
from ticketloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are neither digits nor letters separate words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCK_WINDOWS = 50_000
#: Stands after a document's words; it holds a separator, so it is no word.
END = "\x00"


def words_of(text: Column) -> Column:
    """The words of a text, as they are written."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_WORDS), "")


def joined(words: Column) -> Column:
    """The words as one text, separated by blanks (no word holds one), in lower case."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(words, items): the distinct windows, each with the ids of its items."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(
        F.translate(F.col(text_col).cast("string"), UPPER, LOWER)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (size - 1), F.lit(1)))
    return own.where(F.size("all") > 0).select("item", "all", F.explode(starts).alias("at")).select(
        "item", F.slice("all", F.col("at"), F.lit(size)).alias("words")).groupBy("words").agg(
        F.collect_set("item").alias("items"))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, offset, window, size, items): each window, as a text of so many words, with its
    rarest word in the documents.

    Counts are over all documents; a tie goes to the word first in order. Only words
    of the benchmark are counted, so the counts are as many as these.
    """
    tokens = windows.select(F.posexplode("words").alias("offset", "word"), "words").select(
        F.lower("word").alias("token"), "offset", "words")
    asked = materialise(tokens.select("token").distinct(), "asked-words")
    every = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(
        F.lower("word").alias("token"))
    # Too many for a broadcast: all words are counted, and their counts join by shuffle.
    counts = (every.join(F.broadcast(asked), "token").groupBy("token").agg(F.count("*").alias("n"))
              if fits_broadcast(asked) else
              every.groupBy("token").agg(F.count("*").alias("n")).join(asked, "token"))
    rarest = tokens.join(counts, "token", "left").groupBy("words").agg(F.min(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rare"))
    return rarest.join(windows, "words").select(
        F.col("rare.token").alias("token"), F.col("rare.offset").alias("offset"),
        joined(F.col("words")).alias("window"), F.size("words").alias("size"), "items")


def spread_words(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, all, n_words, at, word): a row for each word, and one for each document's
    end; docs has (doc_id, text)."""
    return docs.select(
        "doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("all")).select(
        "doc_id", "digest", "all", F.size("all").alias("n_words"),
        F.posexplode(F.array_append("all", F.lit(END))).alias("at", "word"))


def matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words, start, size, items) of the windows in documents, and one
    row with a null start for each document; docs has (doc_id, text)."""
    end = windows.sparkSession.range(1).select(
        F.lit(END).alias("token"), F.lit(None).cast("int").alias("offset"),
        F.lit(None).cast("string").alias("window"), F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("array<string>").alias("items"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = joined(F.slice("all", F.greatest(start, F.lit(0)) + 1, F.col("size"))) == F.col("window")
    return spread_words(docs).join(
        F.broadcast(windows.unionByName(end)), F.lower("word") == F.col("token")).where(
        F.col("window").isNull() | (fits & same)).select(
        "doc_id", "digest", "n_words", F.when(F.col("window").isNotNull(), start).alias("start"),
        "size", "items")


def matches_by_shuffle(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """As `matches`, for more windows of at most `size` words than may be broadcast."""
    bits, may_be = key_bits(materialise(windows.select("token").distinct(), "prefix-words"), "token")
    token, is_end = F.lower("word"), F.col("word") == END
    first = F.greatest(F.col("at") - (size - 1), F.lit(0))
    places = materialise(spread_words(docs).withColumn("token", token).crossJoin(
        F.broadcast(bits)).where(is_end | may_be("token")).select(
        "doc_id", "digest", "n_words", "at", "token", first.alias("first"),
        F.when(~is_end, F.slice("all", first + 1, F.lit(2 * size - 1))).alias("near")), "word-places")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = joined(F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("size"))
                  ) == F.col("window")
    hits = spread_join(places.where(F.col("token") != END), windows, ["token"], "token",
                       salt_by=["doc_id", "digest", "at"], side_salt_by=["window"]).where(
        fits & same).select("doc_id", "digest", "n_words", start.alias("start"), "size", "items")
    return hits.unionByName(places.where(F.col("token") == END).select(
        "doc_id", "digest", "n_words", F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<string>").alias("items")))


def find_items(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
               text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, digest (xxhash64 of the text), n_words, spans, items.

    spans lists the windows found as (start, end) in words, end exclusive; items the
    ids found, as strings, sorted. A document's rows meet by its id and digest, so what is
    grouped is one document's hits.
    """
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    windows = materialise(item_windows(items, size, item_id, item_text), "windows")
    made = materialise(prefixes(windows, pair), "prefixes")
    found = (matches(pair, made) if made.count() <= BLOCK_WINDOWS
             else matches_by_shuffle(pair, made, size))
    span = F.when(F.col("start").isNotNull(), F.struct(
        "start", (F.col("start") + F.col("size")).alias("end")))
    return found.groupBy("doc_id", "digest", "n_words").agg(
        F.sum(F.when(F.col("start").isNull(), 1)).alias("copies"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).select(
        "doc_id", "digest", "n_words", "spans", "items",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def covered(spans: Column) -> Column:
    """The number of words in the union of sorted spans."""
    none = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, none, lambda a, x: F.struct(
        F.greatest(a["to"], x["end"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n")),
        lambda a: a["n"])


def contaminated_report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of docs."""
    found = find_items(docs, items, size)
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"),
        covered(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window.

    The merge hint keeps one plan at every size.
    """
    hit = find_items(docs, items, size, id_col, text_col).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest")).distinct().hint("merge")
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(
        F.col(text_col).cast("string")) == F.col("_hit_digest")), "left_anti")
