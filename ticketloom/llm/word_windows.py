"""Substring dedup by level-wise doubling of word windows.

Level 1 finds the windows of half the length that occur more than once: at the anchors
of the full windows only, as each full window holds one such half-length window. What
survives is extended to twice that length: around each surviving anchor the full windows
are compared, and those that an earlier document has too survive. Equal regions of
anchors, up to three halves long, are settled as one. The levels end at the window's length.

Edge cases: null and empty texts have no words; words are runs of other characters than
ASCII white space, compared as they are; a text with fewer words than a window keeps
all; repeated or null ids: see common.numbered, each row is a document of its own there, and
null ids come last; windows are judged on the input; other columns are not looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import anchors
from ticketloom.llm.common import encoded, map_batches, numbered

#: A second base, so that full windows are told apart by 128 bits.
SECOND = anchors.Powers(0xC2B2AE3D27D4EB4F)


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))


def slice_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words of a slice, and where each text's words end."""
    words, ends = [], []
    for text in encoded(batch.column("text")):
        words += text.split()
        ends.append(len(words))
    return word_values(words), np.array(ends, np.int64)


def half_windows(docs: DataFrame, window: int) -> DataFrame:
    """Level 1: the anchors (gram, class, row, place) of half the window's length."""
    def step(batch):
        values, ends = slice_values(batch)
        gram, class_, first, anchor, last = anchors.find(values, ends, window, window // 2)
        of = np.searchsorted(ends, first, "right")
        begin = np.concatenate([[0], ends])[of]
        place = anchors.packed(first - begin, anchor - begin, last - begin)
        return anchors.batch(gram, class_, batch.column("row").to_numpy()[of], place,
                             other_rows_only=True)

    return map_batches(docs.select("row", "text"), step, anchors.SCHEMA)


def full_windows(asked: DataFrame, window: int) -> DataFrame:
    """Level 2: (a, b, row, start): the full windows at the anchors that survive level 1."""
    def step(batch):
        values, ends = slice_values(batch)
        begins = np.concatenate([[0], ends[:-1]])
        lists = batch.column("places")
        sizes = np.diff(lists.offsets.to_numpy())
        first, _, last = anchors.unpacked(lists.flatten().to_numpy())
        of = np.repeat(np.arange(batch.num_rows), sizes)
        counts = last - first + 1
        of = np.repeat(of, counts)
        within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(first, counts) + within
        at = start + begins[of]
        both = [anchors.run_hashes(anchors.prefix_sums(values, powers), at, at + window, powers)
                for powers in (anchors.POWERS, SECOND)]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(x.view(np.int64)) for x in both],
             pa.array(batch.column("row").to_numpy()[of]), pa.array(start)],
            ["a", "b", "row", "start"])

    return map_batches(asked.drop("grams"), step, "a long, b long, row long, start long")


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(row, spans) of the words that windows of earlier rows cover; docs is numbered."""
    marked = anchors.marks(half_windows(docs, window), other_rows_only=True)
    windows = full_windows(anchors.requests(docs, marked), window)
    owners = windows.groupBy("a", "b").agg(F.min("row").alias("least"), F.max("row").alias("most"))
    more = windows.join(owners.where("most > least"), ["a", "b"]).where("row > least").select(
        "row", "start", (F.col("start") + window).alias("end"))
    return anchors.covers(marked, more, window)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, spans (removed words, merged), kept (the words kept, joined
    by one blank)."""
    own = numbered(docs, id_col, text_col)
    rows = own.join(repeated_spans(own, window), "row", "left").select("id", "text", "spans")

    def step(batch):
        n, removed, kept = [], [], []
        for text, spans in zip(encoded(batch.column("text")), batch.column("spans").to_pylist(),
                               strict=True):
            words = text.split()
            n.append(len(words))
            gone = anchors.merged([(x["start"], x["end"]) for x in spans or []])
            removed.append([{"start": a, "end": b} for a, b in gone.tolist()])
            edges = [0, *gone.ravel().tolist(), len(words)]
            kept.append(b" ".join([word for a, b in zip(edges[::2], edges[1::2], strict=True)
                                   for word in words[a:b]]).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, span),
             pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    kind = dict(rows.dtypes)["id"]
    return map_batches(rows, step, (
        f"doc_id {kind}, n_words long, spans array<struct<start: long, end: long>>, kept string"))
