"""Anchors: the few places at which equal windows of any texts can be found.

A window is a run of `window` symbols (words or bytes) of one text. Of the grams (runs
of `gram` symbols) in a window, the one with the least hash, the first of equal ones, is the
window's anchor. It depends on the window's symbols alone, so equal windows have equal
anchors, wherever they stand, and comparing places with equal anchor grams misses no
repeated window. Neighbouring windows share anchors: about 2 of (window - gram + 2)
places are anchors. The windows of an anchor cover its region, one run of symbols.

Regions that are equal as a whole are a class. Before any shuffle, each slice of texts settles
its own classes: all but their first regions repeat something earlier, whatever other slices
hold, so a passage that very many texts share sends one anchor per slice. The settled ones
are dealt by their row, the others meet by the hash of their gram, sorted, and stream
through a task, so the memory of a task does not grow with a gram. What is left for exact
comparison are the first regions of grams that stand in different regions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import map_arrow
from ticketloom.session import materialise

BASE = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)
#: place = first window << 20 | anchor - first window << 10 | last window - first window
FIELD = 10
MOST = (1 << FIELD) - 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self, base: int = BASE):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def prefix_sums(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    up, _ = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               powers: Powers = POWERS) -> np.ndarray:
    """A hash of each run of symbols [start, end) that depends on its symbols alone."""
    _, down = powers.upto(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def find(values: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """(gram hash, class hash, first window, anchor, last window) of all anchors of texts.

    values holds the texts' symbols one after another as 64-bit numbers, ends where each
    text ends. The class hash is of the anchor's region and its place in it.
    """
    n = len(values)
    if n < window:
        return [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3
    sums = prefix_sums(values)
    _, down = POWERS.upto(n + 1)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    across, size = window - gram + 1, 1
    while 2 * size <= across:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < across:
        least = np.minimum(least[:-(across - size)], least[across - size:])
    at = (least & LOW).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    inside = np.repeat(ends, sizes)[:len(at)] - np.arange(len(at)) >= window
    starts = np.flatnonzero(inside)
    if not len(starts):
        return [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3
    anchor = at[starts]
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    first, anchor = starts[new], anchor[new]
    last = starts[np.append(new[1:], len(starts)) - 1]
    classes = run_hashes(sums, first, last + window) ^ mixed((anchor - first).astype(np.uint64))
    return grams[anchor], classes, first, anchor, last


def packed(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << 2 * FIELD | anchor - first << FIELD | last - first


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 2 * FIELD
    return first, first + (place >> FIELD & MOST), first + (place & MOST)


#: What `batch` returns; salt is 0 for anchors that still have to meet others.
SCHEMA = "gram long, class long, row long, place long, salt long"


def batch(grams: np.ndarray, classes: np.ndarray, row: np.ndarray, place: np.ndarray,
          other_rows_only: bool) -> pa.RecordBatch:
    """The anchors of one slice, those settled within it marked by a salt."""
    order = np.lexsort((place, row, classes))
    own, rows = classes[order], row[order]
    head = np.diff(own, prepend=~own[:1]) != 0
    again = ~head
    if other_rows_only:
        again = rows > rows[np.flatnonzero(head)][np.cumsum(head) - 1]
    salt = np.zeros(len(own), np.uint64)
    salt[order[again]] = mixed(rows[again].astype(np.uint64)) | np.uint64(1)
    return pa.RecordBatch.from_arrays(
        [pa.array(grams.view(np.int64)), pa.array(classes.view(np.int64)), pa.array(row),
         pa.array(place), pa.array(salt.view(np.int64))],
        ["gram", "class", "row", "place", "salt"])


def marks(anchors: DataFrame, other_rows_only: bool) -> DataFrame:
    """(row, gram, place, later) for what matters of anchors (SCHEMA).

    later: an equal region stands earlier (in an earlier row, if other_rows_only), so all
    of this one's windows do. Not later: the first of a class (or those in the class's first
    row) of a gram that has several classes. The table is written.
    """
    names = ["gram", "class", "row", "place"]

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in columns], ["row", "gram", "place", "later"])

    placed = anchors.repartition("gram", "salt").sortWithinPartitions(*names)

    def step(batches):
        before = None  # gram, class and first row of the class of the row before
        held = 0       # classes of that gram so far
        for batch in batches:
            gram, class_, row, place = (batch.column(name).to_numpy() for name in names)
            known = batch.column("salt").to_numpy() != 0
            if known.any():
                yield out(row[known], gram[known], place[known], np.ones(known.sum(), bool))
                gram, class_, row, place = (x[~known] for x in (gram, class_, row, place))
            if not len(gram):
                continue
            new_gram = np.diff(gram, prepend=gram[0]) != 0
            new_class = new_gram | (np.diff(class_, prepend=class_[0]) != 0)
            new_gram[0] = before is None or gram[0] != before[0]
            new_class[0] = new_gram[0] or class_[0] != before[1]
            heads = np.flatnonzero(new_class)
            which = np.cumsum(new_class) - 1
            firsts = row[heads] if len(heads) else row[:0]
            if which[0] < 0:  # the first class goes on from the batch before
                firsts = np.concatenate([[before[2]], firsts])
                which = which + 1
            own = firsts[which]
            later = row > own if other_rows_only else ~new_class
            # Grams with several classes; one that may go on in the next batch counts as such.
            group = np.cumsum(new_gram) - (0 if not new_gram[0] else 1)
            classes = np.bincount(group, new_class, minlength=group[-1] + 1)
            if not new_gram[0]:
                classes[0] += held
            held = classes[-1]
            several = classes[group] > 1
            several[group == group[-1]] = True
            use = later | several
            before = (gram[-1], class_[-1], own[-1])
            yield out(row[use], gram[use], place[use], later[use])

    return materialise(map_arrow(
        placed, step, "row long, gram long, place long, later boolean"), "marks")


def requests(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(row, text, grams, places): the texts with the anchors that need a closer look.

    A row's list is as long as its text has anchors.
    """
    asked = marked.where("not later").groupBy("row").agg(
        F.collect_list(F.struct("gram", "place")).alias("asked"))
    return docs.select("row", "text").join(asked, "row").select(
        "row", "text", F.col("asked.gram").alias("grams"), F.col("asked.place").alias("places"))


def covers(marked: DataFrame, more: DataFrame, window: int) -> DataFrame:
    """(row, spans): the sorted spans (start, end) that repeat something earlier.

    Spans of one row may overlap; a row has as many as its text has anchors or windows.
    """
    first = F.shiftright("place", 2 * FIELD)
    last = first + F.col("place").bitwiseAND(F.lit(MOST))
    spans = marked.where("later").select(
        "row", first.alias("start"), (last + window).alias("end")).union(
        more.select("row", "start", "end"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(
        "spans"))


def merged(spans: list[tuple[int, int]]) -> np.ndarray:
    """Sorted spans, those that overlap or touch made one."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return np.array(out, np.int64).reshape(-1, 2)
