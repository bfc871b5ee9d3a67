"""Suffix-array dedup of bytes: deep-shallow sorting of the suffixes at anchors.

A byte is removed if a string of `window` bytes around it also starts earlier. Equal
strings have equal anchors (see anchors), so the suffix array is sparse: it holds the
suffixes at anchors, as far as a window reaches, and likewise the text before them read
backwards. Each task sorts the suffixes whose anchors' grams it was dealt:

  shallow: multikey quicksort over letters of eight bytes, to SHALLOW letters;
  deep: suffixes that agree so far go into a blind trie, which stores only the depths at
  which they differ, and compares a new suffix with one leaf; its walk gives their order.

Neighbours' common prefixes then say which windows around an anchor are equal: those whose
parts after and before the anchor agree as far as they reach. The first of equal
windows stays.

Edge cases: null and empty texts have no bytes; texts shorter than a window keep all;
matches never cross texts; overlapping repeats inside one text count; repeated or null ids:
see common.numbered, rows of one id come in the order of their texts' hash, null ids
last; what is kept may be cut inside a character, so it is returned as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketloom.llm import anchors
from ticketloom.llm.common import encoded, map_arrow, map_batches, numbered

GRAM = 32
SHALLOW = 4
SMALL = 24
#: A number for each byte, from a fixed seed.
BYTE_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)


def slice_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts of a slice, their values, and where each text ends."""
    texts = encoded(batch.column("text"))
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, BYTE_VALUES[data], np.cumsum([len(text) for text in texts])


def byte_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def step(batch):
        _, values, ends = slice_values(batch)
        grams, class_, first, anchor, last = anchors.find(values, ends, window, gram)
        of = np.searchsorted(ends, first, "right")
        begin = np.concatenate([[0], ends])[of]
        place = anchors.packed(first - begin, anchor - begin, last - begin)
        return anchors.batch(grams, class_, batch.column("row").to_numpy()[of], place,
                             other_rows_only=False)

    return map_batches(docs.select("row", "text"), step, anchors.SCHEMA)


def contexts(asked: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, row, place, right, left): the bytes from each anchor on, and those before it
    read backwards, as far as a window around the anchor's gram reaches."""
    def step(batch):
        rows, right, left = [], [], []
        lists = batch.column("places").to_pylist()
        for at, (text, places) in enumerate(zip(encoded(batch.column("text")), lists, strict=True)):
            for anchor in anchors.unpacked(np.array(places, np.int64))[1].tolist():
                rows.append(at)
                right.append(text[anchor:anchor + window])
                left.append(text[max(0, anchor - window + gram):anchor][::-1])
        return pa.RecordBatch.from_arrays(
            [batch.column("grams").flatten(),
             batch.column("row").take(pa.array(rows, pa.int64())),
             batch.column("places").flatten(), pa.array(right, pa.binary()),
             pa.array(left, pa.binary())], ["gram", "row", "place", "right", "left"])

    return map_batches(asked, step,
                       "gram long, row long, place long, right binary, left binary")


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Orders strings that share a long prefix.

    A node is [depth, children by the byte there]; -1 stands for the end of a string. A
    leaf is the list of the numbers of equal strings.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None

    @staticmethod
    def letter(string: bytes, depth: int) -> int:
        return string[depth] if depth < len(string) else -1

    def add(self, number: int) -> None:
        string = self.strings[number]
        if self.root is None:
            self.root = [number]
            return
        node, path = self.root, []
        while isinstance(node, tuple):  # blindly: any leaf below agrees as far as the path does
            path.append(node)
            depth, children = node
            node = children.get(self.letter(string, depth)) or next(iter(children.values()))
        other = self.strings[node[0]]
        shared = common(string, other)
        if shared == len(string) == len(other):
            node.append(number)
            return
        above = [step for step in path if step[0] < shared]
        at = path[len(above)] if len(above) < len(path) else node
        if isinstance(at, tuple) and at[0] == shared:
            at[1][self.letter(string, shared)] = [number]
            return
        fork = (shared, {self.letter(other, shared): at, self.letter(string, shared): [number]})
        if above:
            above[-1][1][self.letter(string, above[-1][0])] = fork
        else:
            self.root = fork

    def walk(self) -> tuple[list[int], list[int]]:
        """(numbers in order, common prefix of each with the one before; the first has -1)."""
        order, shared, stack = [], [], [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, tuple):
                depth, children = node
                letters = sorted(children, reverse=True)
                for letter in letters[:-1]:
                    stack.append((children[letter], depth))
                stack.append((children[letters[-1]], before))
            else:
                order += node
                shared += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, shared


def deep_shallow(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before) of strings of at most `width` bytes."""
    n = len(strings)
    order, shared = np.empty(n, np.int64), np.zeros(n, np.int64)
    letters = np.frombuffer(b"".join([s[:8 * SHALLOW].ljust(8 * SHALLOW, b"\0") for s in strings]),
                            ">u8").reshape(n, SHALLOW).astype(np.uint64)

    def deep(group: np.ndarray, at: int) -> None:
        trie = BlindTrie(strings)
        for number in group.tolist():
            trie.add(number)
        numbers, prefixes = trie.walk()
        order[at:at + len(group)] = numbers
        shared[at + 1:at + len(group)] = prefixes[1:]
        if at:
            shared[at] = common(strings[order[at - 1]], strings[order[at]])

    # Groups wait on a stack, the last in order first, so they come out in order.
    stack, at = [(np.arange(n), 0)] if n else [], 0
    while stack:
        group, depth = stack.pop()
        if len(group) <= SMALL or depth == SHALLOW:
            deep(group, at)
            at += len(group)
            continue
        letter = letters[group, depth]
        pivot = np.partition(letter[[0, len(group) // 2, -1]], 1)[1]
        same = letter == pivot
        for part, next_depth in ((group[letter > pivot], depth), (group[same], depth + 1),
                                 (group[letter < pivot], depth)):
            if len(part):
                stack.append((part, next_depth))
    return order, shared


def repeats(right: list[bytes], left: list[bytes], low: np.ndarray, high: np.ndarray,
            window: int) -> tuple[np.ndarray, np.ndarray]:
    """For anchors in the order of their places: the least and greatest number of bytes
    before the anchor at which a window around it equals an earlier one (-1: at none).

    low and high say which windows are the anchor's own.
    """
    n = len(right)
    ranks = []
    for strings in (right, left):
        order, shared = deep_shallow(strings, window)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append((rank, shared))
    (rank, shared), (rank_left, shared_left) = ranks
    least, most = np.full(n, -1), np.full(n, -1)
    for before in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        own = np.flatnonzero((low <= before) & (before <= high))
        after_group = np.cumsum(shared < window - before)[rank[own]]
        before_group = np.cumsum(shared_left < before)[rank_left[own]]
        _, first = np.unique(after_group * (n + 1) + before_group, return_index=True)
        again = np.ones(len(own), bool)
        again[first] = False
        hit = own[again]
        least[hit] = np.where(least[hit] < 0, before, least[hit])
        most[hit] = before
    return least, most


def repeated_parts(around: DataFrame, window: int) -> DataFrame:
    """(row, start, end) of what repeats, from contexts, each gram in one task."""
    def step(batches):
        held = [[], [], [], []]
        for batch in batches:
            for own, name in zip(held, ("row", "place", "right", "left"), strict=True):
                own += batch.column(name).to_pylist()
        if not held[0]:
            return
        row, place = np.array(held[0], np.int64), np.array(held[1], np.int64)
        order = np.lexsort((place, row))
        row, (first, anchor, last) = row[order], anchors.unpacked(place[order])
        right, left = ([own[at] for at in order.tolist()] for own in held[2:])
        least, most = repeats(right, left, anchor - last, anchor - first, window)
        hit = least >= 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[hit]) for x in (row, anchor - most, anchor - least + window)],
            ["row", "start", "end"])

    return map_arrow(around.repartition("gram").drop("gram"), step,
                     "row long, start long, end long")


def repeated_spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(row, spans) of the bytes that repeat; docs is numbered."""
    marked = anchors.marks(byte_anchors(docs, window, gram), other_rows_only=False)
    around = contexts(anchors.requests(docs, marked), window, gram)
    return anchors.covers(marked, repeated_parts(around, window), window)


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = GRAM,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed bytes, merged), kept (the other bytes)."""
    own = numbered(docs, id_col, text_col)
    rows = own.join(repeated_spans(own, window, gram), "row", "left").select("id", "text", "spans")

    def step(batch):
        n, removed, kept = [], [], []
        for text, spans in zip(encoded(batch.column("text")), batch.column("spans").to_pylist(),
                               strict=True):
            n.append(len(text))
            gone = anchors.merged([(x["start"], x["end"]) for x in spans or []])
            removed.append([{"start": a, "end": b} for a, b in gone.tolist()])
            edges = [0, *gone.ravel().tolist(), len(text)]
            kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, span),
             pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = dict(rows.dtypes)["id"]
    return map_batches(rows, step, (
        f"doc_id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"))
