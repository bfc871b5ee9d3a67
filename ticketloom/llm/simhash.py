"""SimHash fingerprints, linked exactly by distributed vantage-point trees.

Fingerprints are 64 bits. Two that differ in at most `radius` bits differ in at most
radius // 2 bits in one half of them, so there is a tree for each half. The levels of a tree
measure the Hamming distance between a slice of the half and a vantage point (the slice of a
constant fingerprint), and a node's children are its rings. Distances to one vantage
point obey the triangle inequality, and the slices are disjoint, so ring numbers of two
fingerprints cannot differ, summed over the levels, by more than their distance: all other
branches are pruned. What is left of the budget of a half reaches few rings besides a
fingerprint's own. So each fingerprint is put into its own shard (leaf) and asks in the
shards over its boundary; as distance is symmetric, it asks in outer rings only.

In a shard, exact distances decide. Fingerprints are distinct there, and a shard returns a
spanning forest of its links rather than the links: as many rows as it got, at most.

Edge cases: null and empty texts have fingerprint zero, and link like others; texts of
fewer words than a shingle are one shingle; null ids take part, but a component is
named by its smallest id that is not null (null if it has none); repeated rows keep
their rows; an empty table gives none.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.common import encoded, map_arrow, map_batches
from ticketloom.llm.components import components
from ticketloom.session import materialise

SEED = 42
LEVELS = 16
#: The vantage points of all levels, 32 bits each; any constants do.
VANTAGE = (0x9E3779B9, 0x7F4A7C15)
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The SimHash over the word shingles of a UTF-8 text, ASCII letters in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    parts = zip(*[words[at:] for at in range(shingle)], strict=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(seed)),
                         np.uint64, n)
    counts = np.zeros(64, np.int64)
    for first in range(0, n, CHUNK):
        some = hashes[first:first + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_fingerprints(docs: DataFrame, shingle: int, name: str,
                      text_col: str = "text") -> DataFrame:
    """The rows with all their columns, and their fingerprint as a signed 64-bit column."""
    def step(batch):
        prints = np.array([fingerprint(text, shingle)
                           for text in encoded(batch.column(text_col))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(prints)], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return map_batches(docs, step, schema, text_col)


def rings(prints: np.ndarray, half: int, levels: int = LEVELS) -> np.ndarray:
    """The ring number on every level of the tree over one half of the bits."""
    bits = ((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    away = bits ^ np.uint32(VANTAGE[half])
    width = 32 // levels
    parts = (away[:, None] >> np.arange(0, 32, width, dtype=np.uint32)) & np.uint32((1 << width) - 1)
    return np.bitwise_count(parts)


def _leaf(paths: np.ndarray, half: int) -> np.ndarray:
    """One number per leaf: the tree, then the ring numbers (0 to 2 for two bits) in base 3."""
    key = np.full(len(paths), half + 1, np.uint64)
    for level in range(paths.shape[1]):
        key = key * np.uint64(3) + paths[:, level].astype(np.uint64)
    return key.view(np.int64)


def placements(prints: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(shard, asks, fingerprint): each fingerprint in its own shards and where it asks.

    With radius 3 a half has a budget of one bit, so one ring on one level may differ.
    """
    def step(batches):
        for batch in batches:
            own = batch.column("fingerprint").to_numpy().view(np.uint64)
            shard, asks, which = [], [], []
            for half in (0, 1):
                paths = rings(own, half, levels)
                home = _leaf(paths, half)
                shard.append(home)
                asks.append(np.zeros(len(own), bool))
                which.append(own)
                for level in range(levels):
                    outer = paths[:, level] < 32 // levels
                    shard.append(home[outer] + 3 ** (levels - 1 - level))
                    asks.append(np.ones(int(outer.sum()), bool))
                    which.append(own[outer])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shard)), pa.array(np.concatenate(asks)),
                 pa.array(np.concatenate(which).view(np.int64))],
                ["shard", "asks", "fingerprint"])

    return map_arrow(prints, step, "shard long, asks boolean, fingerprint long")


def forest(members: np.ndarray, asking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members, and from those asking to members."""
    all_ = np.concatenate([members, asking])
    group = np.arange(len(all_))
    links = []
    for at in range(len(all_)):
        others = members[:min(at, len(members))]
        near = np.flatnonzero(np.bitwise_count(others ^ all_[at]) <= radius)
        if not len(near):
            continue
        groups, which = np.unique(group[near], return_index=True)
        for other, first in zip(groups.tolist(), near[which].tolist(), strict=True):
            if other != group[at]:
                links.append((int(all_[at]), int(all_[first])))
                group[group == other] = group[at]
    return links


def linked(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that join the same fingerprints as all links of at most radius bits."""
    if radius // 2 > 1:
        raise ValueError("a tree for each half of the bits covers a radius of up to 3")
    shards = placements(prints).repartition("shard").sortWithinPartitions("shard", "asks")

    def step(batches):
        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False),
                   batch.column(2).to_numpy().view(np.uint64)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
            yield from solved([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if held is not None:
            yield from solved(held)

    def solved(rows):
        shard, asks, own = rows
        starts = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1))
        ends = np.append(starts[1:], len(shard))
        members = np.add.reduceat(~asks, starts) if len(starts) else starts
        links = []
        for start, end, n in zip(*[x[(members > 0) & (ends - starts > 1)].tolist()
                                   for x in (starts, ends, members)], strict=True):
            links += forest(own[start:start + n], own[start + n:end], radius)
        if links:
            found = np.array(links, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return map_arrow(shards, step, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(
        with_fingerprints(pair, shingle, "fingerprint").drop("text"), "fingerprints")
    named = grouped(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), radius)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("fingerprint", "component_id")
    return found.join(names, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def grouped(classes: DataFrame, radius: int) -> DataFrame:
    """The classes of equal fingerprints (fingerprint, least) with their component."""
    classes = materialise(classes, "classes")
    groups = components(linked(classes.select("fingerprint"), radius))
    return classes.join(
        groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))


def one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, one for each component: that of its smallest id.

    Of rows with equal ids in a component, the first of the written table stays. Null ids
    come last.
    """
    name, place = free_name(docs, "_fingerprint"), free_name(docs, "_place")
    held = materialise(with_fingerprints(docs, shingle, name, text_col).withColumn(
        place, F.monotonically_increasing_id()), "rows")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                     F.col(place).alias("place"))
    named = grouped(held.groupBy(F.col(name).alias("fingerprint")).agg(
        F.min(first).alias("least")), radius)
    keep = named.groupBy("component").agg(F.min("least").alias("least")).select(
        F.col("least.place").alias(place))
    return held.join(keep, place, "left_semi").select(*[f"`{c}`" for c in docs.columns])
