"""Exact search for queries that share frequent features with a large part of the articles.

Joins make one row per feature, query and article; for whole turns these are more rows than there
are pairs. Here a block of articles is held as sorted arrays by one task, and the queries stream
past it in tiles: the scores of a query with all articles of the block are one weighted count.
A task gives back what can be among a query's best, so no pair is written that cannot.

Bounds: a task holds one block (about BLOCK_POSTINGS postings) and one tile (TILE_FEATURES features
of whole queries). Queries are sent to every block, so the traffic is queries times blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.skew import spread_join
from ticketloom.operators.tfidf import SearchIndex, opened_lists
from ticketloom.session import materialise, shuffle_partitions

BLOCK_POSTINGS = 1_000_000
TILE_FEATURES = 100_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Postings that are dealt out to the blocks at once.
CHUNK_ROWS = 250_000

#: Postings (part 0), lengths of articles (1) and tiles of queries (2) of a block.
PACKED = ("block int, part int, keys binary, ends binary, numbers binary, first binary, "
          "second binary, floors binary")
NAMES = ["block", "part", "keys", "ends", "numbers", "first", "second", "floors"]


def block_steps(top_k: int, threshold: float, slack: float) -> dict[str, Callable]:
    """What is done with rows and blocks; closures, as workers need not know this module."""
    def packed(block: int, part: int, *columns: np.ndarray) -> pa.RecordBatch:
        data = [column.tobytes() for column in columns] + [b""] * (6 - len(columns))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([part], pa.int32()),
             *[pa.array([one], pa.binary()) for one in data]], NAMES)

    def column(batch: pa.RecordBatch, name: str, kind=np.float64) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(kind, copy=False)

    def dealt_out(part: int, names: tuple[str, ...]) -> Callable:
        """Rows (block, id, names) to packed rows, one per block and chunk; `number` is a whole number."""
        def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            block, *columns = (np.concatenate(one) for one in zip(*held))
            order = np.argsort(block, kind="stable")
            found, starts = np.unique(block[order], return_index=True)
            columns = [one[order] for one in columns]
            for one, low, high in zip(found.tolist(), starts, [*starts[1:], len(block)]):
                ids, *rest = (values[low:high] for values in columns)
                number = rest.pop(0) if part == 0 else np.empty(0, np.int64)
                yield packed(one, part, ids, np.empty(0), number, *rest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append((column(batch, "block", np.int32), column(batch, "id", np.int64), *[
                    column(batch, name, np.int64 if name == "number" else np.float64)
                    for name in names]))
                size += batch.num_rows
                if size >= CHUNK_ROWS:
                    yield from out(held)
                    held, size = [], 0
            if size:
                yield from out(held)
        return run

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (q, number, first, second, floor), in the order of q, to tiles of whole queries."""
        def out(q, number, first, second, floor):
            keys, starts = np.unique(q, return_index=True)
            return packed(0, 2, keys, np.append(starts, len(q)).astype(np.int64), number, first,
                          second, floor[starts])

        kinds, held, size = (np.int64, np.int64, np.float64, np.float64, np.float64), [], 0
        for batch in batches:
            held.append([column(batch, name, kind) for name, kind in zip(
                ("q", "number", "first", "second", "floor"), kinds)])
            size += batch.num_rows
            if size >= TILE_FEATURES:
                rows = [np.concatenate(one) for one in zip(*held)]
                # The last query may go on in the next batch.
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield out(*[one[:cut] for one in rows])
                held, size = [[one[cut:] for one in rows]], size - cut
        if size:
            yield out(*[np.concatenate(one) for one in zip(*held)])

    class Block:
        """The postings of some articles, by feature, their weights over the articles' lengths."""

        def __init__(self, rows: list[dict[str, np.ndarray]], lengths: list[dict[str, np.ndarray]]):
            def joined(held, name):
                kind = np.int64 if name in ("keys", "numbers") else np.float64
                return np.concatenate([one[name] for one in held] or [np.empty(0, kind)])

            post, known = joined(rows, "keys"), joined(lengths, "keys")
            self.ids = np.unique(np.concatenate([post, known]))
            place = np.searchsorted(self.ids, post)
            numbers = joined(rows, "numbers")
            order = np.argsort(numbers, kind="stable")
            self.place = place[order]
            self.numbers, self.starts = np.unique(numbers[order], return_index=True)
            self.ends = np.append(self.starts[1:], len(numbers))
            self.weights = []
            at = np.searchsorted(self.ids, known)
            for name in ("first", "second"):
                scale = np.zeros(len(self.ids))
                scale[at] = joined(lengths, name)
                # A word of the headings (a weight of -1) counts as it is, whatever the length.
                weight, own = joined(rows, name)[order], scale[self.place]
                self.weights.append(np.where(weight < 0, 1.0, np.divide(
                    weight, own, out=np.zeros(len(own)), where=own > 0)))

        def best(self, tile: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(query, article, score) of what may be among a query's top_k."""
            n = len(self.numbers)
            at = np.searchsorted(self.numbers, tile["numbers"])
            held = (at < n) & (self.numbers[np.minimum(at, n - 1)] == tile["numbers"]) if n else (
                np.zeros(len(at), bool))
            found = []
            for i, (low, high) in enumerate(zip(tile["ends"], tile["ends"][1:])):
                mine = np.flatnonzero(held[low:high]) + low
                if not len(mine):
                    continue
                starts = self.starts[at[mine]]
                sizes = self.ends[at[mine]] - starts
                rows = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
                weights = np.repeat(tile["second"][mine], sizes) * self.weights[1][rows]
                if tile["first"][mine].any():
                    weights += np.repeat(tile["first"][mine], sizes) * self.weights[0][rows]
                scores = np.bincount(self.place[rows], weights, len(self.ids))
                hits = np.flatnonzero(scores >= max(threshold, tile["floors"][i]) - slack)
                if len(hits) > top_k:
                    least = np.partition(scores[hits], -top_k)[-top_k]
                    hits = hits[scores[hits] >= least - slack]
                found.append((np.full(len(hits), tile["keys"][i]), self.ids[hits], scores[hits]))
            if not found:
                return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            return tuple(np.concatenate(one) for one in zip(*found))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed rows, in the order of block and part, to (q, id, score)."""
        kinds, block, held, ready = dict.fromkeys(NAMES[2:5], np.int64), None, ([], []), None
        for batch in batches:
            for row in range(batch.num_rows):
                number, part = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                data = {name: np.frombuffer(batch.column(name)[row].as_buffer(),
                                            kinds.get(name, np.float64)) for name in NAMES[2:]}
                if number != block:
                    block, held, ready = number, ([], []), None
                if part < 2:
                    # The batch is freed; what is kept is copied.
                    held[part].append({name: values.copy() for name, values in data.items()})
                    continue
                if ready is None:
                    ready, held = Block(*held), ([], [])
                q, ids, scores = ready.best(data)
                if len(q):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q), pa.array(ids), pa.array(scores)], ["q", "id", "score"])

    return {"dealt_out": dealt_out, "tiles": tiles, "meet": meet}


def best_pairs(features: DataFrame, floors: DataFrame, headings: DataFrame, index: SearchIndex,
               profile, top_k: int, slack: float) -> DataFrame:
    """(q, id, score): all pairs that can be among a query's top_k, without the phrase bonus.

    q and id are whole numbers; floors(q, floor) are scores that a query's hits are known to reach.
    """
    spark = features.sparkSession
    steps = block_steps(top_k, profile.threshold, slack)
    known = features.where(F.col("df") > 0)
    numbered = materialise(known.groupBy("kind", "feature").agg(F.max("df").alias("df")).withColumn(
        "number", F.monotonically_increasing_id()), "asked-features")
    size = numbered.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    n_blocks = max(shuffle_partitions(spark), -(-size // BLOCK_POSTINGS))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")

    terms = numbered.where(F.col("kind") == "term").select(F.col("feature").alias("term"), "number")
    if index.lists is not None:
        opened = opened_lists(index.lists.join(terms, "term"), "number")
    else:
        opened = spread_join(index.postings, terms, ["term"], "term", ["id"])
    words = numbered.where(F.col("kind") == "word").select(F.col("feature").alias("word"), "number")
    in_headings = spread_join(headings.select("id", F.explode("words").alias("word")), words,
                              ["word"], "word", ["id"])
    postings = opened.select(block, "id", "number", "meta", "full").unionByName(in_headings.select(
        block, "id", "number", F.lit(0.0).alias("meta"), F.lit(-1.0).alias("full")))
    lengths = index.norms.select(block, "id", "meta_norm", "full_norm")

    n_words = features.groupBy("q").agg(
        F.greatest(F.count_if(F.col("kind") == "word"), F.lit(1)).alias("n_words"))
    asked = spread_join(known.select("q", "kind", "feature", "q_meta", "q_full"),
                        numbered.drop("df"), ["kind", "feature"], "feature", ["q"])
    rows = asked.join(n_words, "q").join(floors, "q", "left").select(
        "q", "number", (profile.meta_weight * F.col("q_meta")).alias("first"),
        F.when(F.col("kind") == "word", profile.overlap_weight / F.col("n_words")).otherwise(
            profile.full_weight * F.col("q_full")).alias("second"),
        F.coalesce("floor", F.lit(0.0)).alias("floor"))
    tiled = materialise(rows.repartition(shuffle_partitions(spark), "q").sortWithinPartitions(
        "q").mapInArrow(steps["tiles"], PACKED), "tiles")

    sent = postings.mapInArrow(steps["dealt_out"](0, ("number", "meta", "full")), PACKED).unionByName(
        lengths.mapInArrow(steps["dealt_out"](1, ("meta_norm", "full_norm")), PACKED)).unionByName(
        tiled.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    met = sent.repartitionById(n_blocks, F.col("block")).sortWithinPartitions(
        "block", "part").mapInArrow(steps["meet"], "q long, id long, score double")
    # Rows are large: Spark's own bound of 64 MB a batch, several times outside the heap, is too much.
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, 4_000_000)
    try:
        return materialise(met, "dense-pairs")
    finally:
        spark.conf.set(BATCH_BYTES, before)
