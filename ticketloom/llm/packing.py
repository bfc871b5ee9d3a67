"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Only the number of pieces per length (at most `capacity` numbers) decides how bins
are filled, so the plan is made on that histogram, and pieces then find their place
by their rank among the pieces of equal length. No task sees more than one partition.

Edge cases: a null or empty text is one piece that holds the end id alone; a longer
document is cut into pieces of `capacity` tokens, the last one may be shorter; ties
between pieces of equal length are broken by their place in the written table; null
and repeated ids are packed like any others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.common import ENCODED_BYTES, encoded, map_arrow, map_batches
from ticketloom.llm.encode import encoder
from ticketloom.session import materialise


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int,
               id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Encode each text once and cut it: one row per piece.

    part and nth say where a piece stands: it is the nth of its length in its task.
    """
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(pair.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, "
              "nth long" + (", ids binary" if with_ids else ""))
    end = np.array([end_id], "<u4").tobytes()
    size = capacity * 4
    seen: dict[int, np.ndarray] = {}

    def step(batch):
        part = TaskContext.get().partitionId()
        if part not in seen:
            seen.clear()
            seen[part] = np.zeros(capacity + 1, np.int64)
        counts = seen[part]
        rows, piece, lengths, sums, nth, kept = [], [], [], [], [], []
        all_ids = encoder(tokenizer).encode(encoded(batch.column("text")))
        for at, ids in enumerate(all_ids):
            ids += end
            for number, first in enumerate(range(0, len(ids), size)):
                part_ids = ids[first:first + size]
                length = len(part_ids) // 4
                rows.append(at)
                piece.append(number)
                lengths.append(length)
                sums.append(zlib.crc32(part_ids))
                nth.append(counts[length])
                counts[length] += 1
                if with_ids:
                    kept.append(part_ids)
        numbers = np.array(piece, np.int64)
        arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                  pa.array(numbers.astype(np.int32)), pa.array(numbers * capacity),
                  pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                  pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
        if with_ids:
            arrays.append(pa.array(kept, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    return map_batches(pair, step, schema, max_bytes=ENCODED_BYTES)


def two_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Fill bins from the numbers of pieces per length.

    Each step fills one bin: the longest pieces that still fit, until none does; then
    the bin's smallest piece gives way to the two unpacked pieces that fill its gap,
    widened by that piece, best, if they fill more of it. The step is repeated as
    often as the pieces last. Returns rows (length, first rank, ranks, first sequence,
    pieces of this length per sequence, offset of the first), sorted by length and rank.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    lengths = [int(x) for x in np.flatnonzero(left)]
    used_up = np.zeros(capacity + 1, np.int64)
    sequence, rows = 0, []
    while lengths:
        gap, bin_ = capacity, {}
        at = len(lengths)
        while gap:
            at = bisect_right(lengths, gap, 0, at)
            if not at:
                break
            at -= 1
            length = lengths[at]
            times = min(int(left[length]), gap // length)
            bin_[length] = times
            gap -= times * length
        if gap and sum(bin_.values()) > 1:
            small = min(bin_)
            room = gap + small
            for length, times in bin_.items():
                left[length] -= times
            free = np.flatnonzero(left[:room + 1])
            if len(free):
                other = np.searchsorted(free, room - free, "right") - 1
                alone = (other >= 0) & (free[other] == free) & (left[free] < 2)
                other = np.where(alone, other - 1, other)
                sums = np.where(other >= 0, free + free[other], 0)
                best = int(np.argmax(sums))
                if sums[best] > small:
                    left[small] += 1
                    bin_[small] -= 1
                    for length in (int(free[best]), int(free[other[best]])):
                        bin_[length] = bin_.get(length, 0) + 1
                        left[length] -= 1
                    if not bin_[small]:
                        del bin_[small]
            for length, times in bin_.items():
                left[length] += times
        repeat = min(int(left[length]) // times for length, times in bin_.items())
        offset = 0
        for length in sorted(bin_, reverse=True):
            times = bin_[length]
            rows.append((length, used_up[length], repeat * times, sequence, times, offset))
            used_up[length] += repeat * times
            left[length] -= repeat * times
            offset += times * length
            if not left[length]:
                lengths.remove(length)
        sequence += repeat
    plan = np.array(rows, np.int64).reshape(-1, 6)
    return plan[np.lexsort((plan[:, 1], plan[:, 0]))]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; see the module for edge cases.

    The plan has a row per length and kind of bin. It is bounded by the capacity, not by
    the data, so it goes to the tasks as a value. with_ids adds each piece's token ids
    (little-endian unsigned 32-bit) for `sequences`.
    """
    pieces = materialise(
        cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {row.length: row.n for row in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = two_fit_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn(
        "nth", F.col("nth") + F.col("before")).drop("part", "before")
    keys = (plan[:, 0] << 44) + plan[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy()
            spot = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            within = rank - spot[:, 1]
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spot[:, 3] + within // np.maximum(spot[:, 4], 1)),
                 pa.array(spot[:, 5] + within % np.maximum(spot[:, 4], 1) * length)],
                [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = dict(pieces.dtypes)["doc_id"]
    return map_arrow(ranked, place, (
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
        + "ids binary, " * with_ids + "sequence_id long, offset long"))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids, from pack(with_ids=True).

    A group is one sequence, so it is bounded by the capacity.
    """
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", "n_tokens",
        F.expr("aggregate(transform(parts, p -> p.ids), X'', (a, x) -> concat(a, x))").alias(
            "ids"))
