"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by frequency in the whole corpus, so the commonest 256
need one byte. A rank takes one to four bytes. Two bits per rank say how many; these
control bits stand in bytes of their own, four ranks each, before the data bytes.

A block (one row of the written table, about BLOCK_TOKENS tokens of whole documents):
    4 bytes  b"FVB1"            8 bytes  documents (u64)      8 bytes  tokens (u64)
    8 bytes per document: tokens of it (u64)
    one control byte per four ranks, the first rank in its lowest two bits
    data bytes, little-endian, as many per rank as its two bits say, plus one
The documents' ids stand beside it in an array column, and the table `ranks` holds the
token id of every rank. Blocks are stored as rows of Parquet files, as executors reach
shared storage through Spark only, and its commit protocol survives lost executors.

Edge cases: null and empty texts hold the end id alone; null ids come first; documents of
equal id stand in the order of their ids' hash; a document is never split, so one of
any length makes a block of its own; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.common import ENCODED_BYTES, encoded, map_arrow, map_batches, slices
from ticketloom.llm.encode import encoder
from ticketloom.session import materialise, new_folder

MAGIC = b"FVB1"
BLOCK_TOKENS = 1 << 18
#: Bytes of each of the four ranks of a control byte.
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Keeps the low bytes that belong to a rank of this many bytes.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    n = len(ranks)
    widths = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF))
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = widths
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    low = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    keep = np.arange(4, dtype=np.uint8) <= widths[:, None]
    return control.tobytes() + low[keep].tobytes()


def decode_ranks(data: np.ndarray, n: int) -> np.ndarray:
    """The ranks, by table lookup of each control byte."""
    controls = -(-n // 4)
    widths = WIDTHS[data[:controls]].reshape(-1)[:n]
    ends = np.cumsum(widths, dtype=np.int64)
    body = np.concatenate([data[controls:], np.zeros(3, np.uint8)])
    at = ends - widths
    values = body[at].astype(np.uint32)
    for byte in range(1, int(widths.max(initial=1))):
        values |= body[at + byte].astype(np.uint32) << np.uint32(8 * byte)
    return values & MASKS[widths]


def encode_block(sizes: list[int], ranks: np.ndarray) -> bytes:
    head = np.array([len(sizes), len(ranks)], "<u8").tobytes()
    return MAGIC + head + np.array(sizes, "<u8").tobytes() + encode_ranks(ranks)


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per document, ranks)."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    documents, tokens = np.frombuffer(block, "<u8", 2, 4).astype(np.int64)
    sizes = np.frombuffer(block, "<u8", documents, 20).astype(np.int64)
    data = np.frombuffer(block, np.uint8, -1, 20 + 8 * int(documents))
    return sizes, decode_ranks(data, int(tokens))


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str):
    """(doc_id, ids) of all documents, written once: ids as unsigned 16 or 32 bits."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = max(encoder(tokenizer).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def step(batch):
        ids = [np.frombuffer(one + end, "<u4").astype(kind).tobytes()
               for one in encoder(tokenizer).encode(encoded(batch.column("text")))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    schema = f"doc_id {dict(pair.dtypes)['doc_id']}, ids binary"
    return materialise(map_batches(pair, step, schema, max_bytes=ENCODED_BYTES), "token-ids"), kind, size


def count_ids(tokens: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id occurs in the corpus; as long as the vocabulary."""
    def step(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])

    rows = map_arrow(tokens.select("ids"), step, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():
        counts[row.id] = row.n
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write their blocks in ascending order of the id."""
    tokens, kind, size = token_table(docs, tokenizer, end_id, id_col, text_col)
    token_of = np.argsort(-count_ids(tokens, kind, size), kind="stable")
    rank_of = np.empty(size, np.uint32)
    rank_of[token_of] = np.arange(size, dtype=np.uint32)
    spark = docs.sparkSession
    spark.createDataFrame([(token_of.astype("<u4").tobytes(),)], "ids binary").write.parquet(
        f"{path}/ranks")
    order = ["doc_id", F.xxhash64("ids")]
    placed = tokens.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = dict(tokens.dtypes)["doc_id"]

    def step(batches):
        shard, before, ids, sizes, ranks, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([ids], pa.list_(arrow_id[0])),
                 pa.array([encode_block(sizes, np.concatenate(ranks))], pa.binary())],
                ["shard", "start", "n_tokens", "doc_ids", "payload"])

        arrow_id = []
        for batch in slices(batches, "ids"):
            arrow_id[:] = [batch.column("doc_id").type]
            for doc_id, one in zip(batch.column("doc_id").to_pylist(), batch.column("ids"),
                                   strict=True):
                found = rank_of[np.frombuffer(one.as_buffer(), kind)]
                ids.append(doc_id)
                sizes.append(len(found))
                ranks.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield out()
                    before, ids, sizes, ranks, held = before + held, [], [], [], 0
        if ids:
            yield out()

    map_arrow(
        placed, step, f"shard int, start long, n_tokens long, doc_ids array<{id_type}>, payload binary"
    ).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    start counts the ids of all documents before: a block knows those of its shard, and the
    driver adds up the shards, one number for each task that wrote.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    token_of = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().ids, "<u4")
    shards = sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    ends = np.cumsum([row.n for row in shards], dtype=np.int64)
    before = {row.shard: int(end) - row.n for row, end in zip(shards, ends, strict=True)}
    id_type = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = (f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
              + ", ids binary" * with_ids)

    def step(batches):
        for batch in slices(batches, "payload"):
            for at in range(batch.num_rows):
                sizes, ranks = decode_block(batch.column("payload")[at].as_py())
                ids = token_of[ranks].astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                start = batch.column("start")[at].as_py() + before[batch.column("shard")[at].as_py()]
                cut = [ids[4 * (end - n):4 * end] for end, n in zip(ends, sizes, strict=True)]
                arrays = [batch.column("doc_ids")[at].values,
                          pa.array(ends - sizes + start),
                          pa.array(sizes), pa.array([zlib.crc32(one) for one in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cut, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(blocks.select("shard", "start", "doc_ids", "payload"), step, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to a new folder and read the documents back."""
    path = new_folder(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
