"""Cross-tokenizer alignment: tokens of two tokenizers linked through the bytes they cover.

A document is encoded by a byte-level BPE (A) and by a piece model (B) over the same bytes, a
space and the text. Each tokenizing is a sparse token-by-byte incidence matrix in compressed
rows (CSR, three numpy arrays). Gustavson's row product A.B^T, which gathers for each entry
of a row of A the matching row of B^T, yields the overlap links. Where both tokens change from
one overlap link to the next, both tokenizings end, and a group of tokens is closed. The
incidence of groups and token ids, again in CSR, gives by the product of its rows the
shared-group links: all A-B pairs of a group, counted by id pair. Equal tokens of a group are
one entry with a value, so a long group is never written out pair by pair.

An id pair's count is the number of documents that hold it linked. Documents are taken in slices.
A slice counts its documents by pair before the shuffle, so no pair has more rows than
there are slices, however many documents hold it; the counts come back to the slices, where
the documents' pairs wait as numbers into the slice's list of pairs.

Edge cases: null and empty texts, and texts whose pieces do not spell the space and the text, have no
tokens: zeros, and an empty groups_sha256; spellings of special tokens are plain text; a text of any
length is encoded whole; documents of one id, and repeated rows, keep their rows and count each;
an empty table gives an empty table; the result has its own columns only.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import map_arrow, slices
from ticketloom.llm.token_files import decode_ranks, encode_ranks
from ticketloom.session import materialise, shuffle_partitions

#: Text bytes encoded at once, and of a slice; a longer text is a slice by itself.
STEP_BYTES, PART_BYTES = 1 << 20, 6 << 20
#: Entries that a row product expands at once.
EXPANDED = 1 << 21
#: Bits of an id pair that hold B's id.
LOW = 16
#: How the byte-level file cuts texts into words, as its tokenizer does without a given pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- tokenizers --------------------------------------------------------------------

def byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level files spell bytes: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteTokenizer:
    """Ids and token bytes by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        cut = made.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            raise ValueError(f"{path} is not a plain byte-level file")
        special = {one["content"] for one in made["added_tokens"] if one["special"]}
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): number
                 for token, number in made["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks,
                                       special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            self.bytes_of[number] = token

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(" " + text)


class PieceTokenizer:
    """Ids and piece bytes by a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [
            bytes([int(piece[1:-1], 16)]) if self.coder.is_byte(number)
            else piece.replace("▁", " ").encode()
            for number, piece in enumerate(map(self.coder.id_to_piece, range(self.coder.vocab_size())))]

    def encode(self, text: str) -> list[int]:
        return self.coder.encode(text)


_TOKENIZERS: dict = {}


def tokenizer(kind: type, path: str):
    """One per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = kind(path)
    return _TOKENIZERS[path]


# --- sparse matrices -----------------------------------------------------------------

@dataclass
class Csr:
    """Compressed rows: row i has columns[ends[i-1]:ends[i]] with these values."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def row_products(a: Csr, b: Csr):
    """Gustavson's A.B in pieces of about EXPANDED terms: (row of A, column of B, product) each.

    Every entry (i, k) of A contributes row k of B times its value. Terms of one row and column
    are not added up yet; they ascend by row of A, then by k.
    """
    sizes = (b.ends - b.starts)[a.columns]
    done = np.cumsum(sizes)
    rows = np.repeat(np.arange(len(a.ends)), a.ends - a.starts)
    first = 0
    while first < len(sizes):
        before = int(done[first - 1]) if first else 0
        last = max(int(np.searchsorted(done, before + EXPANDED, "right")), first + 1)
        size = sizes[first:last]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(b.starts[a.columns[first:last]], size) + inside
        yield (np.repeat(rows[first:last], size), b.columns[at],
               np.repeat(a.values[first:last], size) * b.values[at])
        first = last


def incidence(lengths: np.ndarray) -> Csr:
    """Token by byte: a token's row holds the bytes that it covers."""
    ends = np.cumsum(lengths, dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    return Csr(ends, np.arange(n), np.ones(n, np.int64))


def transposed(lengths: np.ndarray) -> Csr:
    """Byte by token: each byte's row holds the one token that covers it."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return Csr(np.arange(1, len(owner) + 1), owner, np.ones(len(owner), np.int64))


def overlap_links(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple:
    """(A tokens, B tokens, common bytes) of A.B^T, ascending; equal terms are neighbours."""
    parts: list[tuple] = []
    for rows, columns, values in row_products(incidence(lengths_a), transposed(lengths_b)):
        new = np.append(True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1]))
        first = np.flatnonzero(new)
        part = [rows[first], columns[first], np.add.reduceat(values, first)]
        if parts and parts[-1][0][-1] == part[0][0] and parts[-1][1][-1] == part[1][0]:
            part[2][0] += parts[-1][2][-1]  # the cut went through a pair
            parts[-1] = tuple(column[:-1] for column in parts[-1])
            if not len(parts[-1][0]):
                parts.pop()
        parts.append(tuple(part))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def group_incidence(groups: np.ndarray, ids: np.ndarray, n_groups: int) -> Csr:
    """Group by id: how often each id stands in each group."""
    keys, counts = np.unique(groups.astype(np.int64) << 32 | ids, return_counts=True)
    return Csr(np.searchsorted(keys, np.arange(1, n_groups + 1) << 32), keys & 0xFFFFFFFF, counts)


def group_links(a: Csr, b: Csr, document: np.ndarray) -> tuple:
    """(document, id pair, links) summed over the groups of a document; pairs ascend in it.

    For each entry (group, id) of A the product gathers the group's row of B.
    """
    groups = np.repeat(np.arange(len(a.ends)), a.ends - a.starts)
    selected = Csr(np.arange(1, len(groups) + 1), groups, a.values)
    keys, links = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for entries, others, products in row_products(selected, b):
        pair = document[groups[entries]] << 32 | a.columns[entries] << LOW | others
        keys, place = np.unique(np.concatenate([keys, pair]), return_inverse=True)
        links = np.bincount(place, np.concatenate([links, products]), len(keys)).astype(np.int64)
    return keys >> 32, keys & 0xFFFFFFFF, links


# --- documents -----------------------------------------------------------------------

#: Decimal ids, each followed by a comma, a bar or a semicolon.
_WRITTEN: list[bytes] = []


def written(size: int) -> list[bytes]:
    while len(_WRITTEN) < 3 * size:
        number = len(_WRITTEN) // 3
        _WRITTEN.extend(b"%d%c" % (number, mark) for mark in b",|;")
    return _WRITTEN


def digests(ids_a, ids_b, groups_a, groups_b, n_groups, group_ends, size) -> list[str]:
    """The digest of each document's groups; group_ends counts the groups up to each document."""
    n_a, n_b = np.bincount(groups_a, minlength=n_groups), np.bincount(groups_b, minlength=n_groups)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    codes = np.zeros(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + (ends_b - n_b)[groups_a]] = 3 * ids_a
    codes[np.arange(len(ids_b)) + ends_a[groups_b]] = 3 * ids_b
    codes[ends_a + ends_b - n_b - 1] += 1  # a bar after the last A token of a group
    codes[ends_a + ends_b - 1] += 2        # a semicolon after the last B token
    names, out, first = written(size), [], 0
    token_ends = np.concatenate([[0], ends_a + ends_b])[group_ends]
    codes = codes.tolist()
    for end in token_ends.tolist():
        text = b"".join([names[code] for code in codes[first:end]])
        out.append(hashlib.sha256(text[:-1]).hexdigest() if end > first else "")
        first = end
    return out


def align(texts: list, coder_a, coder_b) -> tuple[dict, tuple]:
    """Columns of each text (n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256), and
    (document, id pair, links) of all."""
    ids_a, ids_b, n_a, n_b = [], [], [], []
    bytes_a, bytes_b = coder_a.bytes_of, coder_b.bytes_of
    for text in texts:
        one_a = one_b = []
        if text:
            whole = (" " + text).encode()
            one_a, one_b = coder_a.encode(text), coder_b.encode(text)
            if (b"".join([bytes_a[i] for i in one_a]) != whole
                    or b"".join([bytes_b[i] for i in one_b]) != whole):
                one_a = one_b = []
        ids_a += one_a
        ids_b += one_b
        n_a.append(len(one_a))
        n_b.append(len(one_b))
    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    n_a, n_b = np.array(n_a, np.int64), np.array(n_b, np.int64)
    size_a = np.array([len(token) for token in bytes_a])[ids_a]
    size_b = np.array([len(token) for token in bytes_b])[ids_b]
    of_a, of_b, _ = overlap_links(size_a, size_b)
    new = np.append(True, (of_a[1:] != of_a[:-1]) & (of_b[1:] != of_b[:-1]))[:len(of_a)]
    groups = np.cumsum(new) - 1
    n_groups = int(groups[-1]) + 1 if len(groups) else 0
    groups_a, groups_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    groups_a[of_a], groups_b[of_b] = groups, groups
    document = np.repeat(np.arange(len(texts)), n_a)[np.searchsorted(groups_a, np.arange(n_groups))]
    in_document = np.bincount(document, minlength=len(texts))
    found = group_links(group_incidence(groups_a, ids_a, n_groups),
                        group_incidence(groups_b, ids_b, n_groups), document)
    columns = {
        "n_a": n_a, "n_b": n_b, "n_groups": in_document,
        "n_links": np.bincount(found[0], found[2], len(texts)).astype(np.int64),
        "n_overlaps": np.bincount(document[groups], minlength=len(texts)),
        "groups_sha256": digests(ids_a, ids_b, groups_a, groups_b, n_groups,
                                 np.cumsum(in_document), max(len(bytes_a), len(bytes_b)))}
    return columns, found


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


def slice_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per slice: its documents' columns, its distinct pairs and how many documents have each.

    Of each document: the number of its pairs, and these as gaps between their places in the
    slice's list, with their links, in byte-aligned coding.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    fields = ["slice long", f"doc_ids array<{id_type}>", *(f"{name} array<long>" for name in COUNTS),
              "groups_sha256 array<string>", "n_pairs array<long>", "gaps binary", "links binary",
              "pairs binary", "n_docs binary"]

    def out(number, held):
        columns = [column for column, _, _ in held]
        ids = pa.concat_arrays([one for _, _, one in held])
        sizes = np.cumsum([0] + [len(one) for _, _, one in held])
        document = np.concatenate([found[0] + base for (_, found, _), base in zip(
            held, sizes, strict=False)])
        pairs, place, n_docs = np.unique(np.concatenate([found[1] for _, found, _ in held]),
                                         return_inverse=True, return_counts=True)
        links = np.concatenate([found[2] for _, found, _ in held])
        n_pairs = np.bincount(document, minlength=len(ids))
        gaps = np.diff(place, prepend=0)
        first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
        gaps[first] = place[first]
        values = [number, ids, *(np.concatenate([c[name] for c in columns]) for name in COUNTS),
                  [digest for c in columns for digest in c["groups_sha256"]], n_pairs,
                  encode_ranks(gaps.astype(np.uint32)), encode_ranks(links.astype(np.uint32)),
                  pairs.astype("<u4").tobytes(), n_docs.astype("<u4").tobytes()]
        kinds = [pa.int64(), pa.list_(ids.type), *[pa.list_(pa.int64())] * 5,
                 pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array([value], kind) for value, kind in zip(values, kinds, strict=True)],
            [field.split()[0] for field in fields])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder_a, coder_b = tokenizer(ByteTokenizer, path_a), tokenizer(PieceTokenizer, path_b)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, "text", STEP_BYTES):
            texts = batch.column("text").to_pylist()
            columns, found = align(texts, coder_a, coder_b)
            held.append((columns, found, batch.column("doc_id")))
            size += sum(map(len, filter(None, texts)))
            if size >= PART_BYTES:
                yield out(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield out(number, held)

    return materialise(map_arrow(docs, run, ", ".join(fields)), "aligned-slices")


def pair_counts(parts: DataFrame) -> DataFrame:
    """(slice, pair, count, best): the corpus-wide count of each pair of each slice."""
    def step(batches):
        for batch in batches:
            for number, pairs, n_docs in zip(*(batch.column(i).to_pylist() for i in range(3)),
                                             strict=True):
                pairs = np.frombuffer(pairs, "<u4").astype(np.int64)
                n_docs = np.frombuffer(n_docs, "<u4").astype(np.int64)
                for at in range(0, len(pairs), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs[part]), number)), pa.array(pairs[part]),
                         pa.array(n_docs[part])], ["slice", "pair", "n_docs"])

    rows = map_arrow(parts.select("slice", "pairs", "n_docs"), step,
                     "slice long, pair long, n_docs long")
    totals = materialise(rows.groupBy("pair").agg(F.sum("n_docs").alias("count")), "pair-counts")
    id_a = F.shiftright("pair", LOW)
    most = totals.groupBy(id_a.alias("a")).agg(F.max("count").alias("most"))
    judged = totals.withColumn("a", id_a).join(most, "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return rows.select("slice", "pair").join(materialise(judged, "pairs-judged"), "pair")


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = slice_rows(pair, path_a, path_b)
    tasks = shuffle_partitions(docs.sparkSession)
    looked = pair_counts(parts).repartition(tasks, "slice").groupBy("slice").agg(
        F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    joined = parts.drop("n_docs", "pairs").join(looked, "slice", "left")
    out_names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                 "groups_sha256", "n_overlaps"]
    id_type = dict(pair.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, " + ", ".join(
        f"{name} {'string' if name == 'groups_sha256' else 'long'}" for name in out_names[1:])

    def step(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                def values(name, at=at, batch=batch):
                    return batch.column(name)[at].values
                n_pairs = values("n_pairs").to_numpy()
                total = int(n_pairs.sum())
                found = values("found")
                best = count = np.zeros(0, np.int64)
                if found is not None:
                    pairs, count, best = (found.field(i).to_numpy(zero_copy_only=False)
                                          for i in range(3))
                    order = np.argsort(pairs)
                    count, best = count[order], best[order].astype(np.int64)
                gaps, links = (decode_ranks(np.frombuffer(batch.column(name)[at].as_py(), np.uint8),
                                            total).astype(np.int64) for name in ("gaps", "links"))
                ends = np.cumsum(n_pairs)
                first = (ends - n_pairs)[n_pairs > 0]
                place = np.cumsum(gaps)
                before = np.zeros(total, np.int64)
                before[first] = np.diff(np.concatenate([[0], place[first] - gaps[first]]))
                place -= np.cumsum(before)
                sums = []
                for value in (best, count):
                    running = np.concatenate([[0], np.cumsum(value[place] * links)])
                    sums.append(pa.array(running[ends] - running[ends - n_pairs]))
                columns = {name: values(name) for name in [*COUNTS, "groups_sha256"]}
                columns |= {"doc_id": values("doc_ids"), "n_best": sums[0], "count_sum": sums[1]}
                yield pa.RecordBatch.from_arrays([columns[name] for name in out_names], out_names)

    return map_arrow(joined, step, schema)
