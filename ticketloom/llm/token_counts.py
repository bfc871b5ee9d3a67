"""Token counts per field and section, by character offsets.

The fields of a row are joined to one document, which is encoded once. Each token's
character span then meets the sections it overlaps: an interval join by binary search,
as both lists are sorted. Rule for a token that crosses a boundary: it belongs to the
section that holds most of its characters, and to the earlier one of several such. So
the counts of a document's sections add up to the document's tokens.

Edge cases: a null field is empty, and an empty field or line is a section of no
characters that gets no token; the separator after a field belongs to that field;
characters whose bytes are split among tokens are in the span of each of these tokens;
repeated rows and null ids give their own rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import ENCODED_BYTES, encoded, map_batches
from ticketloom.llm.encode import encoder

class SpanEncoder:
    """Token spans in characters; byte-level tokens get theirs from the bytes that they spell."""

    def __init__(self, path: str):
        self.encoder = encoder(path)

    def whole(self, text: str) -> np.ndarray:
        spans = self.encoder.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.array(spans, np.int64).reshape(-1, 2)

    def spans(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text one row (start, end) per token of encode(text, add_special_tokens=False).

        A token that covers a part of a character spans all of it.
        """
        if self.encoder.kind != "spaced":
            return [self.whole(text.decode()) for text in texts]
        out = []
        for text, ids in zip(texts, self.encoder.encode(texts), strict=True):
            sizes = self.encoder.bytes_of[np.frombuffer(ids, "<u4")]
            ends = np.cumsum(sizes)
            spans = np.stack([ends - sizes, ends - 1], axis=1)  # first and last byte
            if not text.isascii():
                begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
                spans = (np.cumsum(begins) - 1)[spans]
            spans[:, 1] += 1
            out.append(spans)
        return out


_ENCODERS: dict[str, SpanEncoder] = {}


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens, crossing tokens) per section; sections are sorted and do not overlap."""
    filled = np.flatnonzero(ends > starts)
    if not len(filled) or not len(spans):
        return np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    begin, end = starts[filled], ends[filled]
    first = np.clip(np.searchsorted(begin, spans[:, 0], "right") - 1, 0, None)
    last = np.clip(np.searchsorted(begin, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1,
                   0, None)
    home = first.copy()
    over = np.flatnonzero(last > first)
    for at in over:
        among = np.arange(first[at], last[at] + 1)
        shared = np.minimum(end[among], spans[at, 1]) - np.maximum(begin[among], spans[at, 0])
        home[at] = among[int(np.argmax(shared))]
    return (np.bincount(filled[home], minlength=len(starts)),
            np.bincount(filled[home[over]], minlength=len(starts)))


def count_tokens(docs: DataFrame, tokenizer: str, fields: Sequence[str],
                 id_col: str = "doc_id", separator: str = " ",
                 lines: bool = True) -> DataFrame:
    """One row per section: doc_id, field, section (from 0 in its field), start and end in
    the joined document (code points, end exclusive), n_tokens, n_crossing.

    With lines, each line of a field is a section, with its line break.
    """
    text = F.concat_ws("", *[F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")),
                                      F.lit(separator if f != fields[-1] else "")) for f in fields])
    sizes = F.array(*[F.coalesce(F.char_length(F.col(f).cast("string")), F.lit(0))
                      for f in fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), sizes.alias("sizes"))
    kind = dict(rows.dtypes)["doc_id"]
    names = pa.array(list(fields))
    gap = len(separator)

    def sections(body: str, sizes: list[int]):
        begin = 0
        for field, size in enumerate(sizes):
            stop = begin + size + (gap if field < len(sizes) - 1 else 0)
            if not lines:
                yield field, 0, begin, stop
            else:
                at = number = 0
                parts = body[begin:stop].split("\n")
                for part in parts:
                    end = at + len(part) + (number < len(parts) - 1)
                    yield field, number, begin + at, begin + end
                    at, number = end, number + 1
            begin = stop

    def step(batch):
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = SpanEncoder(tokenizer)
        coder = _ENCODERS[tokenizer]
        rows, parts, counts, crosses = [], [], [], []
        texts = encoded(batch.column("text"))
        for at, (raw, spans, sizes) in enumerate(zip(
                texts, coder.spans(texts), batch.column("sizes").to_pylist(), strict=True)):
            found = np.array(list(sections(raw.decode(), sizes)), np.int64)
            n, crossing = allocate(spans, found[:, 2], found[:, 3])
            rows.append(np.full(len(found), at))
            parts.append(found)
            counts.append(n)
            crosses.append(crossing)
        found = np.concatenate(parts)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(np.concatenate(rows))),
             names.take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int32)),
             pa.array(found[:, 2]), pa.array(found[:, 3]),
             pa.array(np.concatenate(counts)), pa.array(np.concatenate(crosses))],
            ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"])

    return map_batches(rows, step, (
        f"doc_id {kind}, field string, section int, start long, end long, n_tokens long, "
        "n_crossing long"), max_bytes=ENCODED_BYTES)
