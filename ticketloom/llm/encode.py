"""Encoding texts with files of the tokenizers library, word by word with a cache.

Byte-pair encoding never looks across the boundaries of its pre-tokens. Where a
file's normalizer and pre-tokenizer guarantee that a blank ends a pre-token, equal
words get equal ids, so a worker encodes each distinct word once and joins cached
ids. Texts or files without that guarantee are encoded as a whole. Either way the
ids equal encode(text, add_special_tokens=False) with encode_special_tokens set:
the spelling of a special token inside a text is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker, about 30 bytes each.
CACHE_WORDS = 600_000
#: Marks at the end of a word that are a pre-token by themselves, after a letter.
MARKS = ".,;:!?%*$#&|)"
CHUNK = 500
DOUBLE = re.compile(r"\s\s")


def irregular(text: str) -> bool:
    """Whether white space stands at an end of the text or next to other white space."""
    return text[:1].isspace() or text[-1:].isspace() or DOUBLE.search(text) is not None


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = made["model"].get("end_of_word_suffix") or ""
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token.removesuffix(suffix) if suffix else token)
        self.size = len(self.bytes_of)
        self.kind = self._kind(made)
        self.words = pa.array([], pa.string())
        self.ids = pa.array([], pa.binary())
        self.marks: dict = {}

    @staticmethod
    def _kind(made: dict) -> str:
        first, cut = made.get("normalizer"), made.get("pre_tokenizer") or {}
        if (first is None and cut.get("type") == "ByteLevel" and cut.get("use_regex")
                and not cut.get("add_prefix_space")):
            return "spaced"
        steps = [step.get("type") for step in (first or {}).get("normalizers", [])]
        parts = cut.get("pretokenizers", [])
        if (steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2
                and parts[0].get("type") == "Split" and parts[0].get("invert")
                and parts[0].get("behavior") == "Removed"
                and parts[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")):
            return "dropped"
        return "whole"

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text."""
        if self.kind == "whole":
            return [self.whole(text.decode()) for text in texts]
        out = [b""] * len(texts)
        if self.kind == "dropped":
            regular, lead = range(len(texts)), 0
            given = pa.array(texts, pa.binary()).cast(pa.string())
            words = pc.ascii_split_whitespace(pc.ascii_lower(given))
        else:
            regular, plain, lead = [], [], 1  # a line feed stands before each text
            for place, text in enumerate(texts):
                one = text.decode()
                if irregular(one):
                    out[place] = self.whole(one)
                elif one:
                    regular.append(place)
                    plain.append("\n" + one)
            given = pa.array(plain, pa.string())
            words = pc.split_pattern(pc.replace_substring(given, "\n", " \n"), " ")
            words = pc.list_slice(words, 1)  # before the line feed there is nothing
        ids, ends = self.ids_of(words.flatten())
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(
            zero_copy_only=False), dtype=np.int64)])].tolist()
        for place, first, last in zip(regular, bounds, bounds[1:], strict=False):
            out[place] = ids[first + lead:last].tobytes()
        return out

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many there are up to each word, from 0.

        Each distinct word is looked up once; the rest is one gathering of ids.
        """
        coded = words.dictionary_encode()
        if not len(coded):
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        column = self.ids_of_distinct(coded.dictionary).take(coded.indices)
        _, offsets, data = column.buffers()
        ids = np.frombuffer(data, "<u4") if data is not None and data.size else np.empty(0, "<u4")
        return ids, np.frombuffer(offsets, np.int32)[:len(column) + 1] // 4

    def ids_of_distinct(self, words: pa.Array) -> pa.Array:
        """The ids of each word: those of a stem that ends in a letter and of its marks, or its own."""
        stems = pc.utf8_rtrim(words, characters=MARKS)
        sizes = sizes_of(words)
        cut = sizes - sizes_of(stems)
        ends = np.flatnonzero(cut)
        last = pc.utf8_slice_codeunits(stems.take(pa.array(ends)), -1).dictionary_encode()
        # a letter that is still one letter in lower case
        letter = np.array([one.isalpha() and len(one.lower()) == 1
                           for one in last.dictionary.to_pylist()], bool)
        cut[ends[~letter[last.indices.to_numpy()]]] = 0
        coded = pc.if_else(pa.array(cut > 0), stems, words).dictionary_encode()
        ids = self.looked_up(coded.dictionary).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(cut)])
        _, offsets, data = words.buffers()
        first = np.frombuffer(offsets, np.int32)[1:len(words) + 1] - cut
        at = np.repeat(first - ends[:-1], cut) + np.arange(ends[-1])
        marks = pa.StringArray.from_buffers(
            len(words), pa.py_buffer(ends.astype(np.int32).tobytes()),
            pa.py_buffer(np.frombuffer(data, np.uint8)[at].tobytes())).dictionary_encode()
        return pc.binary_join_element_wise(ids, pa.array(
            [self.marks_ids(one) for one in marks.dictionary.to_pylist()], pa.binary()).take(
            marks.indices), b"")

    def marks_ids(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > CACHE_WORDS:
                self.marks.clear()
            self.marks[marks] = self.whole(marks) if marks else b""
        return self.marks[marks]

    def looked_up(self, words: pa.Array) -> pa.Array:
        """The ids of each of these distinct words, from the cache or anew.

        The cache is two Arrow columns. When it is full the words asked for now are what is kept.
        """
        places = pc.index_in(words, value_set=self.words)
        if places.null_count:
            new = pc.is_null(places)
            fresh, known = words.filter(new), pc.invert(new)
            if len(self.words) + len(fresh) > CACHE_WORDS:
                held = places.filter(known)
                self.words, self.ids = words.filter(known), self.ids.take(held)
                order = np.zeros(len(words), np.int64)
                order[known.to_numpy(zero_copy_only=False)] = np.arange(len(held))
            else:
                order = places.fill_null(0).to_numpy().astype(np.int64)
            order[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(fresh))
            self.words = pa.concat_arrays([self.words, fresh])
            self.ids = pa.concat_arrays([self.ids, self.made(fresh)])
            places = pa.array(order)
        return self.ids.take(places)

    def made(self, words: pa.Array) -> pa.Array:
        """The ids of new words, many in one call; token lengths tell where each one ends."""
        if self.kind == "dropped":
            texts = words.to_pylist()
            alike = np.array([u.isascii() or (
                unicodedata.is_normalized("NFC", u) and u == u.lower() and len(u.split()) == 1)
                for u in texts], bool)
            if not alike.all():
                ids = [None if same else self.whole(u)
                       for u, same in zip(texts, alike, strict=True)]
                joint = self.made_jointly(words.filter(pa.array(alike)))
                return pc.replace_with_mask(pa.array(ids, pa.binary()), pa.array(alike), joint)
        return self.made_jointly(words)

    def made_jointly(self, words: pa.Array) -> pa.Array:
        if self.kind == "dropped":
            units, sizes = pc.binary_join_element_wise(" ", words, ""), sizes_of(words)
        else:
            units = pc.binary_join_element_wise(
                pc.if_else(pc.starts_with(words, "\n"), "", " "), words, "")
            sizes = sizes_of(units)
        given, ends = encoded_text(units)
        data, lengths = [], []
        for first in range(0, len(words), CHUNK):
            last = min(first + CHUNK, len(words))
            ids = np.array(self.tokenizer.encode_batch_fast(
                [given[ends[first]:ends[last]].decode()], add_special_tokens=False)[0].ids, "<u4")
            reached, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[first:last])
            at = np.searchsorted(reached, wanted)
            if not len(reached) or at[-1] != len(reached) - 1 or not np.array_equal(
                    reached[at], wanted):
                alone = [self.whole(one) for one in (
                    words if self.kind == "dropped" else units)[first:last].to_pylist()]
                data += alone
                lengths.append([len(one) for one in alone])
            else:
                data.append(ids.tobytes())
                lengths.append(np.diff(at, prepend=-1) * 4)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([[], *lengths]))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [
            None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(data))])


def sizes_of(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def encoded_text(units: pa.Array) -> tuple[bytes, np.ndarray]:
    """All units in a row, and where each one starts and the last one ends."""
    _, offsets, data = units.buffers()
    ends = np.frombuffer(offsets, np.int32)[units.offset:units.offset + len(units) + 1]
    return (data.to_pybytes() if data else b""), ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
