"""Quality rules: a linear-chain CRF labels lines, and the share of content decides.

Each line of a text is content or boilerplate. The labels of a document's lines are the
best path (Viterbi) of a linear-chain conditional random field over features of the line.
A document is kept if it passes the base rules and if at least `min_share` of its words
stand in content lines.

The field is trained here. A bounded sample of the documents in `labels`, MAX_DOCS of
each quality, of at most MAX_LINES lines each, gives weak labels: lines of good documents are
content, lines of bad ones boilerplate. In a second round, lines of bad documents that
the first model finds to be content by themselves are relabelled, so that the transitions see
documents of both kinds of lines. Without labels of both qualities every line is content.

Edge cases: a null or empty text has no words and fails the base rules; words are runs of other
characters than ASCII white space; lines without a word are skipped; repeated rows are
judged alike; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.common import encoded, map_batches

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
ASCII_SPACE = b" \t\n\r\x0b\x0c"
#: Bounds of the training sample.
MAX_DOCS, MAX_LINES = 400, 64
MIN_SHARE = 0.5
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30
N_FEATURES = 12
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
NOT_UPPER = bytes(set(range(256)) - set(UPPER))
NOT_LOWER = bytes(set(range(256)) - set(LOWER))
NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))


def line_features(words: list[bytes], line: bytes, seen: bool) -> tuple[float, ...]:
    """Features of one line with at least one word, each between 0 and about 1."""
    n = len(words)
    size = len(line)
    counts = Counter(words)
    upper, lower = (len(line.translate(None, x)) for x in (NOT_UPPER, NOT_LOWER))
    symbols = len(line.translate(None, NOT_SYMBOLS))
    return (1.0, min(1.0, symbols / n), upper / (upper + lower + 1),
            min(1.0, line.count(b"!") / n), min(1.0, 4 * len(line.translate(None, NOT_DIGITS)) / size),
            1.0 if size > 13 * n else 0.0, 1.0 - len(counts) / n,
            max(counts.values()) / n if n > 3 else 0.0, 1.0 if n < 4 else 0.0,
            1.0 if seen else 0.0, 1.0 if line.rstrip(ASCII_SPACE)[-1:] in (b".", b"?", b"!") else 0.0,
            min(1.0, math.log1p(n) / 6))


def document_lines(text: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """(features, words) per line with a word, and how many equal an earlier one."""
    features, sizes, seen, repeated = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            seen.add(line)
            repeated += again
            features.append(line_features(words, line, again))
            sizes.append(len(words))
    return features, sizes, repeated


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first included."""
    if len(words) <= window:
        return 0
    values = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed, size = values, 1
    while size < window:  # hashes of 2, 4 and 8 words
        mixed = (mixed[:-size] * np.uint64(0x9E3779B97F4A7C15)) ^ (
            mixed[size:] + np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = mixed ^ (mixed >> np.uint64(29))
        size *= 2
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    if not equal.any():
        return 0
    often = np.zeros(len(mixed), bool)
    often[order[1:][equal]] = True
    often[order[:-1][equal]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


@dataclass
class LineModel:
    """Weights of the field: state 0 is content, state 1 boilerplate."""

    weights: np.ndarray  # features x 2
    moves: np.ndarray    # from x to

    def viterbi(self, features: list[tuple[float, ...]]) -> list[int]:
        """The best labels of a sequence of lines; content wins ties."""
        scores = (np.array(features) @ self.weights).tolist()
        (a, b), (c, d) = self.moves.tolist()
        good, bad = scores[0]
        back = []
        for x, y in scores[1:]:
            to_good, to_bad = bad + c > good + a, bad + d > good + b
            back.append((to_good, to_bad))
            good, bad = (x + (bad + c if to_good else good + a),
                         y + (bad + d if to_bad else good + b))
        state = int(bad > good)
        path = [state]
        for step in reversed(back):
            state = int(step[state])
            path.append(state)
        return path[::-1]


def train(lines: list[np.ndarray], labels: list[np.ndarray], steps: int = 100) -> LineModel:
    """Maximise the conditional likelihood with a small penalty, by Adam on all sequences."""
    n, longest = len(lines), max(len(x) for x in lines)
    x = np.zeros((n, longest, N_FEATURES))
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for at, (own, label) in enumerate(zip(lines, labels, strict=True)):
        x[at, :len(own)], y[at, :len(own)], mask[at, :len(own)] = own, label, True
    gold = np.eye(2)[y] * mask[..., None]
    pairs = mask[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
    seen, seen_moves = np.einsum("ntf,nts->fs", x, gold), pairs.sum((0, 1))
    w, moves, total = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), mask.sum()
    state = [np.zeros_like(v) for v in (w, w, moves, moves)]

    def log_add(v, axis):
        top = v.max(axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        emit = x @ w
        ahead = np.zeros((n, longest, 2))
        behind = np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = emit[:, t] + log_add(ahead[:, t - 1, :, None] + moves, 1)
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = log_add(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], new, 0)
        norm = log_add(ahead[:, -1], 1)
        p = np.exp(ahead + behind - norm[:, None, None]) * mask[..., None]
        q = np.exp(ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :]
                   - norm[:, None, None, None]) * mask[:, 1:, None, None]
        for at, (value, slope) in enumerate((
                (w, (np.einsum("ntf,nts->fs", x, p) - seen) / total + 1e-4 * w),
                (moves, (q.sum((0, 1)) - seen_moves) / total + 1e-4 * moves))):
            m, v = state[2 * at], state[2 * at + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope ** 2 - v)
            value -= 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return LineModel(w, moves)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS,
        id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """The model from the sample described in the module; rows go by the hash of their id."""
    usable = labels.where(F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("quality"))
    sample = None
    for quality in (0, 1):
        some = usable.where(F.col("quality") == quality).orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        sample = some if sample is None else sample.union(some)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # One row of each id, that of the least hash: a repeated id neither outweighs others nor
    # reaches the driver more than once.
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by(
        "text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("quality", "text")

    def step(batch):
        found = [document_lines(text)[0] for text in encoded(batch.column("text"))]
        use = [at for at, one in enumerate(found) if 0 < len(one) <= MAX_LINES]
        return pa.RecordBatch.from_arrays(
            [batch.column("quality").cast(pa.int32()).take(pa.array(use, pa.int64())),
             pa.array([np.array(found[at], "<f4").tobytes() for at in use], pa.binary())],
            ["quality", "features"])

    rows = sorted(map_batches(chosen, step, "quality int, features binary").collect())
    lines = [np.frombuffer(row.features, "<f4").reshape(-1, N_FEATURES) for row in rows]
    bad = [row.quality == 0 for row in rows]
    if not any(bad) or all(bad):
        return LineModel(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    first = train(lines, [np.full(len(x), int(b)) for x, b in zip(lines, bad, strict=True)])
    alone = first.weights[:, 1] - first.weights[:, 0]
    again = [(x @ alone > 0).astype(int) if b else np.zeros(len(x), int)
             for x, b in zip(lines, bad, strict=True)]
    return train(lines, again)


def judge(text: bytes, model: LineModel, min_share: float = MIN_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_words) of one text."""
    words = text.split()
    n = len(words)
    features, sizes, repeated = document_lines(text)
    again = repeated_words(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
    content = sum(size for size, label in zip(sizes, model.viterbi(features), strict=True)
                  if not label) if features else 0
    chars = len(b"".join(words).decode())
    symbols = len(text.translate(None, NOT_SYMBOLS))
    return (n, chars, symbols, repeated, again, failed,
            not failed and content >= min_share * n, content)


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, content_words long")


def judged(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text",
           min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id and the fields of `judge` for every row."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [field.split()[0] for field in FIELDS.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]

    def step(batch):
        found = [judge(text, model, min_share) for text in encoded(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(values, kind) for values, kind in zip(
                zip(*found, strict=True), types, strict=True)]], ["doc_id", *names])

    return map_batches(pair, step, f"doc_id {dict(pair.dtypes)['doc_id']}, {FIELDS}")


def kept_rows(docs: DataFrame, model: LineModel, text_col: str = "text",
              min_share: float = MIN_SHARE) -> DataFrame:
    """The rows that are kept, with all their columns."""
    def step(batch):
        keep = [judge(text, model, min_share)[6] for text in encoded(batch.column(text_col))]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, step, docs.schema, text_col)
