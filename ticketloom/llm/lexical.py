"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents of equal m form a stratum.
Inside a stratum the postings of a term are grouped by tf: the impact of a posting depends on
(m, tf) only and is computed once per such group. A stratum is stored in parts of about
PART_DOCS documents or PART_TERMS terms, one row each, so equal lengths (a third of all rows may be copies) never
meet in one task.

The greatest tf of a term in a stratum bounds what it can add to a score there. A query visits
first the strata of the highest bounds, as many as surely hold top_k matching documents. Their
k-th score is a floor: of the other strata only those whose bound reaches it are visited. The
result equals scoring every document (tested against brute force).

    m = 100 - 75 + (75 * n * N) div L        n terms of the document, N documents with a term,
    w = floor(1000 * ln((2N + 2) / (2df + 1)))                     L terms of all documents
    score = sum over the query's terms, repeats included, of
            w * ((1000000000 * tf) div (1000 * tf + 8 * m))

Edge cases: null and empty texts have no terms, so they are neither found nor counted, and such
queries find nothing; a text of any length is counted whole; documents of one id are ranked as
rows of their own; queries of one id get the rows of each of them; a null document id is ranked
last among equals, a null query id stays null; empty tables give an empty table; the
result has its own columns only.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.llm.common import encoded, map_arrow, map_batches, numbered
from ticketloom.session import materialise, shuffle_partitions

#: ASCII letters and digits, and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Documents, and terms with repeats, of one part of a stratum, about.
PART_DOCS, PART_TERMS = 8192, 2_000_000
#: Term rows of the queries that are searched for in one go, about; they go to all tasks.
BLOCK_TERMS = 400_000
#: Terms that are sent to the tasks as a set, at most.
MAX_WANTED = 200_000


@dataclass
class LexicalIndex:
    """Tables of an index; `parts` holds the postings, one row per part of a stratum."""

    parts: DataFrame    # m, part, rows, terms, term_ends, tfs, run_ends, places
    bounds: DataFrame   # m, term, max_tf, n_docs
    weights: DataFrame  # term, w
    ids: DataFrame      # row, id

    def save(self, path: str) -> None:
        for name, df in vars(self).items():
            df.write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.__annotations__))


def impact(tf: Column, m: Column) -> Column:
    return F.call_function("div", F.lit(1_000_000_000).cast("bigint") * tf,
                           F.lit(1000).cast("bigint") * tf + F.lit(8).cast("bigint") * m)


def count_terms(wanted: frozenset | None):
    """A step from texts to (row, n, terms, tfs): all counted in n, the wanted ones listed."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, sizes, terms, tfs = [], [], [], []
        for row, text in zip(batch.column("row").to_pylist(), encoded(batch.column("text")),
                             strict=True):
            counts = Counter(TERM_BYTES.findall(text.translate(LOWERED)))
            if counts:
                rows.append(row)
                sizes.append(counts.total())
                if wanted is not None:
                    counts = {term: counts[term] for term in wanted.intersection(counts)}
                terms.append(b" ".join(counts))
                tfs.append(np.fromiter(counts.values(), "<i8", len(counts)).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()),
             pa.array(tfs, pa.binary())], ["row", "n", "terms", "tfs"])
    return step


def pack_part(held: list[pa.RecordBatch]) -> list:
    """One row of `parts` from the documents of a part of a stratum, which ascend by row."""
    table = pa.Table.from_batches(held)
    words = [terms.split() for terms in table.column("terms").to_pylist()]
    sizes = [len(one) for one in words]
    coded = pa.array([term for one in words for term in one], pa.binary()).dictionary_encode()
    tfs = np.frombuffer(b"".join(table.column("tfs").to_pylist()), "<i8")
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    numbers, places = number[coded.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    by_term = np.lexsort((places, tfs, numbers))
    numbers, tfs, places = numbers[by_term], tfs[by_term], places[by_term]
    last = np.append((numbers[1:] != numbers[:-1]) | (tfs[1:] != tfs[:-1]), True)[:len(tfs)]
    run_ends = np.flatnonzero(last) + 1
    term_ends = np.searchsorted(numbers[run_ends - 1], np.arange(len(names)), "right")
    return [table.column("m")[0].as_py(), table.column("part")[0].as_py(),
            table.column("row").to_numpy().astype("<i8").tobytes(),
            [names[i].decode() for i in order],
            term_ends.astype("<i4").tobytes(), tfs[run_ends - 1].astype("<i8").tobytes(),
            run_ends.astype("<i4").tobytes(), places.astype("<i4").tobytes()]


PARTS = ("m long, part long, rows binary, terms array<string>, term_ends binary, tfs binary, "
         "run_ends binary, places binary")
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]


def pack_parts(batches):
    """Documents sorted by (m, part, row) to rows of `parts`, one in memory at a time."""
    def out(held):
        return pa.RecordBatch.from_arrays(
            [pa.array([value], kind) for value, kind in zip(pack_part(held), KINDS, strict=True)],
            [field.split()[0] for field in PARTS.split(", ")])

    held, current = [], None
    for batch in batches:
        keys = np.stack([batch.column("m").to_numpy(), batch.column("part").to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for first, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if first == end:
                continue
            key = (int(keys[0, first]), int(keys[1, first]))
            if held and key != current:
                yield out(held)
                held = []
            current = key
            held.append(batch.slice(first, end - first))
    if held:
        yield out(held)


def postings_of(part: dict) -> tuple:
    """(run ends, tfs of runs, run ends of terms) of a row of `parts`."""
    return (np.frombuffer(part["run_ends"], "<i4"), np.frombuffer(part["tfs"], "<i8"),
            np.frombuffer(part["term_ends"], "<i4"))


def part_bounds(batches):
    """(m, term, max_tf, n_docs) of each part: a term's last run has its greatest tf."""
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1).to_pylist()[0]
            run_ends, tfs, term_ends = postings_of(part)
            last = term_ends - 1
            n_docs = np.diff(run_ends[last], prepend=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(last), part["m"])), pa.array(part["terms"], pa.string()),
                 pa.array(tfs[last]), pa.array(n_docs.astype(np.int64))],
                ["m", "term", "max_tf", "n_docs"])


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> LexicalIndex:
    """Index all documents; with `terms` (term) only postings of these are kept.

    Lengths, document counts and normalisers always come from all terms of all documents. More
    than MAX_WANTED terms are not sent to the tasks: the index then holds all terms.
    """
    spark = docs.sparkSession
    rows = numbered(docs, id_col, text_col)
    wanted = None
    if terms is not None:
        asked = terms.select("term").distinct().limit(MAX_WANTED + 1).collect()
        if len(asked) <= MAX_WANTED:
            wanted = frozenset(row.term.encode() for row in asked)
    counted = materialise(map_batches(rows.select("row", "text"), count_terms(wanted),
                                      "row long, n long, terms binary, tfs binary"), "term-counts")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = F.lit(total.docs).cast("bigint"), F.lit(total.terms or 1).cast("bigint")
    m = F.lit(25).cast("bigint") + F.call_function(
        "div", F.lit(75).cast("bigint") * F.col("n") * n_docs, n_terms)
    sizes = counted.groupBy(m.alias("m")).agg(F.ceil(F.greatest(
        F.count("*") / PART_DOCS, F.sum("n") / PART_TERMS)).alias("n_parts"))
    order = ["m", "part", "row"]
    placed = counted.withColumn("m", m).join(materialise(sizes, "strata-sizes"), "m").withColumn(
        "part", F.pmod(F.xxhash64("row"), F.col("n_parts"))).select(*order, "terms", "tfs")
    parts = materialise(map_arrow(
        placed.repartition(shuffle_partitions(spark), "m", "part").sortWithinPartitions(*order),
        pack_parts, PARTS), "strata")
    bounds = materialise(map_arrow(
        parts.select("m", "terms", "term_ends", "tfs", "run_ends"), part_bounds,
        "m long, term string, max_tf long, n_docs long").groupBy("m", "term").agg(
        F.max("max_tf").alias("max_tf"), F.sum("n_docs").alias("n_docs")), "strata-bounds")
    weights = bounds.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", F.floor(
        F.lit(1000) * F.log((2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1))).alias("w"))
    return LexicalIndex(parts, bounds, materialise(weights, "term-weights"),
                        rows.select("row", "id"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Numbered queries (q, id), and (q, term, qtf) of each."""
    rows = numbered(queries, id_col, text_col).select(F.col("row").alias("q"), "id", "text")
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER),
                                 F.lit(TERM), 0)
    terms = rows.select("q", F.explode_outer(words).alias("term")).where("term is not null")
    return rows.select("q", "id"), materialise(
        terms.groupBy("q", "term").agg(F.count("*").alias("qtf")), "query-terms")


def best_rows(df: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def score_parts(parts: DataFrame, visits: DataFrame, wanted: dict, top_k: int) -> DataFrame:
    """(q, row, score): the best rows of each visited part, for each query that visits it.

    wanted: {q: [(term, weight times its count in the query)]}; visits: (m, q, floor).
    """
    asked = visits.groupBy("m").agg(F.collect_list(F.struct("q", "floor")).alias("asked"))

    def step(batches):
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                part = batch.slice(at, 1).to_pylist()[0]
                run_ends, tfs, term_ends = postings_of(part)
                rows = np.frombuffer(part["rows"], "<i8")
                places = np.frombuffer(part["places"], "<i4")
                # one impact per (term, tf), handed to its postings
                impacts = np.repeat((1_000_000_000 * tfs) // (1000 * tfs + 8 * part["m"]),
                                    np.diff(run_ends, prepend=0))
                ends = run_ends[term_ends - 1].tolist()
                spans = dict(zip(part["terms"], zip([0, *ends[:-1]], ends, strict=True),
                                 strict=True))
                for ask in part["asked"]:
                    scores = np.zeros(len(rows), np.int64)
                    for term, weight in wanted[ask["q"]]:
                        if term in spans:
                            first, end = spans[term]
                            scores[places[first:end]] += weight * impacts[first:end]
                    found = np.flatnonzero(scores >= max(ask["floor"], 1))
                    if len(found) > top_k:  # rows ascend, so the stable order breaks ties
                        found = found[np.argsort(-scores[found], kind="stable")[:top_k]]
                    out += [(ask["q"], row, score) for row, score in zip(
                        rows[found].tolist(), scores[found].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(values), pa.int64()) for values in (zip(*out) if out else [()] * 3)],
                ["q", "row", "score"])

    return map_arrow(parts.join(asked, "m"), step, "q long, row long, score long")


def search_block(index: LexicalIndex, terms: DataFrame, top_k: int) -> DataFrame:
    """(q, row, score, rank) of one block of queries; terms: (q, term, weight)."""
    wanted: dict[int, list] = {}
    for row in terms.collect():
        wanted.setdefault(row.q, []).append((row.term, row.weight))
    most = impact(F.col("max_tf"), F.col("m")) * F.col("weight")
    bounds = materialise(terms.where("weight > 0").join(index.bounds, "term").groupBy("q", "m").agg(
        F.sum(most).alias("bound"), F.max("n_docs").alias("n_docs")), "visits")
    before = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = bounds.withColumn("first", F.coalesce(F.sum("n_docs").over(before), F.lit(0)) < top_k)
    first = ranked.where("first").select("m", "q", F.lit(0).cast("bigint").alias("floor"))
    done = materialise(best_rows(score_parts(index.parts, first, wanted, top_k), top_k), "found")
    floors = done.where(F.col("rank") == top_k).select("q", F.col("score").alias("floor"))
    others = ranked.where("not first").join(floors, "q", "left").select(
        "m", "q", "bound", F.coalesce("floor", F.lit(0)).alias("floor")).where("bound >= floor")
    rest = score_parts(index.parts, others.select("m", "q", "floor"), wanted, top_k)
    return best_rows(done.select("q", "row", "score").unionByName(rest), top_k)


def search(queries: DataFrame, index: LexicalIndex, top_k: int = 10, id_col: str = "item_id",
           text_col: str = "text", counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The query's id, rank, doc_id and score of the top_k best documents of each query.

    Queries are taken in blocks of about BLOCK_TERMS term rows; only a block at a time is
    held on the driver and sent to the tasks.
    """
    numbers, terms = counted or query_terms(queries, id_col, text_col)
    blocks = -(-terms.count() // BLOCK_TERMS)
    weighted = materialise(terms.join(index.weights, "term").select(
        "q", "term", (F.col("qtf") * F.col("w")).alias("weight"),
        F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1))).alias("block")), "query-weights")
    hits = None
    for block in range(max(blocks, 1)):
        found = search_block(index, weighted.where(F.col("block") == block), top_k)
        hits = found if hits is None else hits.unionByName(found)
    return materialise(hits, "hits").join(numbers.withColumnRenamed("id", id_col), "q").join(
        index.ids, "row").select(id_col, F.col("rank").cast("int").alias("rank"),
                                 F.col("id").alias("doc_id"), "score")


def rank_documents(docs: DataFrame, queries: DataFrame, top_k: int = 10, doc_id: str = "doc_id",
                   query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Index all documents for the terms of the queries, then search."""
    counted = query_terms(queries, query_id, text_col)
    index = build_index(docs, counted[1].select("term").distinct(), doc_id, text_col)
    return search(queries, index, top_k, query_id, text_col, counted)
