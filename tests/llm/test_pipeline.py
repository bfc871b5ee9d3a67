"""The registered text queries against SQL or plain versions, and the whole pipeline."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import BYTE, WORD, crc, plain_ids
from tests.test_oracles import ordered
from ticketloom.llm import quality
from ticketloom.llm.common import table
from ticketloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for one in ("documents", "benchmark", "pages"):
        path = os.path.join(sf_dir, f"{one}.parquet")
        duck.execute(f"CREATE VIEW {one} AS SELECT * FROM read_parquet('{path}')")
    got = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [part[0] for part in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, cursor.fetchall())


def test_all_queries_are_registered():
    names = entry_point.queries()
    assert "pipeline" in names
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11))


def test_quality_query(spark, sf_dir, docs):
    rows = QUERIES["op2_quality_rules"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[1:7]) for r in rows} == {
        i: brute.base_rules(t) for i, t in docs.items()}


def test_near_dedup_query(spark, sf_dir, docs):
    rows = QUERIES["op3_simhash_near_dedup"](spark, sf_dir).collect()
    ids = sorted(docs)
    prints = [brute.fingerprint(docs[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(
        ids, prints, brute.linked_groups(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_token_queries(spark, sf_dir, docs):
    rows = QUERIES["op5_token_files"](spark, sf_dir).collect()
    start, want = 0, []
    for i in sorted(docs):
        ids = plain_ids(BYTE, docs[i], 2)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows)) == want
    counts = QUERIES["op1_token_counts"](spark, sf_dir).where("field = 'text'").groupBy(
        "doc_id").sum("n_tokens").collect()
    assert sum(r[1] for r in counts) > 0.9 * (start - 2 * len(docs))


def test_pipeline_equals_plain_stages(spark, sf_dir, docs):
    source = table(spark, sf_dir, "documents")
    model = quality.fit(source, table(spark, sf_dir, "labels"))
    kept = {i: t for i, t in docs.items() if quality.judge((t or "").encode(), model)[6]}
    ids = sorted(kept)
    groups = brute.linked_groups([brute.fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for at, i in enumerate(ids) if groups[at] == at}
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not brute.benchmark_hits(t, items)[1]}
    want = Counter()
    for i, text in kept.items():
        tokens = plain_ids(WORD, brute.masked(text, brute.personal(text)), 1)
        for piece, start in enumerate(range(0, len(tokens), 4096)):
            part = tokens[start:start + 4096]
            want[i, piece, start, len(part), crc(part)] += 1
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = Counter()
    for row in rows:
        filled[row.sequence_id] += row.length
    assert max(filled.values()) <= 4096 and len(filled) <= 1.05 * np.sum(list(filled.values())) / 4096 + 2
