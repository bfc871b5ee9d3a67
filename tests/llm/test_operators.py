"""The text operators against plain versions, on edge cases and on whole small tables."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from ticketloom.llm import (
    anchors,
    components,
    contamination,
    packing,
    personal_data,
    quality,
    simhash,
    suffixes,
    token_counts,
    token_files,
    urls,
    word_windows,
)
from ticketloom.llm.common import table
from ticketloom.llm.encode import Encoder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997} x{i % 13}." for i in range(9000))
SHARED = " ".join(f"shared{i}" for i in range(70))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one word"), (6, "One WORD"),
    (7, f"start here {SHARED} end"), (8, f"other {SHARED} tail\nline\nline\n"),
    (9, f"start here {SHARED} end"), (10, "Straße ÉTÉ naïve 日本 🎉🎉 <|endoftext|>\x00\x01 a  b"),
    (11, "mail a.b@c.org or +1 (555) 555-1234, 10.0.0.255 and 4111 1111 1111 1111"),
    (12, "a" * 700), (None, f"no id {SHARED}"), (13, "tie"), (13, "tie"), (13, "tie again")]
#: Names that the operators use themselves.
EXTRA = ["row", "id", "spans", "kept", "fingerprint", "digest", "place", "start", "n_words",
         "_pii_spans_", "kind", "words", "items", "key"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, *["extra"] * len(EXTRA)) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def in_order():
    """The texts in the order in which repeats are judged, for unique ids."""
    return [(i, t) for i, t in TEXTS if i is not None and i < 13]


def plain_ids(path, text, end):
    coder = Encoder(path)
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- tokens ---------------------------------------------------------------------

@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_encoder_equals_the_tokenizer(path):
    coder = Encoder(path)
    letters = ["a", "The", "it's", " ", "  ", "\n", "\t", ".", "!!", "é", "É", "ñ", "İ", "Σ", "7",
               " ", "\x1c", "日", "🎉", "́", "<|endoftext|>"]
    random.seed(5)
    texts = ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(1500)]
    texts += [t or "" for _, t in TEXTS]
    want = [np.array(e.ids, "<u4").tobytes()
            for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # unknown words, then known ones
        assert coder.encode([t.encode() for t in texts]) == want


def test_packing_on_edge_cases(edge, empty):
    rows = packing.pack(edge, WORD, capacity=64, end_id=1, with_ids=True).collect()
    want = Counter()
    for doc_id, text in TEXTS:
        ids = plain_ids(WORD, text, 1)
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start:start + 64]
            want[doc_id, piece, start, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = Counter()
    for row in rows:
        used.update((row.sequence_id, row.offset + i) for i in range(row.length))
    assert max(used.values()) == 1
    ends = Counter(s for s, _ in used)
    assert max(ends.values()) <= 64 and all((s, n - 1) in used for s, n in ends.items())
    assert packing.pack(empty, WORD).collect() == []


def test_packed_sequences_hold_the_ids(edge):
    placed = packing.pack(edge, WORD, capacity=64, with_ids=True)
    total = sum(len(plain_ids(WORD, text, 1)) for _, text in TEXTS)
    rows = packing.sequences(placed).collect()
    assert sum(r.n_tokens for r in rows) == total
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)


def test_two_fit_replaces_the_smallest_piece():
    # 6 + 3 leaves 1; the 3 gives way to 2 + 2.
    plan = packing.two_fit_plan({6: 1, 3: 1, 2: 2}, 10)
    first = {int(r[0]): int(r[3]) for r in plan}
    assert first[6] == first[2] == 0 and first[3] == 1


@pytest.mark.parametrize("seed", range(8))
def test_two_fit_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 300])
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
    plan = packing.two_fit_plan(histogram, capacity)
    filled, done = Counter(), Counter()
    for length, rank, count, sequence, times, offset in plan.tolist():
        assert rank == done[length]
        done[length] += count
        for i in range(count):
            for place in range(length):
                filled[sequence + i // times, offset + i % times * length + place] += 1
    assert done == Counter(histogram) and max(filled.values()) == 1
    assert max(place for _, place in filled) < capacity
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    big = sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert len({s for s, _ in filled}) <= 1.12 * max(least, big) + 2


def test_rank_coding_round_trip():
    random.seed(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = np.array([random.randrange(1 << random.choice([4, 8, 9, 16, 17, 24, 25, 32]))
                          for _ in range(n)], np.uint32)
        block = token_files.encode_block([n], ranks)
        sizes, back = token_files.decode_block(block)
        assert sizes.tolist() == [n] and back.tolist() == ranks.tolist()


def test_token_files_on_edge_cases(spark, edge, empty):
    rows = token_files.round_trip(edge, BYTE, end_id=2).collect()
    want = Counter((i, crc(plain_ids(BYTE, t, 2))) for i, t in TEXTS)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    assert token_files.round_trip(empty, BYTE).collect() == []


def plain_sections(coder, parts):
    """(field, section, start, end, tokens, crossing) of a document's fields, by a plain loop."""
    body, sections = "".join(parts), []
    begin = 0
    for field, part in enumerate(parts):
        at = begin
        lines = part.split("\n")
        for number, line in enumerate(lines):
            end = at + len(line) + (number < len(lines) - 1)
            sections.append([field, number, at, end, 0, 0])
            at = end
        begin += len(part)
    for start, end in coder.encode(body, add_special_tokens=False).offsets:
        shares = [min(end, s[3]) - max(start, s[2]) for s in sections]
        home = shares.index(max(shares))
        sections[home][4] += 1
        sections[home][5] += sum(share > 0 for share in shares) > 1
    return [tuple(s) for s in sections]


MIXED = ["日本語\n\nテキスト 🎉🎉", "é\ne\u0301 x\t\ty", "a  \n  b\n\n\nc", "x" * 300 + "\n" + "y z " * 99,
         "\n", "don't\nwe'll"]


def test_section_counts_equal_a_plain_loop(spark, edge, empty):
    coder = Encoder(BYTE).tokenizer
    rows = token_counts.count_tokens(edge, BYTE, ["id", "text"]).collect()
    want = Counter((i, ["id", "text"][s[0]], *s[1:]) for i, t in TEXTS
                   for s in plain_sections(coder, ["extra ", t or ""]))
    assert Counter(map(tuple, rows)) == want
    mixed = spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string")
    rows = token_counts.count_tokens(mixed, BYTE, ["text"]).collect()
    assert Counter(map(tuple, rows)) == Counter(
        (i, "text", *s[1:]) for i, t in enumerate(MIXED) for s in plain_sections(coder, [t]))
    assert token_counts.count_tokens(empty, BYTE, ["text"]).collect() == []


def test_crossing_tokens_go_where_most_characters_are():
    spans = np.array([[0, 2], [2, 6], [6, 8]])
    n, crossing = token_counts.allocate(spans, np.array([0, 3, 3, 7]), np.array([3, 3, 7, 9]))
    assert n.tolist() == [1, 0, 2, 0] and crossing.tolist() == [0, 0, 2, 0]


# --- quality ----------------------------------------------------------------------

def test_base_rules(edge, empty, spark):
    model = quality.fit(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = quality.judged(edge, model).collect()
    want = Counter((i, *brute.base_rules(t)) for i, t in TEXTS)
    assert Counter((r.doc_id, *r[1:7]) for r in rows) == want
    assert all(r.kept == (not r.base_failed) for r in rows)  # without labels, all is content
    assert quality.judged(empty, model).collect() == []
    kept = quality.kept_rows(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)


def test_line_model_agrees_with_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    rows = quality.judged(docs, model).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_a_repeated_id_enters_the_sample_once(spark, monkeypatch):
    seen = []
    train = quality.train

    def spy(lines, labels):
        seen.append(len(lines))
        return train(lines, labels)

    monkeypatch.setattr(quality, "train", spy)
    rows = [(1, f"Some sentence number {i}.\nAnother line.") for i in range(30)]
    rows += [(2, "BUY NOW !!! $$$\nclick"), (3, "A quiet text.\nIt goes on.")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = quality.fit(docs.repartition(3), labels)
    assert seen == [3, 3]
    again = quality.fit(docs.orderBy(F.desc("text")), labels)
    assert np.array_equal(one.weights, again.weights) and np.array_equal(one.moves, again.moves)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    model = quality.LineModel(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    for n in (1, 2, 6):
        lines = [tuple(x) for x in rng.random((n, quality.N_FEATURES))]
        scores = np.array(lines) @ model.weights

        def total(path, scores=scores):
            return sum(scores[i, s] for i, s in enumerate(path)) + sum(
                model.moves[a, b] for a, b in zip(path, path[1:], strict=False))

        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert total(model.viterbi(lines)) == pytest.approx(max(map(total, paths)))


# --- near copies --------------------------------------------------------------------

def test_fingerprints_and_groups(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter(
        (i, f"{brute.fingerprint(t):016x}") for i, t in TEXTS)
    prints = [int(r.fingerprint, 16) for r in rows]
    groups = brute.linked_groups(prints)
    for row, group in zip(rows, groups, strict=True):
        ids = [r.doc_id for r, g in zip(rows, groups, strict=True)
               if g == group and r.doc_id is not None]
        assert row.component_id == min(ids, default=None)
    kept = simhash.one_per_group(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(groups))
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_per_group(empty).collect() == []


def test_links_of_many_fingerprints(spark):
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(700):
        value = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            value ^= 1 << bit
        prints.append(value)
    prints += [0, 1, (1 << 64) - 1, 7, 15, 1 << 63]
    prints = list(dict.fromkeys(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.linked(spark.createDataFrame(signed, "fingerprint long").repartition(3))
    found = {r.node: r.component for r in components.components(edges).collect()}
    groups = brute.linked_groups(prints)
    mine = [found.get(p, p) for p, in signed]
    assert len(set(zip(groups, mine, strict=True))) == len(set(groups)) == len(set(mine))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    rows = components.components(edges).collect()
    assert len(rows) == 201 and {r.component for r in rows} == {0}


# --- repeats --------------------------------------------------------------------------

def random_texts(seed, alphabet, longest):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(25)]
    for _ in range(15):
        a, b = rng.choice(texts), rng.choice(texts)
        cut, to = rng.randint(0, len(a)), rng.randint(0, len(b))
        texts.append(b[:to] + a[cut:cut + rng.randint(0, longest)] + b[to:])
    return texts + [texts[3]] * 4 + ["", "ab" * longest]


@pytest.mark.parametrize("seed", range(3))
def test_word_windows_against_brute_force(spark, seed):
    texts = random_texts(seed, ["a ", "b ", "cc ", "a\n"], 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = word_windows.remove_repeats(docs, window=8).orderBy("doc_id").collect()
    assert [(r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in rows] == (
        brute.word_repeats(texts, 8))


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_against_brute_force(spark, seed):
    texts = random_texts(seed, "ab" if seed % 2 else "abcdé", 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = suffixes.remove_repeats(docs, window=12, gram=5).orderBy("doc_id").collect()
    assert [(r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))
            for r in rows] == brute.byte_repeats(texts, 12)


def test_repeats_on_edge_cases(spark, edge, empty):
    known = edge.where("doc_id < 13")
    rows = word_windows.remove_repeats(known).orderBy("doc_id").collect()
    assert [(r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in rows] == (
        brute.word_repeats([t for _, t in in_order()], 50))
    rows = suffixes.remove_repeats(known).orderBy("doc_id").collect()
    assert [(r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))
            for r in rows] == brute.byte_repeats([t for _, t in in_order()], 100)
    # Repeated and null ids: every row is a document, null ids come last.
    rows = word_windows.remove_repeats(edge).collect()
    assert len(rows) == len(TEXTS)
    assert [r.kept for r in rows if r.doc_id is None] == ["no id"] or [
        len(r.kept.split()) for r in rows if r.doc_id is None] == [2]
    assert suffixes.remove_repeats(edge).count() == len(TEXTS)
    assert word_windows.remove_repeats(empty).collect() == []
    assert suffixes.remove_repeats(empty).collect() == []


def test_deep_shallow_sorting():
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 60))) for _ in range(300)]
    strings += [b"ab" * 20 + bytes(rng.choices(b"ab", k=rng.randint(0, 20))) for _ in range(200)]
    strings += strings[:50]
    order, shared = suffixes.deep_shallow(strings, 80)
    # Strings that differ only by zeros at their end may come in any order.
    assert [strings[i].rstrip(b"\0") for i in order] == sorted(s.rstrip(b"\0") for s in strings) or [
        strings[i] for i in order] == sorted(strings)
    for i in range(1, len(order)):
        assert shared[i] == suffixes.common(strings[order[i - 1]], strings[order[i]])


def test_anchor_of_equal_windows_is_equal():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 3000).astype(np.uint64)
    values[2000:2300] = values[100:400]
    _, _, first, anchor, last = anchors.find(values, np.array([1500, 3000]), 20, 7)
    at = {int(w): int(a - w) for f, a, z in zip(first, anchor, last, strict=True)
          for w in range(f, z + 1)}
    assert len(at) == 2 * (1500 - 19)
    assert all(at[100 + i] == at[2000 + i] for i in range(300 - 19))


# --- URLs -------------------------------------------------------------------------------

def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Bad.org/a/"), (4, "http://bad.org/a?x=1"),
            (5, "http://x.net/"), (6, "http://a.example.net/en/1"), (7, "http://x.net"),
            (7, "http://bad.org/a"), (None, "http://notexample.net/en/"), (8, "http://É.org/b#f")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, key string")
    listed = spark.createDataFrame(
        [("bad.org/a",), (None,), ("bad.org/a",)] + [(f"h{i}.org/p",) for i in range(500)], "key string")
    rules = [("block", "net/"), ("allow", "example.net/en/")]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict)
           for r in urls.judge_urls(pages, listed, rules).collect()}
    assert got == {
        (1, "", ""): (None, "allow"), (2, "", ""): (None, "allow"),
        (3, "www.bad.org", "/a/"): (None, "block"), (4, "bad.org", "/a"): (None, "block"),
        (5, "x.net", "/"): ("net/", "block"),
        (6, "a.example.net", "/en/1"): ("example.net/en/", "allow"),
        (7, "x.net", ""): (None, "allow"), (7, "bad.org", "/a"): (None, "block"),
        (None, "notexample.net", "/en/"): ("net/", "block"), (8, "É.org", "/b"): (None, "allow")}
    none = listed.limit(0)
    assert urls.judge_urls(pages, none, []).where("verdict = 'block'").count() == 0
    assert urls.judge_urls(pages.limit(0), listed, rules).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = urls.bloom_table(keys, 20)
    hit = F.lit(True)
    for i, mask in enumerate(urls.masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    probes = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    got = probes.withColumn("block", urls.block_of(F.col("key"), 20)).join(words, "block").where(hit)
    assert got.where("id < 3000").count() == 3000 and got.where("id >= 3000").count() > 0


# --- benchmark passages -------------------------------------------------------------------

def test_contamination_on_edge_cases(spark, edge, empty):
    items = [("a", " ".join(f"Shared{i}" for i in range(20, 45))), ("b", "word"), ("c", None),
             ("d", "!!"), (None, "naïve"), ("a", "one WORD"), ("e", "tie again"), ("f", "x5 w6 " * 30)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, words string")
    rows = contamination.contaminated_report(edge, bench).collect()
    want = Counter()
    for doc_id, text in TEXTS:
        n, hit, found = brute.benchmark_hits(text, items)
        want[doc_id, n, hit, len(found), brute.sha(",".join(found)), hit > 0] += 1
    assert Counter(tuple(r) for r in rows) == want
    clean = contamination.clean_rows(edge, bench)
    assert clean.columns == edge.columns and clean.count() == sum(not r.contaminated for r in rows)
    assert contamination.contaminated_report(edge, bench.limit(0)).where("contaminated").count() == 0
    assert contamination.contaminated_report(empty, bench).collect() == []


def test_contamination_by_shuffled_windows(spark, sf_dir, monkeypatch):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    once = sorted(contamination.contaminated_report(docs, bench).collect())
    monkeypatch.setattr(contamination, "BLOCK_WINDOWS", 300)
    assert sorted(contamination.contaminated_report(docs, bench).collect()) == once
    # Nothing is small enough for a broadcast by its size: words are counted and joined by shuffle.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(contamination.contaminated_report(docs, bench).collect()) == once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- personal data --------------------------------------------------------------------------

HARD = [
    (20, "a@b.c_d@e.fg x@y.zz. 1.2.3.4.5.6.7.8 +1 (234) 555-1234 4111 1111 1111 1111x"),
    (21, "\x01a\x01 x@y.z\x01 256.1.1.1 0000255.0.0.1"),
    (22, "é🎉 mañana foo@bar.com 🎉 4111-1111-1111-1111 4111111111111112 +12 3"),
    (23, "1" * 3000 + " a" * 50 + "@"), (24, "a" * 5000 + "@x.y " + "1 " * 4000),
    (25, "+1+1+12345678 (+49 30 1234567)"), (26, "1.2.3 1.2.3.4.5 1.2.3.4 1.2.3.4")]


def test_personal_data_on_edge_cases(spark, edge, empty):
    texts = TEXTS + HARD
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts],
                                 "doc_id long, text string, spans string, digest string")
    rows = personal_data.report(docs).collect()
    want = Counter()
    for doc_id, text in texts:
        spans = brute.personal(text)
        named = ",".join(f"{kind}:{a}:{b}" for kind, own in zip(personal_data.KINDS, spans, strict=True)
                         for a, b in own)
        want[doc_id, *map(len, spans), brute.sha(named), named] += 1
    assert Counter(tuple(r) for r in rows) == want
    got = personal_data.masked_rows(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        (i, t and brute.masked(t, brute.personal(t))) for i, t in texts)
    assert personal_data.report(empty).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"hello there contact me: user{i}@x.com ok. filler {i} words call now "
                f"+1 (555) 555-{1000 + i} bye") for i in range(12)]
    rows += [(100, "please contact me: user9(at)x.com ok. the number 12345 is plain"),
             (101, "words call now 555-9999 yes. item 4711 of 12"), (102, "filler 77777 words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.report(docs).where("doc_id >= 100").collect()}
    assert got == {100: "email:19:33", 101: "phone:15:23", 102: ""}
    # Copies of one text are no further evidence.
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(50)] + rows[12:14],
                                   "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.report(copies).where("doc_id >= 100").collect()}
    assert got == {100: "", 101: ""}


def test_contexts_are_alike_for_entities_and_tokens(spark):
    link = "https://x.org/" + "long/" * 30
    rows = [(i, f"see line{i} phone: +1 (555) 555-{1000 + i} bye") for i in range(9)]
    rows += [(50 + i, f"{link}page{i} mail: ann{chr(97 + i)}@x.org bye") for i in range(9)]
    rows += [(100, "see line99 phone: 555-9999 yes"), (101, f"{link}page99 mail: ann7(at)x yes"),
             (102, "a bob@x.org phone: 555-9998 yes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.report(docs).where("doc_id >= 100").collect()}
    at = len(f"{link}page99 mail: ")
    assert got == {100: "phone:18:26", 101: f"email:{at}:{at + 9}", 102: "email:2:11,phone:19:27"}


def test_contexts_find_identifiers_of_other_shapes(spark):
    rows = [(i, f"hello there contact me: {chr(97 + i) * 3}@x.com ok. now call now "
                f"+1 (555) 555-{1000 + i} bye") for i in range(24)]
    rows += [(100, "  please contact me: alice(at)x.com, thanks"),
             (101, "please contact me: alice@localhost."), (102, "so call now (555) 555-9999. 12 yes"),
             (103, "so call now 555 123 4567, all of you"), (104, "contact me: soon, call now please"),
             (105, "x\n\ncontact me: al-ice(at)x (call now +1 555 123 4567)"), (106, "contact me:")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.report(docs).where("doc_id >= 100").collect()}
    assert got == {100: "email:21:35", 101: "email:19:34", 102: "phone:12:26", 103: "phone:12:24",
                   104: "", 105: "email:15:26,phone:37:52", 106: ""}
    hidden = {r.doc_id: r.text for r in personal_data.masked_rows(docs).collect()}
    assert hidden[100] == "  please contact me: <EMAIL>, thanks"
    assert hidden[103] == "so call now <PHONE>, all of you" and hidden[104] == rows[-3][1]
    # Behind a pattern that plain words follow as often, nothing is found.
    rows += [(200 + i, f"contact me: {word}") for i, word in enumerate(
        "today later tonight tomorrow never always monday friday".split())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.report(docs).where("doc_id >= 100").collect()}
    assert got[100] == got[101] == "" and got[102] == "phone:12:26"


def test_blocks_of_a_text_equal_the_whole(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["call now ", "contact me: ", "555 12 ", "(555) 1.", "2-3 4 ", "a(at)x.com ", "\n", "  ", "é🎉 ",
             "+49 30 ", "x1/y", "call ", "now ", "7. 8 99999 ", ", ", "me", "\t12"]
    texts = [" " * 9 + "contact me: z", "call now 1", "", "now x", " ", "x" * 99 + " call now 12345"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    patterns = spark.createDataFrame(
        [("call now", True), ("contact me:", False), ("^ now", False), ("^ call", True), ("# me", True)],
        "pattern string, joined boolean")
    whole = Counter(map(tuple, personal_data.behind(docs, patterns).collect()))
    assert len(whole) > 150
    for size in (1, 7, 30):
        monkeypatch.setattr(personal_data, "BLOCK_CHARS", size)
        assert Counter(map(tuple, personal_data.behind(docs, patterns).collect())) == whole


def test_pieces_of_a_text_are_masked_alike(spark, monkeypatch):
    text = " ".join(f"né🎉 u{i}@x.org, 10.0.0.{i} +1 (555) 555-{1000 + i}" for i in range(90))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, None)], "doc_id long, text string")
    want = {1: brute.masked(text, brute.personal(text)), 3: None}
    want[2] = want[1] + " x"
    for size in (1, 5, 1024):
        monkeypatch.setattr(personal_data, "PIECE", size)
        assert {r.doc_id: r.text for r in personal_data.masked_rows(docs).collect()} == want


def test_time_grows_with_the_hits_of_a_text(spark):
    def seconds(hits):
        text = " ".join(f"please contact me: user{i}@x{i}.com or call now alice{i}(at)x{i}." for i in range(hits))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.monotonic()
        assert "@" not in personal_data.masked_rows(docs).first().text
        return time.monotonic() - begin

    seconds(100)
    few, many = seconds(2000), seconds(16000)
    assert many < 8 * few, (few, many)
