"""Lexical search, cross-tokenizer alignment and HTML extraction against plain versions."""

import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import EXTRA, TEXTS
from ticketloom.llm import alignment, dom, lexical, wrappers
from ticketloom.llm.common import table
from ticketloom.llm.queries import QUERIES

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, *["extra"] * len(EXTRA)) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)).repartition(3)


# --- ranked search ------------------------------------------------------------------

def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, top_k):
    """docs, items: lists of (id, text); (item, rank, doc, score) rows, ids not null."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    df = Counter(term for _, c in counts for term in c)
    n, total = len(counts), sum(c.total() for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 100 - 75 + (75 * c.total() * n) // total
            score = sum(int(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))))
                        * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text) if c[t])
            if score:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in
                enumerate(sorted(scored)[:top_k], 1)]
    return Counter(out)


def as_counter(df):
    return Counter(tuple(row) for row in df.collect())


def test_search_on_edge_cases(spark, edge):
    docs = edge.where("doc_id is not null and doc_id < 13")
    items = [("a", "One word, w5 x3 x3 x3"), ("b", None), ("c", ""), ("d", "absent"),
             ("e", "shared1 SHARED2 shared3 tail"), ("f", "tie 日本 été"), ("f", "one"), ("g", "!!")]
    queries = spark.createDataFrame([(*q, "x", "y") for q in items],
                                    "item_id string, text string, row string, q string")
    got = lexical.rank_documents(docs, queries, top_k=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_search([(i, t) for i, t in TEXTS if i is not None and i < 13], items, 3)
    assert as_counter(got) == want
    assert lexical.rank_documents(edge.limit(0), queries).collect() == []
    assert lexical.rank_documents(docs, queries.limit(0)).collect() == []


def test_search_ranks_every_row_of_a_repeated_id(spark, edge):
    queries = spark.createDataFrame([(None, "tie again shared5")], "item_id int, text string")
    rows = lexical.rank_documents(edge, queries, top_k=50).collect()
    assert Counter(r.doc_id for r in rows) == Counter([13, 13, 13, 7, 8, 9, None])
    assert sorted(r["rank"] for r in rows) == list(range(1, 8))


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_scoring_every_document(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 3, 9, 40, 300]))))
            for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(200)]  # a third are copies
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(40)]
    monkeypatch.setattr(lexical, "PART_DOCS", 50)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    queries = spark.createDataFrame(items, "item_id long, text string")
    corpus = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert as_counter(lexical.rank_documents(corpus, queries)) == plain_search(docs, items, 10)


def test_full_index_is_saved_and_bounds_skip_strata(spark, sf_dir, tmp_path):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    lexical.build_index(docs).save(str(tmp_path / "index"))
    index = lexical.LexicalIndex.load(spark, str(tmp_path / "index"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    terms = {t for _, text in rows for t in plain_terms(text)}
    assert {r.term for r in index.weights.collect()} == terms
    got = lexical.search(items, index, top_k=10)
    want = plain_search(rows, [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert as_counter(got) == want


def test_no_part_holds_a_whole_stratum_of_copies(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_DOCS", 20)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same text here").alias("text"))
    parts = lexical.build_index(docs).parts.collect()
    assert len({p.m for p in parts}) == 1
    assert max(len(p.rows) // 8 for p in parts) < 60 and sum(len(p.rows) // 8 for p in parts) == 500


# --- alignment ------------------------------------------------------------------------

def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    coder = Tokenizer.from_file(BYTE)
    coder.encode_special_tokens = True
    letters = {letter: byte for letter, byte in alignment.byte_of_letter().items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def piece_bytes(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else (
            piece.replace("▁", " ").encode())

    per_text, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            ids_a = coder.encode(" " + text, add_special_tokens=False).ids
            ids_b = pieces.encode(text)
            a = [(i, bytes(letters[c] for c in coder.id_to_token(i))) for i in ids_a]
            b = [(i, piece_bytes(i)) for i in ids_b]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                left, right, at_a, at_b = list(a), list(b), 0, 0
                own_a, own_b = [], []
                while left or right:
                    if at_a <= at_b:
                        i, x = left.pop(0)
                        own_a.append(i)
                        at_a += len(x)
                    else:
                        i, x = right.pop(0)
                        own_b.append(i)
                        at_b += len(x)
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        links = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        counts.update(set(links))
        per_text.append((groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for groups, links in per_text:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
                    len(links), sum(counts[p] == most[p[0]] for p in links),
                    sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def alignment_rows(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                    r.groups_sha256) for r in df.collect())


MIXED = [(20, "a▁b"), (21, "wide  spaces   and\ttabs\n\n\nlines "), (22, "ﬁ Ａ é"), (23, "\x00\x01"),
         (24, "x" * 5000), (25, "日本語のテキスト" * 40), (26, "<s> </s> <unk> <0x41> <|endoftext|>"),
         (27, " leading"), (28, "👩‍👩‍👧‍👦 é ñ"), (29, "don't we'll I'M 12345678")]


@pytest.mark.parametrize("step, part, expanded", [(1 << 20, 6 << 20, 1 << 21), (200, 500, 7)])
def test_alignment_on_edge_cases(spark, edge, monkeypatch, step, part, expanded):
    monkeypatch.setattr(alignment, "STEP_BYTES", step)
    monkeypatch.setattr(alignment, "PART_BYTES", part)
    texts = TEXTS[:3] + TEXTS[4:] + MIXED if expanded < 10 else TEXTS + MIXED
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts],
                                 "doc_id long, text string, pair int, slice int").repartition(2)
    want = Counter((i, *rest) for (i, _), rest in zip(
        texts, plain_alignment([t for _, t in texts]), strict=True))
    coded = alignment.ByteTokenizer(BYTE), alignment.PieceTokenizer(PIECE)
    monkeypatch.setattr(alignment, "EXPANDED", expanded)
    columns, found = alignment.align([t for _, t in texts], *coded)
    assert list(zip(columns["n_links"], columns["groups_sha256"], strict=True)) == [
        (row[3], row[6]) for row in plain_alignment([t for _, t in texts])]
    assert alignment_rows(alignment.alignments(docs, BYTE, PIECE)) == want
    assert alignment.alignments(docs.limit(0), BYTE, PIECE).collect() == []


def test_overlap_links_are_the_product():
    rng = random.Random(2)
    lengths = [[], []]
    for one in lengths:
        while sum(one) < 300:
            one.append(min(rng.randint(1, 7), 300 - sum(one)))
    import numpy as np

    rows, columns, common = alignment.overlap_links(*(np.array(one) for one in lengths))
    want = {}
    ends = [np.cumsum(one) for one in lengths]
    for i, (n, end) in enumerate(zip(lengths[0], ends[0], strict=True)):
        for j, (k, last) in enumerate(zip(lengths[1], ends[1], strict=True)):
            shared = min(end, last) - max(end - n, last - k)
            if shared > 0:
                want[i, j] = shared
    got = dict(zip(zip(rows.tolist(), columns.tolist(), strict=True), common.tolist(), strict=True))
    assert got == want and len(rows) == len(want)


def test_registered_alignment_equals_plain_version(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *rest) for r, rest in zip(
        rows, plain_alignment([r.text for r in rows]), strict=True))
    assert alignment_rows(QUERIES["op12_cross_tokenizer_alignment"](spark, sf_dir)) == want


# --- HTML -----------------------------------------------------------------------------

def page(article, nav="<li><a href=/a>Menu one</a></li>", extra="", aside="Buy now 1"):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>"
            f"<header><div>Site</div></header><nav><ul>{nav}</ul></nav>"
            f"<div class='ad'>{aside}</div>{article}{extra}<footer>&copy; us</footer></body></html>")


def texts_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], (
        "page_id long, url string, html string, text string, host string, slot int")).repartition(3)
    got = wrappers.main_texts(df).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return Counter((r.page_id, r.url, r.text) for r in got)


def test_pages_without_article_lose_what_is_constant(spark):
    def body(i):
        return page(f"<div class='wrap'><p>Read our rules first.</p><div id='c'><h2>Story {i}</h2>"
                    f"<p>Body {i} of &lt;text&gt; number<br>{i * 7} &amp; more</p><p>end {i}</p></div>"
                    "<div>All rights kept.</div></div>", aside=f"Buy {i}")

    rows = [(i, f"http://a.example/{i}", body(i)) for i in range(6)]
    want = Counter((i, u, f"Story {i}\n\nBody {i} of <text> number {i * 7} & more\n\nend {i}")
                   for i, u, _ in rows)
    assert texts_of(spark, rows) == want


def test_a_host_of_copies_keeps_its_article(spark):
    copy = page("<article><h1>Same</h1><p>same words in all of the copies here</p></article>")
    rows = [(i, f"https://b.example/{i}", copy.replace("Menu one", f"Menu {i}")) for i in range(9)]
    assert set(t for _, _, t in texts_of(spark, rows)) == {
        "Same\n\nsame words in all of the copies here"}


def test_pages_on_edge_cases(spark):
    rows = [(1, None, None), (2, "no host", ""), (3, "http://c.example", "just text &am &amp"),
            (4, "http://c.example", "<p>one<p>two <b>bold<br>x</p><!-- no --><script>var a='</p>'"),
            (5, None, page("<article><h1>T</h1><p>&nbsp;a\n\tb </p></article>")),
            (5, None, page("<article><h1>T</h1><p>&nbsp;a\n\tb </p></article>")),
            (6, "http://c.example/x", "<p>" + "long " * 200_000),
            (7, "http://c.example/y", "<div>" * 3000 + "deep" + "</div>" * 3000),
            (8, "http://c.example/z", page(
                "<article class='post'><header><h1>Head</h1></header><p>text</p><aside>side</aside>"
                "<form><p>name</p></form><ul><li>1</li><li>2</li></ul></article>",
                extra="<section id='comments'><article class='comment'><p>me too</p></article>"
                      "</section><div class='cookie-notice'>We use</div>"))]
    want = Counter([(1, None, ""), (2, "no host", ""), (3, "http://c.example", "just text &am &"),
                    (4, "http://c.example", "one\n\ntwo bold x"), (5, None, "T\n\na b"),
                    (5, None, "T\n\na b"), (6, "http://c.example/x", ("long " * 200_000).strip()),
                    (7, "http://c.example/y", "deep"),
                    (8, "http://c.example/z", "Head\n\ntext\n\n1\n\n2")])
    assert texts_of(spark, rows) == want
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.main_texts(empty).collect() == []


def plain_matching(a, b):
    """The weight of the best match of two trees, by trying all."""
    own = dom.similar(a, b)
    if not own:
        return 0

    def rest(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(rest(i + 1, j), rest(i, j + 1),
                   rest(i + 1, j + 1) + plain_matching(a[1][i], b[1][j]))
    return own + rest(0, 0)


@pytest.mark.parametrize("seed", range(20))
def test_tree_matching_is_the_best(seed):
    rng = random.Random(seed)

    def shape(depth):
        if not depth or rng.random() < 0.3:
            return "#"
        label = rng.choice(["div", "div.a", "p", "ul"])
        return f"{label}({','.join(shape(depth - 1) for _ in range(rng.randint(1, 4)))})"

    one, two = (f"(body({','.join(shape(3) for _ in range(3))}))" for _ in range(2))
    a, b = dom.tree(one), dom.tree(two)
    weight, pairs = dom.matching(a, b, {})
    assert weight == plain_matching(a, b)
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs})
    keys = dom.align(one, one)
    assert len(set(keys)) == len(keys) and "~" not in "".join(keys)
    assert len(dom.align(one, two)) == two.count("#")


def test_registered_extraction_returns_the_articles(spark, sf_dir):
    want = Counter()
    for r in table(spark, sf_dir, "pages").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (re.sub(r"<(?:br|/?b)>", " ", part) for part in re.split(r"</?(?:p|h1)>", article))
        blocks = [" ".join(html.unescape(part).split()) for part in parts]
        want[r.page_id, r.url, "\n\n".join(filter(None, blocks))] += 1
    got = QUERIES["op13_html_extraction"](spark, sf_dir).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == want
