"""Main text of web pages by wrapper induction: the pages of a host are aligned as DOM trees.

Every page is parsed to a tree of blocks (module dom). The distinct tree shapes of a host are
aligned by simple tree matching with the host's most frequent shape; nodes that match share a
key. At each key the texts of all pages of the host are compared: a text that stands there in
nearly all of at least MIN_ARTICLES articles is a constant node and belongs to the template,
the others are varying slots and belong to the content. Copies and near copies of one
article count as one, so a host of copies does not turn its article into a template.

The article's title is content even where it repeats. Varying menus, adverts, footers, forms,
notices and reader comments are told by their element, class, id or role.

Nothing is gathered by host: shapes, slots and counts are rows, keyed by more than the host.

Edge cases: null and empty HTML give an empty text; pages without a host are compared with none;
broken markup, unclosed elements and pages cut anywhere are read up to their end; pages of any
length are read whole; elements nested deeper than dom.DEPTH count as part of the last that is
not; repeated pages keep their rows; an empty table gives an empty table; the result has its own
columns only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import dom
from ticketloom.llm.common import map_arrow, map_batches
from ticketloom.llm.urls import host
from ticketloom.session import materialise

#: Different articles of a host that a constant node must stand in.
MIN_ARTICLES = 3
#: Share of the articles with a node that must agree on its text.
CONSTANT = 0.8

BLOCKS = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))


def page_blocks(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, host, shape, article, slots, blocks) of each page.

    slots holds the hash of each slot's whole text; null for titles, which are not compared.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", host(F.col("url")))
    kept = ["page_id", "url", "host"]

    def step(batch):
        shapes, articles, slots, blocks = [], [], [], []
        for page in batch.column("html").to_pylist():
            read = dom.read_page(page or "")
            texts: dict[int, list] = {}
            for slot, text in read.blocks:
                texts.setdefault(slot, []).append(text)
            shapes.append(read.shape)
            articles.append(dom.lead([text for _, text in read.blocks]))
            slots.append([None if slot in read.titles else dom.fingerprint("\n".join(texts[slot]))
                          for slot in sorted(texts)])
            blocks.append([{"slot": slot, "text": text} for slot, text in read.blocks])
        return pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in kept), pa.array(shapes), pa.array(articles, pa.int64()),
             pa.array(slots, pa.list_(pa.int64())), pa.array(blocks, BLOCKS)],
            [*kept, "shape", "article", "slots", "blocks"])

    id_type = dict(rows.dtypes)["page_id"]
    return map_batches(rows, step, (
        f"page_id {id_type}, url string, host string, shape string, article long, "
        "slots array<bigint>, blocks array<struct<slot:int,text:string>>"), "html")


def slot_keys(blocks: DataFrame) -> DataFrame:
    """(host, shape, keys): the key of each slot of each distinct shape of a host."""
    shapes = materialise(blocks.where("host != '' and size(slots) > 0").groupBy(
        "host", "shape").agg(F.count("*").alias("n")), "page-shapes")
    seeds = shapes.groupBy("host").agg(F.max_by("shape", F.struct(
        "n", -F.length("shape"), "shape")).alias("seed"))

    def step(batches):
        for batch in batches:
            keys = [dom.align(seed, shape) for seed, shape in zip(
                batch.column("seed").to_pylist(), batch.column("shape").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("shape"), pa.array(keys, pa.list_(pa.string()))],
                ["host", "shape", "keys"])

    pairs = shapes.join(materialise(seeds, "seed-shapes"), "host").select("host", "shape", "seed")
    return materialise(map_arrow(pairs, step, "host string, shape string, keys array<string>"),
                       "slot-keys")


def templates(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """(host, shape, constants): the constant slots of a shape, with their text's hash."""
    found = blocks.where("host != ''").select(
        "host", "shape", "article", F.posexplode("slots").alias("slot", "content")).where(
        "content is not null")
    spots = found.join(keys, ["host", "shape"]).select(
        "host", F.get("keys", F.col("slot")).alias("key"), "content", "article").distinct()
    counts = spots.groupBy("host", "key", "content").agg(F.count("*").alias("n"))
    constant = counts.groupBy("host", "key").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "content")).alias("top")).where(
        (F.col("top.n") >= MIN_ARTICLES) & (F.col("top.n") >= CONSTANT * F.col("total")))
    each = keys.select("host", "shape", F.posexplode("keys").alias("slot", "key"))
    return materialise(each.join(
        materialise(constant.select("host", "key", F.col("top.content").alias("content")),
                    "constant-nodes"), ["host", "key"]).groupBy("host", "shape").agg(
        F.collect_list(F.struct("slot", "content")).alias("constants")), "templates")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """page_id, url, text (blocks joined by an empty line), n_chars and n_template (blocks left out)."""
    blocks = materialise(page_blocks(pages, id_col, url_col, html_col), "page-blocks")
    known = blocks.join(templates(blocks, slot_keys(blocks)), ["host", "shape"], "left")
    content = F.filter("blocks", lambda b: ~F.exists(
        "constants", lambda c: (c["slot"] == b["slot"])
        & (c["content"] == F.get("slots", b["slot"]))))
    left = F.when(F.col("constants").isNull(), F.col("blocks")).otherwise(content)
    return known.select("page_id", "url", left.alias("left"),
                        F.size("blocks").alias("n_blocks")).select(
        F.col("page_id").alias(id_col), F.col("url").alias(url_col),
        F.array_join(F.col("left.text"), "\n\n").alias("text"), "left", "n_blocks").select(
        id_col, url_col, "text", F.char_length("text").cast("bigint").alias("n_chars"),
        (F.col("n_blocks") - F.size("left")).cast("bigint").alias("n_template"))
