"""The registered queries of the text operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.llm import (
    alignment,
    contamination,
    lexical,
    oracles,
    packing,
    personal_data,
    quality,
    simhash,
    suffixes,
    token_counts,
    token_files,
    urls,
    word_windows,
    wrappers,
)
from ticketloom.llm.common import table

QUERIES = {}
ORACLES = {
    "op6_substring_dedup": oracles.OP6,
    "op7_url_filter": oracles.OP7,
    "op8_benchmark_decontamination": oracles.OP8,
    "op9_suffix_array_dedup": oracles.OP9,
    "op11_lexical_search": oracles.OP11,
}


def query(run):
    QUERIES[run.__name__] = run
    return run


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_counts(spark, sf_dir):
    """Tokens per line of source, language and text, as one document of three fields."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
        ["source", "lang", "text"])


@query
def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"),
                        capacity=4096, end_id=1)


@query
def op5_token_files(spark, sf_dir):
    return token_files.round_trip(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


#: Rules of the URL filter, longest first to apply.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
             ("allow", "org/fr/")]
#: Hosts whose pages' canonical URLs make up the list of the query.
LISTED_HOSTS = r"(^|\.)(cheap-pills|spam-farm)\."


@query
def op7_url_filter(spark, sf_dir):
    """The list holds the canonical URLs of the pages of the listed hosts."""
    pages = table(spark, sf_dir, "pages")
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS)).select(urls.canonical(host, path).alias("key"))
    return urls.judge_urls(pages, listed, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op8_benchmark_decontamination(spark, sf_dir):
    return contamination.contaminated_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def removed(spans):
    """The length of merged spans, in all."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


@query
def op6_substring_dedup(spark, sf_dir):
    return word_windows.remove_repeats(table(spark, sf_dir, "documents"), window=50).select(
        "doc_id", "n_words", removed(F.col("spans")).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_suffix_array_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), window=100).select(
        "doc_id", "n_bytes", removed(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_personal_data(spark, sf_dir):
    return personal_data.report(table(spark, sf_dir, "documents"))


@query
def op11_lexical_search(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    return lexical.rank_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top_k=10)


@query
def op12_cross_tokenizer_alignment(spark, sf_dir):
    return alignment.alignments(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"),
        tokenizer_file("piece_bpe_32k.model"))


@query
def op13_html_extraction(spark, sf_dir):
    return wrappers.main_texts(table(spark, sf_dir, "pages"))
