"""Retrieval-augmented answers: context, sources, prompts and outcome texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import fixed_values as fixed
from ticketloom.functions.text import strip
from ticketloom.operators.skew import spread_join
from ticketloom.operators.tfidf import SearchIndex

INSTRUCTIONS = (
    "Answer the support ticket from the knowledge-base extracts below and from nothing else. "
    "Give numbered steps, name the Knowledge Base ID you used, say so when the extracts are "
    "not enough, and stay short and factual.")


def collect_hits(hits: DataFrame, index: SearchIndex, key: str) -> DataFrame:
    """(key, hits): the ranked articles of each query as an array of structs.

    A query has at most top_k hits, so the arrays are short.
    """
    full = spread_join(hits, index.articles, ["id"], "id", [key])
    row = F.struct("rank", "id", "title", "category", "subcategory", "priority", "content",
                   "score")
    return full.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("hits"))


def context(hits: Column) -> Column:
    """One labelled block per hit, in rank order; '' without hits."""
    blocks = F.transform(hits, lambda hit: F.format_string(
        fixed.CONTEXT_BLOCK, hit["id"], hit["title"], hit["category"], hit["subcategory"],
        hit["score"], hit["content"]))
    return F.coalesce(F.array_join(blocks, "\n"), F.lit(""))


def sources(hits: Column) -> Column:
    """array<struct<id, title, category, subcategory, score>>, scores to four digits."""
    listed = F.transform(hits, lambda hit: F.struct(
        hit["id"].alias("id"), hit["title"].alias("title"), hit["category"].alias("category"),
        hit["subcategory"].alias("subcategory"), F.round(hit["score"], 4).alias("score")))
    return F.coalesce(listed, F.array().cast(
        "array<struct<id:bigint,title:string,category:string,subcategory:string,score:double>>"))


def prompt(ticket: Column, query: Column, context_text: Column,
           instructions: str = INSTRUCTIONS) -> Column:
    """The request text for an external batch scorer."""
    sections = "\n".join(f"### {name}\n{guidance}" for name, guidance in zip(
        fixed.ANSWER_SECTIONS, fixed.ANSWER_GUIDANCE, strict=True))
    return F.concat(
        F.lit(f"{instructions}\n\nSUPPORT TICKET:\n"), ticket,
        F.lit("\n\nRETRIEVAL QUERY:\n"), query,
        F.lit("\n\nKNOWLEDGE BASE:\n"), context_text,
        F.lit(f"\n\nAnswer with exactly these sections:\n{sections}\n"))


def prompts(tickets: DataFrame, hits: DataFrame, key: str, text: str,
            instructions: str = INSTRUCTIONS) -> DataFrame:
    """(key, query, n_hits, context, sources, prompt) per ticket; hits from collect_hits."""
    query = strip(F.coalesce(F.col(text), F.lit("")))
    joined = tickets.select(key, text).join(hits, key, "left").withColumn("query", query)
    built = joined.select(
        key, text, "query", F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits"),
        context(F.col("hits")).alias("context"), sources(F.col("hits")).alias("sources"))
    return built.withColumn("prompt", prompt(
        F.coalesce(F.col(text), F.lit("")), F.col("query"), F.col("context"), instructions))


def _counted(template: str, n: Column) -> Column:
    before, after = template.split("{n}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def fold_attempts(log: DataFrame, key: str,
                  most: int = fixed.MAX_SCORER_ATTEMPTS) -> DataFrame:
    """(key, answer, attempts, error) from a log of calls(key, attempt, answer, error).

    Attempts are numbered from 1; those beyond the limit do not count. The first one with a
    text ends the calls: its number is `attempts`, and there is no error. Without any, the last
    attempt's error stands, and `attempts` is NULL.
    """
    answer = F.col("answer")
    text = strip(F.coalesce(answer, F.lit("")))
    error = F.when(text != "", F.lit(None)).otherwise(F.coalesce(
        F.col("error"), F.when(answer.isNull(), fixed.NO_RESPONSE_ERROR).when(
            answer == "", fixed.EMPTY_RESPONSE_ERROR).otherwise(fixed.BLANK_RESPONSE_ERROR)))
    calls = log.where(F.col("attempt").between(1, most)).select(
        key, F.col("attempt").cast("int").alias("attempt"), text.alias("text"),
        error.alias("error"))
    answered = F.when(F.col("text") != "", F.col("attempt"))
    folded = calls.groupBy(key).agg(
        F.min(answered).alias("attempts"), F.min_by("text", answered).alias("answer"),
        F.max_by("error", "attempt").alias("_last"))
    return folded.select(key, "answer", "attempts", F.when(
        F.col("attempts").isNull(), F.col("_last")).alias("error"))


def outcomes(prompted: DataFrame, answers: DataFrame, key: str,
             model_name: str = "external") -> DataFrame:
    """(key, resolution, sources, query, context, workflow) from scored answers(key, answer).

    Without hits the ticket is reported as insufficient whatever was
    answered; hits without an answer text give the fallback.  If the answers
    bring attempts and error (fold_attempts), the last stage tells them: the
    attempts of an answer, the error of a fallback.
    """
    text = strip(F.coalesce(F.col("answer"), F.lit("")))
    told = {name: F.col(name) if name in answers.columns else F.lit(None).cast(kind)
            for name, kind in (("attempts", "int"), ("error", "string"))}
    joined = prompted.join(answers.select(
        key, "answer", *[column.alias(f"_{name}") for name, column in told.items()]),
        key, "left").withColumn("answer", text)
    n = F.col("n_hits")
    hit, answered = n > 0, F.col("answer") != ""

    def stage(status: Column, message: Column, *extra: Column) -> Column:
        return F.struct(status.alias("status"), message.alias("message"), *extra)

    done = F.lit("completed")
    found = F.when(hit, done).otherwise("insufficient")
    workflow = F.struct(
        stage(done, F.lit(fixed.ANALYSIS_MESSAGE), F.col("query")).alias("ticket_analysis"),
        stage(found, F.when(hit, _counted(fixed.RETRIEVED_MESSAGE, n)).otherwise(
            fixed.NOT_RETRIEVED_MESSAGE), n.alias("articles_found"), F.col("sources"))
        .alias("knowledge_retrieval"),
        stage(found, F.when(hit, _counted(fixed.CONTEXT_MESSAGE, n)).otherwise(
            fixed.NO_CONTEXT_MESSAGE), n.alias("context_documents"))
        .alias("context_augmentation"),
        stage(F.when(~hit, "completed_with_warning").when(answered, done).otherwise(
            "failed_with_fallback"),
            F.when(~hit, fixed.NOT_GENERATED_MESSAGE).when(
                answered, fixed.GENERATED_MESSAGE).otherwise(fixed.FALLBACK_MESSAGE),
            F.lit(model_name).alias("model"),
            F.when(hit & answered, F.col("_attempts")).alias("attempts"),
            F.when(hit & ~answered, F.col("_error")).alias("error"))
        .alias("resolution_generation"))
    resolution = F.when(~hit, fixed.INSUFFICIENT_RESOLUTION).when(
        answered, F.col("answer")).otherwise(fixed.FALLBACK_RESOLUTION)
    return joined.select(key, resolution.alias("resolution"), "sources", "query", "context",
                         workflow.alias("workflow"))
