"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import decide, rules
from ticketloom.functions.coercion import (
    classification_correct,
    is_blank,
    percent,
    safe_float,
    safe_int,
    truth,
)
from ticketloom.operators import (
    attempts,
    classification,
    clean,
    feedback,
    metrics,
    model,
    outbox,
    profile,
    rule_index,
    sampling,
    summaries,
    text_model,
)
from ticketloom.operators.retrieval import best_article, search
from ticketloom.operators.tfidf import fit_index, term_counts, tfidf_terms
from ticketloom.plans import answers, bridge, evaluation, triage
from ticketloom.plans.knowledge_base import article_count, build_articles
from ticketloom.session import materialise, new_folder
from ticketloom.sources import schemas, tables
from ticketloom.sources.ledger import Ledger
from ticketloom.streaming import live, runs, upserts

Query = Callable[[SparkSession, str], DataFrame]
SCORE_DIGITS = 6


def day_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- rules -------------------------------------------------------------------

def ticket_severity_priority(spark, sf_dir):
    accepted, _ = clean.split_required(bridge.tickets(spark, sf_dir))
    named = clean.fill_defaults(accepted, {"department": "IT", "employee_name": "Unknown"})
    return triage.classify_by_rules(named).select(
        "ticket_id", "description", "employee_name", "department", "impact", "severity",
        "priority")


def ticket_diagnosis(spark, sf_dir):
    return bridge.tickets(spark, sf_dir).select(
        "ticket_id", rules.diagnosis_record(F.col("description")).alias("record")).select(
        "ticket_id", "record.*")


def conversation_diagnosis(spark, sf_dir):
    """Rules on natural text: whole turns of all speakers."""
    turns = bridge.table(spark, sf_dir, "conversations")
    return turns.groupBy(
        "role", rules.severity(F.col("text")).alias("severity"),
        rules.diagnosis(F.col("text")).alias("diagnosis")).agg(F.count("*").alias("n"))


def classification_correctness(spark, sf_dir):
    return bridge.tickets(spark, sf_dir).select(
        "ticket_id", "predicted", "actual_category", "stated_correct",
        classification_correct(F.col("predicted"), F.col("actual_category"),
                               F.col("stated_correct")).alias("classification_correct"))


def loose_fields(spark, sf_dir):
    """Text fields of feedback coerced in every way a form field can be."""
    given = bridge.feedback(spark, sf_dir)
    return given.select(
        "feedback_id", safe_float(F.col("rating"), -1.0).alias("rating_float"),
        safe_int(F.col("ticket_id"), -1).alias("ticket_int"),
        truth(F.col("resolved"), "resolved").alias("as_resolved"),
        truth(F.col("resolved"), "human").alias("as_human"),
        truth(F.col("resolved"), "api_human").alias("as_api_human"),
        truth(F.col("rating"), "correct").alias("as_correct"),
        is_blank(F.col("rating")).alias("blank_rating"),
        percent(safe_float(F.col("rating")) / 5.0).alias("rating_percent"))


# --- cleaning and profiles ---------------------------------------------------

def clean_documents(spark, sf_dir):
    raw = bridge.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("Customer Name"), F.col("source").alias("Customer Email"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("Ticket Subject"),
        F.col("text").alias("Ticket Description"),
        F.when(F.col("lang") != "en", F.upper("source")).alias("Resolution"),
        F.col("lang").alias("Ticket Type"))
    cleaned = clean.training_text(clean.clean_customer_tickets(raw))
    return cleaned.select(*[
        F.col(f"`{name}`").alias(name.lower().replace(" ", "_")) for name in cleaned.columns])


def audit_records(spark, sf_dir):
    """Accepted and rejected tickets together: every turn, and a blank and an empty copy of it."""
    turns = bridge.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(
        F.array(F.col("text"), F.lit(" \t"), F.lit(None).cast("string"))).alias("description"))
    return clean.audit(*clean.split_required(turns))


def lowered_orders(spark, sf_dir):
    return clean.lower_description(
        bridge.table(spark, sf_dir, "orders"), "o_orderpriority").select(
        "o_orderkey", "o_orderpriority")


def rule_table_matches(spark, sf_dir):
    """One rule per document, its third and fourth word, against the texts of all documents."""
    docs = bridge.table(spark, sf_dir, "documents")
    words = F.split("text", " ")
    rules_given = docs.select(
        F.col("doc_id").alias("rule_ord"), F.lower(F.concat_ws(
            " ", F.get(words, F.lit(2)), F.get(words, F.lit(3)))).alias("keyword"),
        F.col("source").alias("label")).where(F.char_length("keyword") > 1)
    return rule_index.first_rules(docs.select("doc_id", "text"), "text", rules_given, "none").select(
        "doc_id", "rule_ord", "label")


def attempts_so_far(spark, sf_dir):
    """What each user had asked before each ticket."""
    return attempts.attempts_before(bridge.tickets(spark, sf_dir)).select(
        "employee_name", "ticket_id", "attempts", attempts.too_many().alias("too_many"))


def table_shape(spark, sf_dir):
    return profile.shape(bridge.table(spark, sf_dir, "orders"))


def null_counts(spark, sf_dir):
    return profile.null_counts(bridge.tickets(spark, sf_dir))


def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(
        bridge.table(spark, sf_dir, "documents").select("text", "lang", "source"))


def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(bridge.tickets(spark, sf_dir))


def value_counts(spark, sf_dir):
    return profile.value_counts(bridge.table(spark, sf_dir, "orders"), "o_orderpriority")


def low_cardinality_values(spark, sf_dir):
    return profile.low_cardinality_values(bridge.table(spark, sf_dir, "orders"))


def first_rows_per_category(spark, sf_dir):
    events = bridge.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return profile.first_per_group(events, "event_type", "event_id", 5).withColumn(
        "place", F.col("place").cast("bigint"))


def first_seen_values(spark, sf_dir):
    return profile.first_seen_values(
        bridge.table(spark, sf_dir, "events"), "user_id", "event_id")


# --- articles and retrieval --------------------------------------------------

def issues(spark, sf_dir):
    return bridge.tickets(spark, sf_dir).select(
        "ticket_id", rules.diagnosis(F.col("description")).alias("category"),
        F.col("description").alias("subcategory"), F.coalesce("impact", F.lit("")).alias("priority"))


def articles_from_tickets(spark, sf_dir):
    return build_articles(issues(spark, sf_dir), "ticket_id")


def article_total(spark, sf_dir):
    return article_count(articles_from_tickets(spark, sf_dir))


def document_terms(spark, sf_dir):
    """Per document: its terms, the sum of their weights and the heaviest term."""
    terms = tfidf_terms(bridge.table(spark, sf_dir, "documents"), "doc_id", "text")
    rounded = F.round("weight", 9)
    return terms.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("count").alias("n_tokens"),
        F.round(F.sum("weight"), SCORE_DIGITS).alias("total_weight"),
        F.min(F.struct(-rounded, F.col("term"))).alias("_top")).select(
        "doc_id", "n_terms", "n_tokens", "total_weight", F.col("_top.term").alias("top_term"))


def frequent_terms(spark, sf_dir):
    """The 5000 most frequent single words of the corpus, as a classifier would keep them."""
    terms = tfidf_terms(bridge.table(spark, sf_dir, "documents"), "doc_id", "text",
                        max_terms=5000, bigrams=False)
    return terms.groupBy("term").agg(
        F.sum("count").alias("total"), F.max("df").alias("df"),
        F.round(F.max("weight"), SCORE_DIGITS).alias("max_weight"))


def retrieve_topk(spark, sf_dir):
    index = fit_index(bridge.document_articles(spark, sf_dir))
    hits = search(bridge.benchmark_queries(spark, sf_dir), index, "ticket_id", "description", 3)
    return hits.select("ticket_id", "id", F.round("score", SCORE_DIGITS).alias("score"),
                       F.col("rank").cast("bigint").alias("rank"))


def agent_best_article(spark, sf_dir):
    index = fit_index(bridge.document_articles(spark, sf_dir))
    best = best_article(bridge.spoken_turns(spark, sf_dir), index, "ticket_id", "description")
    return best.select(
        "ticket_id", "id", F.round("similarity", SCORE_DIGITS).alias("similarity"))


def retrieval_evaluation(spark, sf_dir):
    index = fit_index(bridge.document_articles(spark, sf_dir))
    return evaluation.evaluate_retrieval(
        bridge.labelled_reports(spark, sf_dir), index, "ticket_id", "description", "category",
        "subcategory")


def retrieval_accuracy(spark, sf_dir):
    return evaluation.accuracy(materialise(retrieval_evaluation(spark, sf_dir), "evaluation"))


def resolution_steps(spark, sf_dir):
    stepped = bridge.stepped_articles(spark, sf_dir)
    resolution = decide.resolution_record(F.col("article"))
    return stepped.select(
        "ticket_id", resolution.alias("resolution"),
        decide.answer_steps(F.col("article.content")).alias("answer")).select(
        "ticket_id", F.col("resolution.response").alias("response"),
        F.array_join("resolution.steps", "|").alias("steps"),
        F.size("resolution.steps").cast("bigint").alias("n_steps"),
        F.array_join("answer", "|").alias("answer_steps"))


# --- triage ------------------------------------------------------------------

def support_index(spark, sf_dir):
    """The index of the support articles: the twelve short ones and all documents."""
    return fit_index(bridge.support_articles(spark, sf_dir))


def topic_classifier(spark, sf_dir):
    """(model, version): trained on all tickets of known category, published and loaded again."""
    known = bridge.tickets(spark, sf_dir).where("actual_category != ''").select(
        "description", "actual_category")
    folder = new_folder(spark, "models")
    model.publish(model.train_classifier(known, "description", "actual_category"), folder,
                  known.count())
    return model.latest(spark, folder)


def answers_for(index):
    """What tickets are told, with the texts of the external scorer.

    Hits and prompts depend on the text alone, so they are made once for each text.
    """
    def given(tickets):
        texts = triage.asked_texts(tickets)
        hits = answers.collect_hits(
            search(texts, index, "text_id", "description", 3), index, "text_id")
        told = materialise(
            answers.prompts(texts, hits, "text_id", "description").drop("text_id", "prompt"),
            "prompts")
        prompted = triage.by_text(tickets.select("ticket_id", "description"), told)
        return answers.outcomes(prompted, bridge.generated_answers(tickets), "ticket_id")
    return given


def validate_escalate(spark, sf_dir):
    index = support_index(spark, sf_dir)
    given = triage.classify_by_rules(bridge.tickets(spark, sf_dir))
    conditions = [F.col(f"escalation.conditions.{name}").alias(name) for name in (
        "critical_priority", "low_confidence", "validation_failed", "resolution_failed",
        "customer_requested_human", "repeated_attempts")]
    return triage.agent_triage(given, index).select(
        "ticket_id", F.col("diagnosis.category").alias("diagnosis"),
        F.col("retrieval.article.id").alias("article_id"),
        F.round("retrieval.similarity", SCORE_DIGITS).alias("similarity"),
        F.array_join("resolution.steps", "|").alias("steps"),
        F.round("validation.confidence", SCORE_DIGITS).alias("confidence"),
        F.col("validation.status").alias("status"),
        F.col("escalation.escalate").alias("escalate"),
        F.col("escalation.message").alias("message"),
        F.array_join("escalation.reasons", "; ").alias("reasons"), *conditions)


def submitted(spark, sf_dir):
    """All tickets through the classifier, search, answers and the agent chain."""
    index = support_index(spark, sf_dir)
    tickets = triage.classify(bridge.tickets(spark, sf_dir), *topic_classifier(spark, sf_dir))
    return triage.submit(tickets, index, answers_for(index)(tickets))


def triage_end_to_end(spark, sf_dir):
    return submitted(spark, sf_dir).select(
        "ticket_id", F.col("predicted").alias("category"), "model_version", "severity", "priority", "status",
        "kb_found", "ai_resolved", "resolution_success", "resolution_failed",
        "classification_correct", "escalated", "escalation_status", "escalation_reason",
        "resolution", F.array_join("resolution_steps", "|").alias("steps"),
        F.round("validation_confidence", 4).alias("validation_confidence"),
        F.size("sources").cast("bigint").alias("n_sources"),
        F.round("ai_response_time", SCORE_DIGITS).alias("ai_response_time"))


def ticket_scorecards(spark, sf_dir):
    return triage.scorecard(submitted(spark, sf_dir))


def triage_metrics(spark, sf_dir):
    """Dashboard numbers of the triage's own output, per severity."""
    done = triage.store(submitted(spark, sf_dir))
    rows = triage.metric_rows(done).join(
        triage.ticket_rows(done).select("ticket_id", "severity"), "ticket_id")
    return metrics.metric_summary(rows, ["severity"], 4)


def answer_prompts(spark, sf_dir):
    index = support_index(spark, sf_dir)
    tickets = bridge.tickets(spark, sf_dir)
    hits = answers.collect_hits(
        search(tickets, index, "ticket_id", "description", 3), index, "ticket_id")
    listed = F.transform("sources", lambda source: F.concat_ws(
        "/", source["id"].cast("string"), source["title"], source["category"],
        source["subcategory"], F.format_string("%.4f", source["score"])))
    return answers.prompts(tickets, hits, "ticket_id", "description").select(
        "ticket_id", "query", F.col("n_hits").cast("bigint").alias("n_hits"), "context",
        F.array_join(listed, "; ").alias("sources"), "prompt")


def answer_outcomes(spark, sf_dir):
    index = fit_index(bridge.document_articles(spark, sf_dir))
    asked = bridge.benchmark_queries(spark, sf_dir)
    hits = answers.collect_hits(
        search(asked, index, "ticket_id", "description", 3), index, "ticket_id")
    prompted = answers.prompts(asked, hits, "ticket_id", "description")
    done = answers.outcomes(
        prompted, answers.fold_attempts(bridge.attempt_log(asked), "ticket_id"), "ticket_id")
    stages = ["ticket_analysis", "knowledge_retrieval", "context_augmentation",
              "resolution_generation"]
    return done.select(
        "ticket_id", "resolution", "query", *[
            F.col(f"workflow.{name}.{part}").alias(f"{name}_{part}")
            for name in stages for part in ("status", "message")],
        F.col("workflow.knowledge_retrieval.articles_found").cast("bigint")
        .alias("articles_found"),
        F.col("workflow.resolution_generation.attempts").cast("bigint").alias("attempts"),
        F.col("workflow.resolution_generation.error").alias("error"))


def escalation_outbox(spark, sf_dir):
    index = support_index(spark, sf_dir)
    given = triage.classify_by_rules(bridge.tickets(spark, sf_dir))
    chained = triage.agent_triage(given, index).withColumnRenamed(
        "resolution", "agent_resolution")
    # What a tracker offers: one priority of the same name, no "Low".
    offered = spark.createDataFrame(
        [("1", "Highest"), ("2", "High"), ("3", "Medium"), ("20", "P2")],
        "id string, name string")
    return outbox.escalation_outbox(chained, offered)


def notice_outbox(spark, sf_dir):
    return outbox.notice_outbox(submitted(spark, sf_dir))


# --- dashboard ---------------------------------------------------------------

def leveled_tickets(spark, sf_dir):
    return triage.classify_by_rules(bridge.tickets(spark, sf_dir)).withColumn(
        "category", F.col("predicted"))


def dashboard_summary(spark, sf_dir):
    return metrics.dashboard(
        leveled_tickets(spark, sf_dir), bridge.metrics(spark, sf_dir))


def dashboard_by_day(spark, sf_dir):
    by_day = bridge.metrics(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    return metrics.metric_summary(by_day, ["day"], 4).withColumn("day", day_text("day"))


def ticket_counts_by_department(spark, sf_dir):
    named = clean.fill_defaults(leveled_tickets(spark, sf_dir), {"department": "IT"})
    return metrics.ticket_counts(named, ["department"])


def weekly_volume(spark, sf_dir):
    tickets = bridge.tickets(spark, sf_dir)
    last = tickets.agg(F.max("created_at")).scalar()
    return metrics.weekly_volume(tickets, last).withColumn("day", day_text("day"))


def recent_tickets(spark, sf_dir):
    return metrics.recent_tickets(leveled_tickets(spark, sf_dir)).withColumn(
        "created_at", time_text("created_at"))


def live_ticket_metrics(spark, sf_dir):
    return metrics.live_ticket_metrics(bridge.metrics(spark, sf_dir))


def live_feedback_metrics(spark, sf_dir):
    return live.feedback_metrics(bridge.feedback(spark, sf_dir))


def classification_report(spark, sf_dir):
    given = bridge.tickets(spark, sf_dir).withColumn("predicted", F.lower("predicted"))
    return classification.classification_report(given, "actual_category", "predicted")


# --- feedback ----------------------------------------------------------------

def feedback_parse(spark, sf_dir):
    return feedback.parse_feedback(bridge.feedback(spark, sf_dir)).drop("feedback_ts")


def feedback_targets(spark, sf_dir):
    return feedback.feedback_targets(
        feedback.accepted_feedback(bridge.feedback(spark, sf_dir)),
        bridge.metrics(spark, sf_dir)).select("feedback_id", "resolved", "rating", "metric_id")


def feedback_applied(spark, sf_dir):
    """Ratings and states of all tickets after all feedback."""
    tickets, rated = feedback.apply_feedback(
        bridge.feedback(spark, sf_dir), bridge.tickets(spark, sf_dir),
        bridge.metrics(spark, sf_dir))
    return tickets.select("ticket_id", "status").join(
        rated.select("ticket_id", "metric_id", "customer_rating"), "ticket_id")


def latest_ticket_metrics(spark, sf_dir):
    """Latest record per user, each user standing for a ticket with many records."""
    events = bridge.table(spark, sf_dir, "events")
    many = bridge.metrics_of(events).drop("ticket_id").join(
        events.select((F.col("event_id") + 1).alias("metric_id"),
                      F.col("user_id").alias("ticket_id")), "metric_id")
    return feedback.latest_metrics(many).select(
        "ticket_id", "metric_id", "escalated", "customer_rating")


# --- samples and model -------------------------------------------------------

def balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(
        bridge.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 10)


def stratified_split(spark, sf_dir):
    return sampling.stratified_split(
        bridge.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


def train_classifier(spark, sf_dir):
    """Train on 80 % of the documents, save, reload and report on the rest."""
    parts = materialise(sampling.stratified_split(
        bridge.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "lang",
        "doc_id"), "split")
    fitted = model.train_classifier(
        parts.where(F.col("part") == "train"), "text", "lang")
    path = new_folder(spark, "classifier")
    model.save_classifier(fitted, path)
    tested = model.predict(
        parts.where(F.col("part") == "test"), model.load_classifier(path), "text")
    return classification.classification_report(tested, "lang", "predicted", 4)


def train_by_tables(spark, sf_dir):
    """The same with the vocabulary as a table; whether the rest is told well enough."""
    parts = materialise(sampling.stratified_split(
        bridge.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "lang",
        "doc_id"), "split")
    path = new_folder(spark, "text-classifier")
    text_model.TextClassifier.fit(
        parts.where(F.col("part") == "train"), "doc_id", "text", "lang",
        max_iterations=100).save(path)
    tested = text_model.TextClassifier.load(spark, path).predict(
        parts.where(F.col("part") == "test"), "doc_id", "text")
    return tested.agg(
        F.count("*").alias("n_tested"),
        (F.avg((F.col("predicted") == F.col("lang")).cast("double")) >= 0.9).alias("told"))


# --- streams -----------------------------------------------------------------

def event_stream(spark, sf_dir):
    schema = bridge.table(spark, sf_dir, "events").schema
    # As a pattern the path may be one file or a folder of files.
    return runs.file_stream(spark, f"{sf_dir}/[e]vents.parquet", schema)


def stream_ticket_metrics(spark, sf_dir):
    records = bridge.metrics_of(event_stream(spark, sf_dir))
    return runs.run_to_table(live.ticket_metrics(records), "complete")


def stream_feedback_metrics(spark, sf_dir):
    given = bridge.feedback_of(event_stream(spark, sf_dir))
    return runs.run_to_table(live.feedback_metrics(given), "complete")


def stream_volume(spark, sf_dir):
    volume = live.volume(bridge.tickets_of(event_stream(spark, sf_dir)))
    return runs.run_to_table(volume, "complete").withColumn("day", day_text("day"))


def stream_repeated_attempts(spark, sf_dir):
    attempts = live.repeated_attempts(bridge.tickets_of(event_stream(spark, sf_dir)))
    return runs.run_to_table(attempts, "update", ["employee_name"])


def stream_attempts_so_far(spark, sf_dir):
    """The same from a stream that is stopped twice and goes on with what came later."""
    events = bridge.table(spark, sf_dir, "events")
    parts, state, found = (new_folder(spark, name) for name in ("events", "stream-state", "found"))
    cuts = events.select(F.percentile_approx("ts", [1 / 3, 2 / 3]).alias("cuts"))
    thirds = events.join(F.broadcast(cuts)).withColumn("part", (
        F.col("ts") > F.get("cuts", F.lit(0))).cast("int") + (
        F.col("ts") > F.get("cuts", F.lit(1))).cast("int")).drop("cuts")
    for part in range(3):
        thirds.where(F.col("part") == part).drop("part").write.mode("append").parquet(parts)
        counted = attempts.stream_attempts(bridge.tickets_of(
            runs.file_stream(spark, parts, events.schema)))
        runs.run_available(counted, runs.batch_writer(found), checkpoint=state)
    return spark.read.schema(counted.schema).parquet(found).drop("batch").withColumn(
        "too_many", attempts.too_many())


def stream_submissions(spark, sf_dir):
    """Tickets submitted in three batches, one of them replayed; the stored tables, read back."""
    events = bridge.table(spark, sf_dir, "events")
    parts = new_folder(spark, "events")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(parts)
    index = support_index(spark, sf_dir)
    ledger = Ledger(spark, new_folder(spark, "submissions"), "submit").open()
    handle = upserts.submission_batches(
        index, *topic_classifier(spark, sf_dir), answers_for(index), ledger)

    def twice(batch, batch_id):
        handle(batch, batch_id)
        if batch_id == 1:
            handle(batch, batch_id)

    runs.run_available(bridge.tickets_of(runs.file_stream(spark, parts, events.schema, 1)), twice)
    stored = ledger.read("tickets", schemas.TICKETS)
    rows = ledger.read("metrics", schemas.METRICS)
    return stored.select("ticket_id", "description", "category", "model_version", "severity",
                         "priority", "status", "employee_name", "department").join(
        rows.select("ticket_id", "ai_resolved", "resolution_success", "kb_found",
                    "classification_correct", "escalated", "customer_rating",
                    F.round("resolution_time", SCORE_DIGITS).alias("resolution_time"),
                    F.round("ai_response_time", SCORE_DIGITS).alias("ai_response_time")),
        "ticket_id", "full")


def stream_triage(spark, sf_dir):
    index = support_index(spark, sf_dir)
    path = new_folder(spark, "triaged")
    stream = triage.classify_by_rules(bridge.tickets_of(event_stream(spark, sf_dir)))
    runs.run_available(stream, upserts.triage_batches(index, path))
    return spark.read.parquet(path).select(
        "ticket_id", "diagnosis", "article_id",
        F.round("similarity", SCORE_DIGITS).alias("similarity"), "validation_status",
        "escalate")


def stream_feedback(spark, sf_dir):
    """Feedback stream applied to stored tables, rewriting only affected days.

    The feedback comes in three files, one per batch, in no order of time.
    """
    tickets_path, metrics_path = new_folder(spark, "tickets"), new_folder(spark, "metrics")
    tables.append_rows(bridge.tickets(spark, sf_dir), tickets_path)
    tables.append_rows(bridge.metrics(spark, sf_dir).withColumn(
        "rating_mark", F.lit(None).cast("struct<feedback_ts: timestamp_ntz, feedback_id: bigint>")),
        metrics_path)
    events = bridge.table(spark, sf_dir, "events")
    parts = new_folder(spark, "events")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(parts)
    given = bridge.feedback_of(runs.file_stream(spark, parts, events.schema, 1))
    marks = new_folder(spark, "metric-marks")
    stored = spark.read.parquet(metrics_path)
    feedback.extend_marks(stored.where("metric_id % 2 = 0"), marks)
    feedback.extend_marks(stored.where("metric_id % 2 = 1"), marks)
    runs.run_available(given, upserts.feedback_batches(
        spark, tickets_path, metrics_path, marks_path=marks))
    return spark.read.parquet(tickets_path).select("ticket_id", "status").join(
        spark.read.parquet(metrics_path).select("ticket_id", "metric_id", "customer_rating"),
        "ticket_id")


# --- sources and sinks -------------------------------------------------------

def csv_round_trip(spark, sf_dir):
    """Tickets written as CSV and read back with an explicit schema."""
    path = new_folder(spark, "tickets-csv")
    documents = bridge.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tables.write_csv(documents, path)
    return tables.read_csv(spark, path, documents.schema, multi_line=True)


def article_round_trip(spark, sf_dir):
    path = new_folder(spark, "articles-json")
    tables.write_articles(articles_from_tickets(spark, sf_dir), path)
    return tables.read_article_lines(spark, path)


def table_append(spark, sf_dir):
    """Three appends to a day-partitioned table, one all refused, then a full scan per day."""
    path = new_folder(spark, "appended")
    given = leveled_tickets(spark, sf_dir)
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    tables.append_tickets(given, path)
    tables.append_tickets(given.drop("department", "employee_name", "status"), path)
    refused = tables.append_tickets(
        given.withColumn("description", F.lit(None).cast("string")), path).groupBy(day).agg(
        F.count("*").alias("n_refused"))
    stored = tables.read_table(spark, path, schemas.TICKETS)
    return stored.groupBy(day, "status", "department").agg(
        F.count("*").alias("n"), F.count_distinct("ticket_id").alias("n_tickets")).join(
        refused, "day", "left")


def metric_append(spark, sf_dir):
    path = new_folder(spark, "appended-metrics")
    unreadable = F.when(F.col("metric_id") % 11 == 0, "abc").otherwise(
        F.col("ai_response_time").cast("string"))
    tables.append_metrics(bridge.metrics(spark, sf_dir).drop("kb_found").withColumn(
        "ai_response_time", unreadable), path)
    stored = tables.read_table(spark, path, schemas.METRICS)
    return metrics.metric_summary(stored, digits=4)


def schema_evolution(spark, sf_dir):
    """An old table without the employee columns, stacked with a new one."""
    given = bridge.tickets(spark, sf_dir)
    old = tables.add_columns(
        given.select("ticket_id", "status"), {"employee_name": "string", "status": "string"})
    stacked = tables.stack_tables([
        old, given.select("ticket_id", "status", "employee_name", "department")])
    return stacked.groupBy("department").agg(
        F.count("*").alias("n"), F.count("employee_name").alias("n_named"))


def day_summaries(spark, sf_dir):
    """Summaries of the tickets, stored by day, the later days in a second go."""
    path = new_folder(spark, "summaries")
    given = bridge.tickets(spark, sf_dir)
    late = F.dayofmonth("created_at") > 15
    for rows in (given.where(~late), given.where(late)):
        summaries.summarise(rows, F.to_date("created_at")).write.mode("append").parquet(path)
    return spark.read.schema(summaries.SUMMARY).parquet(path)


def stored_summaries(spark, sf_dir):
    """The values of the tickets' columns with few, from the summaries of all days."""
    return summaries.merged_values(day_summaries(spark, sf_dir))


def distinct_estimates(spark, sf_dir):
    """Whether the merged sketches tell each column's distinct values within five percent."""
    exact = profile.distinct_counts(bridge.tickets(spark, sf_dir))
    return summaries.merged_counts(day_summaries(spark, sf_dir)).withColumnRenamed(
        "n_distinct", "_about").join(exact, "column_name").select(
        "column_name", "n_rows", "n_distinct",
        (F.abs(F.col("_about") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct"))
        .alias("is_close"))


def column_list(spark, sf_dir):
    return profile.column_names(bridge.table(spark, sf_dir, "orders"))


def head_rows(spark, sf_dir):
    return profile.first_rows(bridge.table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderpriority")


def json_array_read(spark, sf_dir):
    """All documents as articles, written as one JSON array, read back in splits.

    The array is written by ranges of the ids: its files, by name, are one array from "[" to "]".
    """
    path = new_folder(spark, "article-array")
    articles = bridge.document_articles(spark, sf_dir)
    low, high = articles.agg(F.min("id"), F.max("id")).first()
    row = F.to_json(F.struct(*[F.col(name) for name in schemas.ARTICLES.names]))
    lines = articles.repartitionByRange("id").sortWithinPartitions("id").select(F.concat(
        F.when(F.col("id") == low, "[\n").otherwise(""), row,
        F.when(F.col("id") == high, "\n]").otherwise(",")).alias("value"))
    lines.write.text(path)
    return tables.read_articles(spark, path)


def stored_evolution(spark, sf_dir):
    """Tickets stored before a column came and while types were narrower, read with later ones."""
    old, new = new_folder(spark, "tickets-old"), new_folder(spark, "tickets-new")
    given = bridge.tickets(spark, sf_dir)
    given.select(F.col("ticket_id").cast("int").alias("ticket_id"), "status",
                 F.col("repeated_attempts").cast("smallint").alias("repeated_attempts"),
                 F.to_date("created_at").alias("created_at")).write.parquet(old)
    given.select(F.col("ticket_id") + (1 << 33), "status", "department", "repeated_attempts",
                 "created_at").toDF("ticket_id", "status", "department", "repeated_attempts",
                                    "created_at").write.parquet(new)
    return tables.read_evolved(spark, [old, new]).groupBy("department").agg(
        F.count("*").alias("n"), F.max("ticket_id").alias("last_ticket"),
        F.sum("repeated_attempts").alias("attempts"),
        F.count("created_at").alias("n_dated"))


def probed_accuracy(spark, sf_dir):
    """Accuracy from the first usable of three places: absent, without a verdict, usable."""
    verdicts = bridge.table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 7 != 0).cast("int").alias("Retrieval_Correct"))
    paths = [new_folder(spark, f"evaluation-{place}") for place in range(3)]
    verdicts.drop("Retrieval_Correct").write.parquet(paths[1])
    verdicts.write.parquet(paths[2])
    return tables.retrieval_accuracy(tables.first_evaluation(spark, paths))


def stored_accuracy(spark, sf_dir):
    """Accuracy from a stored text column with flags that are not always numbers."""
    verdict = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).when(
        F.col("event_id") % 3 == 0, F.lit("0")).otherwise(F.lit("1"))
    return tables.retrieval_accuracy(
        bridge.table(spark, sf_dir, "events").select("event_id", verdict.alias("Is_Correct")))


REGISTERED: list[Query] = [
    ticket_severity_priority, ticket_diagnosis, conversation_diagnosis,
    rule_table_matches, attempts_so_far, stream_attempts_so_far, json_array_read,
    stored_evolution, probed_accuracy, stored_summaries, distinct_estimates, column_list,
    head_rows, classification_correctness, loose_fields, clean_documents, audit_records, lowered_orders,
    table_shape, null_counts, duplicate_rows, distinct_counts, value_counts,
    low_cardinality_values, first_rows_per_category, first_seen_values, articles_from_tickets,
    article_total, document_terms, frequent_terms, retrieve_topk, agent_best_article,
    retrieval_evaluation, retrieval_accuracy, resolution_steps, validate_escalate,
    triage_end_to_end, ticket_scorecards, triage_metrics, answer_prompts, answer_outcomes,
    escalation_outbox, notice_outbox, dashboard_summary, dashboard_by_day,
    ticket_counts_by_department, weekly_volume, recent_tickets, live_ticket_metrics,
    live_feedback_metrics, classification_report, feedback_parse, feedback_targets,
    feedback_applied, latest_ticket_metrics, balanced_sample, stratified_split,
    train_classifier, train_by_tables, stream_ticket_metrics, stream_feedback_metrics, stream_volume,
    stream_repeated_attempts, stream_submissions, stream_triage, stream_feedback, csv_round_trip,
    article_round_trip, table_append, metric_append, schema_evolution, stored_accuracy,
]
QUERIES: dict[str, Query] = {query.__name__: query for query in REGISTERED}
