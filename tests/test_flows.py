import datetime as dt
import json

from pyspark.sql import functions as F

from ticketloom.operators import model
from ticketloom.operators.tfidf import fit_index
from ticketloom.plans import bridge, queries, triage
from ticketloom.sources import schemas, tables
from ticketloom.streaming import live, runs, upserts


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_triage_invariants(spark, sf_dir):
    done = triage.store(queries.submitted(spark, sf_dir))
    n = bridge.tickets(spark, sf_dir).count()
    assert done.count() == n == done.select("ticket_id").distinct().count()
    assert done.where("escalated = ai_resolved").isEmpty()
    assert done.where("resolution_success and not ai_resolved").isEmpty()
    assert done.where("retrieval.similarity < 0 or retrieval.similarity > 1").isEmpty()
    assert done.where("escalated").where(
        "(escalation_reason is null) and not escalation.escalate").isEmpty()
    found = done.where("retrieval.article is not null")
    assert 0 < found.count() < n
    scores = triage.scorecard(done)
    assert scores.where("article_count * 100 != retrieval_accuracy").isEmpty()
    assert triage.ticket_rows(done).where("status not in ('Escalated', 'AI Resolved')").isEmpty()


def test_outbox_payload_is_json(spark, sf_dir):
    sent = queries.escalation_outbox(spark, sf_dir).where("success").limit(5).collect()
    for row in sent:
        fields = json.loads(row["payload"])["fields"]
        assert fields["priority"]["id"] == row["tracker_id"]
        assert fields["description"]["content"][0]["content"][0]["text"] == row["description"]


def test_streams_equal_batch(spark, sf_dir):
    for stream, batch in [
            (queries.stream_ticket_metrics, queries.live_ticket_metrics),
            (queries.stream_feedback_metrics, queries.live_feedback_metrics),
            (queries.stream_feedback, queries.feedback_applied)]:
        one, two = stream(spark, sf_dir), batch(spark, sf_dir)
        assert rows_of(one.select(sorted(one.columns))) == rows_of(two.select(sorted(two.columns)))


def test_stream_in_several_batches(spark, sf_dir, tmp_path):
    """Attempts counted over many files, in update mode, equal the batch counts."""
    events = bridge.table(spark, sf_dir, "events")
    events.repartitionByRange(5, "event_id").write.parquet(str(tmp_path / "events"))
    stream = runs.file_stream(spark, str(tmp_path / "events"), events.schema, 1)
    got = runs.run_to_table(
        live.repeated_attempts(bridge.tickets_of(stream)), "update", ["employee_name"])
    assert rows_of(got) == rows_of(live.repeated_attempts(bridge.tickets_of(events)))


def test_triage_stream_repeats_safely(spark, sf_dir, tmp_path):
    index = fit_index(bridge.short_articles(spark))
    handle = upserts.triage_batches(index, str(tmp_path / "out"))
    batch = triage.classify_by_rules(bridge.tickets(spark, sf_dir))
    handle(batch, 0)
    handle(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_feedback_rewrites_only_affected_days(spark, tmp_path):
    days = [dt.datetime(2024, 1, d, 9) for d in (1, 2, 3)]
    tickets = spark.createDataFrame(
        [(i + 1, "Open", day) for i, day in enumerate(days)],
        "ticket_id long, status string, created_at timestamp_ntz")
    records = spark.createDataFrame(
        [(i + 1, i + 1, None, day) for i, day in enumerate(days)],
        "metric_id long, ticket_id long, customer_rating double, created_at timestamp_ntz")
    paths = [str(tmp_path / name) for name in ("tickets", "metrics")]
    tables.append_rows(tickets, paths[0])
    tables.append_rows(records, paths[1])
    files = {f for path in paths for f in spark.read.parquet(path).inputFiles()}
    given = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 5), "2", "yes", "4")],
        "feedback_id long, feedback_ts timestamp_ntz, ticket_id string, resolved string, "
        "rating string")
    upserts.feedback_batches(spark, *paths)(given, 0)
    after = {f for path in paths for f in spark.read.parquet(path).inputFiles()}
    assert len(files & after) == 4 and len(after - files) == 2
    assert spark.read.parquet(paths[0]).where("ticket_id = 2").first()["status"] == (
        "Customer Resolved")
    assert spark.read.parquet(paths[1]).where("ticket_id = 2").first()["customer_rating"] == 4.0


def test_model_learns_saves_and_reloads(spark, tmp_path):
    rows = [(i, f"{'printer paper tray' if i % 2 else 'vpn tunnel gateway'} number {i}",
             "Hardware" if i % 2 else "Network") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    fitted = model.train_classifier(df, "text", "label")
    model.save_classifier(fitted, str(tmp_path / "model"))
    again = model.load_classifier(str(tmp_path / "model"))
    asked = spark.createDataFrame([(1, "The PRINTER tray"), (2, "a vpn gateway"), (3, None)],
                                  "id long, text string")
    got = {r["id"]: r["predicted"] for r in model.predict(asked, again, "text").collect()}
    assert (got[1], got[2]) == ("Hardware", "Network") and got[3] in ("Hardware", "Network")
    assert {r["predicted"] for r in model.predict(asked, None, "text").collect()} == {"Unknown"}


def test_old_articles_get_empty_fields(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text(json.dumps([{"id": 1, "title": "T", "content": "line\nbreak"}], indent=2))
    row = tables.read_articles(spark, str(path)).first()
    assert (row["category"], row["subcategory"], row["title"]) == ("", "", "T")
    assert row["content"] == "line\nbreak"


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "quoted", text\nwith break'), (2, None)], "id long, text string")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert rows_of(tables.read_csv(spark, str(tmp_path / "csv"), df.schema, True)) == rows_of(df)


def test_defaults_and_new_columns(spark, tmp_path):
    old = spark.createDataFrame([(1, "x")], "ticket_id long, description string")
    tables.append_tickets(old, str(tmp_path / "t"))
    row = tables.read_table(spark, str(tmp_path / "t"), schemas.TICKETS).first()
    assert (row["status"], row["employee_name"], row["department"]) == ("Open", "Unknown", "IT")
    assert row["created_at"] is not None and row["category"] is None
    widened = tables.add_columns(old, {"department": "string", "description": "string"})
    assert widened.columns == ["ticket_id", "description", "department"]


def test_accuracy_reader(spark):
    def read(rows, name="accuracy"):
        return tables.retrieval_accuracy(spark.createDataFrame(
            [(r,) for r in rows], f"`{name}` string")).first()["retrieval_accuracy"]

    assert read(["1", "0", "x", None]) == 50.0
    assert read(["80", "91"]) == 85.5
    assert read(["1"], "other") is None
    flags = spark.createDataFrame([(True,), (False,), (True,)], "Correct boolean")
    assert tables.retrieval_accuracy(flags).first()["retrieval_accuracy"] == 66.67


def test_late_volume_in_append_mode_is_a_part_of_the_whole(spark, sf_dir):
    tickets = bridge.tickets_of(queries.event_stream(spark, sf_dir))
    closed = runs.run_to_table(live.volume(tickets), "append")
    every = queries.stream_volume(spark, sf_dir).withColumn("day", F.to_date("day"))
    assert closed.exceptAll(every).isEmpty() and closed.count() <= every.count()
