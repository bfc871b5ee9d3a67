"""Rule tables, JSON arrays in splits, evolving tables, probed tables, attempts so far."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.operators import attempts, rule_index
from ticketloom.plans import queries
from ticketloom.sources import tables
from ticketloom.sources.json_arrays import read_array, records


def plain_first(text, rules):
    fits = [(order, word, label) for order, word, label in rules
            if text is not None and word is not None and word in text.lower()]
    return min(fits)[::2] if fits else (None, "none")


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules_equal_testing_each_keyword(spark, broadcast, monkeypatch):
    rng = random.Random(4)
    letters = "abcé 🎉"
    rules = [(i, "".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 6]))), f"l{i % 7}")
             for i in range(300)] + [(900, None, "x"), (5000, "zzz", "never")]
    texts = ["".join(rng.choices(letters + "XYQ", k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(200)]
    texts += [None, "", "ZZZ", texts[0], texts[0]]
    if not broadcast:
        monkeypatch.setattr(rule_index, "fits_broadcast", lambda df: False)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame(rules, "rule_ord long, keyword string, label string")
    got = {r.id: (r.rule_ord, r.label) for r in rule_index.first_rules(df, "text", table, "none").collect()}
    assert got == {i: plain_first(text, rules) for i, text in enumerate(texts)}


def test_the_empty_keyword_fits_every_text(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id long, text string")
    table = spark.createDataFrame([(3, "", "all"), (1, "abc", "own")],
                                  "rule_ord long, keyword string, label string")
    got = {r.id: (r.rule_ord, r.label) for r in rule_index.first_rules(df, "text", table, "none").collect()}
    assert got == {1: (1, "own"), 2: (3, "all"), 3: (None, "none")}
    none = rule_index.first_rules(df, "text", table.limit(0), "none").collect()
    assert {(r.rule_ord, r.label) for r in none} == {(None, "none")}


def test_texts_with_a_rule_do_not_meet_the_later_ones(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "FIRST_WAVE", 4)
    monkeypatch.setattr(rule_index, "GROWTH", 3)
    met, fitting = [], rule_index.fitting
    monkeypatch.setattr(rule_index, "fitting", lambda texts, keyed, sizes: met.append(
        texts.count()) or fitting(texts, keyed, sizes))
    rules = [(i // 2, f"word {i}!", f"l{i}") for i in range(60)] + [(None, "nobody", "n")]
    table = spark.createDataFrame(rules, "rule_ord long, keyword string, label string")
    texts = [" ".join(f"Word {(i * k) % 60}!" for k in (1, 7, 11)) for i in range(1, 90)] + ["none"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.rule_ord, r.label)
           for r in rule_index.first_rules(df, "text", table, "none").collect()}
    assert got == {i: plain_first(text, rules[:-1]) for i, text in enumerate(texts)}
    assert len(met) > 2 and met == sorted(met, reverse=True) and met[-1] < met[0]


def test_ten_thousand_rules_are_looked_at_behind_their_rarest_piece(spark):
    words = spark.range(10_000).select(F.col("id").alias("rule_ord"), F.concat(
        F.lit("error code "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("keyword"),
        F.lit("x").alias("label"))
    texts = spark.range(500).select("id", F.concat(
        F.lit("An error code "), F.lpad((F.col("id") * 37 % 10_000).cast("string"), 5, "0"),
        F.lit(" came up")).alias("text"))
    got = rule_index.first_rules(texts, "text", words)
    assert got.where("rule_ord = id * 37 % 10000").count() == 500
    lowered = texts.select(F.lower("text").alias("_text"))
    keyed = rule_index.keyed_rules(lowered, words, [3])
    assert keyed.where("_piece in ('err', 'cod', 'de ')").isEmpty()


SCHEMA = T.StructType().add("id", "long").add("text", "string").add(
    "inner", T.StructType().add("a", "long").add("b", T.ArrayType(T.StringType())))


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ["700", "1"], strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_in_splits_equal_one_task(spark, tmp_path, small_splits, indent):
    rng = random.Random(8)
    marks = ['{', '}', '"', "\\", "},{", "\n", "a", "é", "[", "]", '\\"', " "]
    rows = [{"id": i, "text": "".join(rng.choices(marks, k=rng.randint(0, 40))),
             "inner": {"a": i, "b": ["}", "{\"", "x"][:i % 4]} if i % 5 else None}
            for i in range(300)]
    for place in range(2):
        (tmp_path / f"part{place}.json").write_text(
            json.dumps(rows[place::2], indent=indent, ensure_ascii=bool(place)), encoding="utf-8")
    path = str(tmp_path)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
    got = read_array(spark, path, SCHEMA).orderBy("id").collect()
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(path).orderBy("id").collect()
    assert got == want and [r.text for r in got] == [r["text"] for r in rows]
    numbers = records(spark, path).groupBy("file").agg(F.sort_array(F.collect_list("record"))).collect()
    assert [r[1] for r in numbers] == [list(range(150))] * 2


def test_the_written_array_is_one_over_several_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "new_folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read = queries.json_array_read(spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "article-array").glob("part-*"))
    assert len(files) > 1
    whole = json.loads("".join(file.read_text(encoding="utf-8") for file in files))
    assert [row["id"] for row in whole] == sorted(row.id for row in read.collect())


def test_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text("[ {} , {\"id\": 3}]\n")
    got = sorted(map(tuple, read_array(spark, str(tmp_path), SCHEMA).select("id").collect()), key=str)
    assert got == [(3,), (None,)]


def test_widened_columns(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.sql("select 1 a, cast(1.5 as float) b, date'2024-01-02' c, 'x' d").write.parquet(one)
    spark.sql("select 5000000000 a, 2.5d b, timestamp_ntz'2024-01-03 10:00:00' c, 7 e").write.parquet(two)
    rows = sorted(tables.read_evolved(spark, [one, two]).collect())
    assert [tuple(r) for r in rows] == [
        (1, 1.5, dt.datetime(2024, 1, 2), "x", None),
        (5_000_000_000, 2.5, dt.datetime(2024, 1, 3, 10), None, 7)]
    spark.sql("select 'text' a").write.parquet(str(tmp_path / "three"))
    with pytest.raises(ValueError, match="no type holds both"):
        tables.read_evolved(spark, [one, str(tmp_path / "three")])


def test_the_first_usable_evaluation_is_read(spark, tmp_path):
    names = [str(tmp_path / name) for name in ("absent", "other", "good", "later")]
    spark.sql("select 1 x").write.parquet(names[1])
    spark.sql("select 80.0d Accuracy").write.parquet(names[2])
    spark.sql("select 1 correct").write.parquet(names[3])
    assert tables.retrieval_accuracy(tables.first_evaluation(spark, names)).first()[0] == 80.0
    assert tables.first_evaluation(spark, names[:2]) is None


def test_attempts_of_a_hot_user_are_dealt_out_by_time(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("ticket_id"), F.when(F.col("id") % 3 > 0, "hot").when(
            F.col("id") % 7 > 0, F.col("id").cast("string")).alias("employee_name"),
        (F.timestamp_seconds(F.col("id") * 7919 % 500_000)).alias("created_at"))
    got = attempts.attempts_before(rows)
    want = rows.selectExpr("*", """row_number() over (partition by employee_name
        order by created_at, ticket_id) - 1 as attempts""")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "hashpartitioning(employee_name#" in plan and "_bucket" in plan
