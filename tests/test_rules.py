import pytest
from pyspark.sql import functions as F

from ticketloom.functions import coercion, decide, rules, text


def column(spark, values, build, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(build(F.col("v"))).collect()]


def test_severity(spark):
    cases = {
        "The entire company system is down": "Critical",
        "The network is down and multiple users cannot work": "High",
        "My computer is not working properly": "Medium",
        "How do I change my software settings?": "Low",
        "The network is down": "Low",  # "network down" is another phrase
        "RANSOMWARE on my disk, urgent": "Critical",
        None: "Low", "": "Low",
    }
    assert column(spark, cases, rules.severity) == list(cases.values())


def test_priority(spark):
    rows = [("Critical", "Organization-wide", "P1"), ("High", "Single user", "P2"),
            ("Low", "Multiple Users", "P2"), ("Medium", "", "P3"), ("Low", "limited users", "P3"),
            ("Low", "Single user", "P4"), ("Critical", "", "P4"), ("High", None, "P4")]
    frame = spark.createDataFrame(rows, "severity string, impact string, wanted string")
    got = frame.select(rules.priority(F.col("severity"), F.col("impact")), "wanted").collect()
    assert all(row[0] == row[1] for row in got)


def test_diagnosis(spark):
    cases = {
        "My laptop touchpad is not responding.": "Hardware",
        "My VPN is not connecting": "VPN / Network",
        "reset my password": "Password / Access",
        "gmail lost my letters": "Email",
        "how to change settings": "Performance",  # "change" holds "hang"
        "an app quits": "Software", "nothing matches": "General IT Issue",
    }
    assert column(spark, cases, rules.diagnosis) == list(cases.values())


def test_article_content_uses_first_rule(spark):
    got = column(spark, ["Printer access denied", "Odd noise", "Dim display"],
                 rules.article_content)
    assert "Check that the printer is powered on" in got[0]
    assert got[0].startswith("This guide covers Printer access denied. ")
    assert "Begin by reproducing" in got[1]
    assert "display brightness" in got[2]


@pytest.mark.parametrize("raw, cleaned", [
    (None, ""), ("  Héllo, WORLD!! ", "héllo world"), ("a_b-c ", "a_bc"), ("...", ""),
])
def test_clean_text(spark, raw, cleaned):
    assert column(spark, [raw], text.clean_text) == [cleaned]


def test_joined_text_keeps_empty_places(spark):
    frame = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert frame.select(text.joined_text(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "a  c"


def test_words_and_bigrams(spark):
    frame = spark.createDataFrame([("The VPN, a vpn and the café x",), ("x",), ("",)], "v string")
    kept = frame.select(text.words("v", ["the", "and"]).alias("w"))
    got = [row[0] for row in kept.select(text.with_bigrams(F.col("w"))).collect()]
    assert got == [["vpn", "vpn", "café", "vpn vpn", "vpn café"], [], []]


def test_letter_words_are_whole_words(spark):
    assert column(spark, ["the café vpn1 abc d-ef ghi"], text.letter_words) == [
        ["the", "abc", "ghi"]]


def test_spelling_is_unified_in_order(spark):
    replaced = column(spark, ["Logged out, then LOG OUT on wi-fi"], lambda c:
                      text.unify_spelling(c, [("log out", "logout"), ("logged out", "logout")]))
    assert replaced == ["logout, then logout on wi-fi"]


def test_article_steps(spark):
    content = "Intro\n - one\n2. two\n3) three\n* \n-- four\n- 1. five\n- six\n- seven\n- eight"
    got = column(spark, [content, "no steps", None], decide.article_steps)
    assert got == [["one", "two", "three", "- four", "five", "six"], [], []]


def test_answer_steps(spark):
    got = column(spark, ["1. no\n12 yes\r\n- dash\n7\n* star\nplain"], decide.answer_steps)
    assert got == [["12 yes", "- dash", "7", "* star"]]


def test_ratings(spark):
    raw = ["", "null", None, "0", "6", "abc", "4.5", "5"]
    assert column(spark, raw, coercion.rating_accepted) == [
        True, True, True, False, False, False, True, True]
    assert column(spark, raw, coercion.rating_value)[-2:] == [4.5, 5.0]


def test_safe_numbers(spark):
    assert column(spark, ["4.5", "x", None, " 7 "], lambda c: coercion.safe_int(c, -1)) == [
        -1, -1, -1, 7]
    assert column(spark, ["4.5", "x", None], coercion.safe_float) == [4.5, 0.0, 0.0]


def test_true_words_depend_on_the_field(spark):
    assert column(spark, ["Human", "YES", "no", None], lambda c: coercion.truth(c, "human")) == [
        True, True, False, False]
    assert column(spark, ["human"], lambda c: coercion.truth(c, "api_human")) == [False]
    assert column(spark, ["", "null", "correct"], lambda c: coercion.optional_truth(
        c, "correct")) == [None, None, True]


def test_confidence_and_validation(spark):
    frame = spark.createDataFrame(
        [(0.0, 0, 32.0, "ESCALATE"), (0.45, 6, 70.0, "AUTO_RESOLVE"),
         (0.44, 6, 69.6, "ESCALATE"), (1.0, 9, 92.0, "AUTO_RESOLVE")],
        "sim double, n int, percent double, status string")
    steps = F.when(F.col("n") > 0, F.array_repeat(F.lit("s"), F.col("n"))).otherwise(
        F.array().cast("array<string>"))
    checked = frame.withColumn("v", decide.validation_record(
        decide.confidence(F.lit(0.8), F.col("sim"), steps)))
    for row in checked.collect():
        assert row["v"]["confidence_percentage"] == row["percent"]
        assert row["v"]["status"] == row["status"]


def test_escalation_reasons_keep_their_order(spark):
    frame = spark.createDataFrame([(0.5, " p1 ", True, False, 3), (0.9, "P4", False, False, 2)],
                                  "c double, p string, failed boolean, human boolean, n int")
    checked = frame.select(decide.escalation_record(
        decide.validation_record(F.col("c")), F.col("p"), F.col("failed"), F.col("human"),
        F.col("n")).alias("e")).collect()
    assert checked[0]["e"]["reasons"] == [
        "Critical priority ticket", "AI confidence below 70%",
        "Validation agent requested escalation", "Resolution attempt failed",
        "Repeated resolution attempts reached 3 or more"]
    assert checked[1]["e"]["escalate"] is False and checked[1]["e"]["reasons"] == []
