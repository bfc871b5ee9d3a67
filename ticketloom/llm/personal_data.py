"""Personal data: patterns find seeds, and bootstrapped contexts find what patterns miss.

Four patterns find the base entities (email, ip, card, phone) of every text. They seed a
bootstrapped extraction:

  the two words before an entity are a lexical pattern of its kind, # for each word that holds
  a digit or @; they are built alike for entities and for other instances;
  every token with a digit in it is an instance, known or not yet known; behind patterns that
  count it gives way to the whole run up to the next blank, and to joined digit groups for
  kinds whose entities hold blanks;
  patterns and instances form a graph, an edge for each pair that occurs;
  in each of ROUNDS rounds a pattern scores the mean of its instances' scores for a kind
  (known entities have 1), and counts if it scores at least MIN_SCORE and its instances'
  scores add up to MIN_SUPPORT; an instance scores 1 - product(1 - score) over its patterns.

Instances that stand behind a pattern that counts in the end are found, too, unless they overlap
a base entity or are plain words; those count against a pattern only. Copies of a text add no weight: only distinct instances count.

All steps are built-in functions. Matches are marked in the text with a character that
no text can hold afterwards, and splitting there gives their places. Only short parts of texts with a digit or @ are
shuffled, by text, where a text's parts meet in one task; of all texts only what stands behind
patterns that count.

Edge cases: null and empty texts hold nothing; offsets are code points; rows are told
apart by id and a hash of their text, so repeated rows get equal results, and null ids
work; an empty table gives no rows; a text may hold any control character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators.skew import key_bits
from ticketloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: As in the contract, but written so that no start is tried in vain and nothing recurs:
#: possessive runs, and a start only where a run of the first class begins.
PATTERNS = (
    r"((?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    r"((?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
    r"([0-9](?:[\x20-]?[0-9])++)",
    r"(\+[0-9][\x20().0-9-]+[0-9])",
)
#: A token: a run of these characters with a digit in it.
TOKEN = r"((?<![\p{L}0-9@._%+-])[\p{L}@._%+-]*+[0-9][\p{L}0-9@._%+-]*+)"
#: Instances that are no entities: such tokens, runs up to the next blank, joined digit groups.
TOKEN_KIND, RUN_KIND, JOINED_KIND = range(len(KINDS), len(KINDS) + 3)
#: Joined digit groups, as in a phone number; a sentence's end parts them.
JOINED = r"^([(+]*+[0-9][0-9\x20().-]*+)"
MIN_JOINED = 7
END = r"(?<![\p{P}\p{S}])[\p{P}\p{S}]++$"
#: Texts are searched in blocks of so many characters and on to where no instance goes across.
BLOCK_CHARS = 2000
BLOCK = r"(?s)(.{1,%d}+.*?(?:(?<=\s)(?=[^\s0-9().-])|\z))"
#: Characters in a piece of a text that is masked.
PIECE = 1024
MARK, NO_MARK = "\x01", "\x02"
#: A word of a context ends before what follows blanks, and before letters that follow punctuation.
CUT = r"(?<=\s)(?=\S)|(?<=[^\s\p{L}0-9@._%+-])(?=[\p{L}0-9@._%+-])"
MIN_TOKEN = 4
ROUNDS, MIN_SCORE, MIN_SUPPORT = 3, 0.8, 5.0
KEY = ["doc_id", "digest"]


def marked_parts(text: Column, pattern: str) -> Column:
    """The text cut at the matches of the pattern: every second part is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$1{MARK}"), MARK, -1)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    def doubled(n):
        return F.when(n > 4, 2 * n - 9).otherwise(2 * n)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    from_right = F.transform(places, lambda i: F.substr(
        F.reverse(digits), i + 1, F.lit(1)).cast("int"))
    total = F.aggregate(F.transform(from_right, lambda n, i: F.when(
        i % 2 == 1, doubled(n)).otherwise(n)), F.lit(0), lambda a, n: a + n)
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = digits_of(value)
    small = F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike(
        "^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    size = F.length(digits)
    return (F.when(kind == 0, True).when(kind == 1, small)
            .when(kind == 2, F.when(size.between(16, 19), luhn(digits)).otherwise(False))
            .when(kind == 3, size.between(8, 15))
            .otherwise(F.length(value) >= MIN_TOKEN))


def context_word(word: Column) -> Column:
    """As it stands in patterns: in lower case, # for all that hold a digit or @."""
    return F.when(word.rlike("[0-9@]"), "#").otherwise(F.lower(F.rtrim(word, F.lit(" \t\n\x0b\f\r"))))


def named_words(words: Column) -> Column:
    """What the words of a text are called in patterns; blanks alone are none."""
    return F.transform(F.filter(words, lambda word: word.rlike(r"\S")), context_word)


def last_words(words: Column, n: int = 2) -> Column:
    """Names its argument once: in a lambda each mention would be computed by itself."""
    return F.reverse(F.slice(F.reverse(words), 1, n))


def intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, start, end, value, pattern) of entities and of tokens.

    docs has (doc_id, text). Entities are valid ones; tokens lose punctuation at their end.
    """
    text = F.replace(F.col("text"), F.lit(MARK), F.lit(NO_MARK))
    has_at, has_digit = F.col("text").contains("@"), F.col("text").rlike("[0-9]")
    none = F.array().cast("array<string>")
    found = [F.when(has_at if kind == 0 else has_digit, marked_parts(text, pattern)).otherwise(none)
             for kind, pattern in enumerate([*PATTERNS, TOKEN])]
    cut = docs.where(F.col("text").rlike("[0-9@]")).select(
        "doc_id", F.xxhash64("text").alias("digest"), F.explode_outer(F.array(*[
            F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))
            for kind, parts in enumerate(found)])).alias("f")).where(
        F.size("f.parts") > 1).select(*KEY, "f.kind", F.posexplode("f.parts").alias("at", "part"))
    is_match = F.col("at") % 2 == 1
    short = cut.select(
        *KEY, "kind", "at", F.length("part").alias("size"), F.when(is_match, F.col("part")).alias(
            "value"), F.when(~is_match, F.concat_ws("", last_words(F.split("part", CUT)))).alias(
            "tail")).dropDuplicates([*KEY, "kind", "at"])
    order = Window.partitionBy(*KEY, "kind").orderBy("at")
    before = F.coalesce(F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A match holds a word at least, so what stands before it gives the rest.
    near = F.concat_ws("", F.lag("tail", 3).over(order), F.lag("value", 2).over(order),
                       F.lag("tail").over(order))
    placed = short.select(
        *KEY, "kind", "at", "value", before.alias("start"), near.alias("near")).where("at % 2 = 1")
    value = F.when(F.col("kind") == TOKEN_KIND, F.regexp_replace("value", r"[@._%+-]+$", "")
                   ).otherwise(F.col("value"))
    # In front of these parts: the text's start, or another match.
    front = F.when(F.col("at") <= 3, F.array(F.lit("^"), F.lit("^"))).otherwise(
        F.array(F.lit("#"), F.lit("#")))
    words = F.concat_ws(" ", last_words(F.concat(front, F.transform(F.filter(
        F.split("near", CUT), lambda word: word.rlike(r"\S")), context_word))))
    return placed.withColumn("value", value).where(valid(F.col("kind"), F.col("value"))).select(
        *KEY, "kind", "start", (F.col("start") + F.length("value")).alias("end"),
        F.lower("value").alias("value"), words.alias("pattern"))


def free_tokens(found: DataFrame) -> DataFrame:
    """Entities, and those other instances that overlap none."""
    # Two running values, one from each end: a frame that ends at the last row is filled anew
    # for every row.
    sides = Window.partitionBy(*KEY)
    order = sides.orderBy("start", "end", "kind")
    back = sides.orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    entity = F.col("kind") < TOKEN_KIND
    reach = F.max(F.when(entity, F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(entity, F.col("start"))).over(
        back.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("reach", reach).withColumn("ahead", ahead).where(
        entity | ((F.coalesce("reach", F.lit(0)) <= F.col("start"))
                  & (F.coalesce("ahead", F.col("end")) >= F.col("end")))).drop("reach", "ahead")


def behind(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """As `intervals`, the runs and joined digit groups that stand behind the patterns.

    docs has (doc_id, text), patterns (pattern, joined): whether digit groups are joined. Every
    word of every text is compared; only those that pass the filter leave their task.
    """
    text = F.replace(F.col("text"), F.lit(MARK), F.lit(NO_MARK))
    bits, passes = key_bits(patterns, "pattern")
    cut = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("digest"), (~F.col("text").rlike("[0-9@]")).alias("plain"),
        F.regexp_extract_all(text, F.lit(BLOCK % BLOCK_CHARS), F.lit(1)).alias("blocks"))
    # Before the text stand two ^; blanks at its start are a word of their own, which no pattern names.
    front, none = F.array(F.lit("^"), F.lit("^")), F.array().cast("array<string>")
    tails = F.transform("blocks", lambda block, i: last_words(F.concat(
        F.when(i == 0, front).otherwise(none), named_words(last_words(F.split(block, CUT), 3)))))
    starts = F.aggregate("blocks", F.array(F.lit(0).cast("bigint")), lambda done, block: F.array_append(
        done, F.element_at(done, -1) + F.length(block)))
    placed = cut.select(*KEY, "plain", "blocks", tails.alias("tails"), starts.alias("starts")).select(
        *KEY, "plain", F.explode_outer(F.arrays_zip(
            F.col("blocks").alias("block"), F.col("starts").alias("from"),
            F.concat(F.array(front), F.col("tails")).alias("last"),
            F.concat(F.array(none, front), F.col("tails")).alias("earlier"))).alias("b")).where(
        F.col("b.block").isNotNull()).select(*KEY, "plain", "b.*").withColumn(
        "words", F.split("block", CUT))
    first = F.coalesce(F.get("words", F.lit(0)).rlike(r"^\s*$").cast("int"), F.lit(0))
    named = placed.withColumn("first", first).withColumn("named", F.concat(
        last_words(F.concat("earlier", "last")), F.transform(F.slice(
            "words", F.col("first") + 1, F.size("words")), context_word)))
    pairs = F.arrays_zip(F.col("named").alias("a"), F.slice("named", 2, F.size("named")).alias("b"))
    each = named.crossJoin(F.broadcast(bits)).select(
        *KEY, "plain", "block", "from", "words", "bits", "first",
        F.posexplode_outer(pairs).alias("at", "pair")).withColumn(
        "pattern", F.concat_ws(" ", F.col("pair.a"), F.col("pair.b")))
    place = F.col("at") + F.col("first")
    inside = F.length(F.array_join(F.slice("words", 1, place), ""))
    hits = each.where(passes("pattern") & (place < F.size("words"))).select(
        *KEY, "plain", "pattern", "block", "from", inside.alias("inside")).select(
        *KEY, "plain", "pattern", (F.col("from") + F.col("inside")).alias("start"),
        F.substr("block", F.col("inside") + 1, F.length("block")).alias("rest"))
    groups = F.regexp_replace(F.get(F.split(F.regexp_extract("rest", JOINED, 1), r"\. "), F.lit(0)),
                              "(?<=[0-9])[^0-9]++$", "")
    run = F.regexp_replace(F.regexp_extract("rest", r"^(\S++)", 1), END, "")
    begins = F.col("rest").rlike(r"^[\p{L}0-9@._%+-]")
    short = hits.select(
        *KEY, "pattern", "start", groups.alias("groups"), F.when(begins, run).alias("run"),
        "plain").join(patterns, "pattern")
    joins = F.col("joined") & F.col("groups").contains(" ") & (
        F.length(digits_of(F.col("groups"))) >= MIN_JOINED)
    value = F.when(joins, F.col("groups")).otherwise(F.col("run"))
    return short.select(
        *KEY, F.when(joins, JOINED_KIND).otherwise(RUN_KIND).alias("kind"), "start",
        (F.col("start") + F.length(value)).cast("bigint").alias("end"), F.lower(value).alias("value"),
        "pattern", "plain").where(F.length("value") >= MIN_TOKEN)


def one_a_place(found: DataFrame) -> DataFrame:
    """Entities, and of the other instances that start at a place joined groups before a run
    before a token: the larger kind, as a run holds the token that it starts with."""
    other = found.where(F.col("kind") >= TOKEN_KIND)
    columns = ["kind", *[c for c in found.columns if c not in (*KEY, "start", "kind")]]
    best = other.groupBy(*KEY, "start").agg(F.max(F.struct(*columns)).alias("best"))
    return found.where(F.col("kind") < TOKEN_KIND).unionByName(best.select(
        *KEY, "start", *[F.col(f"best.{c}").alias(c) for c in columns]))


def score_patterns(found: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE,
                   min_support: float = MIN_SUPPORT) -> DataFrame:
    """(pattern, kind, score) of the patterns that count after the last round.

    A plain word speaks against the patterns before it, but is never an instance of a kind.
    """
    edges = materialise(found.where(F.col("pattern").rlike(r"\p{L}")).select(
        "pattern", "value").distinct(), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = found.where(F.col("kind") < TOKEN_KIND).select("value", "kind").distinct().withColumn(
        "score", F.lit(1.0))
    scores, patterns = seeds, None
    for _ in range(rounds):
        sums = edges.join(scores, "value").groupBy("pattern", "kind").agg(
            F.round(F.sum("score"), 6).alias("sum")).where(F.col("sum") >= min_support)
        patterns = materialise(sums.join(sizes, "pattern").select(
            "pattern", "kind", F.round(F.col("sum") / F.col("n"), 6).alias("score")).where(
            F.col("score") >= min_score), "patterns")
        unlikely = F.sum(F.log(1 - F.least("score", F.lit(0.999))))
        reached = edges.where(~plain_word(F.col("value"))).join(patterns, "pattern").groupBy(
            "value", "kind").agg(F.round(1 - F.exp(unlikely), 6).alias("score"))
        scores = materialise(seeds.union(reached).groupBy("value", "kind").agg(
            F.max("score").alias("score")), "scores")
    return patterns


def plain_word(value: Column) -> Column:
    return value.rlike(r"^[\p{L}\p{M}'\u2019]+$")


def instances(docs: DataFrame) -> DataFrame:
    """All intervals: entities, tokens and what else stands behind patterns that count.

    The texts are searched again as long as more patterns count, ROUNDS times at most, so that
    all instances behind a pattern enter its score. Patterns without any entity or token behind
    them are not searched for.
    """
    first = materialise(free_tokens(intervals(docs)).withColumn("plain", F.lit(False)), "intervals")
    joins = first.where(F.col("kind") < TOKEN_KIND).groupBy("kind").agg(
        F.max(F.col("value").contains(" ")).alias("joined"))
    found, searched = first, None
    for _ in range(ROUNDS):
        new = score_patterns(found).join(joins, "kind").groupBy("pattern").agg(
            F.max("joined").alias("joined"))
        new = materialise(new if searched is None else new.join(
            searched.select("pattern"), "pattern", "left_anti"), "new-patterns")
        if new.isEmpty():
            break
        searched = new if searched is None else searched.union(new)
        found = materialise(one_a_place(free_tokens(
            found.unionByName(behind(docs, new)))), "intervals")
    return found


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, spans, plain): the spans (kind, start, end, base, done) of texts that have any.

    kind is a number in KINDS; spans are sorted by it, then by start. done: where the spans that
    start earlier end (0 if none). plain: the text holds no digit and no @.
    """
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = instances(pair)
    patterns = score_patterns(found).groupBy("pattern").agg(F.max(F.struct(
        "score", (-F.col("kind")).alias("kind"))).alias("best")).select(
        "pattern", (-F.col("best.kind")).alias("kind"))
    more = found.where((F.col("kind") >= TOKEN_KIND) & ~plain_word(F.col("value"))).drop(
        "kind").join(patterns, "pattern").select(
        *KEY, "kind", "start", "end", F.lit(False).alias("base"), "plain")
    base = found.where(F.col("kind") < TOKEN_KIND).select(
        *KEY, "kind", "start", "end", F.lit(True).alias("base"), "plain")
    earlier = Window.partitionBy(*KEY).orderBy("start", "end", "kind").rowsBetween(
        Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("end").over(earlier), F.lit(0)).cast("bigint")
    return base.unionByName(more).withColumn("done", done).groupBy(*KEY).agg(F.sort_array(
        F.collect_list(F.struct("kind", "start", "end", "base", "done"))).alias("spans"),
        F.max("plain").alias("plain"))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, digest: Column,
               hint: str | None = "merge") -> DataFrame:
    """The rows of docs with a column _pii_spans; empty where nothing was found.

    The merge hint keeps one plan at every size.
    """
    right = spans.select(F.col("doc_id").alias("_pii_id"), F.col("digest").alias("_pii_digest"),
                         F.col("spans").alias("_pii_spans"))
    right = right.hint(hint) if hint else right
    same = F.col(id_col).eqNullSafe(F.col("_pii_id")) & (digest == F.col("_pii_digest"))
    return docs.join(right, same, "left").drop("_pii_id", "_pii_digest").withColumn(
        "_pii_spans", F.coalesce("_pii_spans", F.expr(
            "cast(array() as array<struct<kind: int, start: bigint, end: bigint, base: boolean, done: bigint>>)")))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email .. n_phone, base_sha256, spans for every row of docs."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = pair.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("digest"))
    rows = with_spans(keys, find_spans(pair), "doc_id", F.col("digest"))
    base = F.filter("_pii_spans", lambda s: s["base"])

    def count(number: int) -> Column:
        return F.size(F.filter("_pii_spans", lambda s: s["base"] & (s["kind"] == number)))

    counts = [count(number).cast("bigint").alias(f"n_{kind}")
              for number, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                       listed(F.col("_pii_spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans
    the first gives the name, and all their characters go."""
    names = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])
    # A text is cut into pieces once, so that no span counts its way through the whole of it.
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1)).alias("pieces"),
                   F.array_sort(F.transform(spans, lambda s: F.struct(
                       s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"),
                       s["done"].alias("done")))).alias("spans"))

    def part(pieces: Column, first: Column, last: Column) -> Column:
        at = F.floor(first / PIECE).cast("int")
        whole = F.slice(pieces, at + 1, F.floor(last / PIECE).cast("int") - at + 1)
        return F.substr(F.array_join(whole, ""), (first % PIECE + 1).cast("int"),
                        (last - first).cast("int"))

    def filled(own: Column) -> Column:
        kept = F.filter(own["spans"], lambda s: s["start"] >= s["done"])
        return F.array_join(F.transform(kept, lambda s: F.concat(
            part(own["pieces"], s["done"], s["start"]), names[s["kind"]])), "")

    # An array of one, as a lambda's variable is computed once and a column inside a lambda each time.
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(
        F.get(F.transform(F.array(cut), filled), F.lit(0)), F.substr(text, (end + 1).cast("int"))))


def masked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, personal data in the text masked.

    Texts without a digit or @ hold no entities; few have spans, and so they are not shuffled as
    long as those spans can be broadcast.
    """
    text = F.col(text_col).cast("string")
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    spans = materialise(find_spans(docs, id_col, text_col), "spans")
    parts = [with_spans(docs.where(may), spans.where(~F.col("plain")), id_col, F.xxhash64(text)),
             with_spans(docs.where(~may), materialise(spans.where("plain"), "plain-spans"), id_col,
                        F.xxhash64(text), hint=None)]
    first, second = [rows.select(*[
        masked(text, F.col("_pii_spans")).alias(c) if c == text_col else column
        for c, column in zip(docs.columns, columns, strict=True)]) for rows in parts]
    return first.union(second)
