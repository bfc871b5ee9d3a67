"""DuckDB SQL for the registered queries, written independently of the Spark code.

Only fixed word lists, texts and reference rows are shared with the package;
the logic is plain SQL over the given tables.
"""

from __future__ import annotations

from ticketloom.functions import fixed_values as fixed
from ticketloom.plans import bridge
from ticketloom.plans.answers import INSTRUCTIONS

WORD = r"\p{L}\p{N}_"
BLANK = r"\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        if "\n" in value:
            return "(" + " || chr(10) || ".join(lit(part) for part in value.split("\n")) + ")"
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def arr(values) -> str:
    return "[" + ", ".join(lit(value) for value in values) + "]"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(word)})" for word in words) + ")"


def first_match(text: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN {any_of(f'lower({text})', words)} THEN {lit(label)}"
                     for label, words in rules)
    return f"CASE {cases} ELSE {lit(default)} END"


SEVERITY = first_match("description", fixed.SEVERITY_RULES, fixed.DEFAULT_SEVERITY)
DIAGNOSIS = first_match("description", fixed.DIAGNOSIS_RULES, fixed.DEFAULT_DIAGNOSIS)
PRIORITY = """CASE WHEN impact IS NULL THEN 'P4'
  WHEN lower(severity) = 'critical' AND lower(impact) = 'organization-wide' THEN 'P1'
  WHEN lower(severity) = 'high' OR lower(impact) = 'multiple users' THEN 'P2'
  WHEN lower(severity) = 'medium' OR lower(impact) = 'limited users' THEN 'P3' ELSE 'P4' END"""

TICKETS = f"""tickets AS (SELECT event_id + 1 AS ticket_id, event_id, ts, value,
  concat({arr(bridge.PHRASES)}[event_id % 20 + 1], ' (', event_type, ')') AS description,
  {arr(bridge.IMPACTS)}[user_id % 6 + 1] AS impact,
  concat('user', CAST(user_id AS VARCHAR)) AS employee_name,
  {arr(bridge.DEPARTMENTS)}[user_id % 4 + 1] AS department,
  {arr(bridge.STATES)}[event_id % 8 + 1] AS status,
  CASE WHEN event_id % 2 = 0 THEN concat('user', CAST(user_id AS VARCHAR), '@example.org') END
    AS email,
  ts AS created_at, value / 100.0 AS rag_time, value / 90.0 AS rag_elapsed,
  value / 1000.0 AS agent_time, value / 80.0 AS total_time,
  event_id % 11 = 0 AS customer_requested_human, CAST(event_id % 5 AS INTEGER) AS repeated_attempts,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS actual_category,
  ['yes', 'no', 'null', 'Correct'][event_id % 4 + 1] AS stated_correct,
  CASE WHEN event_id % 3 = 0 THEN 'click' ELSE upper(event_type) END AS predicted FROM events)"""
LEVELED = f"""leveled AS (SELECT *, {PRIORITY} AS priority FROM
  (SELECT *, {SEVERITY} AS severity FROM tickets))"""
METRICS = """metrics AS (SELECT event_id + 1 AS metric_id, event_id + 1 AS ticket_id,
  event_id % 3 <> 0 AS ai_resolved, event_id % 3 <> 0 AND event_id % 5 <> 0 AS resolution_success,
  event_id % 7 <> 0 AS kb_found,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 9 <> 0 END AS classification_correct,
  CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value / 50.0 END AS resolution_time,
  CASE WHEN event_id % 10 = 1 THEN 0.0 ELSE value / 70.0 END AS ai_response_time,
  value / 60.0 AS response_time,
  CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 5 + 1 AS DOUBLE) END AS customer_rating,
  event_id % 3 = 0 AS escalated, ts AS created_at FROM events)"""
FEEDBACK = """feedback AS (SELECT event_id AS feedback_id, ts AS feedback_ts,
  CASE WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 17 = 0 THEN NULL
    WHEN event_id % 29 = 0 THEN CAST(event_id + 51 AS VARCHAR)
    ELSE CAST(event_id - event_id % 10 + 1 AS VARCHAR) END AS ticket_id,
  CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'Resolved' ELSE 'no' END
    AS resolved,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 19 = 0 THEN '6'
    WHEN event_id % 23 = 0 THEN 'abc' ELSE CAST(event_id % 5 + 1 AS VARCHAR) END AS rating
  FROM events)"""
PARSED = """parsed AS (SELECT feedback_id, feedback_ts, TRY_CAST(ticket_id AS BIGINT) AS ticket_id,
  lower(resolved) IN ('true', '1', 'yes', 'resolved') AS resolved,
  CASE WHEN TRY_CAST(rating AS DOUBLE) BETWEEN 1 AND 5 THEN CAST(rating AS DOUBLE) END AS rating,
  CASE WHEN rating IS NULL OR rating IN ('', 'null') THEN NULL
    WHEN TRY_CAST(rating AS DOUBLE) IS NULL THEN 'Invalid rating.'
    WHEN TRY_CAST(rating AS DOUBLE) NOT BETWEEN 1 AND 5 THEN 'Rating must be between 1 and 5.' END
    AS error FROM feedback)"""
TARGETS = """newest AS (SELECT created_at,
    max(max(metric_id)) OVER (ORDER BY created_at) AS metric_id FROM metrics GROUP BY created_at),
  own AS (SELECT p.feedback_id, max(m.metric_id) AS metric_id FROM parsed p JOIN metrics m
    ON m.ticket_id = p.ticket_id AND m.created_at <= p.feedback_ts WHERE p.error IS NULL
    GROUP BY p.feedback_id),
  targets AS (SELECT p.feedback_id, p.feedback_ts, p.resolved, p.rating,
    coalesce(o.metric_id, n.metric_id) AS metric_id
    FROM parsed p LEFT JOIN own o USING (feedback_id)
    ASOF LEFT JOIN newest n ON p.feedback_ts >= n.created_at WHERE p.error IS NULL)"""
APPLIED = """, rated AS (SELECT metric_id, arg_max(struct_pack(r := rating),
      struct_pack(t := feedback_ts, f := feedback_id)) AS last, bool_or(resolved) AS done
    FROM targets GROUP BY metric_id)
  SELECT t.ticket_id, CASE WHEN coalesce(r.done, false) THEN 'Customer Resolved' ELSE t.status END
    AS status, m.metric_id, CASE WHEN r.metric_id IS NOT NULL THEN r.last.r
    ELSE m.customer_rating END AS customer_rating
  FROM tickets t JOIN metrics m USING (ticket_id) LEFT JOIN rated r USING (metric_id)"""
DOCUMENT_KB = """kb AS (SELECT doc_id + 1 AS id, lang AS category, source AS subcategory,
  'Low' AS priority, split_part(text, chr(10), 1) AS title, text AS content FROM documents)"""
SHORT_KB = ("short(id, category, subcategory, priority, title, content) AS (VALUES "
            + ", ".join("(" + ", ".join(
                f"CAST({lit(v)} AS BIGINT)" if isinstance(v, int) else lit(v) for v in row) + ")"
                for row in bridge.SHORT_ARTICLES) + ")")
SUPPORT_KB = f"""{SHORT_KB}, kb AS (SELECT * FROM short UNION ALL
  SELECT doc_id + 1 + {len(bridge.SHORT_ARTICLES)}, lang, source, 'Low',
    split_part(text, chr(10), 1), text FROM documents)"""
#: The classifier learns the category from the word in brackets, which names it.
CLASSIFIED = TICKETS.replace(
    "CASE WHEN event_id % 3 = 0 THEN 'click' ELSE upper(event_type) END AS predicted",
    "event_type AS predicted")


def terms(name: str, source: str, key: str, text: str, bigrams: bool = True) -> str:
    """CTEs giving name(key, term, tf) for the texts of a source."""
    stop = "(" + ", ".join(lit(word) for word in fixed.english_stop_words()) + ")"
    pairs = f"""UNION ALL SELECT k, w || ' ' || lead(w) OVER (PARTITION BY k ORDER BY p) AS term
      FROM {name}_w""" if bigrams else ""
    return f"""{name}_l AS (SELECT {key} AS k,
      regexp_extract_all(lower({text}), '[{WORD}]{{2,}}') AS l FROM {source}),
    {name}_w AS (SELECT k, w, p FROM (SELECT k, unnest(l) AS w, generate_subscripts(l, 1) AS p
      FROM {name}_l) WHERE w NOT IN {stop}),
    {name} AS (SELECT k, term, count(*) AS tf FROM (
      SELECT k, w AS term FROM {name}_w {pairs}) WHERE term IS NOT NULL GROUP BY k, term)"""


def fitted(name: str) -> str:
    """CTEs with unit weights: name_v(k, term, w) and name_idf(term, idf)."""
    return f"""{name}_idf AS (SELECT term, count(*) AS df,
      ln((1.0 + (SELECT count(*) FROM {name}_l)) / (1.0 + count(*))) + 1.0 AS idf
      FROM {name} GROUP BY term),
    {name}_r AS (SELECT k, term, tf, df, tf * idf AS w FROM {name} JOIN {name}_idf USING (term)),
    {name}_v AS (SELECT k, term, tf, df,
      w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_r)"""


def cosines(name: str, docs: str, asked: str) -> str:
    return f"""{name}_q AS (SELECT k, term, tf * idf AS w FROM {asked} JOIN {docs}_idf USING (term)),
    {name}_u AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_q),
    {name} AS (SELECT u.k AS q, v.k AS id, sum(u.w * v.w) AS c FROM {name}_u u
      JOIN {docs}_v v USING (term) GROUP BY u.k, v.k)"""


def scored(profile: str, top: int, prefix: str = "s_") -> str:
    """CTEs over kb and asked(key, text): <prefix>hits(key, id, score, rank)."""
    p = prefix
    agent = profile == "agent"
    replacements = fixed.AGENT_REPLACEMENTS if agent else fixed.SEARCH_REPLACEMENTS
    text = "lower(text)"
    for old, new in replacements:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    heading = ("lower(title || ' ' || subcategory || ' ' || category)" if agent
               else "lower(subcategory || ' ' || title)")

    def words(column: str) -> str:
        if agent:
            return (f"list_distinct(list_filter(regexp_extract_all({column}, '[{WORD}]+'), "
                    "lambda x: regexp_full_match(x, '[a-zA-Z]{3,}')))")
        return (f"list_distinct(list_filter(regexp_split_to_array({column}, '[{BLANK}]+'), "
                "lambda x: x <> ''))")

    threshold = fixed.AGENT_THRESHOLD if agent else fixed.SEARCH_THRESHOLD
    cosine = ("coalesce(f.c, 0)" if agent
              else "(0.9 * coalesce(m.c, 0) + 0.1 * coalesce(f.c, 0))")
    meta_ctes = "" if agent else f"""
    {terms(p + 'meta', 'kb', 'id', "category || ' ' || subcategory || ' ' || title")},
    {fitted(p + 'meta')}, {cosines(p + 'cm', p + 'meta', p + 'qt')},"""
    meta_join = "" if agent else f"LEFT JOIN {p}cm m ON m.q = c.q AND m.id = c.id"
    full = "category || ' ' || subcategory || ' ' || title || ' ' || content"
    return f"""{p}nq AS (SELECT min(key) AS q, {text} AS query FROM asked GROUP BY 2),
    {terms(p + 'qt', p + 'nq', 'q', 'query')},
    {terms(p + 'full', 'kb', 'id', full)},
    {fitted(p + 'full')}, {cosines(p + 'cf', p + 'full', p + 'qt')},{meta_ctes}
    {p}h AS (SELECT id, heading, {words('heading')} AS ws FROM
      (SELECT id, {heading} AS heading FROM kb)),
    {p}qw AS (SELECT q, query, {words('query')} AS ws FROM {p}nq),
    {p}ov AS (SELECT a.q, b.id, count(*) AS n FROM
      (SELECT q, unnest(ws) AS w FROM {p}qw) a JOIN (SELECT id, unnest(ws) AS w FROM {p}h) b
      USING (w) GROUP BY a.q, b.id),
    {p}ph AS (SELECT q, id FROM {p}qw JOIN {p}h ON contains(heading, query)),
    {p}c AS (SELECT q, id FROM {p}cf UNION SELECT q, id FROM {p}ov UNION SELECT q, id FROM {p}ph),
    {p}s AS (SELECT c.q, c.id, round({cosine}
        + 0.3 * coalesce(o.n, 0) / greatest(len(w.ws), 1)
        + CASE WHEN ph.id IS NOT NULL THEN 0.5 ELSE 0 END, 9) AS score
      FROM {p}c c JOIN {p}qw w ON w.q = c.q LEFT JOIN {p}cf f ON f.q = c.q AND f.id = c.id
      {meta_join} LEFT JOIN {p}ov o ON o.q = c.q AND o.id = c.id
      LEFT JOIN {p}ph ph ON ph.q = c.q AND ph.id = c.id),
    {p}r AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)
      AS rank FROM {p}s WHERE score >= {threshold}),
    {p}hits AS (SELECT a.key, r.id, r.score, r.rank FROM asked a
      JOIN {p}nq n ON n.query = {text.replace('lower(text)', 'lower(a.text)')}
      JOIN {p}r r ON r.q = n.q AND r.rank <= {top})"""


def asked(source: str) -> str:
    return f"asked AS (SELECT ticket_id AS key, description AS text FROM {source})"


BENCHMARK = "tickets AS (SELECT item_id AS ticket_id, text AS description FROM benchmark)"
TURNS = """tickets AS (SELECT conv_id * 10000 + turn AS ticket_id, text AS description
  FROM conversations)"""
REPORTS = """tickets AS (SELECT id AS ticket_id,
  'User reported ' || title || '. Further investigation needed.' AS description,
  category AS actual_category, subcategory AS actual_subcategory FROM kb)"""


def article_steps(content: str) -> str:
    lines = f"list_transform(string_split({content}, chr(10)), lambda x: {strip('x')})"
    kept = rf"list_filter({lines}, lambda x: regexp_matches(x, '^([-*]|\p{{Nd}}+[.)])'))"
    bare = (rf"list_transform({kept}, lambda x: regexp_replace(regexp_replace(x, "
            rf"'^[-*][{BLANK}]*', ''), '^\p{{Nd}}+[.)][{BLANK}]*', ''))")
    return f"list_filter({bare}, lambda x: x <> '')[1:6]"


def answer_steps(answer: str) -> str:
    breaks = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    lines = (f"list_transform(regexp_split_to_array({answer}, '{breaks}'), "
             f"lambda x: {strip('x')})")
    return (rf"list_filter({lines}, lambda x: "
            rf"regexp_matches(x, '^(\p{{Nd}}{{2}}|\p{{Nd}}$|[-*])'))[1:6]")


def joined(steps: str, separator: str) -> str:
    return f"coalesce(array_to_string({steps}, {lit(separator)}), '')"


# The agent chain over `leveled` tickets and the short articles.
CHAIN = f"""{asked('tickets')}, {scored('agent', 1, 'a_')},
  steps_of AS (SELECT *, {article_steps('content')} AS own FROM kb),
  chain AS (SELECT l.*, {DIAGNOSIS} AS diagnosis, h.id AS article_id,
    CASE WHEN h.id IS NULL THEN 0.0 ELSE least(h.score, 1.0) END AS similarity, k.title AS article_title,
    CASE WHEN h.id IS NULL THEN [] WHEN len(k.own) > 0 THEN k.own
      ELSE {arr(fixed.DEFAULT_STEPS)} END AS steps
    FROM leveled l LEFT JOIN a_hits h ON h.key = l.ticket_id LEFT JOIN steps_of k ON k.id = h.id),
  valued AS (SELECT *, 0.8 * 0.4 + similarity * 0.4 + least(len(steps) / 6.0, 1.0) * 0.2
    AS confidence FROM chain),
  validated AS (SELECT *, confidence * 100 >= 70 AS passed FROM valued),
  flagged AS (SELECT *, priority = 'P1' AS critical_priority,
    confidence < 0.7 AS low_confidence, NOT passed AS validation_failed,
    len(steps) = 0 AS resolution_failed, repeated_attempts >= 3 AS too_often FROM validated),
  escalated AS (SELECT *, critical_priority OR low_confidence OR validation_failed
    OR resolution_failed OR customer_requested_human OR too_often AS escalate FROM flagged)"""
CHAINED = f"WITH {TICKETS}, {LEVELED}, {SUPPORT_KB}, {CHAIN}"

ANSWERS = """answered AS (SELECT ticket_id, CASE ticket_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL
    WHEN 2 THEN ' Likely cause unknown.' || chr(10) || '- Look into: ' || description || chr(10)
      || '12 Close the ticket.' || chr(10) || '1. Wait. '
    ELSE 'Answer for ' || description END AS answer FROM tickets)"""


def prompted(source: str) -> str:
    """CTEs over hits: prompted(ticket_id, query, n_hits, context, sources)."""
    block = ("chr(10) || 'Knowledge Base ID: ' || h.id || chr(10) || 'Title: ' || k.title || "
             "chr(10) || 'Category: ' || k.category || chr(10) || 'Subcategory: ' || "
             "k.subcategory || chr(10) || 'Relevance Score: ' || printf('%.4f', h.score) || "
             "chr(10) || chr(10) || 'Content:' || chr(10) || k.content || chr(10)")
    listed = ("h.id || '/' || k.title || '/' || k.category || '/' || k.subcategory || '/' || "
              "printf('%.4f', round(h.score, 4))")
    return f"""blocks AS (SELECT h.key, count(*) AS n,
      string_agg({block}, chr(10) ORDER BY h.rank) AS context,
      string_agg({listed}, '; ' ORDER BY h.rank) AS sources
      FROM s_hits h JOIN kb k ON k.id = h.id GROUP BY h.key),
    prompted AS (SELECT t.ticket_id, t.description, {strip('t.description')} AS query,
      coalesce(b.n, 0) AS n_hits, coalesce(b.context, '') AS context,
      coalesce(b.sources, '') AS sources
      FROM {source} t LEFT JOIN blocks b ON b.key = t.ticket_id)"""


OUTCOMES = f"""{ANSWERS}, outcomes AS (SELECT p.*, {strip("coalesce(a.answer, '')")} AS answer,
    CASE WHEN n_hits = 0 THEN {lit(fixed.INSUFFICIENT_RESOLUTION)}
      WHEN {strip("coalesce(a.answer, '')")} <> '' THEN {strip("coalesce(a.answer, '')")}
      ELSE {lit(fixed.FALLBACK_RESOLUTION)} END AS resolution
    FROM prompted p LEFT JOIN answered a USING (ticket_id))"""

SUBMITTED = f"""WITH {CLASSIFIED}, {LEVELED}, {SUPPORT_KB}, {CHAIN}, {scored('ticket', 3)}, {prompted('tickets')}, {OUTCOMES},
  kb_known AS (SELECT e.* EXCLUDE (resolution_failed), o.resolution, o.n_hits AS n_sources,
    e.article_id IS NOT NULL OR e.similarity > 0 OR o.n_hits > 0 AS kb_found,
    CASE WHEN len(e.steps) > 0 THEN e.steps ELSE {answer_steps('o.resolution')} END
      AS resolution_steps FROM escalated e JOIN outcomes o USING (ticket_id)),
  failed AS (SELECT *, resolution = '' OR (len(resolution_steps) = 0 AND NOT kb_found)
    AS resolution_failed FROM kb_known),
  forced AS (SELECT *, CASE WHEN priority IN ('P1', 'Critical')
      THEN {lit(fixed.OVERRIDE_REASONS['priority'])}
    WHEN confidence > 0 AND confidence * 100 < 70 THEN {lit(fixed.OVERRIDE_REASONS['confidence'])}
    WHEN resolution_failed THEN {lit(fixed.OVERRIDE_REASONS['failed'])}
    WHEN customer_requested_human THEN {lit(fixed.OVERRIDE_REASONS['human'])}
    WHEN repeated_attempts >= 3 THEN {lit(fixed.OVERRIDE_REASONS['attempts'])} END
      AS escalation_reason FROM failed),
  done AS (SELECT *, escalate OR escalation_reason IS NOT NULL AS escalated,
    CASE WHEN actual_category <> '' THEN lower(actual_category) = lower(predicted)
      WHEN stated_correct NOT IN ('', 'null')
      THEN lower(stated_correct) IN ('true', '1', 'yes', 'correct') END AS classification_correct,
    CASE WHEN rag_time > 0 THEN rag_time ELSE rag_elapsed END + agent_time AS ai_response_time
    FROM forced),
  submitted AS (SELECT *, NOT escalated AS ai_resolved,
    NOT escalated AND NOT resolution_failed AS resolution_success FROM done)"""


def rates(digits: int) -> str:
    return f"""count(*) AS evaluated_tickets,
  count(*) FILTER (escalated) AS escalated_tickets,
  round(100.0 * count(*) FILTER (ai_resolved) / count(*), {digits}) AS ai_resolution_rate,
  round(100.0 * count(*) FILTER (resolution_success) / count(*), {digits})
    AS resolution_success_rate,
  round(100.0 * count(*) FILTER (kb_found) / count(*), {digits}) AS kb_coverage,
  round(coalesce(avg(resolution_time) FILTER (resolution_time > 0), 0), {digits})
    AS average_resolution_time,
  round(coalesce(avg(ai_response_time) FILTER (ai_response_time > 0), 0), {digits})
    AS average_ai_response_time,
  round(coalesce(avg(customer_rating) FILTER (customer_rating > 0), 0), {digits})
    AS customer_satisfaction,
  round(100.0 * count(*) FILTER (classification_correct) / nullif(count(classification_correct), 0),
    {digits}) AS classification_accuracy"""


RESOLVED = "lower(coalesce(status, '')) IN ('resolved', 'closed', 'customer resolved', 'ai resolved')"
LIVE = """SELECT count(*) AS total_tickets, count(*) FILTER (escalated) AS escalated_tickets,
  round(100.0 * count(*) FILTER (ai_resolved) / count(*), 2) AS ai_resolution_rate,
  round(100.0 * count(*) FILTER (resolution_success) / count(*), 2) AS resolution_success_rate,
  round(100.0 * count(*) FILTER (kb_found) / count(*), 2) AS kb_coverage,
  round(100.0 * count(*) FILTER (classification_correct) / count(classification_correct), 2)
    AS classification_accuracy,
  round(sum(resolution_time) / count(*), 2) AS average_resolution_time,
  round(sum(response_time) / count(*), 2) AS average_response_time,
  round(avg(ai_response_time) FILTER (ai_response_time <> 0), 2) AS average_ai_response_time
  FROM metrics"""
LIVE_FEEDBACK = """SELECT count(*) AS feedback_count,
  round(100.0 * count(*) FILTER (resolved) / count(*), 2) AS feedback_resolution_rate,
  round(coalesce(avg(rating), 0), 2) AS customer_satisfaction FROM parsed WHERE error IS NULL"""


def null_count_rows(source: str, columns, value: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, {value.format(c=c)} AS {name} FROM {source}"
        for c in columns)


TICKET_COLUMNS = [
    "ticket_id", "description", "impact", "employee_name", "department", "status", "email",
    "created_at", "rag_time", "rag_elapsed", "agent_time", "total_time",
    "customer_requested_human", "repeated_attempts", "actual_category", "stated_correct",
    "predicted"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                 "o_orderpriority"]


def article_text(subcategory: str) -> str:
    cases = " ".join(f"WHEN {any_of(f'lower({subcategory})', words)} THEN {lit(text)}"
                     for words, text in fixed.ARTICLE_RULES)
    before, after = fixed.ARTICLE_OPENING.split("{subcategory}")
    return (f"{lit(before)} || {subcategory} || {lit(after)} || "
            f"CASE {cases} ELSE {lit(fixed.ARTICLE_FALLBACK)} END")


BUILT_KB = f"""issues AS (SELECT ticket_id, {DIAGNOSIS} AS category, description AS subcategory,
    coalesce(impact, '') AS priority FROM tickets),
  firsts AS (SELECT category, subcategory, min(ticket_id) AS ticket_id FROM issues GROUP BY ALL),
  built AS (SELECT row_number() OVER (ORDER BY f.ticket_id) AS id, f.category, f.subcategory,
    i.priority, f.subcategory || ' Troubleshooting Guide' AS title,
    {article_text('f.subcategory')} AS content
    FROM firsts f JOIN issues i ON i.ticket_id = f.ticket_id)"""


def clean(text: str) -> str:
    lowered = f"lower(coalesce({text}, ''))"
    removed = f"regexp_replace({lowered}, '[^{WORD}{BLANK}]', '', 'g')"
    return strip(removed)


def report(source: str, actual: str, predicted: str, digits: int) -> str:
    return f"""cm AS (SELECT {actual} AS a, {predicted} AS p, count(*) AS n FROM {source} GROUP BY ALL),
  labels_seen AS (SELECT a AS label FROM cm UNION SELECT p FROM cm),
  sums AS (SELECT label,
    coalesce((SELECT sum(n) FROM cm WHERE a = label AND p = label), 0) AS hit,
    coalesce((SELECT sum(n) FROM cm WHERE a = label), 0) AS support,
    coalesce((SELECT sum(n) FROM cm WHERE p = label), 0) AS guessed FROM labels_seen),
  classes AS (SELECT label, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall,
    2.0 * hit / (guessed + support) AS f1, support, hit FROM sums),
  rows AS (SELECT label, precision, recall, f1, support FROM classes
    UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support),
      sum(hit) / sum(support), sum(support) FROM classes
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM classes
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
      sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
      FROM classes)
  SELECT label, round(precision, {digits}) AS precision, round(recall, {digits}) AS recall,
    round(f1, {digits}) AS f1, CAST(support AS BIGINT) AS support FROM rows"""


def numbered(steps: str) -> str:
    return (f"coalesce(array_to_string(list_transform({steps}, lambda s, i: i || '. ' || s || "
            "chr(10)), ''), '')")


NL = "chr(10)"
TRACKER_BODY = f"""description || {NL} || {NL} || 'diagnosed as ' || diagnosis || ', 80.00% sure'
  || ' | our priority ' || priority || coalesce(' | filed as ' || tracker_name, '')
  || {NL} || {NL} || response || {NL} || {numbered('steps')}"""
RESPONSE = f"""CASE WHEN article_id IS NULL THEN {lit(fixed.NO_ARTICLE_RESPONSE)}
  ELSE 'A relevant knowledge-base article (''' || article_title || ''') was found for this issue. '
  || 'Follow the recommended troubleshooting steps below.' END"""
TICKET_ROW = """SELECT ticket_id, diagnosis, article_id, round(similarity, 6) AS similarity"""


def json_text(text: str) -> str:
    """Spark leaves slashes and non-ASCII characters as they are."""
    return f"to_json({text})"


ORACLES: dict[str, str] = {
    "ticket_severity_priority": f"""WITH {TICKETS}, {LEVELED} SELECT ticket_id, description,
      employee_name, coalesce(department, 'IT') AS department, impact, severity, priority
      FROM leveled""",
    "ticket_diagnosis": f"""WITH {TICKETS}, d AS (SELECT ticket_id, {DIAGNOSIS} AS diagnosis
      FROM tickets) SELECT ticket_id, diagnosis, diagnosis AS category,
      CAST(0.8 AS DOUBLE) AS confidence, CASE WHEN diagnosis = {lit(fixed.DEFAULT_DIAGNOSIS)}
      THEN {lit(fixed.DEFAULT_DIAGNOSIS_MESSAGE)} ELSE 'Ticket classified as ' || diagnosis
      || ' based on detected keywords.' END AS message FROM d""",
    "conversation_diagnosis": f"""WITH t AS (SELECT role, text AS description FROM conversations)
      SELECT role, {SEVERITY} AS severity, {DIAGNOSIS} AS diagnosis, count(*) AS n
      FROM t GROUP BY ALL""",
    "classification_correctness": f"""WITH {TICKETS} SELECT ticket_id, predicted, actual_category,
      stated_correct, CASE WHEN actual_category <> '' THEN lower(actual_category) = lower(predicted)
      WHEN stated_correct NOT IN ('', 'null') THEN lower(stated_correct) IN
      ('true', '1', 'yes', 'correct') END AS classification_correct FROM tickets""",
    "loose_fields": f"""WITH {FEEDBACK} SELECT feedback_id,
      coalesce(TRY_CAST(rating AS DOUBLE), -1.0) AS rating_float,
      coalesce(TRY_CAST(ticket_id AS BIGINT), -1) AS ticket_int,
      lower(resolved) IN ('true', '1', 'yes', 'resolved') AS as_resolved,
      lower(resolved) IN ('true', '1', 'yes', 'human') AS as_human,
      lower(resolved) IN ('true', '1', 'yes') AS as_api_human,
      lower(rating) IN ('true', '1', 'yes', 'correct') AS as_correct,
      rating IN ('', 'null') AS blank_rating,
      CASE WHEN r > 0 AND r <= 1 THEN r * 100 ELSE r END AS rating_percent
      FROM (SELECT *, coalesce(TRY_CAST(rating AS DOUBLE), 0.0) / 5.0 AS r FROM feedback)""",
    "clean_documents": f"""WITH d AS (SELECT DISTINCT lang AS who, source AS mail,
        split_part(text, chr(10), 1) AS subject, text,
        CASE WHEN lang <> 'en' THEN upper(source) END AS resolution FROM documents),
      c AS (SELECT {clean('subject')} AS ticket_subject, {clean('text')} AS ticket_description,
        {clean('resolution')} AS resolution, who AS ticket_type FROM d)
      SELECT *, ticket_subject || ' ' || ticket_description AS customer_query,
        ticket_subject || ' ' || ticket_description || ' ' || ticket_subject || ' '
        || ticket_description AS text FROM c""",
    "audit_records": f"""WITH a AS (SELECT conv_id, turn, unnest([text, ' ' || chr(9), NULL])
        AS given FROM conversations), c AS (SELECT conv_id, turn,
        {strip("coalesce(given, '')")} AS description FROM a) SELECT *, CASE WHEN description = ''
        THEN 'Ticket description is required.' END AS error FROM c""",
    "lowered_orders": """SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority
      FROM orders""",
    "table_shape": f"SELECT count(*) AS n_rows, CAST({len(ORDER_COLUMNS)} AS BIGINT) AS n_columns FROM orders",
    "null_counts": f"WITH {TICKETS} " + null_count_rows(
        "tickets", TICKET_COLUMNS, "count(*) - count({c})", "n_null"),
    "duplicate_rows": """SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM
      (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)""",
    "distinct_counts": f"WITH {TICKETS} " + null_count_rows(
        "tickets", TICKET_COLUMNS, "count(DISTINCT {c})", "n_distinct"),
    "value_counts": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL",
    "low_cardinality_values": "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {lit(c)} AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n
        FROM orders WHERE (SELECT count(DISTINCT {c}) FROM orders) <= 20 GROUP BY {c}"""
        for c in ORDER_COLUMNS) + ")",
    "first_rows_per_category": """SELECT event_id, event_type, user_id, place FROM (SELECT *,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events)
      WHERE place <= 5""",
    "first_seen_values": """SELECT user_id AS value, min(event_id) AS first_seen FROM events
      GROUP BY user_id""",
    "articles_from_tickets": f"WITH {TICKETS}, {BUILT_KB} SELECT * FROM built",
    "article_total": f"WITH {TICKETS}, {BUILT_KB} SELECT count(*) AS n_articles FROM built",
    "document_terms": f"""WITH {terms('t', 'documents', 'doc_id', 'text')}, {fitted('t')}
      SELECT k AS doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens,
      round(sum(w), 6) AS total_weight,
      arg_min(term, struct_pack(w := -round(w, 9), t := term)) AS top_term
      FROM t_v GROUP BY k""",
    "frequent_terms": f"""WITH {terms('a', 'documents', 'doc_id', 'text', False)},
      kept AS (SELECT term FROM a GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000),
      t_l AS (SELECT * FROM a_l), t AS (SELECT a.* FROM a JOIN kept USING (term)), {fitted('t')}
      SELECT term, CAST(sum(tf) AS BIGINT) AS total, max(df) AS df, round(max(w), 6) AS max_weight
      FROM t_v GROUP BY term""",
    "retrieve_topk": f"""WITH {DOCUMENT_KB}, {BENCHMARK}, {asked('tickets')},
      {scored('ticket', 3)} SELECT key AS ticket_id, id, round(score, 6) AS score, rank
      FROM s_hits""",
    "agent_best_article": f"""WITH {DOCUMENT_KB}, {TURNS}, {asked('tickets')},
      {scored('agent', 1)} SELECT key AS ticket_id, id, round(least(score, 1.0), 6) AS similarity
      FROM s_hits""",
}
EVALUATED = f"""WITH {DOCUMENT_KB}, {REPORTS}, {asked('tickets')}, {scored('ticket', 1)},
  judged AS (SELECT t.ticket_id AS "Ticket_ID", actual_category AS "Actual_Category",
    actual_subcategory AS "Actual_Subcategory",
    coalesce(k.category, '') AS "Retrieved_Category",
    coalesce(k.subcategory, '') AS "Retrieved_Subcategory",
    round(coalesce(h.score, 0.0), 4) AS "Score",
    coalesce(actual_category = k.category AND actual_subcategory = k.subcategory, false)
      AS "Correct"
    FROM tickets t LEFT JOIN s_hits h ON h.key = t.ticket_id LEFT JOIN kb k ON k.id = h.id)"""
ORACLES |= {
    "retrieval_evaluation": f"{EVALUATED} SELECT * FROM judged",
    "retrieval_accuracy": f"""{EVALUATED} SELECT count(*) AS total,
      count(*) FILTER ("Correct") AS correct, count(*) FILTER (NOT "Correct") AS incorrect,
      round(100.0 * count(*) FILTER ("Correct") / count(*), 2) AS accuracy FROM judged""",
    "resolution_steps": f"""WITH d AS (SELECT doc_id AS ticket_id,
        split_part(text, chr(10), 1) AS title,
        CASE lang WHEN 'en' THEN replace(text, chr(10), chr(10) || '- ')
          WHEN 'de' THEN replace(text, chr(10), chr(10) || ' 2. ')
          WHEN 'fr' THEN replace(text, chr(10), chr(10) || '10) * ') ELSE text END AS content
        FROM documents),
      s AS (SELECT *, {article_steps('content')} AS own, {answer_steps('content')} AS a FROM d),
      c AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE {arr(fixed.DEFAULT_STEPS)} END AS steps
        FROM s)
      SELECT ticket_id, 'A relevant knowledge-base article (''' || title || ''') was found for '
        || 'this issue. Follow the recommended troubleshooting steps below.' AS response,
        {joined('steps', '|')} AS steps, len(steps) AS n_steps, {joined('a', '|')} AS answer_steps
      FROM c""",
    "validate_escalate": f"""{CHAINED} {TICKET_ROW}, {joined('steps', '|')} AS steps,
      round(confidence, 6) AS confidence,
      CASE WHEN passed THEN 'AUTO_RESOLVE' ELSE 'ESCALATE' END AS status, escalate,
      CASE WHEN escalate THEN {lit(fixed.HUMAN_NEEDED_MESSAGE)} ELSE {lit(fixed.NO_HUMAN_MESSAGE)}
        END AS message,
      concat_ws('; ', CASE WHEN critical_priority THEN 'Critical priority ticket' END,
        CASE WHEN low_confidence THEN 'AI confidence below 70%' END,
        CASE WHEN validation_failed THEN 'Validation agent requested escalation' END,
        CASE WHEN resolution_failed THEN 'Resolution attempt failed' END,
        CASE WHEN customer_requested_human THEN 'Customer requested human support' END,
        CASE WHEN too_often THEN 'Repeated resolution attempts reached 3 or more' END) AS reasons,
      critical_priority, low_confidence, validation_failed, resolution_failed,
      customer_requested_human, too_often AS repeated_attempts FROM escalated""",
    "triage_end_to_end": f"""{SUBMITTED} SELECT ticket_id, predicted AS category,
      'v1' AS model_version, severity,
      priority, CASE WHEN escalated THEN 'Escalated' ELSE 'AI Resolved' END AS status, kb_found,
      ai_resolved, resolution_success, resolution_failed, classification_correct, escalated,
      CASE WHEN escalated THEN 'Escalated to Human Agent' ELSE 'Continue AI Resolution' END
        AS escalation_status, escalation_reason, resolution,
      {joined('resolution_steps', '|')} AS steps,
      round(confidence * 100, 4) AS validation_confidence, n_sources,
      round(ai_response_time, 6) AS ai_response_time FROM submitted""",
    "ticket_scorecards": f"""{SUBMITTED} SELECT ticket_id,
      CAST(kb_found AS BIGINT) AS article_count, 100 * CAST(kb_found AS BIGINT)
      AS retrieval_accuracy, n_sources AS document_count,
      100 * CAST(resolution_success AS BIGINT) AS resolution_rate,
      round(ai_response_time, 2) AS average_response_time FROM submitted""",
    "triage_metrics": f"""{SUBMITTED}, stored AS (SELECT *, total_time AS resolution_time,
      CAST(NULL AS DOUBLE) AS customer_rating FROM submitted)
      SELECT severity, {rates(4)} FROM stored GROUP BY severity""",
    "answer_prompts": f"""WITH {TICKETS}, {SUPPORT_KB}, {asked('tickets')},
      {scored('ticket', 3)}, {prompted('tickets')}
      SELECT ticket_id, query, n_hits, context, sources, {lit(INSTRUCTIONS)} || {NL} || {NL}
      || 'SUPPORT TICKET:' || {NL} || description || {NL} || {NL} || 'RETRIEVAL QUERY:' || {NL}
      || query || {NL} || {NL} || 'KNOWLEDGE BASE:' || {NL} || context || {NL} || {NL}
      || 'Answer with exactly these sections:' || {NL} || {f" || {NL} || ".join(
          f"'### ' || {lit(name)} || {NL} || {lit(guidance)}" for name, guidance in zip(
              fixed.ANSWER_SECTIONS, fixed.ANSWER_GUIDANCE, strict=True))}
      || {NL} AS prompt FROM prompted""",
    "answer_outcomes": f"""WITH {DOCUMENT_KB}, {BENCHMARK}, {asked('tickets')},
      {scored('ticket', 3)}, {prompted('tickets')}, {OUTCOMES}
      SELECT ticket_id, resolution, query, 'completed' AS ticket_analysis_status,
      {lit(fixed.ANALYSIS_MESSAGE)} AS ticket_analysis_message,
      CASE WHEN n_hits > 0 THEN 'completed' ELSE 'insufficient' END AS knowledge_retrieval_status,
      CASE WHEN n_hits > 0 THEN n_hits || ' relevant knowledge-base article(s) retrieved.'
        ELSE {lit(fixed.NOT_RETRIEVED_MESSAGE)} END AS knowledge_retrieval_message,
      CASE WHEN n_hits > 0 THEN 'completed' ELSE 'insufficient' END AS context_augmentation_status,
      CASE WHEN n_hits > 0 THEN 'Retrieved knowledge from ' || n_hits
        || ' article(s) added to the AI context.' ELSE {lit(fixed.NO_CONTEXT_MESSAGE)} END
        AS context_augmentation_message,
      CASE WHEN n_hits = 0 THEN 'completed_with_warning' WHEN answer <> '' THEN 'completed'
        ELSE 'failed_with_fallback' END AS resolution_generation_status,
      CASE WHEN n_hits = 0 THEN {lit(fixed.NOT_GENERATED_MESSAGE)}
        WHEN answer <> '' THEN {lit(fixed.GENERATED_MESSAGE)}
        ELSE {lit(fixed.FALLBACK_MESSAGE)} END AS resolution_generation_message,
      n_hits AS articles_found,
      CASE WHEN n_hits > 0 AND ticket_id % 5 = 2 THEN 2 WHEN n_hits > 0 AND ticket_id % 5 > 2 THEN 1
        END AS attempts,
      CASE WHEN n_hits > 0 AND ticket_id % 5 = 0 THEN {lit(fixed.BLANK_RESPONSE_ERROR)} END AS error
      FROM outcomes""",
    "escalation_outbox": f"""{CHAINED}, named AS (SELECT *, {RESPONSE} AS response,
        CASE priority WHEN 'P1' THEN '1' WHEN 'P2' THEN '20' WHEN 'P3' THEN '3' END AS tracker_id,
        CASE priority WHEN 'P1' THEN 'Highest' WHEN 'P2' THEN 'P2' WHEN 'P3' THEN 'Medium' END
          AS tracker_name FROM escalated WHERE escalate),
      bodies AS (SELECT *, diagnosis || ' (handed over by Help Desk)' AS summary,
        {TRACKER_BODY} AS body FROM named)
      SELECT ticket_id, priority, tracker_id, tracker_name, tracker_id IS NOT NULL AS success,
        summary, body AS description, CASE WHEN tracker_id IS NOT NULL THEN
        '{{"fields":{{"project":{{"key":"HELP"}},"summary":' || to_json(summary)
        || ',"description":{{"type":"doc","version":1,"content":[{{"type":"paragraph","content":'
        || '[{{"type":"text","text":' || to_json(body) || '}}]}}]}},"issuetype":{{"name":"Task"}},'
        || '"priority":{{"id":' || to_json(tracker_id) || '}}}}}}' END AS payload FROM bodies""",
    "notice_outbox": f"""{SUBMITTED} SELECT ticket_id, email AS recipient,
      'Your request to Help Desk: an answer' AS subject,
      'Help Desk found an answer to what you wrote to us:' || {NL} || '> ' || description || {NL}
      || {NL} || 'This should help:' || {NL} || {numbered('resolution_steps')} || {NL}
      || 'Did it not? Reply to this message and a colleague takes over.' AS body FROM submitted
      WHERE ai_resolved AND email IS NOT NULL""",
    "dashboard_summary": f"""WITH {TICKETS}, {LEVELED}, {METRICS},
      a AS (SELECT count(*) AS total_tickets,
        count(*) FILTER (lower(severity) = 'critical') AS critical_tickets,
        count(*) FILTER (lower(severity) = 'high') AS high_tickets,
        count(*) FILTER (status = 'Open') AS open_tickets FROM leveled),
      b AS (SELECT {rates(2)} FROM metrics) SELECT * FROM a, b""",
    "dashboard_by_day": f"""WITH {METRICS} SELECT strftime(created_at, '%Y-%m-%d') AS day,
      {rates(4)} FROM metrics GROUP BY 1""",
    "ticket_counts_by_department": f"""WITH {TICKETS}, {LEVELED}
      SELECT coalesce(department, 'IT') AS department, count(*) AS total_tickets,
        count(*) FILTER (lower(severity) = 'critical') AS critical_tickets,
        count(*) FILTER (lower(severity) = 'high') AS high_tickets,
        count(*) FILTER (status = 'Open') AS open_tickets FROM leveled GROUP BY 1""",
    "weekly_volume": f"""WITH {TICKETS}, monday AS (SELECT CAST(date_trunc('week', max(created_at))
        AS DATE) AS m FROM tickets),
      days AS (SELECT CAST(m + CAST(i AS INTEGER) AS DATE) AS day, ['Monday', 'Tuesday', 'Wednesday', 'Thursday',
        'Friday', 'Saturday', 'Sunday'][i + 1] AS day_name FROM monday, range(7) r(i))
      SELECT strftime(day, '%Y-%m-%d') AS day, day_name, count(ticket_id) AS received,
        count(ticket_id) FILTER ({RESOLVED}) AS resolved
      FROM days LEFT JOIN tickets ON CAST(created_at AS DATE) = day GROUP BY ALL""",
    "recent_tickets": f"""WITH {TICKETS}, {LEVELED} SELECT ticket_id, employee_name, department,
      predicted AS category, severity, priority, status,
      strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM leveled
      ORDER BY ticket_id DESC LIMIT 15""",
    "live_ticket_metrics": f"WITH {METRICS} {LIVE}",
    "live_feedback_metrics": f"WITH {FEEDBACK}, {PARSED} {LIVE_FEEDBACK}",
    "classification_report": f"WITH {TICKETS}, " + report(
        "tickets", "actual_category", "lower(predicted)", 6),
    "feedback_parse": f"""WITH {FEEDBACK}, {PARSED} SELECT feedback_id, ticket_id, resolved,
      rating, error FROM parsed""",
    "feedback_targets": f"""WITH {METRICS}, {FEEDBACK}, {PARSED}, {TARGETS}
      SELECT feedback_id, resolved, rating, metric_id FROM targets""",
    "feedback_applied": f"WITH {TICKETS}, {METRICS}, {FEEDBACK}, {PARSED}, {TARGETS} {APPLIED}",
    "latest_ticket_metrics": f"""WITH {METRICS} SELECT user_id AS ticket_id,
      max(metric_id) AS metric_id, arg_max(escalated, metric_id) AS escalated,
      arg_max(struct_pack(r := customer_rating), metric_id).r AS customer_rating
      FROM metrics JOIN events ON event_id + 1 = metric_id GROUP BY user_id""",
    "balanced_sample": """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (
      PARTITION BY lang ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) AS p
      FROM documents) WHERE p <= 10""",
    "stratified_split": """SELECT doc_id, lang, CASE WHEN p <= floor(n * 0.2 + 0.5) THEN 'test'
      ELSE 'train' END AS part FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
      row_number() OVER (PARTITION BY lang
        ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) AS p FROM documents)""",
    "train_by_tables": """SELECT count(*) AS n_tested, true AS told FROM (SELECT lang,
      count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang
        ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id) AS p FROM documents)
      WHERE p <= floor(n * 0.2 + 0.5)""",
    "stream_ticket_metrics": f"WITH {METRICS} {LIVE}",
    "stream_feedback_metrics": f"WITH {FEEDBACK}, {PARSED} {LIVE_FEEDBACK}",
    "stream_volume": f"""WITH {TICKETS} SELECT strftime(created_at, '%Y-%m-%d') AS day,
      count(*) AS received, count(*) FILTER ({RESOLVED}) AS resolved FROM tickets GROUP BY 1""",
    "stream_repeated_attempts": f"""WITH {TICKETS} SELECT employee_name, count(*) AS attempts,
      count(*) >= 3 AS too_many FROM tickets GROUP BY employee_name""",
    "stream_submissions": f"""{SUBMITTED} SELECT ticket_id, description, predicted AS category,
      'v1' AS model_version, severity, priority,
      CASE WHEN escalated THEN 'Escalated' ELSE 'AI Resolved' END AS status, employee_name,
      coalesce(department, 'IT') AS department, ai_resolved, resolution_success, kb_found,
      classification_correct, escalated, CAST(NULL AS DOUBLE) AS customer_rating,
      round(total_time, 6) AS resolution_time, round(ai_response_time, 6) AS ai_response_time
      FROM submitted""",
    "stream_triage": f"""{CHAINED} {TICKET_ROW},
      CASE WHEN passed THEN 'AUTO_RESOLVE' ELSE 'ESCALATE' END AS validation_status, escalate
      FROM escalated""",
    "stream_feedback": f"WITH {TICKETS}, {METRICS}, {FEEDBACK}, {PARSED}, {TARGETS} {APPLIED}",
    "csv_round_trip": "SELECT doc_id, lang, text FROM documents",
    "article_round_trip": f"WITH {TICKETS}, {BUILT_KB} SELECT * FROM built",
    "table_append": f"""WITH {TICKETS}, both_parts AS (
        SELECT ticket_id, created_at, status, coalesce(department, 'IT') AS department FROM tickets
        UNION ALL SELECT ticket_id, created_at, 'Open', 'IT' FROM tickets)
      SELECT day, status, department, n, n_tickets, n_refused FROM (
        SELECT strftime(created_at, '%Y-%m-%d') AS day, status, department, count(*) AS n,
          count(DISTINCT ticket_id) AS n_tickets FROM both_parts GROUP BY ALL)
      JOIN (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n_refused FROM tickets
        GROUP BY ALL) USING (day)""",
    "metric_append": f"""WITH {METRICS}, stored AS (SELECT * REPLACE (false AS kb_found,
      CASE WHEN metric_id % 11 = 0 THEN 0.0 ELSE ai_response_time END AS ai_response_time,
      CAST(NULL AS DOUBLE) AS customer_rating) FROM metrics) SELECT {rates(4)} FROM stored""",
    "schema_evolution": f"""WITH {TICKETS} SELECT department, count(*) AS n,
      count(employee_name) AS n_named FROM (SELECT NULL AS department, NULL AS employee_name
      FROM tickets UNION ALL SELECT department, employee_name FROM tickets) GROUP BY department""",
    "rule_table_matches": """WITH r AS (SELECT doc_id AS rule_ord, source AS label,
        lower(concat_ws(' ', split(text, ' ')[3], split(text, ' ')[4])) AS keyword FROM documents),
      f AS (SELECT d.doc_id, min(rule_ord) AS rule_ord FROM documents d
        JOIN r ON length(keyword) > 1 AND contains(lower(d.text), keyword) GROUP BY d.doc_id)
      SELECT doc_id, rule_ord, coalesce(label, 'none') AS label FROM documents
      LEFT JOIN f USING (doc_id) LEFT JOIN r USING (rule_ord)""",
    "attempts_so_far": f"""WITH {TICKETS}, a AS (SELECT employee_name, ticket_id, count(*) OVER (
        PARTITION BY employee_name ORDER BY created_at, ticket_id
        ROWS UNBOUNDED PRECEDING) - 1 AS attempts FROM tickets)
      SELECT *, attempts >= 3 AS too_many FROM a""",
    "stored_summaries": f"WITH {TICKETS} SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {lit(c)} AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n
        FROM tickets WHERE (SELECT count(DISTINCT {c}) FROM tickets) <= 20 AND {c} IS NOT NULL
        GROUP BY {c}""" for c in TICKET_COLUMNS) + ")",
    "distinct_estimates": f"WITH {TICKETS} " + " UNION ALL ".join(
        f"""SELECT {lit(c)} AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct,
        true AS is_close FROM tickets""" for c in TICKET_COLUMNS),
    "column_list": " UNION ALL ".join(
        f"SELECT {place} AS position, {lit(c)} AS column_name, {lit(kind)} AS data_type"
        for place, (c, kind) in enumerate(zip(ORDER_COLUMNS, (
            "bigint", "bigint", "string", "double", "timestamp_ntz", "string"), strict=True), 1)),
    "head_rows": """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
      ORDER BY o_orderkey LIMIT 5""",
    "json_array_read": f"WITH {DOCUMENT_KB} SELECT * FROM kb",
    "stored_evolution": f"""WITH {TICKETS}, stored AS (
        SELECT NULL AS department, ticket_id, repeated_attempts, created_at FROM tickets UNION ALL
        SELECT department, ticket_id + 8589934592, repeated_attempts, created_at FROM tickets)
      SELECT department, count(*) AS n, max(ticket_id) AS last_ticket,
        CAST(sum(repeated_attempts) AS BIGINT) AS attempts, count(created_at) AS n_dated
      FROM stored GROUP BY department""",
    "probed_accuracy": """SELECT round(100.0 * count(*) FILTER (event_id % 7 <> 0) / count(*), 2)
      AS retrieval_accuracy, count(*) AS evaluated FROM events""",
    "stored_accuracy": """SELECT round(avg(v) * 100, 2) AS retrieval_accuracy, count(v) AS evaluated
      FROM (SELECT CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 0.0
      ELSE 1.0 END AS v FROM events)""",
}
ORACLES["stream_attempts_so_far"] = ORACLES["attempts_so_far"]
