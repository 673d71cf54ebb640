"""Queries for the control flow from questions to answers, and for parsed documents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import graph as G
from vellum.operators import monitor as M
from vellum.operators import parse as P
from vellum.operators import ranking as R
from vellum.plans.monitor import _ONE as ONE
from vellum.sources.tables import table


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return M.one_per_question(table(spark, folder, "query_log"))


def search_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The searches of every question; those with dropped quotes ask a follow-up."""
    log = _log(spark, folder).where("question is not null")
    tests = F.array(*(F.lit(t) for t in (*G.LEGAL_TESTS, "none")))
    follow = F.when(F.coalesce("quotes_dropped", F.lit(0)) > 3, F.concat(F.lit("What do Articles 5 and 6a add to: "), "question"))
    asked = log.select(
        F.col("query_id").alias("question_id"), F.when(follow.isNotNull(), 2).otherwise(1).alias("round"), "question", "intent", T.named_articles(F.col("question")).alias("articles"), F.array().cast("array<string>").alias("annexes"),
        F.split("question", " and ").alias("sides"), F.element_at(tests, (F.col("query_id") % 7 + 1).cast("int")).alias("legal_test"), follow.alias("follow_up"), F.lit("lookup").alias("follow_kind"), F.array().cast("array<string>").alias("follow_sides"),
    )
    return G.plan(asked).select("question_id", "round", "side", "query", "label", F.array_join("articles", ",").alias("articles"), F.array_join("annexes", ",").alias("annexes"), "named_only")


def control_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Where each logged question would go next at every fork."""
    log = _log(spark, folder)
    zero = lambda c: F.coalesce(c, F.lit(0))
    covered = F.coalesce("citation_coverage", F.lit(0.0))
    late, again = zero("latency_ms") > 20_000, F.coalesce("prompt_version", F.lit("")) == "v7"
    steps = log.select(
        "query_id",
        G.after_collect(F.array_size("document_version_ids"), covered, zero("quotes_dropped") % 2).alias("gate"),
        G.needs_shorter(late, again, F.lit(1)).alias("shorter"),
        G.needs_repair(F.lit(1), again, zero("quotes_dropped"), covered).alias("repair"),
        G.follows_up(F.coalesce("verdict", F.lit("abstained")), F.lit(1), F.col("intent"), covered > 0.9, F.lit("lookup"), F.col("question"), F.lit("")).alias("follow_up"),
    )
    return steps


def round_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    total = F.coalesce("quotes_total", F.lit(0))
    rounds = log.select(F.col("query_id").alias("question_id"), F.lit(1).alias("round"), "intent", total.alias("claims"), (total - F.coalesce("quotes_dropped", F.lit(0))).alias("kept"), (F.coalesce("latency_ms", F.lit(0)) > 20_000).alias("overran"), (F.coalesce("prompt_version", F.lit("")) != "v7").alias("answerable"))
    return G.round_outcome(rounds)


def collected_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of each question from its legs as sides, each with its share of the budget."""
    hits = table(spark, folder, "candidate").dropDuplicates(["candidate_id"]).where("leg is not null and leg_rank is not null")
    clean = F.lower(F.trim("authority"))
    named = hits.select(F.col("query_id").alias("question_id"), F.col("leg").alias("side"), F.col("structural_unit_id").alias("unit_id"), F.when(clean.isin(*R.TIERS), clean).otherwise("other").alias("authority"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("leg_rank").alias("place"), "candidate_id")
    once = named.groupBy("question_id", "side", "unit_id").agg(F.min(F.struct("place", "candidate_id", "authority", "score")).alias("r")).select("question_id", "side", "unit_id", "r.place", "r.authority", "r.score")
    costs = table(spark, folder, "structural_unit").select("unit_id", T.estimate_tokens(F.col("text")).alias("cost")).dropDuplicates(["unit_id"])
    return G.collect(once.join(costs, "unit_id")).select("question_id", "unit_id", "authority", "score", "place", "label", "cost")


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last three questions of each thread with what was said, oldest first."""
    steps = table(spark, folder, "chat_steps").where("thread_id is not null and step_id is not null")
    once = steps.groupBy("thread_id", "step_id").agg(F.min(F.struct(F.coalesce("is_streaming", F.lit(False)).alias("s"), F.coalesce("created_at", F.lit("")).alias("at"), F.coalesce("input_text", F.lit("")).alias("i"), F.coalesce("output_text", F.lit("")).alias("o"))).alias("r"))
    turns = once.select("thread_id", "step_id", T.micros(F.col("r.at")).alias("at"), F.col("r.o").alias("question"), F.col("r.i").alias("answer"))
    return G.history(turns, "thread_id", [F.desc_nulls_last("at"), F.desc("step_id")]).select("thread_id", F.md5("turns").alias("turns"))


def evidence_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each unit as a prompt would show it."""
    versions = table(spark, folder, "document_version").dropDuplicates(["document_version_id"]).join(table(spark, folder, "legal_source").select("source_id", F.lower("authority").alias("authority"), "title"), "source_id").select("document_version_id", "authority", "title", "version_label")
    units = table(spark, folder, "structural_unit").dropDuplicates(["unit_id"]).join(versions, "document_version_id")
    citation = T.citation_label(F.col("unit_type"), F.col("unit_number"), F.col("unit_path"), F.col("authority"), F.col("title"))
    block = G.evidence_block(F.concat(F.lit("E"), F.col("unit_id").cast("string")), citation, F.col("heading"), F.col("authority"), F.col("version_label"), F.col("context"), F.col("text"))
    return units.select("unit_id", F.md5(block).alias("block"))


def parsed_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headed units that the parser of acts finds in documents made of one stored unit each, under its heading line."""
    word = F.when(F.col("unit_type") == "article", "Article").otherwise(F.upper("unit_type"))
    made = table(spark, folder, "structural_unit").dropDuplicates(["unit_id"]).select(F.col("unit_id").alias("doc_id"), F.concat(F.concat_ws(" ", word, "unit_number", "heading"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = P.parse(made, "doc_id", "text", "act").where("unit_type <> 'paragraph'")
    return found.groupBy("doc_id", "unit_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("unit_number"))), ",").alias("numbers"))


def parsed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by the parser of their kind: statutes as acts, others as sections."""
    kind = F.when(F.col("authority") == "law", "act").when(F.col("authority") == "code", "code").otherwise("sections")
    documents = table(spark, folder, "documents").select("doc_id", "text", kind.alias("parser"))
    return P.parse_by_source(documents, "doc_id", "text", "parser").select("doc_id", "ordinal", "unit_type", "unit_number", "unit_path", "parent_path", F.length("text").alias("n"), "error")


def _folds() -> str:
    """Characters and their folded forms as two SQL lists, by the rule of the fold."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    special = {c: to for to, kinds in T.FOLDED.items() for c in kinds} | dict.fromkeys(T.DROPPED, "")
    forms = {chr(i): special.get(chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000}
    changed = {c: f for c, f in forms.items() if c != f}
    return f"SELECT unnest([{', '.join(map(quote, changed))}]) AS c, unnest([{', '.join(map(quote, changed.values()))}]) AS f"


def _verify_sql() -> str:
    bound = T.BOUNDARY.replace("'", "''")
    trim = lambda x: f"trim({x}, '{bound}')"
    return f"""WITH RECURSIVE k AS ({_folds()}),
q AS (SELECT row_number() OVER () AS n, unit_id, text_normalized AS quote FROM (SELECT DISTINCT unit_id, text_normalized FROM normalized_text)),
e AS (SELECT DISTINCT ON (unit_id) unit_id, text FROM structural_unit WHERE unit_id IN (SELECT unit_id FROM q) ORDER BY unit_id),
t AS (SELECT n AS id, quote AS text FROM q UNION ALL SELECT -1 - unit_id, text FROM e),
ch AS (SELECT id, unnest(range(1, length(text) + 1)) AS i, text FROM t), cc AS (SELECT id, i, substring(text, i, 1) AS c FROM ch),
fd AS (SELECT id, i, coalesce(f, c) AS f FROM cc LEFT JOIN k USING (c)), fx AS (SELECT id, i, f, unnest(range(1, length(f) + 1)) AS j FROM fd),
x AS (SELECT id, i, j, substring(f, j, 1) AS x, regexp_full_match(substring(f, j, 1), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]') AS sp FROM fx),
w AS (SELECT *, lag(sp) OVER o AS before, count(*) FILTER (NOT sp) OVER (o ROWS UNBOUNDED PRECEDING) AS seen, count(*) FILTER (NOT sp) OVER (PARTITION BY id) AS whole FROM x WINDOW o AS (PARTITION BY id ORDER BY i, j)),
f AS (SELECT id, string_agg(CASE WHEN sp THEN ' ' ELSE x END, '' ORDER BY i, j) AS folded, list(i - 1 ORDER BY i, j) AS offs FROM w WHERE NOT sp OR (NOT coalesce(before, true) AND seen > 0 AND seen < whole) GROUP BY id),
a AS (SELECT n, q.unit_id, e.text, {trim("coalesce(fq.folded, '')")} AS needle, CASE WHEN e.text IS NOT NULL THEN coalesce(fe.folded, '') END AS hay, fe.offs FROM q LEFT JOIN e USING (unit_id) LEFT JOIN f fq ON fq.id = q.n LEFT JOIN f fe ON fe.id = -1 - q.unit_id),
p AS (SELECT *, list_filter(list_transform(CASE WHEN contains(needle, '[...]') THEN string_split(needle, '[...]') WHEN contains(needle, '...') THEN string_split(needle, '...') ELSE [needle] END, lambda s: {trim('s')}), lambda s: s <> '') AS parts FROM a),
st AS (SELECT n, 0 AS step, 1 AS pos, 0 AS first FROM p UNION ALL
  SELECT st.n, step + 1, CASE WHEN strpos(substring(hay, st.pos), parts[step + 1]) = 0 THEN 0 ELSE st.pos + strpos(substring(hay, st.pos), parts[step + 1]) - 1 + length(parts[step + 1]) END,
    CASE WHEN step = 0 THEN strpos(hay, parts[1]) ELSE first END FROM st JOIN p USING (n) WHERE step < len(parts) AND st.pos > 0 AND hay IS NOT NULL),
l AS (SELECT n, arg_max(pos, step) AS pos, arg_max(first, step) AS first FROM st GROUP BY n),
m AS (SELECT p.*, pos, first, CASE WHEN hay IS NULL THEN 'unknown' WHEN length(needle) < 24 OR len(list_filter(string_split(needle, ' '), lambda s: s <> '')) < 4 THEN 'short' WHEN pos = 0 THEN 'not_found' WHEN len(parts) > 1 THEN 'elided' ELSE 'exact' END AS method FROM p JOIN l USING (n))
SELECT unit_id AS quote_id, unit_id, method, CASE WHEN method IN ('exact', 'elided') THEN first - 1 END AS start, CASE WHEN method IN ('exact', 'elided') THEN pos - 1 END AS "end",
CASE WHEN method IN ('exact', 'elided') THEN substring(text, offs[first] + 1, offs[pos - 1] - offs[first] + 1) END AS shown FROM m"""


_TESTS = {t: (",".join(a), ",".join(x), ", ".join([f"Article {y}" for y in a] + [f"Annex {y}" for y in x])) for t, (a, x) in G.LEGAL_TESTS.items()}
_ARTS = r"array_to_string(flatten(list_transform(regexp_extract_all({}, '(?i)\bArticles?\s+(\d+[a-z]?(?:\s*(?:,|and|or|to)\s*\d+[a-z]?)*)', 1), lambda g: regexp_extract_all(g, '\d+[a-z]?'))), ',')"
SQL = {
    "search_tasks": ONE
    + f""", t AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}', '{a}', '{x}', '{n}')" for i, (t, (a, x, n)) in enumerate(_TESTS.items()))}) v(i, test, arts, anns, names)),
b AS (SELECT query_id AS question_id, question, intent, string_split(question, ' and ') AS sides, query_id % 7 AS i, coalesce(quotes_dropped, 0) > 3 AS follows FROM l WHERE question IS NOT NULL),
f AS (SELECT question_id, 2 AS round, 0 AS side, 'What do Articles 5 and 6a add to: ' || question AS query, true AS named, '' AS anns FROM b WHERE follows)
SELECT question_id, round, side, query, 'for: ' || query AS label, {_ARTS.format('query')} AS articles, '' AS annexes, false AS named_only FROM f
UNION ALL SELECT question_id, 1, s - 1, sides[s], 'for: ' || sides[s], '', '', false FROM (SELECT *, unnest(range(1, least(len(sides), 3) + 1)) AS s FROM b WHERE NOT follows AND intent = 'comparison' AND len(sides) > 1)
UNION ALL SELECT question_id, 1, 0, question, '', {_ARTS.format('question')}, '', false FROM b WHERE NOT follows AND NOT (coalesce(intent, '') = 'comparison' AND len(sides) > 1)
UNION ALL SELECT question_id, 1, 1, question, 'the legal test in ' || names, arts, anns, true FROM b JOIN t USING (i) WHERE NOT follows AND intent = 'applicability'""",
    "control_flow": ONE
    + """ SELECT query_id, CASE WHEN len(document_version_ids) > 0 AND coalesce(citation_coverage, 0) >= 0.005 THEN 'generate' WHEN coalesce(quotes_dropped, 0) % 2 > 0 THEN 'finalise' ELSE 'abstain' END AS gate,
coalesce(latency_ms, 0) > 20000 AND coalesce(prompt_version, '') <> 'v7' AS shorter, coalesce(prompt_version, '') <> 'v7' AND coalesce(quotes_dropped, 0) > 0 AND coalesce(citation_coverage, 0) < 0.8::DOUBLE AS repair,
coalesce(coalesce(verdict, 'abstained') <> 'abstained' AND coalesce(intent, '') <> 'applicability' AND NOT coalesce(citation_coverage, 0) > 0.9::DOUBLE AND nullif(trim(question), '') <> '', false) AS follow_up FROM l""",
    "round_outcomes": ONE
    + """, c AS (SELECT query_id AS question_id, coalesce(intent, '') AS i, coalesce(quotes_total, 0) AS n, coalesce(quotes_total, 0) - coalesce(quotes_dropped, 0) AS kept, coalesce(latency_ms, 0) > 20000 AS o, coalesce(prompt_version, '') <> 'v7' AS ok FROM l),
d AS (SELECT *, i <> 'applicability' AND NOT ok AS unable, CASE WHEN n = 0 THEN 0 ELSE kept / n END AS cov FROM c),
v AS (SELECT *, CASE WHEN kept = 0 OR unable THEN 'abstained' WHEN cov >= 0.8::DOUBLE THEN 'answered' WHEN cov >= 0.4::DOUBLE THEN 'partial' ELSE 'abstained' END AS verdict FROM d)
SELECT question_id, 1 AS round, verdict, CASE WHEN kept = 0 AND o THEN 'overran' WHEN kept = 0 THEN 'unsupported' WHEN unable THEN 'no_evidence' WHEN verdict = 'abstained' THEN 'unsupported' END AS reason FROM v""",
    "collected_evidence": """WITH RECURSIVE h AS (SELECT DISTINCT candidate_id, query_id AS question_id, leg AS side, structural_unit_id AS unit_id, CASE WHEN lower(trim(authority)) IN ('law', 'guidance', 'code') THEN lower(trim(authority)) ELSE 'other' END AS authority, coalesce(score, 0.0) AS score, leg_rank AS place FROM candidate WHERE leg IS NOT NULL AND leg_rank IS NOT NULL),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_id, side, unit_id ORDER BY place, candidate_id) = 1),
u AS (SELECT DISTINCT unit_id, CAST(trunc(length(coalesce(text, '')) / 3.6::DOUBLE) AS BIGINT) + 32 AS cost FROM structural_unit),
j AS (SELECT o.*, cost, CASE authority WHEN 'law' THEN 0 WHEN 'guidance' THEN 1 WHEN 'code' THEN 2 ELSE 3 END AS tier FROM o JOIN u USING (unit_id)),
s AS (SELECT j.*, 2400 // n AS share, row_number() OVER (PARTITION BY question_id, side ORDER BY tier, place, unit_id) AS r FROM j JOIN (SELECT question_id, count(DISTINCT side) AS n FROM j GROUP BY 1) USING (question_id)),
w AS (SELECT *, cost AS spent, true AS kept FROM s WHERE r = 1 UNION ALL SELECT s.*, CASE WHEN w.spent + s.cost > s.share THEN w.spent ELSE w.spent + s.cost END, w.spent + s.cost <= s.share FROM w JOIN s ON s.question_id = w.question_id AND s.side = w.side AND s.r = w.r + 1),
m AS (SELECT question_id, unit_id, min((side, r)) AS first_at, arg_max(authority, (side, r)) AS authority, arg_max(score, (side, r)) AS score, arg_max(cost, (side, r)) AS cost FROM w WHERE kept GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE authority WHEN 'law' THEN 0 WHEN 'guidance' THEN 1 WHEN 'code' THEN 2 ELSE 3 END, first_at) AS place FROM m)
SELECT question_id, unit_id, authority, score, place, 'E' || place AS label, cost FROM f""",
    "evidence_blocks": r"""WITH u AS (SELECT DISTINCT ON (unit_id) * FROM structural_unit ORDER BY unit_id), v AS (SELECT DISTINCT document_version_id, version_label, lower(authority) AS authority, title FROM document_version JOIN legal_source USING (source_id)),
c AS (SELECT *, CASE WHEN authority <> 'law' THEN title || coalesce(' ' || nullif(unit_number, ''), '') WHEN unit_type IN ('article', 'annex', 'recital', 'chapter', 'section', 'paragraph') AND nullif(unit_number, '') IS NOT NULL THEN upper(unit_type[1]) || unit_type[2:] || ' ' || unit_number ELSE unit_path END AS label,
  concat_ws('; ', CASE authority WHEN 'law' THEN 'BINDING LAW' WHEN 'guidance' THEN 'COMMISSION GUIDANCE (not binding)' WHEN 'code' THEN 'VOLUNTARY CODE OF PRACTICE (not binding)' END, version_label) AS src FROM u JOIN v USING (document_version_id))
SELECT unit_id, md5('[E' || unit_id || '] ' || label || coalesce(' - ' || nullif(heading, ''), '') || CASE WHEN src <> '' THEN '  (' || src || ')' ELSE '' END || coalesce(chr(10) || 'Where it sits: ' || regexp_replace(nullif(context, ''), '^(Section \d+): [^›|]*', '\1 '), '') || chr(10) || coalesce(text, '')) AS block FROM c""",
    "parsed_headings": r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(concat_ws(' ', CASE WHEN unit_type = 'article' THEN 'Article' ELSE upper(unit_type) END, unit_number, heading) || chr(10) || coalesce(text, ''), '\r?\n|\x0c')) AS raw FROM (SELECT DISTINCT ON (unit_id) unit_id AS doc_id, * FROM structural_unit ORDER BY unit_id)), n AS (SELECT doc_id, regexp_replace(raw, '^[\s\x0B\x1c-\x1f\x{85}\p{Z}]+|[\s\x0B\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS line FROM s),
k AS (SELECT doc_id, regexp_replace(regexp_replace(line, '[▲▼►◄]', '', 'g'), '^[\s\x0B\x1c-\x1f\x{85}\p{Z}]+|[\s\x0B\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS line FROM n WHERE NOT regexp_matches(line, '^[▲▼►◄]\s*[BM]\d*\s*$') AND NOT regexp_matches(line, '^\S+\s+—\s+[A-Z]{2}\s+—\s+[\d.]+\s+—\s+[\d.]+\s+—\s+\d+\s*$') AND NOT regexp_matches(line, '^(OJ\s+[LC],|ELI:|\d+/\d+\s+ELI:|https?://data\.europa\.eu/)')),
h AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^Article\s+\d+[a-z]?\b') THEN 'article' WHEN regexp_matches(line, '^CHAPTER\s+[IVXLC]+\b') THEN 'chapter' WHEN regexp_matches(line, '^ANNEX\s+([IVXLC]+|\d+)\b') THEN 'annex' WHEN regexp_matches(line, '^SECTION\s+([IVXLC]+|\d+)\b') THEN 'section' END AS unit_type,
  regexp_extract(line, '^\w+\s+(\d+[a-z]?|[IVXLC]+)', 1) AS number FROM k)
SELECT doc_id, unit_type, count(*) AS n, string_agg(number, ',' ORDER BY number) AS numbers FROM h WHERE unit_type IS NOT NULL GROUP BY ALL""",
    "verify_quotes": _verify_sql(),
}
QUERIES = {f.__name__: f for f in (search_tasks, control_flow, round_outcomes, collected_evidence, conversation_turns, evidence_blocks, parsed_headings, parsed_documents)}
