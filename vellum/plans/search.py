"""Queries for retrieval from question to evidence, with every leg computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.models import overlap_score
from vellum.operators import ranking as R
from vellum.operators import retrieval as V
from vellum.plans.retrieval import KEYS, STOP_WORDS, active
from vellum.session import Cuts
from vellum.sources.tables import table

WEIGHTS = {"structural": 2.0}
CANDIDATES = 20


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of the rows whose id is divisible by 50, each text once, under its smallest id."""
    log = table(spark, folder, "query_log").where("query_id % 50 = 0 and question is not null")
    return log.groupBy(F.col("question").alias("text")).agg(F.min("query_id").alias("query"))


def fulltext_search(spark: SparkSession, folder: str) -> DataFrame:
    """Search texts with phrases, alternatives and barred words against all units."""
    asked = _questions(spark, folder)
    made = asked.select("query", F.concat(F.lit('"'), F.regexp_extract("text", r"(\w+ \w+)\W*$", 1), F.lit('" or '), F.col("text"), F.lit(" -article")).alias("text"))
    units = table(spark, folder, "structural_unit").select("unit_id", "text").dropDuplicates(["unit_id"])
    found = V.search(units, V.parsed_search(made, "text", STOP_WORDS))
    return found.select("query", "unit_id", F.round("score", 6).alias("score"))


def structural_search(spark: SparkSession, folder: str) -> DataFrame:
    """Units of two sources that each question names."""
    return V.named_units(active(spark, folder, KEYS), _questions(spark, folder)).select("query", "unit_id", "place")


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    hits = V.legs(active(spark, folder), _questions(spark, folder), STOP_WORDS, CANDIDATES)
    return R.fuse(hits, ["query"], "unit_id", WEIGHTS).where(F.col("place") <= CANDIDATES)


def hybrid_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """The fused first candidates of each question, with their rank in each leg."""
    return _fused(spark, folder).select("query", "unit_id", F.round("score", 9).alias("score"), F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("legs"), "place")


def research_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """From question to labelled evidence: legs, fusion, reranking, expansion to articles, binding law first.

    Questions without a passage above the threshold have no evidence."""
    fused = Cuts(spark).cut(_fused(spark, folder))
    units = active(spark, folder)
    passages = fused.join(units.select("unit_id", "text"), "unit_id").join(_questions(spark, folder).withColumnRenamed("text", "question"), "query")
    scored = passages.select("query", "unit_id", F.col("place").alias("prior"), overlap_score(F.col("question"), F.col("text")).alias("score"))
    kept = R.keep_best(scored, ["query"], "prior").where(F.col("score") >= R.MIN_SCORE)
    found = R.expand_to_parents(kept.withColumn("chunk_id", F.col("unit_id")), units, ["query"])
    order = Window.partitionBy("query").orderBy(R.tier(F.col("authority")), "place", "unit_id")
    ranked = found.join(units.select("unit_id", "authority"), "unit_id").withColumn("place", F.row_number().over(order).cast("bigint"))
    return R.label(ranked).select("query", "unit_id", F.round("score", 6).alias("score"), "authority", "label")


_STEM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'sses$', 'ss'), 'ies$', 'i'), '([^s])s$', '\\1'), '([aeiouy].*[a-z])(?:ing|ed)$', '\\1'), 'y$', 'i'), '([a-z]{{3,}})e$', '\\1')"


def _stems(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: {_STEM.format('w')})"


_STOP = f"list_transform({STOP_WORDS}, lambda w: {_STEM.format('w')})"
_BASE = """WITH u AS (SELECT DISTINCT ON (unit_id) * REPLACE (nullif(parent_id, 0) AS parent_id) FROM structural_unit ORDER BY unit_id),
a AS (SELECT u.*, source_key, lower(s.authority) AS authority FROM u JOIN (SELECT DISTINCT document_version_id, source_id FROM document_version WHERE status = 'active') USING (document_version_id) JOIN legal_source s USING (source_id)),
q AS (SELECT question AS text, min(query_id) AS query FROM query_log WHERE query_id % 50 = 0 AND question IS NOT NULL GROUP BY 1)"""
_KEYS = r""", ak AS (SELECT query, unnest(list_distinct(
  list_transform(flatten(list_transform(regexp_extract_all(text, '(?i)\bArticles?\s+(\d+[a-z]?(?:\s*(?:,|and|or|to)\s*\d+[a-z]?)*)', 1), lambda g: regexp_extract_all(g, '\d+[a-z]?'))), lambda x: 'article ' || lower(x))
  || list_transform(regexp_extract_all(text, '(?i)\bAnnex(?:es)?\s+([IVXLC]+)\b', 1), lambda x: 'annex ' || upper(x))
  || list_transform(regexp_extract_all(text, '(?i)\b(?:commitment|sub-measure|measure|appendix)\s+\d+(?:\.\d+)*'), lambda x: 'part ' || lower(regexp_replace(x, '\s+', ' '))))) AS key FROM q),
uk AS (SELECT unit_id, ordinal, source_key, CASE WHEN unit_type = 'article' THEN 'article ' || lower(unit_number) WHEN unit_type = 'annex' THEN 'annex ' || upper(unit_number)
  WHEN unit_type = 'paragraph' THEN 'article ' || lower(nullif(regexp_extract(unit_path, '(?:^|/)ART_([^/]+)', 1), ''))
  WHEN authority = 'code' THEN 'part ' || lower(nullif(regexp_extract(unit_number, '(?i)(?:^| )((?:commitment|sub-measure|measure|appendix) \d+(?:\.\d+)*)$', 1), '')) END AS key FROM a),
nu AS (SELECT query, unit_id, row_number() OVER (PARTITION BY query ORDER BY ordinal, unit_id) AS place FROM (SELECT DISTINCT query, unit_id, ordinal FROM ak JOIN uk USING (key) WHERE {where}) QUALIFY place <= 40)"""
_FUSED = (
    _BASE
    + _KEYS.replace("{where}", "true")
    + f""", t AS (SELECT unit_id, concat_ws(chr(10), heading, text) AS text FROM a),
wq AS (SELECT query AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM q),
wu AS (SELECT unit_id AS id, unnest(list_filter(string_split_regex(lower(text), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')) AS w FROM t),
vq AS (SELECT id, ('0x' || md5(w)[1:6])::BIGINT % 64 AS b, sum(CASE WHEN md5(w)[7] <= '7' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM wq GROUP BY ALL),
vu AS (SELECT id, ('0x' || md5(w)[1:6])::BIGINT % 64 AS b, sum(CASE WHEN md5(w)[7] <= '7' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM wu GROUP BY ALL),
nq AS (SELECT id, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS x, b FROM vq), nv AS (SELECT id, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY id)), 0) AS x, b FROM vu),
dot AS (SELECT q.id AS query, u.id AS unit_id, sum(q.x * u.x) AS d FROM nq q JOIN nv u USING (b) GROUP BY ALL),
dn AS (SELECT q.query, t.unit_id, row_number() OVER (PARTITION BY q.query ORDER BY round(1 - coalesce(d, 0), 9), t.unit_id) AS place FROM q CROSS JOIN t LEFT JOIN dot ON dot.query = q.query AND dot.unit_id = t.unit_id QUALIFY place <= 20),
sq AS (SELECT query, list_distinct(list_filter({_stems("unnest(string_split_regex(text, '(?i)\\s+or\\s+'))")}, lambda w: NOT list_contains({_STOP}, w))) AS terms FROM q),
su AS (SELECT unit_id, {_stems('text')} AS words FROM t),
fs AS (SELECT query, unit_id, max(len(list_filter(words, lambda w: list_contains(terms, w)))::DOUBLE / len(words)) AS score FROM sq JOIN su ON len(terms) > 0 AND list_has_all(words, terms) GROUP BY ALL),
ft AS (SELECT query, unit_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, unit_id) AS place FROM fs QUALIFY place <= 20),
l AS (SELECT 'dense' AS leg, * FROM dn UNION ALL SELECT 'fulltext', * FROM ft UNION ALL SELECT 'structural', * FROM nu),
f AS (SELECT query, unit_id, sum(CASE WHEN leg = 'structural' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + place)) AS score, min(struct_pack(leg := leg, r := place)) AS first, string_agg(leg || ':' || place, ',' ORDER BY leg) AS legs FROM l GROUP BY ALL),
h AS (SELECT query, unit_id, score, legs, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, first, unit_id) AS place FROM f QUALIFY place <= 20)"""
)
SQL = {
    "fulltext_search": _BASE
    + rf""", m AS (SELECT query, text, regexp_extract(text, '(\w+ \w+)\W*$', 1) AS ph FROM q),
p AS (SELECT query, 0 AS alt, {_stems('ph')} AS terms, array_to_string({_stems('ph')}, ' ') AS phrase, [] AS barred FROM m
  UNION ALL SELECT query, 1, unnest([{_stems('text')}]), NULL, [] FROM m WHERE false),
x AS (SELECT query, unnest(string_split_regex(text || ' -article', '(?i)\s+or\s+')) AS part FROM m),
y AS (SELECT query, list_distinct(list_filter({_stems("regexp_replace(part, '(?:^|' || chr(92) || 's)-[' || chr(92) || 'p{L}' || chr(92) || 'p{M}' || chr(92) || 'p{N}]+', ' ', 'g')")}, lambda w: NOT list_contains({_STOP}, w))) AS terms,
  flatten(list_transform(regexp_extract_all(part, '(?:^|\s)-([\p{{L}}\p{{M}}\p{{N}}]+)', 1), lambda b: {_stems('b')})) AS barred FROM x),
su AS (SELECT unit_id, {_stems('text')} AS words FROM u),
hits AS (SELECT query, unit_id, len(list_filter(words, lambda w: list_contains(terms, w)))::DOUBLE / len(words) AS score FROM p JOIN su ON len(terms) > 0 AND list_has_all(words, terms) AND contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')
  UNION ALL SELECT query, unit_id, len(list_filter(words, lambda w: list_contains(terms, w)))::DOUBLE / len(words) FROM y JOIN su ON len(terms) > 0 AND list_has_all(words, terms) AND NOT list_has_any(words, barred))
SELECT query, unit_id, round(max(score), 6) AS score FROM hits GROUP BY ALL""",
    "structural_search": _BASE + _KEYS.replace("{where}", f"source_key IN ('{KEYS[0]}', '{KEYS[1]}')") + " SELECT query, unit_id, place FROM nu",
    "hybrid_retrieve": _FUSED + " SELECT query, unit_id, round(score, 9) AS score, legs, place FROM h",
    "research_evidence": _FUSED
    + r""", w AS (SELECT query, unit_id, place AS prior, list_distinct(list_filter(string_split_regex(lower(q.text), '\s+'), lambda w: w <> '')) AS wq, list_distinct(list_filter(string_split_regex(lower(coalesce(a.text, '')), '[\s\x0B\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')) AS wp FROM h JOIN a USING (unit_id) JOIN q USING (query)),
sc AS (SELECT query, unit_id, prior, CASE WHEN len(wq) > 0 THEN len(list_intersect(wq, wp))::DOUBLE / (len(wq) + 1.0::DOUBLE) ELSE 0 END AS score FROM w),
k AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY query ORDER BY score DESC, prior) AS r, row_number() OVER (PARTITION BY query ORDER BY prior) AS o FROM sc WINDOW p AS (PARTITION BY query) QUALIFY (n <= 4 OR r <= 4) AND score >= 0.005),
e AS (SELECT k.query, CASE WHEN x.unit_type = 'paragraph' AND y.unit_type = 'article' AND CAST(trunc(length(coalesce(y.text, '')) / 3.6::DOUBLE) AS BIGINT) + 32 <= 1200 THEN y.unit_id ELSE k.unit_id END AS unit_id, score, CASE WHEN n <= 4 THEN o ELSE r END AS place
  FROM k JOIN a x USING (unit_id) LEFT JOIN a y ON y.unit_id = x.parent_id),
g AS (SELECT query, unit_id, max(score) AS score, min(place) AS place FROM e GROUP BY ALL)
SELECT query, unit_id, round(score, 6) AS score, authority, 'E' || row_number() OVER (PARTITION BY query ORDER BY CASE authority WHEN 'law' THEN 0 WHEN 'guidance' THEN 1 WHEN 'code' THEN 2 ELSE 3 END, place, unit_id) AS label FROM g JOIN a USING (unit_id)""",
}
QUERIES = {f.__name__: f for f in (fulltext_search, structural_search, hybrid_retrieve, research_evidence)}
