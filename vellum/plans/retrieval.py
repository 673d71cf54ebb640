"""Queries for retrieval legs and document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import retrieval as R
from vellum.operators import structure as S
from vellum.sources.tables import table


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "structural_unit").dropDuplicates(["unit_id"]).withColumn("parent_id", F.nullif("parent_id", F.lit(0)))


def active(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    return R.active_units(table(spark, folder, "structural_unit"), table(spark, folder, "document_version"), table(spark, folder, "legal_source"), keys)


def active_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return active(spark, folder).select("unit_id", "document_version_id", "source_key", "authority", "unit_type", "unit_path", "ordinal")


# Words that are not searched.
STOP_WORDS = "a an and are as at be but by can do does for from had has have how i if in is it its long may me must need needs of on only or shall should than that the their there this to was what when where which who why will with would you your".split()
KEYS = ["karmholt-ranking-ordinance", "rovano-tariffs-guide"]


def source_filtered_scan(spark: SparkSession, folder: str) -> DataFrame:
    return active(spark, folder, KEYS).select("unit_id", "source_key")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    row = vectors.where("vec_id = 0").first()
    query = list(row["embedding"] or []) if row else []  # without the query vector, nothing is near
    return R.nearest(vectors if query else vectors.limit(0), query, 20).withColumn("distance", F.round("distance", 6))


def dense_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    found = R.nearest_batch(vectors, vectors.where("vec_id % 50 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "place")


def fulltext_and_match(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct questions with search words against all units."""
    asked = table(spark, folder, "query_log").select(F.col("question").alias("query")).where("query is not null").distinct()
    terms = F.array_except(T.words(F.col("query")), F.array(*map(F.lit, STOP_WORDS)))
    found = R.match_all(_units(spark, folder), asked.select("query", terms.alias("terms")))
    return found.withColumn("score", F.round("score", 6))


def structural_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return R.structural_lookup(active(spark, folder), ["12", "19", "33"], ["iv", "VI"]).select("unit_id", "unit_type", "unit_number", "unit_path")


def named_articles(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "query_log").select("question").where("question is not null").distinct()
    return asked.select("question", F.explode(T.named_articles(F.col("question"))).alias("article"))


def code_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of codes in sentences made of the units' places and numbers."""
    said = F.concat(F.lit("See commitment "), F.col("ordinal").cast("string"), F.lit(" and Sub-Measure "), F.col("unit_number"))
    texts = table(spark, folder, "structural_unit").select(F.col("unit_id").alias("doc_id"), F.explode(T.code_parts(said)).alias("part"))
    return texts.groupBy("doc_id", "part").agg(F.count("*").alias("n"))


def corrected_intent(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "query_log").dropDuplicates(["query_id"])
    fixed = log.select("query_id", F.lower(F.trim("intent")).alias("intent"), T.corrected_intent(F.lower(F.trim("intent")), F.col("question")).alias("corrected"))
    return fixed.where("intent <> corrected")


def child_scan(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("parent_id").orderBy("ordinal", "unit_id")
    return _units(spark, folder).where("parent_id is not null").select("parent_id", "unit_id", F.row_number().over(order).cast("bigint").alias("position"))


def ancestor_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    return S.ancestor_pairs(_units(spark, folder), "document_version_id", "unit_id", "unit_path").select("document_version_id", "unit_id", "ancestor")


def subtree_sizes(spark: SparkSession, folder: str) -> DataFrame:
    pairs = S.ancestor_pairs(_units(spark, folder), "document_version_id", "unit_id", "unit_path")
    return pairs.groupBy("ancestor").agg(F.count("*").alias("below"))


def outline(spark: SparkSession, folder: str) -> DataFrame:
    return S.outline(_units(spark, folder))


def next_boundary_slice(spark: SparkSession, folder: str) -> DataFrame:
    starts = _units(spark, folder).where("unit_type = 'article'").select("document_version_id", "unit_id", "ordinal").withColumn("position", F.col("ordinal").cast("bigint") * 1_000_000_000 + F.col("unit_id"))
    return S.next_boundary(starts, ["document_version_id"], "position").select("unit_id", "position", "next_at")


def keep_last_heading(spark: SparkSession, folder: str) -> DataFrame:
    headed = _units(spark, folder).where("heading is not null").select("document_version_id", "heading", F.struct("ordinal", "unit_id").alias("at"))
    return S.keep_last(headed, ["document_version_id", "heading"], "at").select("document_version_id", "heading", F.col("at.unit_id").alias("unit_id"))


def lis_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Article numbers of each version that form a longest increasing run in document order."""
    articles = _units(spark, folder).where("unit_type = 'article' and unit_number is not null").select("document_version_id", (F.col("ordinal").cast("bigint") * 1_000_000_000 + F.col("unit_id")).alias("at"), F.regexp_extract("unit_number", r"(\d+)", 1).cast("int").alias("number")).where("number is not null")

    def keep(values: list) -> list[int]:
        kept = set(S.longest_increasing(values))
        return [i in kept for i in range(len(values))]

    return S.per_document(articles, "document_version_id", "at", "number", keep, "kept").where("kept = 1").groupBy("document_version_id").agg(F.count("*").alias("length"))


_LEVELS = ("recital", "chapter", "section", "article", "paragraph", "point")


def depth_stack_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest earlier unit of a higher level, by document order."""
    level = F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("unit_type")).cast("int")
    rows = _units(spark, folder).select("document_version_id", (F.col("ordinal").cast("bigint") * 1_000_000_000 + F.col("unit_id")).alias("at"), level.alias("level"))
    return S.per_document(rows, "document_version_id", "at", "level", S.stack_parents, "above")


def paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    return S.paragraphs(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "paragraph_no", "label", F.length("paragraph").cast("bigint").alias("n"))


def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    parts = lines.select("doc_id", "line_no", F.posexplode(S.fitting_pieces(F.col("line"), 500)).alias("part_no", "line"))
    priced = parts.select("doc_id", F.struct("line_no", "part_no").alias("at"), T.estimate_tokens(F.col("line")).alias("cost"))
    return S.greedy_chunks(priced, "doc_id", "at", "cost").select("doc_id", "at.*", "cost", "chunk_no")


def citation_labels(spark: SparkSession, folder: str) -> DataFrame:
    units = active(spark, folder)
    label = T.citation_label(F.col("unit_type"), F.col("unit_number"), F.col("unit_path"), F.col("authority"), F.col("title"))
    return units.select("unit_id", label.alias("label"))


def deeplinks(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "document_version").where("celex is not null").select("document_version_id", "celex")
    link = T.deeplink("https://register.example/text", F.col("celex"), F.col("unit_type"), F.col("unit_number"), F.col("unit_path"))
    return _units(spark, folder).join(versions, "document_version_id").select("unit_id", link.alias("link"))


_U = "WITH u AS (SELECT DISTINCT ON (unit_id) * REPLACE (nullif(parent_id, 0) AS parent_id) FROM structural_unit ORDER BY unit_id)"
_A = _U + ", a AS (SELECT u.*, v.source_id, s.source_key, s.title, lower(s.authority) AS authority FROM u JOIN document_version v USING (document_version_id) JOIN legal_source s USING (source_id) WHERE v.status = 'active')"
_W = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''))"
_ART = "nullif(regexp_extract(unit_path, '(?:^|/)ART_([^/]+)', 1), '')"
SQL = {
    "active_chunks": _A + " SELECT unit_id, document_version_id, source_key, authority, unit_type, unit_path, ordinal FROM a",
    "source_filtered_scan": _A + " SELECT unit_id, source_key FROM a WHERE source_key IN ('karmholt-ranking-ordinance', 'rovano-tariffs-guide')",
    "dense_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q.e), 6) AS distance FROM embeddings, q ORDER BY 1 - list_dot_product(embedding::DOUBLE[], q.e), vec_id LIMIT 20""",
    "dense_topk_batch": """WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS place FROM d) SELECT query_id, vec_id, round(distance, 6) AS distance, place FROM r WHERE place <= 10""",
    "fulltext_and_match": _U
    + f""", q AS (SELECT DISTINCT question AS query, list_filter({_W.format('question')}, lambda w: NOT list_contains({STOP_WORDS}, w)) AS terms FROM query_log WHERE question IS NOT NULL),
w AS (SELECT unit_id, {_W.format('text')} AS words FROM u)
SELECT query, unit_id, round(len(terms)::DOUBLE / len(words), 6) AS score FROM q, w WHERE len(terms) >= 1 AND list_has_all(words, terms)""",
    "structural_lookup": _A
    + f""" SELECT unit_id, unit_type, unit_number, unit_path FROM a WHERE unit_type = 'article' AND unit_number IN ('12', '19', '33') OR unit_type = 'annex' AND upper(unit_number) IN ('IV', 'VI')
OR unit_type = 'paragraph' AND {_ART} IN ('12', '19', '33') ORDER BY ordinal, unit_id LIMIT 40""",
    "named_articles": r"""WITH q AS (SELECT DISTINCT question FROM query_log WHERE question IS NOT NULL),
g AS (SELECT question, unnest(regexp_extract_all(question, '(?i)\bArticles?\s+(\d+[a-z]?(?:\s*(?:,|and|or|to)\s*\d+[a-z]?)*)', 1)) AS g FROM q)
SELECT question, unnest(regexp_extract_all(g, '\d+[a-z]?')) AS article FROM g""",
    "code_parts": r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(?:commitment|sub-measure|measure|appendix)\s+\d+(?:\.\d+)*')) AS m FROM (SELECT unit_id AS doc_id, 'See commitment ' || ordinal || ' and Sub-Measure ' || unit_number AS text FROM structural_unit)),
p AS (SELECT doc_id, regexp_extract(m, '^(\S+)', 1) AS k, regexp_extract(m, '(\S+)$', 1) AS n FROM m)
SELECT doc_id, upper(k[1]) || lower(k[2:]) || ' ' || n AS part, count(*) AS n FROM p GROUP BY ALL""",
    "corrected_intent": r"""WITH l AS (SELECT DISTINCT query_id, lower(trim(intent)) AS intent, question FROM query_log)
SELECT query_id, intent, 'lookup' AS corrected FROM l WHERE intent IN ('greeting', 'out_of_scope') AND regexp_matches(question, '\bai act\b|\bartificial intelligence act\b|\b2024/1689\b|\bthis regulation\b|\barticle\s+\d|\bannex\s+[IVXLC]+\b|\brecital\s+\d', 'i')""",
    "child_scan": _U + " SELECT parent_id, unit_id, row_number() OVER (PARTITION BY parent_id ORDER BY ordinal, unit_id) AS position FROM u WHERE parent_id IS NOT NULL",
    "ancestor_prefix_join": _U + " SELECT x.document_version_id, x.unit_id, y.unit_id AS ancestor FROM u x JOIN u y ON x.document_version_id = y.document_version_id AND starts_with(x.unit_path, y.unit_path || '/')",
    "subtree_sizes": _U + " SELECT y.unit_id AS ancestor, count(*) AS below FROM u x JOIN u y ON x.document_version_id = y.document_version_id AND starts_with(x.unit_path, y.unit_path || '/') GROUP BY 1",
    "outline": _U + " SELECT parent_id, count(*) AS children, string_agg(heading, ' | ' ORDER BY ordinal, unit_id) AS headings FROM u WHERE parent_id IS NOT NULL AND trim(heading) <> '' GROUP BY 1 HAVING count(*) >= 2",
    "next_boundary_slice": _U + ", s AS (SELECT document_version_id, unit_id, ordinal::BIGINT * 1000000000 + unit_id AS position FROM u WHERE unit_type = 'article') SELECT unit_id, position, lead(position) OVER (PARTITION BY document_version_id ORDER BY position) AS next_at FROM s",
    "keep_last_heading": _U + " SELECT document_version_id, heading, arg_max(unit_id, (ordinal, unit_id)) AS unit_id FROM u WHERE heading IS NOT NULL GROUP BY ALL",
    "paragraph_split": r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, nullif(regexp_extract(line, '^(\d+[a-z]?)\.\s+\S', 1), '') AS label FROM l),
p AS (SELECT *, count(label) OVER (PARTITION BY doc_id ORDER BY i) AS paragraph_no FROM n)
SELECT doc_id, paragraph_no, max(label) AS label, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n FROM p GROUP BY doc_id, paragraph_no""",
    "citation_labels": _A
    + """ SELECT unit_id, CASE WHEN authority <> 'law' THEN title || coalesce(' ' || nullif(unit_number, ''), '')
WHEN unit_type IN ('article', 'annex', 'recital', 'chapter', 'section', 'paragraph') AND nullif(unit_number, '') IS NOT NULL THEN upper(unit_type[1]) || unit_type[2:] || ' ' || unit_number ELSE unit_path END AS label FROM a""",
    "deeplinks": _U
    + f""" SELECT unit_id, 'https://register.example/text?uri=CELEX%3A' || url_encode(celex) || coalesce('#' || CASE unit_type WHEN 'paragraph' THEN 'art_' || {_ART} WHEN 'article' THEN 'art_' || nullif(unit_number, '')
WHEN 'annex' THEN 'anx_' || nullif(unit_number, '') WHEN 'recital' THEN 'rct_' || nullif(unit_number, '') WHEN 'chapter' THEN 'cpt_' || nullif(unit_number, '') END, '') AS link
FROM u JOIN document_version USING (document_version_id) WHERE celex IS NOT NULL""",
}
QUERIES = {
    f.__name__: f
    for f in (
        active_chunks, source_filtered_scan, dense_topk, dense_topk_batch, fulltext_and_match, structural_lookup, named_articles, code_parts, corrected_intent, child_scan,
        ancestor_prefix_join, subtree_sizes, outline, next_boundary_slice, keep_last_heading, lis_headings, depth_stack_parents, paragraph_split, chunk_pack, citation_labels, deeplinks,
    )
}
