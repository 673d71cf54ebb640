"""Retrieval legs: dense nearest neighbours, keyword match, structural lookup, over active units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.models import embedder
from vellum.functions.text import article_of, code_parts, named_articles, words
from vellum.session import Cuts

#: Query vectors per block, about; a block is what every task holds besides its own rows.
BLOCK = 2_000


def active_units(units: DataFrame, versions: DataFrame, sources: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Units of active versions with their source. `keys` None: no filter; an empty list: no rows.

    The version filter reaches the scan; Spark broadcasts either side only below its size limit.
    """
    active = versions.where(F.col("status") == "active").select("document_version_id", "source_id", "version_label")
    named = sources.select("source_id", "source_key", "title", F.lower("authority").alias("authority"))
    if keys is not None:
        named = named.where(F.col("source_key").isin(keys))
    own = units.select("unit_id", "document_version_id", "parent_id", "unit_type", "unit_number", "unit_path", "heading", "text", "ordinal")
    return own.join(active, "document_version_id").join(named, "source_id").dropDuplicates(["unit_id"])


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query by cosine distance of unit vectors; ties by key. Null vectors are left out."""
    literal = F.array(*(F.lit(float(x)) for x in query)).cast("array<double>")
    dot = F.aggregate(F.zip_with(F.col(vector), literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.where(F.col(vector).isNotNull()).select(key, (F.lit(1.0) - dot).alias("distance")).orderBy("distance", key).limit(k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, asked: str | None = None) -> DataFrame:
    """(query_id, key, distance, place): the k rows nearest to each query, over all rows, exactly.

    `asked` names the queries' id column (default: key). Queries go through in blocks of a bounded
    size: the driver holds one block at a time, every task scores its batches by one matrix product
    and passes on its own k best per query only, and a block's result is stored before the next.
    """
    asked = asked or key
    kinds = {key: vectors.schema[key].dataType.simpleString(), "query_id": queries.schema[asked].dataType.simpleString()}
    cuts = Cuts(vectors.sparkSession)
    wanted = queries.where(F.col(vector).isNotNull()).select(F.col(asked).alias("query_id"), vector).dropDuplicates(["query_id"])
    stored = cuts.cut(wanted.withColumn("hash", F.xxhash64("query_id")))
    rows = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-stored.count() * 5 // (4 * block)))
    if blocks > 1:
        rows = cuts.cut(rows)  # it is read once per block
    ddl = f"query_id {kinds['query_id']}, {key} {kinds[key]}, distance double"
    rank = Window.partitionBy("query_id").orderBy(F.round("distance", 9), key)
    parts: list[DataFrame] = []
    for b in range(blocks):
        held = stored.where(F.pmod("hash", F.lit(blocks)) == b).select("query_id", vector).collect()
        if not held and blocks > 1:
            continue
        ids = [r[0] for r in held]
        matrix = np.array([r[1] for r in held], np.float64).reshape(len(held), -1 if held else 0)

        def score(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not ids or not batch.num_rows:
                    continue
                own = np.array(batch.column(1).to_pylist(), np.float64)
                distance = 1.0 - matrix @ own.T
                n = min(k, batch.num_rows)
                best = np.argpartition(distance, n - 1, axis=1)[:, :n]
                worst = np.take_along_axis(distance, best, 1).max(axis=1)
                q, r = np.nonzero(distance <= worst[:, None] + 1e-9)  # ties at the edge stay in
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), batch.column(0).take(pa.array(r)), pa.array(distance[q, r])], names=["query_id", key, "distance"])

        near = rows.mapInArrow(score, ddl).withColumn("place", F.row_number().over(rank).cast("bigint")).where(F.col("place") <= k)
        parts.append(cuts.cut(near) if blocks > 1 else near)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def match_all(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, unit_id, score): units that hold all words of a query, with the share of those words.

    `units`: unit_id, text; `queries`: query, terms (array). Each query is joined on its rarest word
    only, and its other words are then checked against the unit's own word list. Queries without
    words match nothing.
    """
    listed = units.select("unit_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    asked = queries.where(F.size("terms") > 0).select("query", "terms").dropDuplicates(["query"])
    found = _on_rarest(listed.select("unit_id", F.explode("words").alias("word")), asked, "query")
    hits = found.join(asked, "query").join(listed, "unit_id").where(F.size(F.array_except("terms", "words")) == 0)
    return hits.select("query", "unit_id", (F.size("terms") / F.size("words")).alias("score"))


def _on_rarest(postings: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """(by, unit_id): units with the rarest of each query's terms. Postings hold no more than a word and an id."""
    terms = asked.select(by, F.explode("terms").alias("word"))
    frequency = postings.join(terms.select("word").distinct(), "word", "left_semi").groupBy("word").count()
    rarest = terms.join(frequency, "word", "left").groupBy(by).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word")).alias("r")).select(by, "r.word")
    return postings.join(rarest, "word").select(by, "unit_id")


# Endings that a light stem takes off, in order.
STEMS = ((r"sses$", "ss"), (r"ies$", "i"), (r"([^s])s$", r"$1"), (r"([aeiouy].*[a-z])(?:ing|ed)$", r"$1"), (r"y$", "i"), (r"([a-z]{3,})e$", r"$1"))


def stem(word: Column) -> Column:
    """A light stem for English endings; other words stay as they are."""
    for pattern, to in STEMS:
        word = F.regexp_replace(word, pattern, to)
    return word


def stems(text: Column) -> Column:
    """The stems of a text in order, repeats included."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(split, lambda w: w != ""), stem)


def parsed_search(queries: DataFrame, text: str, stop: list[str]) -> DataFrame:
    """(query, alt, terms, phrases, barred): what a search text asks for, by alternative.

    Bare words all have to occur, "quoted words" one after the other, -words not at all; `or` (outside
    quotes) separates alternatives. Stop words are not asked for. An alternative without terms finds nothing.
    """
    alternatives = F.split(F.coalesce(text, F.lit("")), r'(?i)\s+or\s+(?=(?:[^"]*"[^"]*")*[^"]*$)')
    split = queries.select("query", F.posexplode(alternatives).alias("alt", "part"))
    phrases = F.filter(F.transform(F.regexp_extract_all("part", F.lit('"([^"]*)"'), F.lit(1)), stems), lambda p: F.size(p) > 0)
    open_ = F.regexp_replace("part", '"[^"]*"', " ")
    barred = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(open_, F.lit(r"(?:^|\s)-([\p{L}\p{M}\p{N}]+)"), F.lit(1)), stems)))
    bare = F.regexp_replace(open_, r"(?:^|\s)-[\p{L}\p{M}\p{N}]+", " ")
    kept = F.array_except(stems(bare), F.array(*(stem(F.lit(w)) for w in stop)))
    terms = F.array_distinct(F.concat(kept, F.flatten(phrases)))
    return split.select("query", "alt", terms.alias("terms"), F.transform(phrases, lambda p: F.array_join(p, " ")).alias("phrases"), barred.alias("barred"))


def search(units: DataFrame, parsed: DataFrame) -> DataFrame:
    """(query, unit_id, score): units that meet one of a query's alternatives; score is the share of its terms.

    `units`: unit_id, text; `parsed`: as from parsed_search. Each alternative is joined on its rarest
    term; only the units found there are then read as a whole.
    """
    listed = units.select("unit_id", stems(F.col("text")).alias("words")).where(F.size("words") > 0)
    asked = parsed.where(F.size("terms") > 0).withColumn("at", F.struct("query", "alt"))
    found = _on_rarest(listed.select("unit_id", F.explode(F.array_distinct("words")).alias("word")), asked.select("at", "terms"), "at")
    rows = found.join(asked, "at").join(listed, "unit_id")
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    meets = (F.size(F.array_except("terms", "words")) == 0) & (F.size(F.array_intersect("barred", "words")) == 0)
    meets = meets & F.forall("phrases", lambda p: F.contains(line, F.concat(F.lit(" "), p, F.lit(" "))))
    share = F.size(F.filter("words", lambda w: F.array_contains("terms", w))) / F.size("words")
    return rows.where(meets).groupBy("query", "unit_id").agg(F.max(share).alias("score"))


#: Fixed value: numbers of annexes that a question names.
NAMED_ANNEXES = r"(?i)\bAnnex(?:es)?\s+([IVXLC]+)\b"


def asked_keys(question: Column) -> Column:
    """What a question names: `article 6`, `annex III`, `part measure 1.2`."""
    articles = F.transform(named_articles(question), lambda a: F.concat(F.lit("article "), F.lower(a)))
    annexes = F.transform(F.regexp_extract_all(question, F.lit(NAMED_ANNEXES), F.lit(1)), lambda a: F.concat(F.lit("annex "), F.upper(a)))
    parts = F.transform(code_parts(question), lambda p: F.concat(F.lit("part "), F.lower(p)))
    return F.array_distinct(F.concat(articles, annexes, parts))


def unit_key(authority: Column) -> Column:
    """The key under which a unit is found by name: articles and their paragraphs, annexes, and parts of a
    code (`S1 Measure 1.2` under `part measure 1.2`); null for others."""
    part = F.regexp_extract("unit_number", r"(?i)(?:^| )((?:commitment|sub-measure|measure|appendix) \d+(?:\.\d+)*)$", 1)
    return (
        F.when(F.col("unit_type") == "article", F.concat(F.lit("article "), F.lower("unit_number")))
        .when(F.col("unit_type") == "annex", F.concat(F.lit("annex "), F.upper("unit_number")))
        .when(F.col("unit_type") == "paragraph", F.concat(F.lit("article "), F.lower(article_of(F.col("unit_path")))))
        .when((authority == "code") & (part != ""), F.concat(F.lit("part "), F.lower(part)))
    )


def named_units(units: DataFrame, questions: DataFrame, limit: int = 40) -> DataFrame:
    """(query, unit_id, place): the units each question names, in document order. An equality join on the name.

    `units`: unit_id, unit_type, unit_number, unit_path, authority, ordinal; `questions`: query, text.
    """
    keyed = units.select("unit_id", "ordinal", unit_key(F.col("authority")).alias("key")).where("key is not null")
    asked = questions.select("query", F.explode(asked_keys(F.col("text"))).alias("key"))
    found = asked.join(keyed, "key").select("query", "unit_id", "ordinal").distinct()
    order = Window.partitionBy("query").orderBy("ordinal", "unit_id")
    return found.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= limit).drop("ordinal")


def legs(units: DataFrame, questions: DataFrame, stop: list[str], candidates: int = 20, dim: int = 64) -> DataFrame:
    """(query, unit_id, leg, leg_rank): the dense, full-text and structural hits of each question.

    `units`: active units with text, heading, authority and the columns of named_units; `questions`: query, text.
    """
    embed = embedder(dim)
    searched = units.select("unit_id", F.concat_ws("\n", "heading", "text").alias("text"))
    vectors = searched.select("unit_id", embed(F.col("text")).alias("embedding"))
    dense = nearest_batch(vectors, questions.select("query", embed(F.col("text")).alias("embedding")), candidates, "unit_id", asked="query")
    words_hit = search(searched, parsed_search(questions, "text", stop))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "unit_id")
    full = words_hit.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= candidates)
    named = named_units(units, questions)
    leg = lambda df, name, query="query": df.select(F.col(query).alias("query"), "unit_id", F.lit(name).alias("leg"), F.col("place").alias("leg_rank"))
    return leg(dense, "dense", "query_id").unionByName(leg(full, "fulltext")).unionByName(leg(named, "structural"))


def structural_lookup(units: DataFrame, articles: list[str], annexes: list[str], limit: int = 40) -> DataFrame:
    """Units named by number: articles, annexes, and paragraphs of named articles; in document order."""
    numbers = [a.strip() for a in articles]
    roman = [a.strip().upper() for a in annexes]
    named = (
        ((F.col("unit_type") == "article") & F.col("unit_number").isin(numbers))
        | ((F.col("unit_type") == "annex") & F.upper("unit_number").isin(roman))
        | ((F.col("unit_type") == "paragraph") & article_of(F.col("unit_path")).isin(numbers))
    )
    return units.where(named).orderBy("ordinal", "unit_id").limit(limit)
