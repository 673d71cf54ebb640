"""The document library: which version of a source is wanted, how it is fetched, and what a run did to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.structure import path_prefixes

# Longest error that is kept; numbers of the units of a code that head a group; seconds of a rate window.
LONGEST_ERROR = 4_000
GROUP_HEAD = r"(^| )Commitment [0-9]+$"
WINDOW = 60


def consolidated_prefix(celex: Column) -> Column:
    """What the numbers of consolidated versions begin with: 0 in place of the first character. An empty number is an error."""
    fault = F.raise_error(F.lit("a source without register number has no consolidated versions"))
    return F.when(F.length(celex) > 0, F.concat(F.lit("0"), F.substr(celex, F.lit(2)))).otherwise(fault)


def register_id(uri: Column) -> Column:
    """The last part of a work's address."""
    return F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1)


def tolerant_date(value: Column) -> Column:
    """The date in the first ten characters; null where there is none."""
    return F.substring(value, 1, 10).try_cast("date")


def base_works(sources: DataFrame, works: DataFrame) -> DataFrame:
    """(source_id, celex, doc_date, work): the work of each source's own number, null where the register has none.

    `sources`: source_id, celex; `works`: celex, doc_date, work. Of several the latest, then the greatest, stands.
    """
    best = works.groupBy("celex").agg(F.max(F.struct("doc_date", "work")).alias("w"))
    return sources.join(best, "celex", "left").select("source_id", "celex", "w.doc_date", "w.work")


def consolidated_versions(sources: DataFrame, works: DataFrame) -> DataFrame:
    """(source_id, celex, doc_date, place): the consolidated versions of each source, newest first, undated ones last.

    `sources`: source_id, prefix; `works`: celex, doc_date. A prefix condition becomes an equality on the
    part of the number before its hyphen.
    """
    named = works.select("celex", "doc_date", F.substring_index("celex", "-", 1).alias("prefix")).distinct()
    order = Window.partitionBy("source_id").orderBy(F.desc(F.coalesce("doc_date", F.lit("0001-01-01").cast("date"))), F.desc("celex"))
    return sources.join(named, "prefix").select("source_id", "celex", "doc_date", F.row_number().over(order).cast("bigint").alias("place"))


def targets(sources: DataFrame, base: DataFrame, consolidated: DataFrame) -> DataFrame:
    """(source_id, route, celex, doc_date, error): which version of each source should be live.

    `sources`: source_id, source_key, local_file, doc_date, use_consolidated. Local files stand under
    their source's key; a source whose version cannot be resolved has an error.
    """
    newest = consolidated.where("place = 1").select("source_id", F.struct("celex", "doc_date").alias("new"))
    first = base.where("work is not null").select("source_id", F.struct("celex", "doc_date").alias("old"))
    local = F.col("local_file").isNotNull()
    route = F.when(local, "local").when(F.col("use_consolidated"), "consolidated").otherwise("base")
    chosen = F.when(local, F.struct(F.col("source_key").alias("celex"), F.col("doc_date"))).when(F.col("use_consolidated"), F.col("new")).otherwise(F.col("old"))
    both = sources.join(newest, "source_id", "left").join(first, "source_id", "left").select("source_id", route.alias("route"), chosen.alias("v"))
    return both.select("source_id", "route", "v.celex", "v.doc_date", F.when(F.col("v").isNull(), F.concat(F.lit("no version for route "), "route")).alias("error"))


def renditions(responses: DataFrame, magic: bytes = b"%PDF-") -> DataFrame:
    """(name, format, url, size, sha256, error): of each document the PDF if one came, else the page.

    `responses`: name, kind (`pdf` or `html`), url, status, content. A PDF address that gives a page has
    failed; only status 200 counts; a document without a usable response has an error.
    """
    good = (F.col("status") == 200) & F.col("content").isNotNull() & ((F.col("kind") == "html") | (F.substring("content", 1, len(magic)) == F.lit(magic)))
    row = F.struct(F.when(F.col("kind") == "pdf", 0).otherwise(1).alias("rank"), "url", F.col("kind").alias("format"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    best = responses.groupBy("name").agg(F.min(F.when(good, row)).alias("r"))
    return best.select("name", "r.format", "r.url", "r.size", "r.sha256", F.when(F.col("r").isNull(), "no usable source").alias("error"))


def create_versions(versions: DataFrame, units: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, units) with each incoming version as `ingesting`; one that was there is reset and loses its units.

    `versions`: document_version_id, source_id, celex, version_label, content_sha256, status; `incoming`:
    source_id, celex, version_label, content_sha256. New ids follow the greatest there is.
    """
    known = versions.select("document_version_id", "source_id", "celex")
    same = (F.col("i.source_id") == F.col("k.source_id")) & (F.col("i.celex") == F.col("k.celex"))
    met = incoming.alias("i").join(known.alias("k"), same, "left").select("i.*", "k.document_version_id")
    top = versions.agg(F.coalesce(F.max("document_version_id"), F.lit(0)).alias("top"))
    order = Window.orderBy("source_id", "celex")  # one row per source that is ingested now
    new = met.where("document_version_id is null").join(top, F.lit(True)).withColumn("document_version_id", F.col("top") + F.row_number().over(order)).drop("top")
    old = met.where("document_version_id is not null")
    fresh = old.unionByName(new).withColumn("status", F.lit("ingesting")).select(*versions.columns)
    rest = versions.join(old.select("document_version_id"), "document_version_id", "left_anti").select(*versions.columns)
    return rest.unionByName(fresh), units.join(old.select("document_version_id"), "document_version_id", "left_anti")


def mark_failed(versions: DataFrame, failures: DataFrame) -> DataFrame:
    """Versions with those that failed marked: status failed, and the error's first LONGEST_ERROR characters. `failures`: document_version_id, error."""
    errors = failures.groupBy("document_version_id").agg(F.substring(F.min("error"), 1, LONGEST_ERROR).alias("error"))
    marked = versions.join(errors.withColumn("failed", F.lit(True)), "document_version_id", "left")
    return marked.withColumn("status", F.when(F.col("failed"), "failed").otherwise(F.col("status"))).drop("failed")


def check_runs(sources: DataFrame, active: DataFrame, found: DataFrame) -> DataFrame:
    """(source_id, outcome, active_mark, latest_mark, note) of a check of every source: unchanged, new_version or error.

    `sources`: source_id; `active`: source_id, mark; `found`: source_id, mark, error. A source about
    which nothing was found is an error too: a check always leaves a row.
    """
    both = sources.select("source_id").join(active.select("source_id", F.col("mark").alias("active_mark")), "source_id", "left").join(found.select("source_id", F.col("mark").alias("latest_mark"), "error"), "source_id", "left")
    error = F.coalesce("error", F.when(F.col("latest_mark").isNull(), "nothing found"))
    outcome = F.when(error.isNotNull(), "error").when(F.col("active_mark") == F.col("latest_mark"), "unchanged").otherwise("new_version")
    return both.select("source_id", outcome.alias("outcome"), "active_mark", "latest_mark", error.alias("note"))


def unit_outlines(asked: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, parent_id, n, outline): what lies beside each asked unit, one line per part.

    The group is that under the parent of the highest of the unit itself, its article or annex, and its
    commitment; groups of one part give no row. `asked`: unit_id; `units`: unit_id, document_version_id,
    unit_path, unit_type, unit_number, parent_id, heading, text, ordinal, one row per unit.
    """
    heads = units.where(F.col("unit_type").isin("article", "annex") | F.col("unit_number").rlike(GROUP_HEAD)).select("document_version_id", F.col("unit_path").alias("at"), "parent_id", F.col("unit_id").alias("head"))
    own = asked.join(units, "unit_id").select("unit_id", "document_version_id", "unit_path", "parent_id")
    above = own.select("unit_id", "document_version_id", F.explode(path_prefixes(F.col("unit_path"))).alias("at")).join(heads, ["document_version_id", "at"]).select("unit_id", F.length("at").alias("n"), "head", "parent_id")
    reached = above.unionByName(own.select("unit_id", F.length("unit_path").alias("n"), F.col("unit_id").alias("head"), "parent_id")).where("parent_id is not null")
    groups = reached.groupBy("unit_id").agg(F.min(F.struct("n", "head", "parent_id")).alias("r")).select("unit_id", F.col("r.parent_id").alias("parent_id"))
    line = F.substring_index("text", "\n", 1)
    titled = F.when(F.col("heading").isNull() | (F.col("heading") == "") | F.contains(line, F.col("heading")), line).when(F.contains(line, F.lit(":")), F.concat(F.substring_index(line, ":", 1), F.lit(": "), "heading")).otherwise(F.concat(line, F.lit(" "), "heading"))
    parts = units.join(groups.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", F.struct("ordinal", "unit_id", F.coalesce(titled, F.lit("")).alias("line")).alias("p"))
    lists = parts.groupBy("parent_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).where(F.size("ps") > 1)
    return groups.join(lists, "parent_id").select("unit_id", "parent_id", F.size("ps").alias("n"), F.array_join(F.transform("ps", lambda p: p["line"]), "\n").alias("outline"))


_WORDS = r"[\p{L}\p{M}\p{N}]+"


def containing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage, key): texts that hold a passage letter by letter. `passages`: passage; `texts`: key, text.

    Each passage meets only the texts that share its rarest sure key; the letters are compared there.
    Sure keys are its inner words; of two words the beginning of the second; of one word its first
    three letters, anywhere in a word; without a word its first character. Null and empty ones give no row.
    """
    found = F.regexp_extract_all("passage", F.lit(_WORDS), F.lit(0))
    asked = passages.where(F.length("passage") > 0).select("passage").distinct().withColumn("ws", found).withColumn("n", F.least(F.size("ws"), F.lit(3)))
    tag = lambda kind, x: F.concat(F.lit(kind), x)
    keys = (
        F.when(F.col("n") == 3, F.transform(F.slice("ws", F.lit(2), F.greatest(F.size("ws") - 2, F.lit(0))), lambda w: tag("w", w)))
        .when(F.col("n") == 2, F.array(tag("p", F.substring(F.get("ws", F.lit(1)), 1, 4))))
        .when(F.col("n") == 1, F.array(tag("g", F.substring(F.get("ws", F.lit(0)), 1, 3))))
        .otherwise(F.array(tag("c", F.substring("passage", 1, 1))))
    )
    asked = asked.select("passage", "n", F.explode(F.array_distinct(keys)).alias("word"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)))
    beginnings = lambda w: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length(w))), lambda i: tag("p", F.left(w, i)))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: tag("g", F.substr(w, i, F.lit(n))))
    of_kind = {
        3: F.transform(words, lambda w: tag("w", w)),
        2: F.flatten(F.transform(words, beginnings)),
        1: F.flatten(F.transform(words, lambda w: F.concat(*(grams(w, n) for n in (1, 2, 3))))),
        0: F.transform(F.split("text", ""), lambda c: tag("c", c)),
    }
    kinds = [r["n"] for r in asked.select("n").distinct().collect()]  # four at most
    if not kinds:
        return texts.select(F.lit("").alias("passage"), "key").limit(0)
    held = texts.where("text is not null")
    postings = held.select("key", F.explode(F.array_distinct(F.concat(*(of_kind[k] for k in kinds)))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    frequency = postings.groupBy("word").count()
    rarest = asked.join(frequency, "word", "left").groupBy("passage").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word")).alias("r")).select("passage", "r.word")
    return postings.join(rarest, "word").select("passage", "key").distinct().join(held, "key").where(F.contains(F.col("text"), F.col("passage"))).select("passage", "key").distinct()


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed, max_new: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, fresh): key, sha, reused and vector of each text, and the cache's new rows (sha, vector).

    Each distinct text that the cache lacks is embedded once. Above `max_new` of them nothing is
    embedded and it is an error. `texts`: key, text; `cache`: sha, vector. Null texts have no vector.
    """
    hashed = texts.withColumn("sha", F.sha2("text", 256))
    known = cache.dropDuplicates(["sha"])
    todo = hashed.where("text is not null").select("sha", "text").join(known.select("sha"), "sha", "left_anti").dropDuplicates(["sha"])
    if max_new is not None and (n := todo.count()) > max_new:
        raise RuntimeError(f"{n} new texts, but no more than {max_new} may be embedded; nothing was spent")
    fresh = todo.select("sha", embed(F.col("text")).alias("vector"))
    whole = known.select("sha", "vector", F.lit(True).alias("reused")).unionByName(fresh.withColumn("reused", F.lit(False)))
    return hashed.select("key", "sha").join(whole, "sha", "left").select("key", "sha", F.coalesce("reused", F.lit(False)).alias("reused"), "vector"), fresh


def waits(events: DataFrame, by: str, limit: int, reserve: Column) -> DataFrame:
    """(event_id, wait): seconds that a call would have waited for room in the window of tokens.

    `events`: event_id, by, at (microseconds), tokens. A call waits until enough of the calls of its last
    minute have left it; windows run per hour and key, so that no key is one task.
    """
    span = WINDOW * 1_000_000
    hour = F.expr("at div 3600000000")
    spread = events.withColumn("hour", F.explode(F.when(F.expr(f"(at + {span}) div 3600000000") > hour, F.array(hour, hour + 1)).otherwise(F.array(hour)))).withColumn("own", F.col("hour") == hour)
    # calls at the same instant count in the order of their ids
    w = Window.partitionBy(by, "hour").orderBy("at").rangeBetween(-span, 0)
    seen = spread.withColumn("before", F.array_sort(F.collect_list(F.struct("at", "event_id", "tokens")).over(w)))
    earlier = F.filter("before", lambda e: (e["at"] < F.col("at")) | (e["event_id"] < F.col("event_id")))
    used = F.aggregate(earlier, F.lit(0).cast("bigint"), lambda s, e: s + e["tokens"])
    freed = F.aggregate(
        earlier,
        F.struct(used.alias("left"), F.lit(None).cast("bigint").alias("until")),
        lambda s, e: F.struct(
            (s["left"] - e["tokens"]).alias("left"),
            F.when(s["until"].isNull() & (s["left"] - e["tokens"] + reserve <= limit), e["at"]).otherwise(s["until"]).alias("until"),
        ),
    )
    wait = F.when(used + reserve <= limit, F.lit(0.0)).otherwise((freed["until"] + span - F.col("at")) / 1e6)
    return seen.where("own").select("event_id", wait.alias("wait"))


