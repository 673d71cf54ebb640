"""Document structure: ancestors by path, outlines, boundaries, stacks, monotone runs, packing."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.arrow import whole_groups
from vellum.functions.text import estimate_tokens, most_characters


def path_prefixes(path: Column) -> Column:
    """All proper prefixes of a path: A/B/C gives A and A/B."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ancestor_pairs(units: DataFrame, scope: str, key: str, path: str) -> DataFrame:
    """(scope, key, ancestor, ancestor_path): every unit with the units whose paths lead to it.

    A prefix condition becomes an equality: each path is spread to its prefixes, as many as it is
    deep, and these meet the paths themselves.
    """
    below = units.where(F.contains(F.col(path), F.lit("/"))).select(scope, key, F.explode(path_prefixes(F.col(path))).alias("ancestor_path"))
    above = units.select(scope, F.col(key).alias("ancestor"), F.col(path).alias("ancestor_path"))
    return below.join(above, [scope, "ancestor_path"]).select(scope, key, "ancestor", "ancestor_path")


def outline(units: DataFrame) -> DataFrame:
    """(parent_id, children, headings): headings of at least two siblings, in document order.

    `units`: unit_id, parent_id, heading, ordinal. Parents with one heading give no row.
    """
    named = units.where(F.col("parent_id").isNotNull() & F.col("heading").isNotNull() & (F.trim("heading") != ""))
    grouped = named.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "unit_id", "heading"))).alias("h"))
    return grouped.where(F.size("h") >= 2).select("parent_id", F.size("h").cast("bigint").alias("children"), F.array_join(F.transform("h", lambda x: x["heading"]), " | ").alias("headings"))


def next_boundary(starts: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each start with the next one of its group, where its stretch ends; the last has null."""
    return starts.withColumn("next_at", F.lead(at).over(Window.partitionBy(*by).orderBy(at)))


def keep_last(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Of rows with one key the last, in the order of the kept positions."""
    kept = df.groupBy(*by).agg(F.max(F.struct(at, *(c for c in df.columns if c not in (*by, at)))).alias("r"))
    return kept.select(*by, "r.*")


def longest_increasing(values: list) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience sorting)."""
    tails: list = []
    tops: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            tops.append(i)
        else:
            tails[at], tops[at] = v, i
        before[i] = tops[at - 1] if at else -1
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def stack_parents(levels: list[int]) -> list[int]:
    """For each heading the index of the nearest one before it with a smaller level, or -1."""
    stack: list[int] = []
    parents = []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parents.append(stack[-1] if stack else -1)
        stack.append(i)
    return parents


def running_items(labels: list[str]) -> list[bool]:
    """Whether each label continues the run a, b, c, ... or 1, 2, 3, ...; others are text."""
    kept, expected = [], 1
    for text in labels:
        number = int(text) if text.isdigit() else (ord(text.lower()) - 96 if len(text) == 1 and text.isascii() and text.isalpha() else 0)
        kept.append(number == expected)
        expected += number == expected
    return kept


def per_document(rows: DataFrame, document: str, order: str, value: str, function, result: str) -> DataFrame:
    """Apply a sequential list function to each document's values in order: (document, order, value, result).

    A document is walked in one task; documents are bounded by what one file holds.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (document, order, value)}
    ddl = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", {result} int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, [document]):
            owners, values = chunk.column(0).to_pylist(), chunk.column(2).to_pylist()
            out: list[int] = []
            start = 0
            for end in range(1, len(owners) + 1):
                if end == len(owners) or owners[end] != owners[start]:
                    out += function(values[start:end])
                    start = end
            for batch in chunk.append_column(result, pa.array([None if x is None else int(x) for x in out], pa.int32())).to_batches():
                yield batch

    return rows.select(document, order, value).repartition(document).sortWithinPartitions(document, order).mapInArrow(run, ddl)


def paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no, label, paragraph): lines such as `2. ...` start a numbered paragraph.

    Lines before the first start are paragraph 0 without label. Null texts give no row.
    """
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    start = F.regexp_extract("line", r"^(\d+[a-z]?)\.\s+\S", 1)
    order = Window.partitionBy(key).orderBy("line_no")
    numbered = lines.withColumn("label", F.nullif(start, F.lit(""))).withColumn("paragraph_no", F.count("label").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy(key, "paragraph_no").agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return grouped.select(key, "paragraph_no", "label", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("paragraph"))


#: Breaks at which an oversize piece is cut, coarse to fine: paragraph, line, sentence, word.
BREAKS = tuple(map(re.compile, (r"\r?\n(?:[ \t]*\r?\n)+", r"\r?\n", r"(?<=[.;:!?])\s+", r"\s+")))


def cut_text(text: str, limit: int, kind: int = 0) -> list[str]:
    """The text in pieces of at most `limit` code points, without the white space around them.

    Stretches between breaks are joined while they fit; one that is itself too long is cut at the
    next finer kind, a word at last by length.
    """
    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    if kind == len(BREAKS):
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    breaks = [m.span() for m in BREAKS[kind].finditer(text)]
    out: list[str] = []
    start = end = 0
    for a, b in zip([0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(text)]):
        if b - start <= limit:
            end = b
            continue
        if end > start:
            out.append(text[start:end])
        start = end = a
        if b - a <= limit:
            end = b
        else:
            out += cut_text(text[a:b], limit, kind + 1)
            start = end = b
    if end > start:
        out.append(text[start:end])
    return [piece for piece in map(str.strip, out) if piece]


def fitting_pieces(text: Column, target: int) -> Column:
    """The text as an array of pieces whose estimated tokens are at most `target`; only longer texts leave the JVM."""
    limit = most_characters(target)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_text(t, limit))

    long = F.length(text) > limit
    return F.when(long, cut(F.when(long, text))).otherwise(F.array(text))


def greedy_chunks(pieces: DataFrame, by: str, order: str, cost: str, target: int = 500) -> DataFrame:
    """Assign pieces, in order, to chunks: a piece that would pass the target opens a new chunk."""

    def run(costs: list[int]) -> list[int]:
        chunk, used, out = 0, 0, []
        for c in costs:
            if used and used + (c or 0) > target:
                chunk, used = chunk + 1, 0
            used += c or 0
            out.append(chunk)
        return out

    return per_document(pieces, by, order, cost, run, "chunk_no")


#: Fixed value: numbers of the units of a code around which its structure is read.
ANCHOR = r"(^| )Commitment [0-9]+$"


def with_structure(evidence: DataFrame, units: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, anchor, unit_id, position, full): what is read around code units in the evidence.

    `evidence`: by, unit_id, authority, place; `units`: unit_id, document_version_id, unit_number,
    unit_path, ordinal, text. A code unit's anchor is the commitment above it, or the unit itself.
    Of the anchor's whole subtree, in document order, units that are no evidence yet are read in
    full while the budget lasts; the others (full = 0) give only their first line, and the outline
    of these lines counts against what is left for the next anchor. A unit belongs to the first
    anchor that reaches it.
    """
    pairs = ancestor_pairs(units, "document_version_id", "unit_id", "unit_path").select("unit_id", "ancestor", F.length("ancestor_path").alias("depth"))
    commitments = units.where(F.col("unit_number").rlike(ANCHOR)).select(F.col("unit_id").alias("ancestor"))
    above = pairs.join(commitments, "ancestor", "left_semi").groupBy("unit_id").agg(F.min(F.struct("depth", "ancestor")).alias("a"))
    code = evidence.where("authority = 'code'").select(by, "unit_id", "place").join(above, "unit_id", "left")
    anchors = code.groupBy(by, F.coalesce("a.ancestor", "unit_id").alias("anchor")).agg(F.min("place").alias("anchor_no"))
    below = pairs.select(F.col("ancestor").alias("anchor"), "unit_id").unionByName(units.select(F.col("unit_id").alias("anchor"), "unit_id"))
    reached = anchors.join(below, "anchor").join(evidence.select(by, "unit_id"), [by, "unit_id"], "left_anti")
    first = reached.groupBy(by, "unit_id").agg(F.min(F.struct("anchor_no", "anchor")).alias("a")).select(by, "unit_id", "a.*")
    line = F.substring_index("text", "\n", 1)
    priced = first.join(units.select("unit_id", "ordinal", estimate_tokens(F.col("text")).alias("cost"), F.length(line).alias("line")), "unit_id")
    rows = priced.select(by, F.struct("anchor_no", "ordinal", "unit_id").alias("position"), F.struct("anchor_no", "anchor", "unit_id", "cost", "line").alias("row"))

    def fold(steps: list[dict]) -> list[int]:
        spent, out, unread, anchor = 0, [], [], None
        for s in steps:
            if s["anchor_no"] != anchor:
                if unread:
                    spent += int((sum(unread) + len(unread) - 1) / 3.6) + 32
                unread, anchor = [], s["anchor_no"]
            full = spent + s["cost"] <= budget
            out.append(full)
            if full:
                spent += s["cost"]
            else:
                unread.append(s["line"])
        return out

    done = per_document(rows, by, "position", "row", fold, "full")
    return done.select(by, F.col("row.anchor").alias("anchor"), F.col("row.unit_id").alias("unit_id"), F.col("position.ordinal").alias("ordinal"), "full")
