"""Small text functions for titles, numbers, names, links and messages; all JVM-side but two."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import deeplink

# Characters of a damaged code page in titles: the first stands for a space, the others for nothing.
DAMAGED = "\x92\x84\x93\x94"
# Patterns of a numbered heading and of the date in a running header.
NUMBERED = r"(?s)^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
HEADER_DATE = r"—\s+[A-Z]{2}\s+—\s+(\d{2})\.(\d{2})\.(\d{4})\s+—"
# Short forms of labels; lengths of a link title and of a recap; phrases of a spent quota.
SHORT_LABELS = {"Article ": "Art. ", "Recital ": "Rec. ", "Paragraph ": "Para. "}
LINK_TITLE, RECAP = 300, 700
QUOTA = ("RESOURCE_EXHAUSTED", "exceeded your current quota")
#: White space of any kind.
WHITE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"


def one_spaced(text: Column) -> Column:
    """Single spaces for white space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def clean_title(raw: Column) -> Column:
    """A title without code page damage, one-spaced."""
    return one_spaced(F.translate(raw, DAMAGED, " "))


def number_and_rest(title: Column) -> Column:
    """struct(number, rest): `2.3.1. Scope` gives 2.3.1 and Scope; without a number it is null, and rest the title."""
    has = title.rlike(NUMBERED)
    return F.struct(F.when(has, F.regexp_extract(title, NUMBERED, 1)).alias("number"), F.when(has, F.rtrim(F.regexp_extract(title, NUMBERED, 2))).otherwise(title).alias("rest"))


def number_parts(number: Column) -> Column:
    """`2.10.1` as an array of ints, which sorts as the numbers do."""
    return F.transform(F.split(number, r"\."), lambda x: x.cast("int"))


def folded_title(title: Column) -> Column:
    """For comparisons: one-spaced, in lower case."""
    return F.lower(one_spaced(title))


def header_date(line: Column) -> Column:
    """The date in a running header; null where there is none."""
    found = [F.regexp_extract(line, HEADER_DATE, i) for i in (3, 2, 1)]
    return F.when(line.rlike(HEADER_DATE), F.concat_ws("-", *found).try_cast("date"))


def file_stem(name: Column) -> Column:
    """What a file name such as `03a_Guide_General.pdf` has between its first underscore and its extension."""
    return F.regexp_extract(name, r"^[^_]*_(.*?)(?:\.[^.]*)?$", 1)


def key_of_file(name: Column, prefix: str) -> Column:
    """`03a_Guide_General.pdf` as a source key, with a prefix: `ec-guide-general`."""
    return F.concat(F.lit(f"{prefix}-"), F.lower(F.translate(file_stem(name), "_", "-")))


def title_of_file(name: Column) -> Column:
    return F.translate(file_stem(name), "_", " ")


def publication_label(status: Column, day: Column) -> Column:
    """`draft 2026-01-01` for drafts, else `published 2026-01-01`."""
    return F.concat(F.when(status == "draft", "draft ").otherwise("published "), F.coalesce(day.cast("string"), F.lit("")))


def version_label(celex: Column, day: Column, consolidated: Column) -> Column:
    """`consolidated 2026-07-27`, `as adopted 2024-06-13`; the number where the day is unknown."""
    return F.when(day.isNull(), celex).otherwise(F.concat(F.when(consolidated, "consolidated ").otherwise("as adopted "), day.cast("string")))


def unit_link(base: str, landing: Column, celex: Column, unit_type: Column, number: Column, path: Column) -> Column:
    """Where a reader checks a unit: the landing page of a document that has one, else its place in the register."""
    return F.coalesce(landing, deeplink(base, celex, unit_type, number, path))


def short_label(label: Column) -> Column:
    """`Article 5` as `Art. 5`."""
    out = label
    for long, short in SHORT_LABELS.items():
        out = F.when(F.startswith(label, F.lit(long)), F.concat(F.lit(short), F.substr(label, F.lit(len(long) + 1)))).otherwise(out)
    return out


def cut(text: Column, n: int) -> Column:
    """One-spaced, and at most n characters, the last three of them dots where it was longer."""
    flat = one_spaced(text)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 3)), F.lit("...")))


def link_title(quote: Column) -> Column:
    """A quote for a link's title: cut, with backslashes and quotation marks escaped."""
    return F.regexp_replace(cut(quote, LINK_TITLE), r'([\\"])', r"\\$1")


def recap(pieces: Column) -> Column:
    """The non-blank pieces of an answer as one reminder."""
    return cut(F.array_join(F.filter(pieces, lambda p: F.trim(p) != ""), " "), RECAP)


def is_quota_error(message: Column) -> Column:
    found = F.lit(False)
    for phrase in QUOTA:
        found = found | F.contains(message, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def criterion_text(criterion: Column, explanation: Column) -> Column:
    """A criterion as a claim, and the key that leads verified claims back to it."""
    return F.btrim(F.concat(F.coalesce(criterion, F.lit("")), F.lit(" - "), F.coalesce(explanation, F.lit(""))), F.lit(" -"))


def mask(text: Column, n: int) -> Column:
    """Long values in traces: the first n characters and how many there were."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("... ["), F.format_number(F.length(text), 0), F.lit(" chars]")))


@F.pandas_udf(T.StringType())
def vector_literal(vectors: pd.Series) -> pd.Series:
    """Numbers in seven significant digits, in brackets; null stays null."""
    return vectors.map(lambda v: None if v is None else "[" + ",".join(f"{x:.7g}" for x in v) + "]")


def token_counter(path: str):
    """A pandas UDF text -> number of tokens of a public vocabulary file (`*.json`), without special tokens; null counts 0."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)  # once per Arrow batch
        tokenizer.encode_special_tokens = True
        return pd.Series([len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)], dtype="int32")

    return count


@F.pandas_udf(T.DoubleType())
def closeness(quotes: pd.Series, texts: pd.Series) -> pd.Series:
    """How near a rejected quote comes to its text, 0 to 100: a diagnosis that accepts nothing.

    The share of the quote's characters that its best window of the text matches in order; the
    windows begin where blocks in common suggest.
    """
    out = []
    for quote, text in zip(quotes, texts):
        if not quote or not text:
            out.append(0.0)
            continue
        matcher = difflib.SequenceMatcher(None, text, quote, autojunk=False)
        best = 0.0
        for block in matcher.get_matching_blocks():
            start = max(0, block.a - block.b)
            window = difflib.SequenceMatcher(None, text[start : start + len(quote)], quote, autojunk=False)
            if window.real_quick_ratio() > best:
                best = max(best, window.ratio())
        out.append(round(100 * best, 2))
    return pd.Series(out)
