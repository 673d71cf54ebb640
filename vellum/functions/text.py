"""Scalar text functions of the engine, JVM-side wherever a built-in can express them."""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that normalization drops, and the ASCII forms it folds others to.
DROPPED = "­​‌‍﻿"
FOLDED = {
    "'": "‘’‚‛",
    '"': "“”„‟«»",
    "-": "‐‑‒–—―−",
    "...": "…",
    " ": "     ",
}
# Trimmed from both ends of a quote; markers of an elision, in order of precedence.
BOUNDARY = " \t\n\"'`.,;:-()[]"
ELISIONS = ("[...]", "[\u2026]", "...", "\u2026")
# Patterns of parts of a code, of named articles and their numbers, of texts that name the law or a
# provision of it, and of heading lines.
CODE_PART = r"(?i)\b(commitment|sub-measure|measure|appendix)\s+(\d+(?:\.\d+)*)"
NAMED_ARTICLES = r"(?i)\bArticles?\s+(\d+[a-z]?(?:\s*(?:,|and|or|to)\s*\d+[a-z]?)*)"
ARTICLE_NUMBER = r"(\d+[a-z]?)"
PROVISION = r"(?i)\bai act\b|\bartificial intelligence act\b|\b2024/1689\b|\bthis regulation\b|\barticle\s+\d|\bannex\s+[IVXLC]+\b|\brecital\s+\d"
HEADINGS = {
    "article": r"(?s)^Article\s+(\d+[a-z]?)\b\s*(.*)$",
    "chapter": r"(?s)^CHAPTER\s+([IVXLC]+)\b\s*(.*)$",
    "annex": r"(?s)^ANNEX\s+([IVXLC]+|\d+)\b\s*(.*)$",
    "section": r"(?s)^SECTION\s+([IVXLC]+|\d+)\b\s*(.*)$",
}
# The token estimate.
CHARS_PER_TOKEN, TOKEN_BASE = 3.6, 32

NORMALIZED = T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])


class _Folds(dict):
    """Character to its folded form; filled as characters come up."""

    def __missing__(self, c: str) -> str:
        self[c] = form = unicodedata.normalize("NFKC", c)
        return form


_FOLDS = _Folds({c: to for to, kinds in FOLDED.items() for c in kinds} | dict.fromkeys(DROPPED, ""))
_VISIBLE = re.compile(r"\S+")


def fold_text(text: str) -> tuple[str, list[int]]:
    """Folded text without outer white space and with single spaces, and each character's index in `text`.

    Every character is folded first; `source` repeats its index once per folded character. The words
    of the folded text then keep their stretch of it, and a single space stands for what is between.
    """
    if text.isascii():
        folded, source = text, np.arange(len(text))
    else:
        forms = [_FOLDS[c] for c in text]
        folded, source = "".join(forms), np.repeat(np.arange(len(text)), [len(f) for f in forms])
    spans = [m.span() for m in _VISIBLE.finditer(folded)]
    offsets: list[int] = []
    for start, end in spans:
        offsets += source[start : end + 1].tolist() if end < len(folded) else source[start:end].tolist()
    if spans and spans[-1][1] < len(folded):
        offsets.pop()  # of the white space behind the last word
    return " ".join(folded[a:b] for a, b in spans), offsets


@F.pandas_udf(NORMALIZED)
def normalize(texts: pd.Series) -> pd.DataFrame:
    """Folded text with offsets; null stays null."""
    done = [(None, None) if t is None else fold_text(t) for t in texts]
    return pd.DataFrame({"text": [d[0] for d in done], "offsets": [d[1] for d in done]})


@F.pandas_udf(T.StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """The same without offsets."""
    return pd.Series([None if t is None else fold_text(t)[0] for t in texts], dtype=object)


def original_slice(original: Column, offsets: Column, start: Column, end: Column) -> Column:
    """The original characters of a span [start, end) of the folded text."""
    first, last = F.get(offsets, start), F.get(offsets, end - 1)
    return F.substring(original, first + 1, last - first + 1)


def trim_boundary(quote: Column) -> Column:
    """Strip spaces, quotation marks, brackets and punctuation from both ends."""
    return F.btrim(quote, F.lit(BOUNDARY))


def segments(quote: Column) -> Column:
    """Parts between elisions, without boundary punctuation; only the first kind of marker that occurs splits. Empty parts go."""
    split = F.array(quote)
    for marker in reversed(ELISIONS):
        split = F.when(F.contains(quote, F.lit(marker)), F.split(quote, F.concat(F.lit("\\Q"), F.lit(marker), F.lit("\\E")))).otherwise(split)
    return F.filter(F.transform(split, lambda s: trim_boundary(s)), lambda s: s != "")


def estimate_tokens(text: Column) -> Column:
    """Characters / 3.6, truncated, plus 32."""
    return (F.length(F.coalesce(text, F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("int") + TOKEN_BASE


def most_characters(tokens: int) -> int:
    """The longest text whose estimate is at most so many tokens."""
    return math.ceil((tokens - TOKEN_BASE + 1) * CHARS_PER_TOKEN) - 1


def micros(created_at: Column) -> Column:
    """ISO text in any of its forms as UTC microseconds; without a zone it is UTC; unreadable is null."""
    stamp = F.trim(created_at)
    zoned = F.when(stamp.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?)$") & stamp.rlike(r"\d:\d"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def words(text: Column) -> Column:
    """Distinct lower-case words of letters (with their marks) and digits of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))


def code_parts(question: Column) -> Column:
    """Parts of a code that a question names, such as `Measure 1.2`."""
    kinds, numbers = F.regexp_extract_all(question, F.lit(CODE_PART), F.lit(1)), F.regexp_extract_all(question, F.lit(CODE_PART), F.lit(2))
    return F.zip_with(kinds, numbers, lambda k, n: F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.substr(k, F.lit(2))), F.lit(" "), n))


def named_articles(question: Column) -> Column:
    """Article numbers that a question names; `Articles 53 and 54` gives both."""
    groups = F.regexp_extract_all(question, F.lit(NAMED_ARTICLES), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(ARTICLE_NUMBER), F.lit(1))))


def corrected_intent(intent: Column, question: Column) -> Column:
    """A small-talk intent becomes `lookup` where the question names a provision."""
    names = F.coalesce(question, F.lit("")).rlike(PROVISION)
    return F.when(intent.isin("greeting", "out_of_scope") & names, "lookup").otherwise(intent)


def classify_heading(title: Column) -> Column:
    """struct(type, number, heading) of a heading line; null type where none fits."""
    parts = F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("number"), title.alias("heading"))
    for kind, pattern in reversed(HEADINGS.items()):
        found = F.struct(F.lit(kind).alias("type"), F.regexp_extract(title, pattern, 1).alias("number"), F.rtrim(F.regexp_extract(title, pattern, 2), F.lit("\"' ")).alias("heading"))
        parts = F.when(title.rlike(pattern), found).otherwise(parts)
    return parts


def article_of(path: Column) -> Column:
    """The article number in a unit path, or null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)ART_([^/]+)", 1), F.lit(""))


def deeplink(base: str, celex: Column, unit_type: Column, number: Column, path: Column) -> Column:
    """Address of a unit, with a fragment where its type has one; a paragraph leads to its article."""
    prefix = F.create_map(*(F.lit(x) for pair in {"article": "art_", "annex": "anx_", "recital": "rct_", "chapter": "cpt_"}.items() for x in pair))
    fragment = F.when(unit_type == "paragraph", F.concat(F.lit("art_"), article_of(path))).otherwise(F.concat(F.try_element_at(prefix, unit_type), F.nullif(number, F.lit(""))))
    return F.concat(F.lit(f"{base}?uri=CELEX%3A"), F.url_encode(celex), F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))


def citation_label(unit_type: Column, number: Column, path: Column, authority: Column, title: Column) -> Column:
    """`Article 6` for law; other documents are named by their title."""
    named = F.initcap(F.when(unit_type.isin("article", "annex", "recital", "chapter", "section", "paragraph"), unit_type))
    number = F.nullif(number, F.lit(""))
    return F.when(authority != "law", F.concat_ws(" ", title, number)).otherwise(F.coalesce(F.concat(named, F.lit(" "), number), path))


def shorten(text: Column, n: int) -> Column:
    """White space collapsed, and cut to n characters with a final `...` where longer."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, n - 3)), F.lit("...")))


def fit_lines(text: Column, budget: int) -> Column:
    """A text whose estimate is above the budget keeps its first lines: four fifths of them, again and
    again, until it fits. A text whose first line alone is too large stays as it is."""
    joined = lambda lines: F.array_join(lines, "\n")
    fits = lambda lines: estimate_tokens(joined(lines)) <= budget
    fewer = lambda lines: F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(lines) * F.lit(0.8)).cast("int")))
    steps = F.sequence(F.lit(1), F.lit(128))  # enough for any text that a row can hold
    cut = F.aggregate(steps, F.split(text, "\n"), lambda lines, _: F.when((F.size(lines) <= 1) | fits(lines), lines).otherwise(fewer(lines)))
    return F.when(fits(cut), joined(cut)).otherwise(text)


def retry_seconds(message: Column, default: float = 20.0) -> Column:
    """Seconds that an error message asks to wait, 1 at least; the default where it names none."""
    stated = F.nullif(F.regexp_extract(message, r"(?:retry in |retryDelay['\"]:\s*['\"])(\d+(?:\.\d+)?)s", 1), F.lit(""))
    return F.greatest(F.lit(1.0), F.coalesce(stated.cast("double"), F.lit(default)))
