"""One consistent form for texts that look the same but differ in characters.

Per token: invisible characters go, hyphens and quotes become one kind each, compatibility forms are
taken apart, the possible scripts of all letters are intersected, look-alike letters are respelled
in the script that fits the whole token, and accents are composed again. White space becomes single
spaces. A token that fits several scripts takes the script that most tokens of its text have.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of the same shape in Latin, Cyrillic and Greek; - where a script has none.
# Letters of one script (such as the Latin alpha, script g and dotless i) are letters of their own.
SHAPES = """
A А Α|B В Β|C С -|E Е Ε|H Н Η|I І Ι|J Ј -|K К Κ|M М Μ|N - Ν|O О Ο|P Р Ρ|S Ѕ -|T Т Τ|X Х Χ|Y Ү Υ|Z - Ζ|Q Ԛ -|W Ԝ -
a а α|c с ϲ|d ԁ -|e е -|h һ -|i і ι|j ј ϳ|l ӏ -|o о ο|p р ρ|q ԛ -|s ѕ -|u - υ|v ѵ ν|w ԝ -|x х -|y у -|k - κ
V Ѵ -|- Г Γ|- П Π|- Ф Φ
"""
# Further scripts, each with its letters beside the Latin ones of the same shape.
MORE = """
ARMENIAN օo սu հh ոn զq ցg ՕO ՍU ԼL
CHEROKEE ᎪA ᏴB ᏟC ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ
"""
# Kinds of hyphen and minus, of apostrophe, of quotation mark.
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d\u2043"
APOSTROPHES = "\u2018\u2019\u201a\u201b\u2032\u2035`\u00b4\u02b9\u02bc\u02bb\u02bd\u02c8\uff07\u2039\u203a"
QUOTES = "\u201c\u201d\u201e\u201f\u2033\u2036\u00ab\u00bb\uff02"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
REMEMBER = 300_000

_RESPELL: dict[str, dict[str, str]] = {}
for _entry in re.split(r"[|\n]", SHAPES.strip()):
    _spelled = dict((s, c) for s, c in zip(SCRIPTS, _entry.split()) if c != "-")
    for _c in _spelled.values():
        _RESPELL[_c] = _spelled
for _line in MORE.split("\n"):
    for _pair in _line.split()[1:]:
        _RESPELL.setdefault(_pair[1], {"LATIN": _pair[1]})[_line.split()[0]] = _pair[0]
        _RESPELL[_pair[0]] = _RESPELL[_pair[1]]
_RESPELL["У"] = {"CYRILLIC": "У", "LATIN": "Y", "GREEK": "Υ"}
_FOLD = {ord(c): to for kinds, to in ((HYPHENS, "-"), (APOSTROPHES, "'"), (QUOTES, '"')) for c in kinds}
_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(1 << 16)
def _invisible(c: str) -> bool:
    return ord(c) in _FILLERS or (unicodedata.category(c) in ("Cf", "Cc") and not c.isspace())


@lru_cache(1 << 16)
def _script(c: str) -> str | None:
    """One of SCRIPTS; other letters give None, as do marks, digits and signs."""
    name = unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""
    return name if name in SCRIPTS else None


def _fitting(letters: list[str]) -> set[str] | None:
    """The scripts in which all letters can be spelled; null if no letter belongs to one of SCRIPTS.

    Where no script fits, it is the one of most letters that have one spelling only: the others are
    then respelled beside them.
    """
    fit: set[str] | None = None
    for c in letters:
        own = _script(c)
        if own is None:
            continue
        possible = set(_RESPELL[c]) if c in _RESPELL else {own}
        fit = possible if fit is None else fit & possible
    if fit is not None and not fit:
        own = [_script(c) for c in letters if _script(c) and len(_RESPELL.get(c, ())) < 2]
        fit = {max(SCRIPTS, key=own.count)} if own else fit
    return fit


class Normalizer:
    """Consistent forms of texts; remembers tokens."""

    def __init__(self):
        self.known: dict[str, tuple[str, frozenset[str], str]] = {}
        self.formed: dict[tuple[str, str], tuple[str, range | list[int]]] = {}

    def _token(self, token: str) -> tuple[str, frozenset[str], str]:
        """(decomposed form without invisible characters, scripts it fits, its script if that is one)."""
        seen = self.known.get(token)
        if seen is None:
            if token.isascii() and token.isprintable() and "`" not in token:
                plain = token
            else:
                shown = "".join(c for c in token if not _invisible(c)).translate(_FOLD)
                plain = unicodedata.normalize("NFKD", shown).translate(_FOLD)
                plain = "".join(c for c in plain if not _invisible(c))
            fit = _fitting(list(plain))
            seen = (plain, frozenset(fit or ()), next(iter(fit)) if fit and len(fit) == 1 else "")
            if len(self.known) >= REMEMBER:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = seen
        return seen

    @staticmethod
    def _spell(plain: str, fit: frozenset[str], main: str) -> str:
        if plain.isascii() and main == "LATIN":
            return plain
        script = main if main in fit else ("LATIN" if "LATIN" in fit else min(fit, default=""))
        if script:
            plain = "".join(_RESPELL[c].get(script, c) if c in _RESPELL else c for c in plain)
        return unicodedata.normalize("NFC", plain)

    def _main(self, tokens: list[tuple[str, frozenset[str], str]]) -> str:
        counts = dict.fromkeys(SCRIPTS, 0)
        for _, _, script in tokens:
            if script:
                counts[script] += 1
        return max(SCRIPTS, key=lambda s: counts[s])  # of equals the first

    def form(self, text: str) -> str:
        tokens = [self._token(t) for t in text.split()]
        main = self._main(tokens)
        spelled = [self._spelled(p, f, main) for p, f, _ in tokens if p]
        whole = " ".join(spelled)
        return " ".join(whole.split()) if not whole.isascii() else whole

    def _spelled(self, plain: str, fit: frozenset[str], main: str) -> str:
        if plain.isascii() and main == "LATIN":
            return plain
        return _spell_cached(plain, fit, main)

    def _formed(self, token: str, plain: str, fit: frozenset[str], main: str) -> tuple[str, range | list[int]]:
        """The form of one token in a text of that main script, and offsets into the token; remembered."""
        seen = self.formed.get((token, main))
        if seen is None:
            if plain == token and token.isascii() and main == "LATIN":
                seen = token, range(len(token))
            else:
                chars: list[str] = []
                offsets: list[int] = []
                for at, cluster in _clusters(token):
                    shown = "".join(c for c in cluster if not _invisible(c)).translate(_FOLD)
                    piece = self._spell(unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", shown).translate(_FOLD)), fit, main)
                    for k, c in enumerate(c for c in piece if not _invisible(c)):
                        if not (c == " " and (not chars or chars[-1] == " ")):
                            chars.append(c)
                            offsets.append(at + min(k, len(cluster) - 1))
                if chars and chars[-1] == " ":
                    chars.pop()
                    offsets.pop()
                seen = "".join(chars), offsets
            if len(self.formed) >= REMEMBER:
                self.formed.clear()
            if len(token) <= 64:
                self.formed[token, main] = seen
        return seen

    def form_with_offsets(self, text: str) -> tuple[str, list[int]]:
        """The form, and for each of its characters the index of the character it came from."""
        tokens = [(m.start(), m.group()) for m in re.finditer(r"\S+", text)]
        parts = [self._token(t) for _, t in tokens]
        main = self._main(parts)
        out: list[str] = []
        offsets: list[int] = []
        end = 0
        for (start, token), (plain, fit, _) in zip(tokens, parts):
            formed, inside = self._formed(token, plain, fit, main)
            if not formed:
                continue
            if out:
                offsets.append(end)
            out.append(formed)
            offsets += range(start, start + len(formed)) if type(inside) is range else [start + i for i in inside]
            end = start + len(token)
        return " ".join(out), offsets


@lru_cache(1 << 17)
def _spell_cached(plain: str, fit: frozenset[str], main: str) -> str:
    return Normalizer._spell(plain, fit, main)


def _clusters(token: str) -> Iterator[tuple[int, str]]:
    """Stretches of a token that normalize independently: a character with its marks and fillers."""
    start = 0
    for i in range(1, len(token) + 1):
        if i == len(token) or not (unicodedata.category(token[i])[0] == "M" or _invisible(token[i]) or "\u1160" <= token[i] <= "\u11ff" or token[i] in "\uff9e\uff9f"):
            yield start, token[start:i]
            start = i


def confusables(texts: DataFrame, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(key, token, kind, scripts, form): each text's tokens that mislead, once.

    kind `mixed`: letters of several scripts; `whole`: letters of one script, but not of the text's
    main one, in which all of them could be spelled. scripts are those of the letters as written;
    form is the consistent spelling. Null and blank texts give no row.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer = Normalizer()
        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                tokens = [] if not t or t.isascii() else list(dict.fromkeys(t.split()))
                if not tokens:
                    continue
                main = normalizer._main([normalizer._token(x) for x in t.split()])
                for token in tokens:
                    if token.isascii():
                        continue
                    plain, fit, _ = normalizer._token(token)
                    written = sorted({s for c in plain if (s := _script(c))})
                    if len(written) > 1 or (written and written[0] != main and main in fit):
                        rows.append((i, token, "mixed" if len(written) > 1 else "whole", written, Normalizer._spell(plain, fit, main)))
            if rows:
                at, token, sort, scripts, form = zip(*rows)
                columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(token), pa.array(sort), pa.array(scripts, pa.list_(pa.string())), pa.array(form)]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "token", "kind", "scripts", "form"])

    return texts.select(key, F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, token string, kind string, scripts array<string>, form string").distinct()


def normalized(texts: DataFrame, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(key, form, offsets) of each distinct row; a null text has null form and offsets, a blank one empty ones."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer = Normalizer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                done = [(None, None) if t is None else normalizer.form_with_offsets(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f for f, _ in done], pa.string()), pa.array([o for _, o in done], pa.list_(pa.int32()))], names=[key, "form", "offsets"])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, form string, offsets array<int>")


def fingerprints(texts: DataFrame, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(key, k1, k2, raw): 128 bits of the consistent form and 64 of the text itself, one row per
    distinct row of the input. Null texts and texts with an empty form give none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer, form_hash, raw_hash = Normalizer(), xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, k1, k2, raw = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                form = normalizer.form(t) if t else ""
                if form:
                    a, b = struct.unpack("<qq", form_hash(form.encode("utf-8", "surrogatepass")))
                    keys.append(i)
                    k1.append(a)
                    k2.append(b)
                    raw.append(raw_hash(t.encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(raw, pa.int64())], names=[key, "k1", "k2", "raw"])

    return texts.select(key, F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, k1 bigint, k2 bigint, raw bigint").distinct()


def _many(prints: DataFrame, key: str) -> DataFrame:
    """(k1, k2, members, variants): forms with more than one text."""
    per = prints.groupBy("k1", "k2", "raw").agg(F.count_distinct(key).alias("n"))
    whole = per.groupBy("k1", "k2").agg(F.sum("n").alias("members"), F.count("*").alias("variants"))
    return whole.where("variants > 1")


def classes(prints: DataFrame, key: str = "unit_id") -> DataFrame:
    """Membership: (key, class_id, variant, members, links) of the rows whose form has more than one
    text; links are the members of the class with another text."""
    per = prints.groupBy("k1", "k2", "raw").agg(F.count_distinct(key).alias("alike"))
    own = prints.join(_many(prints, key), ["k1", "k2"]).join(per, ["k1", "k2", "raw"])
    return own.select(key, F.concat_ws(":", F.hex("k1"), F.hex("k2")).alias("class_id"), F.hex("raw").alias("variant"), "members", (F.col("members") - F.col("alike")).alias("links"))


#: Members of a class that one side of a join task holds.
CLASS_BLOCK = 2_000


def lookalike_pairs(prints: DataFrame, key: str = "unit_id", block: int = CLASS_BLOCK) -> DataFrame:
    """(key_a, key_b), a < b: rows of one form whose texts differ. Exact copies are no pair.

    A class above `block` members is cut into blocks by a hash of the id; one side goes to its own
    block, the other to each, so that no task holds more than a block of it on one side.
    """
    places = _many(prints, key).select("k1", "k2", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    own = prints.join(places, ["k1", "k2"])
    a = own.select("k1", "k2", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("place"), F.col(key).alias(f"{key}_a"), F.col("raw").alias("raw_a"))
    b = own.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("place"), F.col(key).alias(f"{key}_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["k1", "k2", "place"]).where((F.col("raw_a") != F.col("raw_b")) & (F.col(f"{key}_a") < F.col(f"{key}_b"))).select(f"{key}_a", f"{key}_b").distinct()
