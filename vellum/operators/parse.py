"""Documents to units: acts, recitals, numbered sections and codes, each document in its own row.

A parser takes the text of one document, pages separated by form feeds, and gives its units in
document order. `parse` runs one over a table without moving a row; what a parser refuses comes out
as an error beside the key, so that one bad document stops nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import HEADINGS
from vellum.operators.structure import longest_increasing, running_items, stack_parents

# Lines that are no text, glyphs inside lines, and what a running header looks like.
MARKER_LINE, MARKERS = re.compile(r"^[▲▼►◄]\s*[BM]\d*\s*$"), re.compile(r"[▲▼►◄]")
RUNNING_HEADER = re.compile(r"^\S+\s+—\s+[A-Z]{2}\s+—\s+[\d.]+\s+—\s+[\d.]+\s+—\s+\d+\s*$")
HEADER_DATE = re.compile(r"—\s+[A-Z]{2}\s+—\s+(\d{2})\.(\d{2})\.(\d{4})\s+—")
FURNITURE = re.compile(r"^(OJ\s+[LC],|ELI:|\d+/\d+\s+ELI:|https?://data\.europa\.eu/)")
# Starts of paragraphs and recitals, the end of a preamble, empty references, sizes of marker and body.
PARAGRAPH, RECITAL = re.compile(r"^(\d+[a-z]?)\.\s+\S"), re.compile(r"^\((\d{1,3})\)(?:\s+|$)")
ENACTING, EMPTY_REFERENCE = "HAVE ADOPTED THIS REGULATION", re.compile(r"\s*\(\s*\)")
MARKER_SIZE, BODY_SIZE = 8.5, 9.6
# Path prefixes and levels of the units of an act; limits of the parsers.
PREFIXES = {"chapter": "CH", "section": "SEC", "article": "ART", "annex": "ANX"}
LEVELS = {"annex": 1, "chapter": 2, "section": 3, "article": 4}
MISSING, LEAST_RECITALS, LEAST_SECTIONS, SPAN, LONGEST, NEEDLE = 0.02, 20, 5, 0.5, 120, 40
# Numbered headings, rows of a table of contents, parts of a code and their levels.
NUMBERED, CONTENTS = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"), re.compile(r"\.{4,}\s*\d+\s*$|\s\d{1,3}$")
PART = re.compile(r"^(Section|Commitment|Measure|Sub-measure|Appendix|Annex)\s+(\d+(?:\.\d+)*)[.:]?\s*(.*)$")
PART_LEVELS = {"Section": 1, "Appendix": 1, "Annex": 1, "Commitment": 2, "Measure": 3, "Sub-measure": 4}
NAMED_PARTS = ("Objectives", "Recitals", "Glossary")
# Items and titles of recitals in a code, quoted law and where a code speaks for itself again.
ITEM, ITEM_TITLE = re.compile(r"^\(?([a-z])\)\s+"), re.compile(r"^(.{3,100}?)[:.]\s")
LEGAL_TEXT, QUOTED = re.compile(r"^LEGAL TEXT\b:?\s*(.*)$"), re.compile(r"^(\d+\.\s|Article \d)")
OWN_WORDS = re.compile(r"^(In order to|To fulfil|To effectively|Signatories|ADDITIONAL LEGAL TEXT)")


class ParseError(ValueError):
    """A document that has not the form its parser reads."""


class Line(NamedTuple):
    text: str
    page: int


class Heading(NamedTuple):
    level: int
    kind: str
    number: str | None
    heading: str | None
    at: int
    page: int


def read_lines(text: str) -> tuple[list[Line], str | None]:
    """Lines with their pages, without noise, and the ISO date of the first running header that has one."""
    lines, date = [], None
    for page, sheet in enumerate(text.split("\f"), 1):
        for raw in re.split(r"\r?\n", sheet):
            line = raw.strip()
            if RUNNING_HEADER.match(line):
                if date is None and (m := HEADER_DATE.search(line)):
                    date = "-".join(reversed(m.groups()))
                continue
            line = "" if MARKER_LINE.match(line) or FURNITURE.match(line) else MARKERS.sub("", line).strip()
            if line:
                lines.append(Line(line, page))
    return lines, date


def joined(lines: list[Line]) -> str:
    """Lines as one text; a soft hyphen at the end of a line glues the next to it."""
    return "\n".join(line.text for line in lines).replace("­\n", "")


def _unit(kind: str, number: str | None, path: str, parent: str | None, heading: str | None, text: str, page: int) -> dict:
    return {"unit_type": kind, "unit_number": number, "unit_path": path, "parent_path": parent, "heading": heading, "text": text, "page": page, "context": None}


def _headings(lines: list[Line]) -> list[Heading]:
    out = []
    for i, line in enumerate(lines):
        for kind, pattern in HEADINGS.items():
            if m := re.match(pattern, line.text):
                out.append(Heading(LEVELS[kind], kind, m[1], m[2].rstrip("\"' ") or None, i, line.page))
                break
    return out


def monotone(lines: list[Line], wanted: list[tuple[Callable[[str], bool], int | None]]) -> list[int | None]:
    """For each entry the first line after the last one found that matches it, on its page or the next; None where there is none."""
    found: list[int | None] = []
    after = 0
    for matches, page in wanted:
        span = range(after, len(lines)) if page is None else (i for i in range(after, len(lines)) if page <= lines[i].page <= page + 1)
        at = next((i for i in span if matches(lines[i].text)), None)
        found.append(at)
        after = after if at is None else at + 1
    return found


def _located(lines: list[Line], outline: list[tuple[int, str, int | None]]) -> list[Heading]:
    """Headings of an outline (level, title, page) in the text; too many that are missing are an error."""
    entries = []
    for level, title, page in outline:
        for kind, pattern in HEADINGS.items():
            if m := re.match(pattern, title):
                label = f"{kind.capitalize() if kind == 'article' else kind.upper()} {m[1]}".casefold()
                entries.append((level, kind, m[1], m[2].rstrip("\"' ") or None, page, label))
                break
    places = monotone(lines, [(lambda text, label=e[5]: text.casefold() == label, e[4]) for e in entries])
    if not entries or sum(p is None for p in places) > MISSING * len(entries):
        raise ParseError(f"{sum(p is None for p in places)} of {len(entries)} headings of the outline are not in the text")
    return [Heading(e[0], e[1], e[2], e[3], at, e[4] or lines[at].page) for e, at in zip(entries, places) if at is not None]


def parse_act(text: str, outline: list[tuple[int, str, int | None]] | None = None) -> list[dict]:
    """Chapters, sections, articles with their numbered paragraphs, and annexes."""
    lines, _ = read_lines(text)
    heads = _located(lines, outline) if outline else _headings(lines)
    parents = stack_parents([h.level for h in heads])
    units: list[dict] = []
    paths: list[str] = []
    for i, h in enumerate(heads):
        above = None if h.kind == "annex" or parents[i] < 0 else paths[parents[i]]
        own = f"{PREFIXES[h.kind]}_{h.number}"
        paths.append(f"{above}/{own}" if above else own)
        body = lines[h.at : heads[i + 1].at if i + 1 < len(heads) else len(lines)]
        units.append(_unit(h.kind, h.number, paths[i], above, h.heading, joined(body), h.page))
        if h.kind == "article":
            starts = [k for k, line in enumerate(body) if PARAGRAPH.match(line.text)]
            for k, end in zip(starts, [*starts[1:], len(body)]):
                number = PARAGRAPH.match(body[k].text)[1]
                units.append(_unit("paragraph", f"{h.number}({number})", f"{paths[i]}/PAR_{number}", paths[i], None, joined(body[k:end]), body[k].page))
    return units


def sized_line(words: list[tuple[str, float]]) -> tuple[str | None, str]:
    """(recital number, body text) of a line of words with sizes: a small number before body text
    opens a recital; a line without body text is a footnote and gives nothing."""
    body = " ".join(w for w, size in words if round(size, 1) == BODY_SIZE)
    m = re.fullmatch(r"\((\d{1,3})\)", words[0][0]) if words else None
    return (m[1] if m and body and round(words[0][1], 1) == MARKER_SIZE else None), body


def parse_recitals(text: str, expected: int | None = None) -> list[dict]:
    """The recitals of a preamble: numbers that continue the run 1, 2, 3, ... before the enacting formula."""
    lines, _ = read_lines(text)
    end = next((i for i, line in enumerate(lines) if ENACTING in line.text), None)
    if end is None:
        raise ParseError("no enacting formula")
    numbered = [(i, m[1]) for i, line in enumerate(lines[:end]) if (m := RECITAL.match(line.text))]
    kept = [i for (i, _), keep in zip(numbered, running_items([n for _, n in numbered])) if keep]
    if len(kept) < LEAST_RECITALS or expected not in (None, len(kept)):
        raise ParseError(f"{len(kept)} recitals, {expected or LEAST_RECITALS} expected")
    out = []
    for n, (i, stop) in enumerate(zip(kept, [*kept[1:], end]), 1):
        body = [Line(RECITAL.sub("", lines[i].text), lines[i].page), *lines[i + 1 : stop]]
        out.append(_unit("recital", str(n), f"RCT_{n}", None, None, f"({n})\n" + EMPTY_REFERENCE.sub("", joined([x for x in body if x.text])), lines[i].page))
    return out


def _numbered_headings(lines: list[Line]) -> list[Heading]:
    """Numbered headings of the body: of each number the last line that reads like a title, in a longest rising run."""
    last: dict[str, Heading] = {}
    for i, line in enumerate(lines):
        m = None if len(line.text) > LONGEST or CONTENTS.search(line.text) else NUMBERED.match(line.text)
        if m and m[2][0].isupper() and m[2][-1] not in ";,":
            last[m[1]] = Heading(m[1].count(".") + 1, "section", m[1], m[2].strip(), i, line.page)
    ordered = sorted(last.values(), key=lambda h: h.at)
    return [ordered[k] for k in longest_increasing([tuple(map(int, h.number.split("."))) for h in ordered])]


def _sections(lines: list[Line], heads: list[Heading]) -> list[dict]:
    """Units of located headings; paths are kept apart by underscores. Too few, or bunched ones: one unit."""
    pages = lines[-1].page if lines else 0
    if heads and heads[-1].page - heads[0].page < SPAN * pages and pages > 1:
        heads = []
    if len(heads) < LEAST_SECTIONS:
        return [_unit("section", None, "SEC_1", None, None, joined(lines), lines[0].page)] if lines else []
    parents = stack_parents([h.level for h in heads])
    units: list[dict] = []
    seen: set[str] = set()
    for i, h in enumerate(heads):
        above = units[parents[i]]["unit_path"] if parents[i] >= 0 else None
        path = f"{above}/" if above else ""
        path += f"SEC_{h.number or i + 1}"
        while path in seen:
            path += "_"
        seen.add(path)
        body = lines[h.at : heads[i + 1].at if i + 1 < len(heads) else len(lines)]
        units.append(_unit("section", h.number, path, above, h.heading, joined(body), h.page))
    return units


def parse_sections(text: str, outline: list[tuple[int, str, int | None]] | None = None) -> list[dict]:
    """Sections by an outline of at least LEAST_SECTIONS entries, else by the numbered headings of the text."""
    lines, _ = read_lines(text)
    if not lines:
        raise ParseError("no text")
    if not outline or len(outline) < LEAST_SECTIONS:
        return _sections(lines, _numbered_headings(lines))
    flat = lambda t: " ".join(t.split()).casefold()
    needles = [flat(title)[:NEEDLE] for _, title, _ in outline]
    alike = lambda needle: lambda line: bool(needle) and (flat(line).startswith(needle) or needle.startswith(flat(line)))
    places = monotone(lines, [(alike(n), page) for n, (_, _, page) in zip(needles, outline)])
    heads = []
    for (level, title, page), at in zip(outline, places):
        if at is not None:
            m = NUMBERED.match(title)
            heads.append(Heading(level, "section", m[1] if m else None, m[2].strip() if m else title, at, page or lines[at].page))
    return _sections(lines, heads)


def parse_code(text: str) -> list[dict]:
    """Parts of a code with their context; recitals, glossary terms and quoted law become units of their own."""
    lines, _ = read_lines(text)
    lines = [line for line in lines if not re.fullmatch(r"\d{1,3}", line.text)]
    heads: list[Heading] = []
    for i, line in enumerate(lines):
        m = PART.match(line.text)
        if m and not CONTENTS.search(m[3]):
            heads.append(Heading(PART_LEVELS[m[1]], m[1], f"{m[1]} {m[2]}", m[3] or None, i, line.page))
        elif line.text in NAMED_PARTS:
            heads.append(Heading(1, "part", line.text, None, i, line.page))
    if not heads:
        raise ParseError("no part of a code")
    parents = stack_parents([h.level for h in heads])
    paths: list[str] = []
    by_path: dict[str, dict] = {}
    for i, h in enumerate(heads):
        path = (f"{paths[parents[i]]}/" if parents[i] >= 0 else "") + "SEC_" + h.number.replace(" ", "_")
        while path in by_path:
            path += "_"
        paths.append(path)
        body = [line.text for line in lines[h.at : heads[i + 1].at if i + 1 < len(heads) else len(lines)]]
        kept, children = _split_part(h.number, body)
        by_path[path] = _unit("section", h.number, path, paths[parents[i]] if parents[i] >= 0 else None, h.heading, "\n".join(kept), h.page)
        for suffix, kind, number, heading, own in children:
            by_path[f"{path}/{suffix}"] = _unit(kind, number[:LONGEST], f"{path}/{suffix}", path, heading, "\n".join(own), h.page)
    return _described(list(by_path.values()), by_path)


def _split_part(number: str, body: list[str]) -> tuple[list[str], list[tuple]]:
    """The lines that stay with a part, and its children as (suffix, type, number, heading, lines)."""
    if number == "Recitals":
        items = [(i, m[1]) for i, line in enumerate(body) if (m := ITEM.match(line))]
        starts = [i for (i, _), keep in zip(items, running_items([x for _, x in items])) if keep]
        if len(starts) < 2:
            return body, []
        children = []
        for i, end in zip(starts, [*starts[1:], len(body)]):
            letter = ITEM.match(body[i])[1]
            title = ITEM_TITLE.match(ITEM.sub("", " ".join(body[i:end]), count=1))
            named = title[1].strip() if title else ""
            children.append((f"REC_{letter}", "recital", f"Recital {letter}", named if named and len(named.split()) <= 14 and not named.startswith(("The ", "This ")) else None, body[i:end]))
        return body[: starts[0]], children
    if number == "Glossary":
        head = next((i for i, line in enumerate(body) if line.split() == ["Term", "Definition"]), None)
        terms: list[list[str]] = []
        for line in body[head + 1 :] if head is not None else []:
            cells = [c.strip() for c in line.split("\t") if c.strip()]
            if len(cells) == 2:
                terms.append(cells)
            elif terms and cells:
                terms[-1][1] += " " + " ".join(cells)
        if len(terms) < 2:
            return body, []
        return body[:head], [(f"TERM_{n}", "section", f"Glossary: {re.sub('[‘’]', '', t)}", None, [t, d]) for n, (t, d) in enumerate(terms, 1)]
    at = next((i for i, line in enumerate(body) if LEGAL_TEXT.match(line)), None)
    if at is None:
        return body, []
    end = next((i for i in range(at + 1, len(body)) if OWN_WORDS.match(body[i])), len(body))
    if end == at + 1 or not QUOTED.match(body[at + 1]):
        return body, []
    source = LEGAL_TEXT.match(body[at])[1].strip() or "the law"
    return body[: at + 1] + body[end:], [("LEGAL", "section", f"{number}, quoted law", f"Quoted from {source}", body[at + 1 : end])]


def _described(units: list[dict], by_path: dict[str, dict]) -> list[dict]:
    """Context of each unit: the headings above it, what its commitment implements, whether a measure is
    optional; numbers begin with their section where the code has several."""
    chains: dict[str, list[dict]] = {}
    for u in units:
        chains[u["unit_path"]] = [*chains.get(u["parent_path"], []), u]
    implements = {u["unit_path"]: m[1].strip() for u in units for line in u["text"].split("\n") if (m := LEGAL_TEXT.match(line)) and m[1].strip()}
    for u in units:
        chain = chains[u["unit_path"]]
        legal = u["unit_path"].endswith("/LEGAL")
        notes = [" › ".join(x["heading"] if x["unit_path"].endswith("/LEGAL") else f"{x['unit_number']}: {x['heading']}" if x["heading"] else x["unit_number"] for x in chain)]
        if source := next((implements[x["unit_path"]] for x in reversed(chain) if x["unit_path"] in implements), None):
            notes.append(f"implements {source}")
        if u["unit_number"].split()[0] in ("Measure", "Sub-measure"):
            notes.append("optional" if any("(optional)" in (x["heading"] or "") for x in chain) else "mandatory for signatories")
        notes += ["recital"] * (u["unit_type"] == "recital") + ["law reproduced in the code"] * legal
        u["context"] = " | ".join(notes)
    sections = [u for u in units if u["parent_path"] is None and u["unit_number"].startswith("Section ")]
    for u in units if len(sections) > 1 else []:
        top = chains[u["unit_path"]][0]
        if top is not u and top["unit_number"].startswith("Section "):
            u["unit_number"] = f"S{top['unit_number'].split()[1]} {u['unit_number']}"
    return units


#: Parsers by name; further ones may be added.
PARSERS: dict[str, Callable[[str], list[dict]]] = {"act": parse_act, "recitals": parse_recitals, "sections": parse_sections, "code": parse_code}
_COLUMNS = [("unit_type", "string"), ("unit_number", "string"), ("unit_path", "string"), ("parent_path", "string"), ("heading", "string"), ("context", "string"), ("text", "string"), ("page", "int")]


def parse(documents: DataFrame, key: str, text: str, parser: str) -> DataFrame:
    """(key, ordinal, unit_type, unit_number, unit_path, parent_path, heading, context, text, page, error) of each document.

    A document that the parser refuses has one row with its error and no unit; a null text is such a
    document. A document without units has no row. Each row is parsed where it lies.
    """
    function = PARSERS[parser]
    kind = documents.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, ordinal int, " + ", ".join(f"{n} {t}" for n, t in _COLUMNS) + ", error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[dict] = []
            for i, content in enumerate(batch.column(1).to_pylist()):
                try:
                    if content is None:
                        raise ParseError("no text")
                    units = [u | {"ordinal": n, "error": None} for n, u in enumerate(function(content), 1)]
                except ParseError as error:
                    units = [{"error": str(error)}]
                at += [i] * len(units)
                rows += units
            if rows:
                types = {"string": pa.string(), "int": pa.int32()}
                columns = [pa.array([r.get(n) for r in rows], types[t]) for n, t in [("ordinal", "int"), *_COLUMNS, ("error", "string")]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], names=[key, "ordinal", *(n for n, _ in _COLUMNS), "error"])

    return documents.select(key, F.col(text).cast("string")).mapInArrow(run, ddl)


def parse_by_source(documents: DataFrame, key: str, text: str, parser: str) -> DataFrame:
    """The same where the column `parser` names each document's parser; unknown names are errors."""
    parts = [parse(documents.where(F.col(parser) == name), key, text, name) for name in PARSERS]
    known = F.coalesce(F.col(parser).isin(*PARSERS), F.lit(False))
    empty = [F.lit(None).cast(t).alias(n) for n, t in [("ordinal", "int"), *_COLUMNS]]
    whole = documents.where(~known).select(key, *empty, F.concat(F.lit("no parser "), F.coalesce(F.col(parser), F.lit("null"))).alias("error"))
    for part in parts:
        whole = whole.unionByName(part)
    return whole
