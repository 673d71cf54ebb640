import pytest

from vellum.operators import parse as P

ACT = """CHAPTER I
General
Article 1 Scope'
1. This applies to all.
(a) also here
2. It binds cumu­
lative parties.
\f02024R1689 — EN — 27.07.2026 — 001.001 — 61
▼B
SECTION 1
►Article 2
Unnumbered text.
ANNEX I
List"""


def test_act():
    units = P.parse_act(ACT)
    assert [(u["unit_type"], u["unit_number"], u["unit_path"], u["parent_path"], u["page"]) for u in units] == [
        ("chapter", "I", "CH_I", None, 1),
        ("article", "1", "CH_I/ART_1", "CH_I", 1),
        ("paragraph", "1(1)", "CH_I/ART_1/PAR_1", "CH_I/ART_1", 1),
        ("paragraph", "1(2)", "CH_I/ART_1/PAR_2", "CH_I/ART_1", 1),
        ("section", "1", "CH_I/SEC_1", "CH_I", 2),
        ("article", "2", "CH_I/SEC_1/ART_2", "CH_I/SEC_1", 2),
        ("annex", "I", "ANX_I", None, 2),
    ]
    assert units[1]["heading"] == "Scope" and units[3]["text"] == "2. It binds cumulative parties." and units[2]["text"].endswith("also here")
    assert P.read_lines(ACT)[1] == "2026-07-27"


def test_outline():
    outline = [(2, "CHAPTER I General", 1), (3, "SECTION 1", 2), (4, "Article 2", 2), (1, "ANNEX I List", 2)]
    assert [u["unit_path"] for u in P.parse_act(ACT, outline)] == ["CH_I", "CH_I/SEC_1", "CH_I/SEC_1/ART_2", "ANX_I"]
    with pytest.raises(P.ParseError):
        P.parse_act(ACT, [*outline, (4, "Article 9", 2)])


def test_recitals():
    text = "\n".join(f"({n}) Reason {n} ( ) holds.\n(99) is no reason" for n in range(1, 25)) + "\nHAVE ADOPTED THIS REGULATION\n(25) not here"
    found = P.parse_recitals(text, 24)
    assert len(found) == 24 and found[0]["text"] == "(1)\nReason 1 holds.\n(99) is no reason" and found[-1]["unit_path"] == "RCT_24"
    for bad in ("(1) x", "(1) x\nHAVE ADOPTED THIS REGULATION"):
        with pytest.raises(P.ParseError):
            P.parse_recitals(bad)
    with pytest.raises(P.ParseError):
        P.parse_recitals(text, 23)
    assert P.sized_line([("(7)", 8.5), ("Whereas", 9.6), ("note", 8.5)]) == ("7", "Whereas")
    assert P.sized_line([("(7)", 8.5), ("See", 8.5)]) == (None, "") and P.sized_line([("(7)", 9.6), ("of", 9.6)]) == (None, "(7) of")


def test_sections():
    contents = "\n".join(f"{n}. Part {'xABCDEF'[n]} ....... {n}" for n in range(1, 7)) + "\n9. Stray"
    body = "\n".join(f"{n}. Part {'xABCDEF'[n]}\nText, see\n1. item of a list;\n" + (f"{n}.1. Detail\nMore" if n == 2 else "") for n in range(1, 7))
    units = P.parse_sections(contents + "\n" + body)
    assert [u["unit_path"] for u in units] == ["SEC_1", "SEC_2", "SEC_2/SEC_2.1", "SEC_3", "SEC_4", "SEC_5", "SEC_6"]
    assert P.parse_sections("1. One\ntext\n2. Two\ntext")[0] | {"text": ""} == P._unit("section", None, "SEC_1", None, None, "", 1)
    bunched = body + "\f".join(["", "page", "page", "page", "page"])
    assert len(P.parse_sections(bunched)) == 1
    outline = [(1, "Introduction", 1), (1, "2. Scope of the guide", 1), (2, "2.1. Terms", 1), (1, "Absent", 1), (1, "Last words", 1), (1, "End", 1)]
    found = P.parse_sections("Introduction\nx\n2. Scope of\nthe guide\n2.1. Terms\ny\nLast words\nz\nEnd", outline)
    assert [u["unit_path"] for u in found] == ["SEC_1", "SEC_2", "SEC_2/SEC_2.1", "SEC_4", "SEC_5"]


CODE = """Section 1 Marking
Recitals
intro
a) Trust: people rely on it.
(b) The signatories recognise much. And more.
b) not again
Commitment 1. Marks
LEGAL TEXT: Article 50(2)
2. Providers shall mark.
Signatories will do so.
Measure 1.1 Tags (optional)
Sub-measure 1.1.1
12
Section 2 Rest
Commitment 1
Glossary
Term Definition
‘Mark’\tA sign
on a thing
Tag\tA label"""


def test_code():
    units = {u["unit_path"]: u for u in P.parse_code(CODE)}
    assert list(units) == [
        "SEC_Section_1", "SEC_Recitals", "SEC_Recitals/REC_a", "SEC_Recitals/REC_b", "SEC_Recitals/SEC_Commitment_1", "SEC_Recitals/SEC_Commitment_1/LEGAL", "SEC_Recitals/SEC_Commitment_1/SEC_Measure_1.1",
        "SEC_Recitals/SEC_Commitment_1/SEC_Measure_1.1/SEC_Sub-measure_1.1.1", "SEC_Section_2", "SEC_Section_2/SEC_Commitment_1", "SEC_Glossary", "SEC_Glossary/TERM_1", "SEC_Glossary/TERM_2",
    ]
    assert units["SEC_Recitals/REC_a"]["heading"] == "Trust" and units["SEC_Recitals/REC_b"]["heading"] is None
    legal = units["SEC_Recitals/SEC_Commitment_1/LEGAL"]
    assert legal["text"] == "2. Providers shall mark." and "Providers" not in units[legal["parent_path"]]["text"]
    assert units["SEC_Recitals/SEC_Commitment_1/SEC_Measure_1.1"]["context"].endswith("implements Article 50(2) | optional")
    assert units["SEC_Section_2/SEC_Commitment_1"]["unit_number"] == "S2 Commitment 1"
    assert units["SEC_Glossary/TERM_1"]["text"] == "‘Mark’\nA sign on a thing"


def test_rows(spark):
    rows = [(1, ACT, "act", 0), (2, None, "act", 0), (3, "", "sections", 0), (4, "x" * 50_000, "sections", 0), (5, CODE, "code", 0), (6, "x", "none", 0), (7, "x", None, 0), (1, ACT, "act", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parser string, page int")
    found = P.parse_by_source(df, "doc_id", "text", "parser").collect()
    errors = {r["doc_id"]: r["error"] for r in found if r["error"]}
    assert errors == {2: "no text", 3: "no text", 6: "no parser none", 7: "no parser null"}
    assert sum(r["doc_id"] == 1 for r in found) == 14 and sum(r["doc_id"] == 4 for r in found) == 1
    assert P.parse(df.limit(0), "doc_id", "text", "act").count() == 0
