import pytest

from vellum.llm.lookalikes import Normalizer, classes, confusables, fingerprints, lookalike_pairs, normalized

SAME = [
    ("Article 12 of the Act", "Ａｒｔｉｃｌｅ １２ of the Act"),
    ("café", "café"),
    ("ﬁle office", "file oﬃce"),
    ("soft­hyphen zero​width", "softhyphen zerowidth"),
    ("a  b c　d\n", " a b c d"),
    ("K-12", "K‑12"),
    ("don't “say”", "don’t \"say\""),
    ("the article", "thе аrticlе"),
    ("registro éxito", "registrо е́xito"),
    ("Annex VI, 5 K", "Annex Ⅵ, 5 K"),
    ("защита и право", "зaщита и прaво"),
    ("No 5", "№ 5"),
    ("over the hill", "оνer thе hill"),
    ("Φύλακας ΠΓ", "Фύλακας ПГ"),
    ("no sum", "ոօ ѕսm"),
    ("HALT", "ᎻAᏞᎢ"),
    ("gжo on", "gжо on"),
]
OTHER = [("the act", "The act"), ("resume", "résumé"), ("10", "1O"), ("K-12", "K12"), ("the act", "theact"), ("a b", "ab"), ("act.", "act"), ("x 1", "x 2"), ("б", "6")]


@pytest.mark.parametrize("a, b", SAME)
def test_reads_the_same(a, b):
    n = Normalizer()
    assert n.form(a) == n.form(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_reads_otherwise(a, b):
    n = Normalizer()
    assert n.form(a) != n.form(b)


@pytest.mark.parametrize("text", [t for pair in SAME + OTHER for t in pair] + ["", " ​ ", "日本語 テスト ｶﾞ", "한국어", "ä́", "́x", "x" * 5_000])
def test_offsets_and_idempotence(text):
    n = Normalizer()
    form, offsets = n.form_with_offsets(text)
    assert form == n.form(text) == n.form(form)
    assert len(offsets) == len(form) and offsets == sorted(offsets) and all(0 <= o < len(text) for o in offsets)


def test_whole_script_words_follow_their_text():
    n = Normalizer()
    assert n.form("the со of") == "the co of"
    assert n.form("со защитой") == "со защитой"


def test_confusable_tokens(spark):
    df = spark.createDataFrame([(1, "the аct is a ѕсоре here", "k"), (2, "the act", "k"), (3, None, "k"), (4, "со защитой", "k"), (1, "the аct is a ѕсоре here", "k")], "unit_id long, text string, form string")
    got = sorted((r["unit_id"], r["kind"], r["form"], tuple(r["scripts"])) for r in confusables(df).collect())
    assert got == [(1, "mixed", "act", ("CYRILLIC", "LATIN")), (1, "whole", "scope", ("CYRILLIC",))]
    assert confusables(df.limit(0)).count() == 0


def test_hot_classes_in_blocks(spark):
    rows = [(i, ("the act", "thе act", "the  act")[i % 3], "k") for i in range(40)]
    prints = fingerprints(spark.createDataFrame(rows, "unit_id long, text string, raw string"))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 != b % 3}
    assert {tuple(r) for r in lookalike_pairs(prints, block=7).collect()} == {tuple(r) for r in lookalike_pairs(prints).collect()} == want
    links = {r["unit_id"]: (r["members"], r["links"]) for r in classes(prints).collect()}
    assert links[0] == (40, 26) and links[1] == (40, 27)


def test_pairs(spark):
    rows = [(1, "the act", "k"), (2, "thе act", "k"), (2, "thе act", "k"), (3, "the act", "k"), (4, "the act", "k"), (5, "else", "k"), (6, None, "k"), (7, "", "k"), (8, " ​", "k"), (9, " ", "k"), (None, "the act", "k")]
    df = spark.createDataFrame(rows, "unit_id long, text string, raw string")
    prints = fingerprints(df)
    assert {tuple(r) for r in lookalike_pairs(prints).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert classes(prints.where("unit_id is not null")).count() == 4
    assert lookalike_pairs(fingerprints(df.limit(0))).count() == 0
    forms = {r["unit_id"]: r["form"] for r in normalized(df.where("unit_id is not null").distinct()).collect()}
    assert forms[6] is None and forms[7] == "" and forms[2] == "the act"
