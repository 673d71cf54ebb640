import random

from vellum.llm.reading import document_frequencies, familiar_words, features, fit, language_code, reading_levels
from vellum.session import Cuts

EASY = "You can ask us. Show the card. We can help you. The form is free. Keep the note safe.".split(". ")
HARD = "notwithstanding the foregoing the {0} undertaking shall substantiate the {1} proportionality of the {2} thresholds subject to the {3} limitations enunciated therein and shall periodically revalidate the {4} allocation of residual liability between successive intermediaries"
RARE = [f"{a}{b}tional" for a in "bcdfglmnprst" for b in ("an", "er", "is", "ol", "ut", "en", "ar")]


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        hard = i % 4 == 0
        text = ". ".join(HARD.format(*rng.choices(RARE, k=5)) for _ in range(3)) if hard else ". ".join(rng.choices(EASY, k=12)) + "."
        docs.append((i, text, [" en", "EN", "en-GB", None][i % 4] if i % 8 else "xx-", "clash", 1))
        if i % 3 == 0:
            labels.append((i, "a", (4 if hard else 1) - (i % 27 == 0) * hard))
    return docs, labels


DOCS = "doc_id long, text string, lang string, sentence string, n_words int"


def levels(spark, docs, labels):
    cuts = Cuts(spark)
    df = spark.createDataFrame(docs, DOCS)
    lists = familiar_words(cuts.cut(document_frequencies(df)))
    return reading_levels(cuts.cut(features(df, lists)), spark.createDataFrame(labels, "doc_id long, annotator string, reading_level int"))


def test_held_out_levels(spark):
    docs, labels = corpus()
    known = {i for i, _, _ in labels}
    found = {r["doc_id"]: r["reading_level"] for r in levels(spark, docs, labels).collect()}
    held_out = [i for i in found if i not in known]
    right = sum((found[i] == 4) == (i % 4 == 0) for i in held_out)
    assert right / len(held_out) > 0.97


def test_edge_rows(spark):
    docs, labels = corpus(40)
    odd = [(100, None, "en", "", 0), (101, "", None, "", 0), (102, " \n ", "en", "", 0), (103, "too short to tell.", "en", "", 0), (104, "x" * 50_000, "en", "", 0), (105, "申請は無料です。 " * 40, "ja", "", 0), (1, docs[1][1], "EN", "", 1)]
    found = levels(spark, docs + odd, labels + [(None, None, 4), (5, None, None)])
    by_id = {r["doc_id"]: r["reading_level"] for r in found.collect()}
    assert [by_id[i] for i in (100, 101, 102, 103, 104)] == [None] * 5 and by_id[105] in (1, 2, 3, 4)
    assert found.count() == len(docs) + len(odd)
    assert levels(spark, [], []).count() == 0
    assert {r["reading_level"] for r in levels(spark, docs, []).collect()} <= {1, None}


def test_documents_without_language_are_counted(spark):
    docs = [(i, "the form is free of charge", "en", "", 0) for i in range(6)] + [(i, "das blatt ist frei", "de", "", 0) for i in range(6, 12)] + [(12, "the form is late", None, "", 0), (13, "das blatt fehlt", "und", "", 0), (14, "??", None, "", 0), (15, None, None, "", 0)]
    df = spark.createDataFrame(docs, DOCS)
    stated = Cuts(spark).cut(document_frequencies(df))
    told = {(r["lang"], r["word"]): r["n"] for r in document_frequencies(df, familiar_words(stated)).collect()}
    assert told["en", ""] == told["de", ""] == told["en", "late"] == told["de", "fehlt"] == 1 and len(told) == 9


def test_parts():
    assert [language_code(x) for x in ("en", " EN ", "en-GB", "fr_XX", "und", "", None, "e")] == ["en", "en", "en", "fr", "", "", "", ""]
    assert all(m[1][0] < 0 for m in fit([]))
