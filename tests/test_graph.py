import pytest
from pyspark.sql import functions as F

from vellum.functions.models import embedder
from vellum.operators import graph as G
from vellum.operators import library as L
from vellum.operators import runs as N
from vellum.operators import verify as V
from vellum.operators.answers import score_cases

QUESTIONS = "question_id int, round int, question string, intent string, articles array<string>, annexes array<string>, sides array<string>, legal_test string, follow_up string, follow_kind string, follow_sides array<string>, label string"


def test_plan(spark):
    rows = [
        (1, 1, "q", "lookup", ["6"], ["III"], [], "none", None, None, None, ""),
        (2, 1, "q", "comparison", [], [], ["a", "b", "c", "d"], None, None, None, None, ""),
        (3, 1, "q", "applicability", [], None, None, "high_risk", None, None, None, ""),
        (4, 2, "q", "lookup", ["9"], [], [], None, "And Articles 5 and 6a?", "lookup", [], ""),
        (5, 1, "q", "comparison", None, None, ["one"], None, None, None, None, ""),
        (6, 2, "q", "lookup", [], [], [], None, "x or y", "comparison", ["x", "y"], ""),
    ]
    got = [(r["question_id"], r["side"], r["query"], r["label"], r["articles"], r["annexes"], r["named_only"]) for r in G.plan(spark.createDataFrame(rows, QUESTIONS)).orderBy("question_id", "side").collect()]
    assert got == [
        (1, 0, "q", "", ["6"], ["III"], False),
        *((2, i, s, f"for: {s}", [], [], False) for i, s in enumerate("abc")),
        (3, 0, "q", "", [], [], False),
        (3, 1, "q", "the legal test in Article 6, Annex III", ["6"], ["III"], True),
        (4, 0, "And Articles 5 and 6a?", "for: And Articles 5 and 6a?", ["5", "6a"], [], False),
        (5, 0, "q", "", [], [], False),
        (6, 0, "x", "for: x", [], [], False),
        (6, 1, "y", "for: y", [], [], False),
    ]


def test_attempts(spark):
    rows = [
        (1, 1, 1, True, 0, 0.0), (1, 1, 2, True, 0, 0.0), (1, 1, 3, False, 0, 1.0),
        (2, 1, 1, False, 2, 0.5), (2, 1, 2, True, 0, 0.0), (2, 1, 3, False, 1, 0.5), (2, 1, 4, False, 0, 1.0),
        (3, 1, 1, False, 1, 0.9), (3, 2, 1, True, 5, 0.1), (3, 2, 2, False, 0, 1.0),
    ]
    found = G.final_attempts(spark.createDataFrame(rows, "question_id int, round int, attempt int, overran boolean, rejected int, coverage double"))
    assert {(r["question_id"], r["round"]): (r["attempts"], r["overran"], r["path"]) for r in found.collect()} == {
        (1, 1): (2, True, "generate > shorten > generate > verify"),
        (2, 1): (3, False, "generate > verify > repair > generate > shorten > generate > verify"),
        (3, 1): (1, False, "generate > verify"),
        (3, 2): (1, True, "generate > verify"),
    }


def test_texts(spark):
    row = spark.createDataFrame([("next?", "before", "  ", True), ("next?", "before", "full", False), ("next?", None, "x", False), ("next?", "before", " ", False)], "q string, p string, r string, f boolean")
    assert [r[0] for r in row.select(G.standalone(F.col("q"), F.col("p"), F.col("r"), F.col("f"))).collect()] == ["before next?", "full", "next?", "next?"]
    claims = spark.createDataFrame(
        [(1, 2, " two ", "law", [("Article 5", "u", 'a "b"'), ("Article 5", "v", "c"), ("Recital 2", None, "d")]), (1, 1, "one", "code", []), (2, 1, "b", "law", None), (2, 2, "a", "law", None)],
        "question_id int, claim_no int, claim string, basis string, citations array<struct<label: string, link: string, quote: string>>",
    )
    bodies = {r["question_id"]: r["body"] for r in G.rendered_claims(claims).collect()}
    assert bodies[1] == '**Legal requirement**\n\ntwo [Art. 5](<u> "a \\"b\\"") `Rec. 2`\n\n**Practical implementation**\n\none'
    assert bodies[2] == "b\n\na"
    criteria = spark.createDataFrame([(1, "c", "e", "met"), (1, "d", None, "met")], "question_id int, criterion string, explanation string, status string")
    kept = spark.createDataFrame([(1, "c - e"), (2, "d")], "question_id int, text string")
    assert [r["criterion"] for r in G.surviving_criteria(criteria, kept).collect()] == ["c"]
    turns = spark.createDataFrame([(1, i, f"q{i}" if i != 2 else " ", f"a{i}") for i in range(5)], "t int, n int, question string, answer string")
    assert G.history(turns, "t", [F.desc("n")]).first()["turns"] == "\n\n".join(f"User: q{i}\nAssistant: a{i}" for i in (1, 3, 4))
    blocks = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, place int, block string")
    prompt = G.prompts(blocks, "q").select(G.user_prompt(F.lit("Q"), F.col("evidence"), F.array(F.lit("bad")), F.lit(False))).first()[0]
    assert prompt == "QUESTION\nQ\n\nEVIDENCE\n\na\n\n---\n\nb\n\nAnswer the question using only the evidence above.\n\nREJECTED QUOTES\n  - bad"


def test_library(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "key int, text string")
    cache = spark.createDataFrame([("c",)], "text string").select(F.sha2("text", 256).alias("sha"), embedder(4)(F.col("text")).alias("vector"))
    rows, fresh = L.embed_with_cache(texts, cache, embedder(4), max_new=1)
    assert {r["key"]: (r["reused"], r["vector"] is None) for r in rows.collect()} == {1: (False, False), 2: (False, False), 3: (True, False), 4: (False, True)} and fresh.count() == 1
    with pytest.raises(RuntimeError):
        L.embed_with_cache(texts, cache, embedder(4), max_new=0)
    passages = spark.createDataFrame([("quick brown fox",), ("x",), ("brown",), ("",), ("k br",), ("row",), (" ",), ("oxen",)], "passage string")
    docs = spark.createDataFrame([(1, "the quick brown foxes"), (2, "quick brown"), (3, "axe"), (4, None), (5, "")], "key int, text string")
    assert sorted(map(tuple, L.containing(passages, docs).collect())) == [(" ", 1), (" ", 2), ("brown", 1), ("brown", 2), ("k br", 1), ("k br", 2), ("quick brown fox", 1), ("row", 1), ("row", 2), ("x", 1), ("x", 3)]
    assert L.consolidated_prefix and spark.createDataFrame([("32024R1",)], "c string").select(L.consolidated_prefix(F.col("c"))).first()[0] == "02024R1"
    with pytest.raises(Exception, match="register number"):
        spark.createDataFrame([("",)], "c string").select(L.consolidated_prefix(F.col("c"))).collect()


def test_diagnosis_and_scores(spark):
    quotes = spark.createDataFrame([(1, 1, "the provider shall not keep the technical file ready"), (2, 1, "completely different words about other matters")], "quote_id int, unit_id int, quote string")
    units = spark.createDataFrame([(1, "In general the provider shall keep the technical file ready for ten years.")], "unit_id int, text string")
    near = {r["quote_id"]: r["closeness"] for r in V.diagnose(V.verify_quotes(quotes, units), quotes, units).collect()}
    assert near[1] > 85 > 60 > near[2]
    rows = [("a", ["6"], ["III"], ["Article 6"], False, "answered", "You must comply", False), ("b", [], None, [], False, "answered", "you must comply", True)]
    got = {r["id"]: (r["recall"], r["leaked"]) for r in score_cases(spark.createDataFrame(rows, "id string, expected array<string>, expected_annexes array<string>, cited array<string>, should_abstain boolean, verdict string, blob string, expect_criteria boolean")).collect()}
    assert got == {"a": (0.5, False), "b": (1.0, True)}


RESULTS = "id int, error string, verdict string, should_abstain boolean, expect_criteria boolean, produced_criteria boolean, leaked boolean, recall double, coverage double, quotes_total int, quotes_dropped int, tokens int, waited_ms int, latency_ms int, bases map<string,int>"


def test_summary(spark):
    rows = [(1, None, "answered", False, True, True, True, 0.5, 0.8, 4, 1, 100, 1_500, 900, {"code": 2}), (2, "boom", "answered", True, False, False, False, None, 0.0, 9, 9, 9, 9, 9, {}), (3, None, "answered", True, False, False, False, None, 0.6, 0, 0, 51, 0, 0, {"law": 1})]
    s = N.summary(spark.createDataFrame(rows, RESULTS)).first()
    assert (s["cases"], s["errors"], s["answer_rate"], s["correct_refusals"], s["citation_recall"], s["quote_accuracy"], s["tokens_per_case"], s["wait_s"], s["latency_p50"], s["latency_p95"]) == (3, 1, 1.0, "0/1", 0.5, 0.75, 75, 1, 900, 0)
    assert sorted(map(tuple, N.flagged(spark.createDataFrame(rows, RESULTS)).collect())) == [("false_answer", 3), ("verdict_leak", 1), ("without_law", 1)]
    empty = N.summary(spark.createDataFrame([], RESULTS)).first()
    assert (empty["cases"], empty["answer_rate"], empty["latency_p95"], empty["correct_refusals"]) == (0, 0.0, 0, "0/0")
