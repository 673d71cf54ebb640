import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions.models import embedder, overlap_score
from vellum.operators import monitor as M
from vellum.operators import retrieval as R
from vellum.operators import structure as S
from vellum.operators import verify as V
from vellum.operators import versions as N

UNIT = "unit_id long, document_version_id long, parent_id long, unit_type string, unit_number string, unit_path string, heading string, text string, ordinal int, source_id int"


@pytest.mark.parametrize("block", [2_000, 7])
def test_nearest_batch_is_exact(spark, block):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[5] = vectors[6]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(999, None)], "vec_id long, embedding array<float>")
    found = R.nearest_batch(df, df.where("vec_id % 10 = 0"), 5, block=block).collect()
    stored = vectors.astype(np.float32).astype(float)
    for q in range(0, 300, 10):
        order = sorted(range(300), key=lambda i: (round(1 - float(stored[i] @ stored[q]), 9), i))[:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["place"])] == order
    assert R.nearest_batch(df.limit(0), df.limit(0), 5).count() == 0
    assert [r["vec_id"] for r in R.nearest(df, list(stored[5]), 2).collect()] == [5, 6]


def test_match_all(spark):
    units = spark.createDataFrame([(1, "The price list of the school"), (2, "price only"), (3, None), (4, "LIST price!"), (4, "LIST price!")], "unit_id long, text string").dropDuplicates()
    queries = spark.createDataFrame([("a", ["price", "list"]), ("b", []), ("c", ["nowhere"])], "query string, terms array<string>")
    assert sorted((r["query"], r["unit_id"]) for r in R.match_all(units, queries).collect()) == [("a", 1), ("a", 4)]


def test_active_units_and_lookup(spark):
    units = spark.createDataFrame([(1, 1, None, "article", "12", "ART_12", None, "t", 1, 7), (2, 1, 1, "paragraph", "1", "CH_I/ART_12/PAR_1", None, "t", 2, 7), (3, 2, None, "article", "12", "ART_12", None, "t", 1, 7), (4, 1, None, "annex", "iv", "ANX_IV", None, "t", 3, 7)], UNIT)
    versions = spark.createDataFrame([(1, 1, "v", "active"), (2, 1, "w", "superseded")], "document_version_id long, source_id int, version_label string, status string")
    sources = spark.createDataFrame([(1, "key", "T", "LAW")], "source_id int, source_key string, title string, authority string")
    active = R.active_units(units, versions, sources)
    assert {r["unit_id"] for r in active.collect()} == {1, 2, 4} and R.active_units(units, versions, sources, []).count() == 0
    assert [r["unit_id"] for r in R.structural_lookup(active, [" 12"], ["IV "]).collect()] == [1, 2, 4]


def test_quotes(spark):
    text = "The provider shall keep the technical file for ten years. It shall not delete the pre‑market records before that date."
    evidence = spark.createDataFrame([(1, text)], "unit_id long, text string")
    quotes = [
        (1, 1, "“The provider shall keep the technical file for ten years.”"),
        (2, 1, "The provider shall keep [...] delete the pre-market records"),
        (3, 1, "delete the pre-market records [...] The provider shall keep"),
        (4, 1, "The provider shall not keep the technical file for ten years"),
        (5, 1, "ten years"),
        (6, 9, "The provider shall keep the technical file"),
        (7, 1, None),
    ]
    got = {r["quote_id"]: r for r in V.verify_quotes(spark.createDataFrame(quotes, "quote_id long, unit_id long, quote string"), evidence).collect()}
    assert [got[i]["method"] for i in range(1, 8)] == ["exact", "elided", "not_found", "not_found", "short", "unknown", "short"]
    assert got[1]["shown"] == text[: text.index(".")] and got[2]["shown"].endswith("pre‑market records")


def test_verdicts(spark):
    df = spark.createDataFrame([(0.8, 1), (0.79, 1), (0.4, 2), (0.1, 2), (1.0, 0), (1.0, None)], "c double, n int")
    assert [r[0] for r in df.select(V.verdict(F.col("c"), F.col("n"))).collect()] == ["answered", "partial", "partial", "abstained", "abstained", "abstained"]


def test_sequences():
    rng = random.Random(4)
    for _ in range(200):
        v = [rng.randint(0, 9) for _ in range(rng.randint(0, 12))]
        kept = [v[i] for i in S.longest_increasing(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(kept) == max(best, default=0) and all(a < b for a, b in zip(kept, kept[1:]))
    assert S.stack_parents([1, 2, 3, 2, 1, 3]) == [-1, 0, 1, 0, -1, 4]
    assert S.running_items(["1", "3", "2", "x", "3"]) == [True, False, True, False, True]
    assert S.running_items(["a", "b", "d", "c"]) == [True, True, False, True]


def test_paragraphs_and_chunks(spark):
    docs = spark.createDataFrame([(1, "Intro\n1. First\n(a) x\n2a. Second"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["paragraph_no"], r["label"], r["paragraph"]) for r in S.paragraphs(docs, "doc_id", "text").collect() if r["doc_id"] == 1)
    assert got == [(1, 0, None, "Intro"), (1, 1, "1", "1. First\n(a) x"), (1, 2, "2a", "2a. Second")]
    pieces = spark.createDataFrame([("d", i, c) for i, c in enumerate([200, 200, 200, 900, 10])] + [("e", 0, 1)], "d string, i int, cost int")
    chunks = S.greedy_chunks(pieces, "d", "i", "cost").collect()
    assert [r["chunk_no"] for r in sorted(chunks, key=lambda r: (r["d"], r["i"]))] == [0, 0, 1, 2, 3, 0]


def test_paths(spark):
    units = spark.createDataFrame([(1, 1, "A"), (1, 2, "A/B"), (1, 3, "A/B/C"), (1, 4, "A_B/C"), (2, 5, "A/B")], "v long, id long, path string")
    got = sorted((r["id"], r["ancestor"]) for r in S.ancestor_pairs(units, "v", "id", "path").collect())
    assert got == [(2, 1), (3, 1), (3, 2)]


def test_percentile_and_kpis(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 10)] + [("h", 5), ("g", None)], "g string, v int")
    got = {r["g"]: (r["p50"], r["p95"]) for r in M.rank_percentile(df, ["g"], "v", {"p50": (1, 2), "p95": (19, 20)}).collect()}
    assert got == {"g": (4, 8), "h": (5, 5)}
    log = "query_id long, logged_at timestamp, asked_at timestamp, intent string, verdict string, citation_coverage double, quotes_total int, quotes_dropped int, latency_ms int, model string"
    rows = [(1, None, None, " Lookup", "answered", 1.0, 4, 1, 100, "m"), (2, None, None, None, "abstained", None, None, None, 0, "m"), (3, None, None, "GREETING ", "abstained", None, 0, 0, 50, "m")]
    k = M.kpis(M.one_per_question(spark.createDataFrame(rows, log))).first()
    assert (k["questions"], k["small_talk"], k["answer_rate"], k["quote_accuracy"], k["p50"]) == (3, 1, 0.5, 0.75, 100)
    assert M.kpis(spark.createDataFrame([], log)).first()["questions"] == 0


def test_versions(spark):
    versions = spark.createDataFrame([(1, 1, "active", None, "0X-1", None), (2, 1, "discovered", None, "0X-2", None), (3, 2, "active", None, "0Y-1", None)], "document_version_id long, source_id int, status string, superseded_by long, celex string, doc_date date")
    got = {r["document_version_id"]: (r["status"], r["superseded_by"]) for r in N.activate(versions, versions.where("status = 'discovered'")).collect()}
    assert got == {1: ("superseded", 2), 2: ("active", None), 3: ("active", None)}
    sources = spark.createDataFrame([(1, "3X"), (2, ""), (3, None)], "source_id int, celex_base string")
    assert [r["celex"] for r in N.consolidated(versions, sources).collect()] == ["0X-2"]
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    cache = spark.createDataFrame([("b",)], "text string").select(F.sha2("text", 256).alias("sha"))
    assert tuple(N.embed_plan(texts, cache).first()) == (3, 1, 1) and N.new_texts(texts, cache).count() == 1


def test_model_seams(spark):
    df = spark.createDataFrame([("the price list",), (None,)], "t string")
    rows = df.select(embedder(16)(F.col("t")).alias("e"), overlap_score(F.lit("price of list"), F.col("t")).alias("s")).collect()
    assert abs(sum(x * x for x in rows[0]["e"]) - 1) < 1e-5 and not any(rows[1]["e"]) and rows[0]["s"] == 0.5
