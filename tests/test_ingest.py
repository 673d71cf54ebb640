import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import answers as A
from vellum.operators import ingest as I  # noqa: E741
from vellum.operators.structure import ancestor_pairs
from vellum.sources import files
from vellum.streaming import monitor as S


def test_lines_to_units(spark):
    text = "intro\n12\nCHAPTER I Duties\nbody of the chapter\nArticle 3 Scope\nfirst co­\nntinued\n▲ M1\nlast ....... 7\n\n  end "
    pages = spark.createDataFrame([(1, text), (2, None), (3, "no heading")], "doc_id long, text string")
    units = I.units_from_lines(I.clean_lines(pages, "doc_id", "text"), "doc_id").orderBy("doc_id", "unit_no").collect()
    assert [(r["doc_id"], r["unit_no"], r["unit_type"], r["unit_number"], r["heading"], r["text"]) for r in units] == [
        (1, 0, None, None, None, "intro"),
        (1, 1, "chapter", "I", "Duties", "body of the chapter"),
        (1, 2, "article", "3", "Scope", "first continued\nend"),
        (3, 0, None, None, None, "no heading"),
    ]


def test_glossary(spark):
    lines = spark.createDataFrame([(1, 0, "\tlost"), (1, 1, "Term\tone"), (1, 2, "\ttwo"), (1, 3, "plain"), (1, 4, "Other\tx")], "doc_id int, line_no int, line string")
    assert sorted((r["term"], r["meaning"]) for r in I.glossary(lines, "doc_id").collect()) == [("Other", "x"), ("Term", "one two")]


def test_breadcrumbs_selection_chunks(spark):
    schema = "unit_id long, document_version_id long, parent_id long, unit_type string, unit_number string, unit_path string, heading string, context string, text string, ordinal int"
    units = spark.createDataFrame(
        [
            (1, 1, None, "chapter", "III", "CH_III", "Duties", None, "x", 1),
            (2, 1, 1, "article", "6", "CH_III/ART_6", None, None, "own", 2),
            (3, 1, 2, "paragraph", "1", "CH_III/ART_6/PAR_1", None, " ", "p " * 400, 3),
            (4, 1, 2, "paragraph", "2", "CH_III/ART_6/PAR_2", None, "A › B", "q " * 400, 4),
            (5, 1, 2, "paragraph", None, "CH_III/ART_6/PAR_3", None, None, " ", 5),
        ],
        schema,
    )
    pairs = ancestor_pairs(units, "document_version_id", "unit_id", "unit_path")
    titles = spark.createDataFrame([(1, "The Act")], "document_version_id long, title string")
    crumbs = {r["unit_id"]: r["breadcrumb"] for r in I.breadcrumbs(units, pairs.select("unit_id", "ancestor", F.length("ancestor_path").alias("depth")), titles).collect()}
    assert crumbs[3] == "The Act - Chapter III, Article 6, Paragraph 1 - Duties" and crumbs[4] == "The Act - A › B - Duties"
    assert {r["unit_id"] for r in I.select_units(units, pairs, ["article"]).collect()} == {1, 2}
    chunks = sorted((r["unit_id"], r["chunk_no"], len(r["text"])) for r in I.chunk_units(units).collect())
    assert chunks == [(2, 0, 3 + 2 + 800), (2, 1, 800)]  # the chapter has no own text to speak of


def test_plan_and_zip(spark):
    fetched = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "source_id int, sha string")
    stored = spark.createDataFrame([(1, 10, "a"), (2, 20, "x"), (3, 30, "c")], "source_id int, document_version_id long, sha string")
    counts = spark.createDataFrame([(10, 5), (20, 5)], "document_version_id long, n long")
    assert {r["source_id"]: r["action"] for r in I.ingest_plan(fetched, stored, counts).collect()} == {1: "up_to_date", 2: "ingest", 3: "ingest", 4: "ingest"}
    drafts, vectors = spark.createDataFrame([(0, "a"), (1, "b")], "i int, t string"), spark.createDataFrame([(0, [1.0]), (1, [2.0])], "i int, v array<double>")
    assert I.zip_strict(drafts, vectors, "i").count() == 2
    with pytest.raises(Exception, match="differ at"):
        I.zip_strict(drafts, vectors.where("i = 0"), "i").collect()


def test_answers(spark):
    text = "The provider shall keep the technical file for ten years."
    claims = spark.createDataFrame(
        [("q", 1, "kept", [("E1", text), ("E1", " ")]), ("q", 2, "lost", [("E1", "The provider may throw the file away at once"), ("E9", text)]), ("q", 3, " ", [("E1", text)]), ("q", 4, "bare", [])],
        "question_id string, claim_no int, claim string, quotes array<struct<label string, quote string>>",
    )
    evidence = spark.createDataFrame([("q", "E1", 7, "guidance", text)], "question_id string, label string, unit_id long, authority string, text string")
    checked = A.verify_answers(claims, evidence)
    assert sorted((r["claim_no"], r["verified"], r["rejected"], r["survives"], r["basis"]) for r in checked.collect()) == [(1, 1, 0, True, "guidance"), (2, 0, 2, False, None), (4, 0, 0, False, None)]
    out = A.outcomes(checked).first()
    assert (out["claims"], out["kept"], out["verdict"], out["needs_repair"]) == (3, 1, "abstained", True)
    rounds = spark.createDataFrame([("a", 1, "answered", 2), ("a", 2, "abstained", 0), ("b", 1, "answered", 1), ("b", 2, "partial", 1), ("c", 1, "abstained", 0)], "question_id string, round int, verdict string, claims int")
    assert {r["question_id"]: (r["rounds"], r["claims"], r["verdict"]) for r in A.merge_rounds(rounds).collect()} == {"a": (1, 2, "answered"), "b": (2, 2, "partial"), "c": (1, 0, "abstained")}


def test_case_scores(spark):
    rows = [("a", ["6", "anx:III"], ["Article 6", "Annex III"], False, "answered", ""), ("b", ["6"], ["Paragraph 6(2)"], False, "answered", "You must comply"), ("c", [], [], True, "abstained", None), ("d", ["5"], ["Article 50"], False, "abstained", "")]
    got = {r["id"]: (r["recall"], r["right"], r["leaked"]) for r in A.score_cases(spark.createDataFrame(rows, "id string, expected array<string>, cited array<string>, should_abstain boolean, verdict string, blob string")).collect()}
    assert got == {"a": (1.0, True, False), "b": (1.0, True, True), "c": (1.0, True, False), "d": (0.0, False, False)}
    costs = spark.createDataFrame([(1, 60), (2, 50), (3, 1)], "id int, cost int")
    assert [r["id"] for r in A.within_budget(costs, "id", "cost", 100).collect()] == [1, 2]


def test_evidence(spark):
    units = spark.createDataFrame([(1, None, "article", "x " * 900, "code"), (2, None, "article", "y " * 900, "law"), (3, 2, "paragraph", "p", "law")], "unit_id long, parent_id long, unit_type string, text string, authority string")
    hits = spark.createDataFrame([(9, 1, "dense", 1), (9, 3, "text", 1)], "query_id long, unit_id long, leg string, leg_rank int")
    got = A.gather_evidence(hits, units, budget=600).collect()
    assert [(r["unit_id"], r["label"]) for r in got] == [(2, "E1")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    docs = files.binary_documents(spark, f"{tmp_path}/*.pdf")
    assert {r["name"]: r["valid"] for r in docs.collect()} == {"a.pdf": True, "b.pdf": False}
    wanted = spark.createDataFrame([("a.pdf",), ("c.pdf",)], "name string")
    assert [r["name"] for r in files.missing(wanted, docs).collect()] == ["c.pdf"]
    files.write_manifest(docs, f"{tmp_path}/manifest")
    assert set(spark.read.json(f"{tmp_path}/manifest").columns) == {"path", "name", "size", "sha256", "valid"}
    (tmp_path / "r.json").write_text(json.dumps({"results": {"bindings": [{"work": {"value": "w1"}}, {"work": {"value": "w2"}, "date": {"value": "2020-01-01"}}]}}))
    assert sorted((r["work"], r["date"]) for r in files.query_results(spark, f"{tmp_path}/r.json", ["work", "date"]).collect()) == [("w1", None), ("w2", "2020-01-01")]
    (tmp_path / "cases.yaml").write_text("- {id: a, question: 'What?', expected_articles: ['6']}\n- {id: b, question: 'Why?', should_abstain: true}\n")
    assert [(r["id"], r["expected_articles"], r["should_abstain"]) for r in files.cases(spark, f"{tmp_path}/cases.yaml").collect()] == [("a", ["6"], False), ("b", [], True)]


def test_snapshots_and_lock(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    files.publish(spark.range(3).coalesce(1), root)
    files.publish(spark.range(5).coalesce(1), root)
    assert files.current(spark, root).count() == 5
    with files.Lock(spark, root, "k"):
        with pytest.raises(RuntimeError):
            with files.Lock(spark, root, "k"):
                pass
    with files.Lock(spark, root, "k"):
        pass
    files.append(spark.range(2), f"{tmp_path}/audit")
    files.append(spark.range(2), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 4


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i // 10}:{i % 10 * 5:02d}", "a" if i % 3 else "b") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").select("event_id", F.to_timestamp_ntz("ts").alias("ts"), "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = S.event_stream(spark, str(tmp_path))
    daily = S.run_to_table(S.daily_counts(stream), spark, f"{tmp_path}/c1")
    assert sorted((r["event_type"], r["n"]) for r in daily.collect()) == [("a", 20), ("b", 10)]
    loads = S.run_to_table(S.window_load(S.event_stream(spark, str(tmp_path))), spark, f"{tmp_path}/c2", "append").collect()
    seconds = {"a": [], "b": []}
    for i, _, kind in rows:
        seconds[kind].append(i // 10 * 60 + i % 10 * 5)
    expected = sorted((k, sum(s - 60 <= t <= s for t in v)) for k, v in seconds.items() for s in v)
    assert sorted((r["event_type"], r["load"]) for r in loads) == expected


def test_structure_expansion(spark):
    from vellum.operators.structure import with_structure

    line = "head\n" + "x" * 355  # 132 tokens
    units = spark.createDataFrame(
        [(1, 1, "Commitment 1", "C1", 1, line), (2, 1, "m", "C1/M1", 2, line), (3, 1, "m", "C1/M2", 3, line), (4, 1, "m", "C1/M2/S1", 4, line), (5, 1, "x", "C1X", 5, line), (6, 1, "z", "Z", 6, line), (7, 1, "z", "Z/Y", 7, "short")],
        "unit_id long, document_version_id long, unit_number string, unit_path string, ordinal int, text string",
    )
    evidence = spark.createDataFrame([("q", 3, "code", 1), ("q", 2, "code", 2), ("q", 6, "code", 3), ("q", 5, "law", 4)], "q string, unit_id long, authority string, place int")
    got = sorted((r["anchor"], r["unit_id"], r["full"]) for r in with_structure(evidence, units, "q", 140).collect())
    assert got == [(1, 1, 1), (1, 4, 0), (6, 7, 0)]  # 132, then an outline of 33, nothing is left for 33 more
    assert sorted(r["full"] for r in with_structure(evidence, units, "q", 400).collect()) == [1, 1, 1]
    assert with_structure(evidence.limit(0), units, "q", 400).count() == 0


def test_shortening(spark):
    from vellum.functions.text import fit_lines, retry_seconds, shorten

    df = spark.createDataFrame([("a" * 36 + "\n" + "b" * 36 + "\n" + "c" * 36,), ("x" * 400,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(fit_lines(F.col("t"), 53)).collect()]
    assert got == ["a" * 36 + "\n" + "b" * 36, "x" * 400, "short", None]
    assert [r[0] for r in df.select(shorten(F.col("t"), 10)).collect()] == ["aaaaaaa...", "xxxxxxx...", "short", None]
    waits = spark.createDataFrame([("please retry in 2.5s",), ('"retryDelay": "0.2s"',), ("no",), (None,)], "m string")
    assert [r[0] for r in waits.select(retry_seconds(F.col("m"))).collect()] == [2.5, 1.0, 20.0, 20.0]


def test_no_chunk_passes_the_target(spark):
    from vellum.functions.text import estimate_tokens
    from vellum.operators.structure import cut_text

    texts = ["aa bb. " * 900, "x" * 5_000, "line one\n" * 400 + "\n\n" + "y " * 2_000, "short"]
    for text in texts:
        parts = cut_text(text, 100)
        assert all(0 < len(p) <= 100 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert cut_text("one two\n\nthree four. five", 12) == ["one two", "three four.", "five"]
    units = spark.createDataFrame([(1, None, "article", "own", 1), *((i + 2, 1, "paragraph", t, i + 2) for i, t in enumerate(texts))], "unit_id long, parent_id long, unit_type string, text string, ordinal int")
    chunks = I.chunk_units(units).withColumn("whole", estimate_tokens(F.col("text"))).orderBy("chunk_no").collect()
    assert all(r["tokens"] <= 500 and r["whole"] <= 500 for r in chunks)
    assert "".join("".join(r["text"] for r in chunks).split()) == "".join("".join(["own", *texts]).split())
