from pyspark.sql import functions as F

from vellum.operators import evaluate as E
from vellum.operators import ranking as R


def test_fusion_order_and_ties(spark):
    hits = spark.createDataFrame([(1, "x", "dense", 1), (1, "y", "dense", 2), (1, "y", "text", 1), (1, "z", "text", 1), (1, "z", "text", 3), (1, "w", None, 1), (2, "x", "dense", None)], "q long, item string, leg string, leg_rank int")
    got = [(r["item"], r["place"]) for r in R.fuse(hits, ["q"], "item").orderBy("place").collect()]
    assert got == [("y", 1), ("x", 2), ("z", 3)]
    weighted = R.fuse(hits, ["q"], "item", {"text": 3.0}).orderBy("place").collect()
    assert [r["item"] for r in weighted] == ["y", "z", "x"]


def test_pack_skips_and_keeps_the_first(spark):
    items = spark.createDataFrame([(1, 1, 600), (1, 2, 900), (1, 3, 100), (2, 1, 5_000), (2, 2, 10), (3, 1, None), (3, 2, 800)], "q int, place int, cost int")
    got = sorted((r["q"], r["place"], r["spent"]) for r in R.pack_budget(items, ["q"], "place", "cost", 800).collect())
    assert got == [(1, 1, 600), (1, 3, 700), (2, 1, 5_000), (3, 1, 0), (3, 2, 800)]
    assert R.pack_budget(items.limit(0), ["q"], "place", "cost", 800).count() == 0


def test_authority_before_budget(spark):
    items = spark.createDataFrame([(1, 1, "code", 300), (1, 2, "guidance", 300), (1, 3, "law", 500)], "q int, place int, authority string, cost int")
    ordered = R.top(items.withColumnRenamed("place", "prior"), ["q"], [R.tier(F.col("authority")), F.col("prior")], 20)
    kept = R.pack_budget(ordered, ["q"], "place", "cost", 1_000).orderBy("place").collect()
    assert [r["authority"] for r in kept] == ["law", "guidance"]
    assert "law" not in [r["authority"] for r in R.pack_budget(items, ["q"], "place", "cost", 1_000).collect()]


def test_reserved_slot(spark):
    tiers = ["code", "guidance", "code", "guidance", "law", "law"]
    ranked = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(tiers)] + [(2, 1, "law"), (2, 2, "code")], "q int, place int, authority string")
    got = R.keep_with_law(ranked, ["q"])
    assert sorted((r["q"], r["place"]) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (2, 2)]
    assert [r["place"] for r in got.where("promoted").collect()] == [5]


def test_rerank_skips_small_pools(spark):
    scored = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.95), (1, 3, 0.4), (1, 4, 0.8), (1, 5, 0.001), (2, 7, 0.0001), (2, 6, 0.0)], "q int, id int, score double")
    got = R.keep_best(scored, ["q"], "id", keep=2)
    assert [(r["q"], r["id"], r["place"], r["best_score"]) for r in got.orderBy("q", "place").collect()] == [(1, 2, 1, 0.95), (1, 4, 2, 0.95), (2, 6, 1, 0.005), (2, 7, 2, 0.005)]


def test_merge_and_fit(spark):
    found = spark.createDataFrame([(1, "u", 1, "first"), (1, "v", 2, "only"), (1, "u", 3, "last")], "q int, unit string, place int, side string")
    assert sorted((r["unit"], r["place"], r["side"]) for r in R.merge_evidence(found, ["q"], "unit", "place").collect()) == [("u", 1, "last"), ("v", 2, "only")]
    items = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 1), (2, 1, 999)], "q int, place int, cost int")
    assert sorted((r["q"], r["place"]) for r in R.fit_prompt(items, ["q"], "place", "cost", 100).collect()) == [(1, 1), (2, 1)]


def test_expand_to_parents(spark):
    units = spark.createDataFrame([(1, None, "article", "short"), (2, 1, "paragraph", "p"), (3, None, "article", "x" * 9_000), (4, 3, "paragraph", "p"), (5, 1, "point", "p")], "unit_id long, parent_id long, unit_type string, text string")
    hits = spark.createDataFrame([(1, 2, 20, 0.5, 2), (1, 1, 10, 0.4, 1), (1, 4, 40, 0.3, 3), (1, 5, 50, 0.2, 4), (1, 99, 90, 0.1, 5)], "q int, unit_id long, chunk_id long, score double, place int")
    got = sorted((r["unit_id"], r["score"], r["hits"], r["place"]) for r in R.expand_to_parents(hits, units, ["q"]).collect())
    assert got == [(1, 0.5, 2, 1), (4, 0.3, 1, 3), (5, 0.2, 1, 4), (99, 0.1, 1, 5)]


def test_ir_metrics(spark):
    rows = [("a", 1, "x", 0.9, ["x", "y"]), ("a", 2, "z", 0.8, ["x", "y"]), ("a", 3, "y", 0.001, ["x", "y"]), ("b", 1, "q", 0.9, []), ("c", 1, "q", 0.9, ["r"])]
    got = {r["q"]: r for r in E.ir_metrics(spark.createDataFrame(rows, "q string, place int, item string, score double, expected array<string>"), "q").collect()}
    assert (got["a"]["p_at_1"], got["a"]["recall"], got["a"]["mrr"], got["a"]["pool_recall"]) == (1, 0.5, 1.0, 1.0)
    assert abs(got["a"]["ndcg"] - 1.5 / (1 + 1 / 1.5849625)) < 1e-5
    assert got["b"]["recall"] == got["c"]["ndcg"] == got["c"]["mrr"] == 0.0
