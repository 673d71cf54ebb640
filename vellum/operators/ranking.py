"""Ranking: fusion, ordering, top-k, budgets and evidence, per pool of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import estimate_tokens

# Fixed values of the ranking operators.
RRF_K = 60
KEEP, MIN_SCORE = 4, 0.005
EVIDENCE_BUDGET, PARENT_CAP = 2_400, 1_200
TIERS = {"law": 0, "guidance": 1, "code": 2}


def tier(authority: Column) -> Column:
    """0 law, 1 guidance, 2 code, 3 anything else."""
    ranks = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))
    return F.coalesce(F.try_element_at(ranks, authority), F.lit(3))


def fuse(hits: DataFrame, by: list[str], item: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: (*by, item, score, first_leg, first_rank, legs, ranks, place); ranks maps legs to ranks.

    `hits`: the columns by, item, leg, leg_rank. An item's rank in a leg is its best one, so that
    repeated rows change nothing. Equal scores keep the order of first appearance: leg, rank, then
    item. Null legs or ranks are no hit. One shuffle by item serves both sums; pools meet last.
    """
    weight = F.lit(1.0)
    for leg, w in (weights or {}).items():
        weight = F.when(F.col("leg") == leg, F.lit(w)).otherwise(weight)
    together = hits.where("leg is not null and leg_rank is not null").select(*by, item, "leg", "leg_rank").repartition(*by, item)
    best = together.groupBy(*by, item, "leg").agg(F.min("leg_rank").alias("leg_rank"))
    scored = best.groupBy(*by, item).agg(
        F.sum(weight / (RRF_K + F.col("leg_rank"))).alias("score"),
        F.min(F.struct("leg", "leg_rank")).alias("first"),
        F.count("*").alias("legs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("leg", "leg_rank")))).alias("ranks"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "first", item)
    return scored.select(*by, item, "score", F.col("first.leg").alias("first_leg"), F.col("first.leg_rank").alias("first_rank"), "legs", "ranks", F.row_number().over(order).cast("bigint").alias("place"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each pool, numbered; planned as a partial and a final group limit."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


def keep_best(scored: DataFrame, by: list[str], tie: str, keep: int = KEEP, min_score: float = MIN_SCORE) -> DataFrame:
    """Rerank: pools of at most `keep` pass whole and in their order, with the threshold as best
    score; others keep the `keep` best at or above the threshold. Adds place and best_score."""
    whole = Window.partitionBy(*by)
    ranked = scored.withColumn("pool", F.count("*").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("score"), tie))).withColumn("top_score", F.max("score").over(whole))
    skip = F.col("pool") <= keep
    kept = ranked.where(skip | ((F.col("r") <= keep) & (F.col("score") >= min_score)))
    place = F.when(skip, F.row_number().over(whole.orderBy(tie))).otherwise(F.col("r"))
    return kept.withColumn("place", place.cast("bigint")).withColumn("best_score", F.when(skip, F.lit(min_score)).otherwise(F.col("top_score"))).drop("pool", "r", "top_score")


def keep_with_law(ranked: DataFrame, by: list[str], keep: int = KEEP) -> DataFrame:
    """First `keep` by place; if none of them is law, the best law below takes the last slot."""
    whole = Window.partitionBy(*by)
    law = F.col("authority") == "law"
    marked = ranked.withColumn("has", F.max(F.when(F.col("place") <= keep, law)).over(whole)).withColumn("next", F.min(F.when(law & (F.col("place") > keep), F.col("place"))).over(whole))
    promote = ~F.coalesce("has", F.lit(False)) & F.col("next").isNotNull()
    kept = (F.col("place") <= F.when(promote, keep - 1).otherwise(keep)) | (promote & (F.col("place") == F.col("next")))
    return marked.where(kept).withColumn("promoted", F.coalesce(F.col("place") > keep, F.lit(False))).drop("has", "next")


def pack_budget(items: DataFrame, by: list[str], order: str, cost: str, budget: int | str = EVIDENCE_BUDGET) -> DataFrame:
    """Greedy packing in order: an item that would overflow is skipped and later ones still tried;
    the first is kept even if it is over. Pools have to be bounded, as those of `top` are.

    `budget` may name a column with each pool's own. Returns the kept rows with `spent`, the cost so
    far. A null cost counts 0.
    """
    rest = [c for c in items.columns if c not in by]
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(cost).cast("bigint"), F.lit(0)).alias("c"), F.struct(*rest).alias("r"))))
    pools = items.groupBy(*by).agg(rows.alias("rows"), F.max(F.col(budget) if isinstance(budget, str) else F.lit(budget)).alias("_most"))
    taken = F.expr(
        """aggregate(rows, cast(array() as array<struct<at:int,spent:bigint>>), (kept, x) -> CASE
          WHEN size(kept) > 0 AND element_at(kept, -1).spent + x.c > _most THEN kept
          ELSE concat(kept, array(struct(cast(array_position(rows, x) as int) as at, coalesce(try_element_at(kept, -1).spent, 0L) + x.c as spent))) END)"""
    )
    return pools.withColumn("k", F.explode(taken)).withColumn("row", F.expr("element_at(rows, k.at).r")).select(*by, "row.*", F.col("k.spent").alias("spent"))


def expand_to_parents(hits: DataFrame, units: DataFrame, by: list[str], cap: int = PARENT_CAP) -> DataFrame:
    """Collapse hits onto citable units: a paragraph becomes its article if that costs at most `cap`
    tokens. (*by, unit_id, score, hits, place): best score, number of chunks, first appearance.

    `hits`: by, unit_id, chunk_id, score, place. `units`: one row per unit.
    """
    parents = units.select(F.col("unit_id").alias("pid"), F.col("unit_type").alias("ptype"), estimate_tokens(F.col("text")).alias("pcost"))
    own = hits.join(units.select("unit_id", "unit_type", "parent_id"), "unit_id", "left")
    up = own.join(parents, (F.col("parent_id") == F.col("pid")) & (F.col("ptype") == "article"), "left")
    to = F.when((F.col("unit_type") == "paragraph") & (F.col("pcost") <= cap), F.col("pid")).otherwise(F.col("unit_id"))
    return up.withColumn("unit_id", to).groupBy(*by, "unit_id").agg(F.max("score").alias("score"), F.count_distinct("chunk_id").alias("hits"), F.min("place").alias("place"))


def merge_evidence(found: DataFrame, by: list[str], item: str, order: str) -> DataFrame:
    """Items found several times keep the first position and the values of the last."""
    rest = [c for c in found.columns if c not in (*by, item, order)]
    return found.groupBy(*by, item).agg(F.min(order).alias(order), F.max(F.struct(order, *rest)).alias("last")).select(*by, item, order, *(F.col(f"last.{c}").alias(c) for c in rest))


def label(ranked: DataFrame, prefix: str = "E") -> DataFrame:
    """Labels by place: E1, E2, ..."""
    return ranked.withColumn("label", F.concat(F.lit(prefix), F.col("place").cast("string")))


def fit_prompt(items: DataFrame, by: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Drop items from the tail until the rest fits; the first always stays."""
    upto = F.sum(cost).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return items.withColumn("upto", upto).withColumn("first", first).where((F.col("upto") <= budget) | F.col("first")).drop("first")
