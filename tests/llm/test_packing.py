import random
from collections import defaultdict

from pyspark.sql import functions as F

from vellum.llm.packing import fill_containers, pack

ROWS = "doc_id long, tokens int, source string, cluster long, first string, block string"


def test_bins_are_sound_and_full():
    rng = random.Random(3)
    n = 3_000
    sizes = [rng.randint(1, 900) for _ in range(n)]
    sources = [f"s{rng.randrange(30)}" if rng.random() < 0.7 else "hot" for _ in range(n)]
    clusters = [rng.randrange(50) if rng.random() < 0.3 else 1_000 + i for i in range(n)]
    placed = pack(sizes, sources, clusters, 2_048)
    bins = defaultdict(list)
    for i, b in enumerate(placed):
        bins[b].append(i)
    assert min(placed) == 0 and max(sum(sizes[i] for i in v) for v in bins.values()) <= 2_048
    assert all(len({clusters[i] for i in v}) == len(v) for v in bins.values())
    assert sum(sizes) / (len(bins) * 2_048) > 0.98


def test_tightest_bin_and_conflicts():
    # 6 and 5 open two bins of 10; 4 fits the first exactly, unless its source or cluster is there
    assert pack([6, 5, 4], ["a", "b", "c"], [1, 2, 3], 10) == [0, 1, 0]
    assert pack([6, 5, 4], ["a", "b", "a"], [1, 2, 3], 10) == [0, 1, 1]
    assert pack([6, 5, 4], ["a", "b", "c"], [1, 2, 1], 10) == [0, 1, 1]
    assert pack([6, 4], ["a", "a"], [None, None], 10) == [0, 0]
    assert pack([6, 4], ["a", "b"], [1, 1], 10) == [0, 1]
    assert pack([], [], [], 10) == [] and pack([0], ["a"], [None], 10) == [-1]


def test_sources_are_kept_apart_while_the_slack_lasts():
    sizes, sources = [6] * 50 + [4] * 50, ["a", "b"] * 25 + ["a"] * 50
    repeats = []
    for slack in (0.0, 0.2, 1.0):
        placed = pack(sizes, sources, [None] * 100, 10, slack)
        bins = defaultdict(list)
        for i, b in enumerate(placed):
            bins[b].append(sources[i])
        assert len(bins) <= 50 * (1 + slack)
        repeats.append(sum(len(set(v)) < len(v) for v in bins.values()))
    assert repeats[0] > repeats[1] > repeats[2] == 0


def test_rows(spark):
    rows = [(1, 5_000, "a", 1, "x", "x"), (2, 0, "a", None, "x", "x"), (3, None, None, None, None, None), (4, 2_048, "a", 2, "", ""), (5, 10, None, None, "", ""), (5, 10, None, None, "", "")]
    found = fill_containers(spark.createDataFrame(rows, ROWS), block=2)
    got = sorted((r["doc_id"], r["piece_no"], r["first"], r["tokens"]) for r in found.collect())
    assert got == [(1, 0, 0, 2_048), (1, 1, 2_048, 2_048), (1, 2, 4_096, 904), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 2_048), (5, 0, 0, 10), (5, 0, 0, 10)]
    assert {r["doc_id"] for r in found.where("container_id is null").collect()} == {2, 3}
    assert found.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t")).where("t > 2048").count() == 0
    assert fill_containers(spark.createDataFrame([], ROWS)).count() == 0
