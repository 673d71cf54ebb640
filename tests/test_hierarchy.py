import random

import pytest
from pyspark.sql import functions as F

from vellum.operators.hierarchy import clean_path, descendants, hierarchy, links_by_id, links_by_path, walk

UNITS = "unit_id long, ver long, parent_id long, unit_path string, path string, state string, node int"
LINKS = "space string, node long, parent long, dangling boolean, segment string, label string"


def brute_force(links):
    up = {n: p for _, n, p, *_ in links}
    lost = {n for _, n, _, d, *_ in links if d}
    out = {}
    for n in up:
        way, x = [n], n
        while up[x] is not None and up[x] not in way:
            x = up[x]
            way.append(x)
        if up[x] is None:
            out[n] = ("orphan" if x in lost else "rooted", x, len(way) - 1, way[:0:-1])
        else:
            ring = way[way.index(up[x]) :]
            out[n] = ("cycle" if n in ring else "below_cycle", min(ring), None, None)
    return out


def forest(n, seed):
    rng = random.Random(seed)
    links = []
    for i in range(n):
        r = rng.random()
        parent = None if r < 0.1 else (rng.randrange(n) if r < 0.15 else max(0, i - rng.randint(0, 3)))
        links.append(("s", i, parent, parent is None and rng.random() < 0.3, f"n{i}", "clash"))
    return links


@pytest.mark.parametrize("max_component", [200_000, 5, 0])
def test_equals_brute_force(spark, max_component):
    links = forest(400, 11)
    found = hierarchy(spark.createDataFrame(links, LINKS), max_component).collect()
    expected = brute_force(links)
    below = {}
    for _, _, _, way in expected.values():
        for a in way or ():
            below[a] = below.get(a, 0) + 1
    assert len(found) == 400
    for r in found:
        state, root, depth, way = expected[r["node"]]
        assert (r["state"], r["root"], r["depth"], r["ancestors"]) == (state, root, depth, way)
        if depth is not None:
            assert r["n_descendants"] == below.get(r["node"], 0)
            assert r["path"] == "/".join(f"n{a}" for a in [*way, r["node"]])
    rings = {r["root"] for r in found if r["state"] == "cycle"}
    assert sorted(r["root"] for r in found if r["closes_cycle"]) == sorted(rings)


@pytest.mark.parametrize("max_component", [200_000, 0])
def test_deep_chain_and_star(spark, max_component):
    links = [("chain", i, i - 1 if i else None, False, "x", "") for i in range(300)] + [("star", i, 0 if i else None, False, "x", "") for i in range(1_000)]
    found = hierarchy(spark.createDataFrame(links, LINKS), max_component)
    got = {r["space"]: (r["d"], r["n"]) for r in found.groupBy("space").agg(F.max("depth").alias("d"), F.max("n_descendants").alias("n")).collect()}
    assert got == {"chain": (299, 299), "star": (1, 999)}
    assert descendants(found.where("space = 'star'")).count() == 999


COLUMNS = ["space", "node", "parent", "root", "depth", "path", "ancestors", "n_descendants", "state", "closes_cycle", "cycle_ancestors"]


@pytest.mark.parametrize("seed, paths", [(1, True), (2, False)])
def test_all_ways_give_the_same_rows(spark, seed, paths):
    rng = random.Random(seed)
    links = [*forest(300, seed), *(("deep", i, i - 1 if i else None, True, "x", "") for i in range(70))]
    n = 40  # rings of all sizes with trees of branches below them
    links += [("rings", i, (i + 1) % 7 if i < 7 else 8 + (i - 7) % 3 if i < 11 else rng.randrange(i), False, f"r{i}", "") for i in range(n)]
    plain = spark.createDataFrame([r[:5] for r in links], "space string, node long, parent long, dangling boolean, segment string")
    scoped = plain.withColumn("scope", F.when(F.col("space") == "s", F.lit(None)).otherwise(F.length("space")).cast("bigint"))
    results = []
    for rows, limit in ((plain, 200_000), (scoped, 200_000), (scoped, 60), (plain, 0)):
        found = hierarchy(rows, limit, paths)
        assert found.columns == COLUMNS
        results.append(sorted(map(repr, (tuple(r) for r in found.collect()))))
    assert all(r == results[0] for r in results[1:]) and len(results[0]) == len(links)


def test_memory_is_linear_in_depth():
    import tracemalloc

    n = 100_000
    tracemalloc.start()
    found = walk(list(range(n)), [None, *range(n - 1)], [False] * n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.level[-1] == n - 1 and found.below[0] == n - 1 and peak < 200 << 20


def test_links_by_id(spark):
    rows = [(1, 1, None, "A", "", "", 0), (2, 1, 1, "A/B", "", "", 0), (2, 1, 1, "A/B", "", "", 0), (3, 1, 0, None, "", "", 0), (4, 2, 1, "", "", "", 0), (5, 1, 99, "X", "", "", 0), (6, 1, 6, "S", "", "", 0), (None, 1, 1, "N", "", "", 0), (7, None, None, "Q", "", "", 0), (8, None, 7, "Q/R", "", "", 0)]
    links = links_by_id(spark.createDataFrame(rows, UNITS), "t", "unit_id", "ver", "parent_id", "unit_path")
    got = {r["node"]: (r["parent"], r["dangling"], r["segment"]) for r in links.collect()}
    assert got == {1: (None, False, "A"), 2: (1, False, "B"), 3: (None, False, "#3"), 4: (None, True, "#4"), 5: (None, True, "X"), 6: (6, False, "S"), 7: (None, False, "Q"), 8: (7, False, "R")}
    states = {r["node"]: r["state"] for r in hierarchy(links).collect()}
    assert states[6] == "cycle" and states[4] == states[5] == "orphan" and states[8] == "rooted"


def test_links_by_path(spark):
    rows = [(1, 1, "CH_I", None), (2, 1, "CH_I/ART_1 ", " /ch_i/ "), (3, 1, "CH_I//ART_1/PAR_1", "CH_I//ART_1"), (4, 1, "Z", "CH_IX"), (5, 2, "Q", "CH_I"), (6, 1, "R", " \t"), (7, 1, "CH_I/ART_1", "CH_I")]
    links = links_by_path(spark.createDataFrame(rows, "id long, ver long, p string, pp string"), "t", "id", "ver", "pp", "p")
    got = {r["node"]: (r["parent"], r["dangling"]) for r in links.collect()}
    assert got == {1: (None, False), 2: (1, False), 3: (2, False), 4: (None, True), 5: (None, True), 6: (None, False), 7: (1, False)}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], LINKS)).count() == 0
    assert spark.createDataFrame([("  //a/ ",)], "p string").select(clean_path(F.col("p"))).first()[0] == "A/"[:1]


@pytest.mark.parametrize("max_component", [200_000, 0])
def test_trees_below_cycles(spark, max_component):
    links = [*forest(400, 11), *(("ring", i, p, False, "x", "") for i, p in [(3, 5), (4, 3), (5, 4), (6, 4), (7, 6), (8, 6), (1, 7), (9, 9), (2, 9)])]
    up = {(s, n): p for s, n, p, *_ in links}
    expected = set()
    for (space, n), p in up.items():
        x, way = p, []
        while x is not None and x != n and x not in way:
            way.append(x)
            x = up[space, x]
        expected |= {(space, a, n, i + 1) for i, a in enumerate(way)}
    found = hierarchy(spark.createDataFrame(links, LINKS), max_component).cache()
    pairs = [tuple(r) for r in descendants(found).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    counts = {}
    for space, a, *_ in expected:
        counts[space, a] = counts.get((space, a), 0) + 1
    assert {(r["space"], r["node"]): r["n_descendants"] for r in found.collect()} == {k: counts.get(k, 0) for k in up}
    assert sorted(r["node"] for r in found.where("space = 'ring' and closes_cycle").collect()) == [3, 9]
    found.unpersist()
