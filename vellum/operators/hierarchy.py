"""Parent-child links to full hierarchies.

Every unit names at most one parent, so the links form trees, trees below a missing parent, and
cycles with trees hanging from them. `hierarchy` brings whole components to one task and walks them
depth-first with node colours. Where links stay inside a scope (a document version) and the scope
fits one task, its components are found there; the components of larger scopes come from pointer
doubling first. A component of more than `max_component` units is never brought to one task: the
same columns come from pointer doubling alone. Which way is taken never changes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.arrow import whole_groups
from vellum.session import Cuts

SCHEMA = "space string, node bigint, parent bigint, root bigint, depth int, path string, ancestors array<bigint>, n_descendants bigint, state string, closes_cycle boolean, cycle_ancestors array<bigint>"
_ARROW = pa.schema(
    [
        ("space", pa.string()),
        ("node", pa.int64()),
        ("parent", pa.int64()),
        ("root", pa.int64()),
        ("depth", pa.int32()),
        ("path", pa.string()),
        ("ancestors", pa.list_(pa.int64())),
        ("n_descendants", pa.int64()),
        ("state", pa.string()),
        ("closes_cycle", pa.bool_()),
        ("cycle_ancestors", pa.list_(pa.int64())),
    ]
)
#: Ancestors and path characters that one batch of rows may hold, and rows.
BATCH_SIZE, BATCH_ROWS = 2_000_000, 20_000


def clean_path(path: Column) -> Column:
    """Trim white space, then outer slashes; upper case; one slash for several. Blank gives ''."""
    trimmed = F.regexp_replace(F.coalesce(path, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.upper(trimmed), "^/+|/+$", ""), "/{2,}", "/")


def last_segment(path: Column, node: Column) -> Column:
    """The unit's own part of its path; its id where the path is blank."""
    own = F.element_at(F.split(clean_path(path), "/"), -1)
    return F.when(own == "", F.concat(F.lit("#"), node.cast("string"))).otherwise(own)


def one_row_per_id(df: DataFrame, key: str) -> DataFrame:
    """Copies count once; of rows that share an id but differ, the smallest row stands. Null ids are left out."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


def links_by_id(df: DataFrame, space: str, node: str, scope: str, parent: str, path: str) -> DataFrame:
    """Links stated as a parent id. Null or 0 marks a root; the parent has to be a unit of the same scope."""
    units = one_row_per_id(
        df.select(
            F.col(node).cast("bigint").alias("node"),
            F.col(scope).cast("bigint").alias("scope"),
            F.nullif(F.col(parent).cast("bigint"), F.lit(0)).alias("stated"),
            F.col(path).cast("string").alias("own_path"),
        ),
        "node",
    )
    known = units.select(F.col("node").alias("known"), F.col("scope").alias("known_scope"))
    return units.join(known, (F.col("stated") == F.col("known")) & F.col("scope").eqNullSafe(F.col("known_scope")), "left").select(
        F.lit(space).alias("space"),
        "node",
        F.col("known").alias("parent"),
        (F.col("stated").isNotNull() & F.col("known").isNull()).alias("dangling"),
        last_segment(F.col("own_path"), F.col("node")).alias("segment"),
        "scope",
    )


def links_by_path(df: DataFrame, space: str, node: str, scope: str, parent: str, path: str) -> DataFrame:
    """Links stated as a parent path. A blank one marks a root; of units that share a path, the smallest id is the parent."""
    units = one_row_per_id(
        df.select(
            F.col(node).cast("bigint").alias("node"),
            F.col(scope).cast("bigint").alias("scope"),
            clean_path(F.col(parent)).alias("stated"),
            clean_path(F.col(path)).alias("own_path"),
        ),
        "node",
    )
    known = units.where(F.col("own_path") != "").groupBy(F.col("scope").alias("known_scope"), F.col("own_path").alias("known_path")).agg(F.min("node").alias("known"))
    return units.join(known, (F.col("stated") == F.col("known_path")) & F.col("scope").eqNullSafe(F.col("known_scope")), "left").select(
        F.lit(space).alias("space"),
        "node",
        F.col("known").alias("parent"),
        ((F.col("stated") != "") & F.col("known").isNull()).alias("dangling"),
        last_segment(F.col("own_path"), F.col("node")).alias("segment"),
        "scope",
    )


def components(links: DataFrame, cuts: Cuts) -> DataFrame:
    """Each node's component, by pointer doubling: (space, node, jump, label, hops, top).

    After i rounds `jump` is the ancestor 2^i links up. Nodes that reach a top are settled with it
    as label; the rest lead into cycles, and their label is the smallest id on the cycle, known once
    a jump is longer than there are such nodes. Rounds: log2 of the depth, or of the nodes at cycles.
    `hops` counts the links up to the top. Nodes may be of any type that can be ordered.
    """
    is_top = F.col("parent").isNull()
    here = cuts.cut(
        links.select(
            "space",
            "node",
            F.coalesce("parent", "node").alias("jump"),
            F.when(is_top, F.col("node")).alias("label"),
            F.col("node").alias("least"),
            F.when(is_top, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("hops"),
        )
    )
    settled = here.where(F.col("label").isNotNull())
    moving = here.where(F.col("label").isNull())
    parts = [settled]
    left, span = moving.count(), 1
    while left:
        to = here.select(F.col("space").alias("s"), F.col("node").alias("n"), F.col("jump").alias("j"), F.col("label").alias("l"), F.col("least").alias("m"), F.col("hops").alias("h"))
        stepped = moving.join(to, (F.col("space") == F.col("s")) & (F.col("jump") == F.col("n"))).select(
            "space",
            "node",
            F.when(F.col("l").isNull(), F.col("j")).otherwise(F.col("jump")).alias("jump"),
            F.col("l").alias("label"),
            F.least("least", "m").alias("least"),
            (F.col("hops") + F.col("h")).alias("hops"),
        )
        step = cuts.cut(stepped)
        span *= 2
        settled, moving = step.where(F.col("label").isNotNull()), step.where(F.col("label").isNull())
        parts.append(settled)
        before, left = left, moving.count()
        if left == before and span > left:
            break
        here = _union(parts[:-1]).unionByName(step)
    done = _union(parts).select("space", "node", "jump", "label", "hops", F.lit(True).alias("top"))
    if not left:
        return done
    at = moving.select(F.col("space").alias("s"), F.col("node").alias("n"), F.col("least").alias("m"))
    looped = moving.join(at, (F.col("space") == F.col("s")) & (F.col("jump") == F.col("n"))).select("space", "node", "jump", F.col("m").alias("label"), "hops", F.lit(False).alias("top"))
    return done.unionByName(looped)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


class Forest(NamedTuple):
    """Walked components. `order`: all units, depth-first; `level`: links below the start of their tree;
    `starts`: the start of each tree, with its cycle where it is on one. Linear in the units."""

    order: list[int]
    level: list[int]
    root: list[int]
    state: list[str]
    below: list[int]
    closes: list[bool]
    starts: dict[int, tuple[list[int], int] | None]


def walk(nodes: list, parents: list, dangling: list) -> Forest:
    """Depth-first walk, with an explicit stack and node colours, over complete components."""
    n = len(nodes)
    index = {node: i for i, node in enumerate(nodes)}
    up = [-1 if p is None else index.get(p, -1) for p in parents]
    children: dict[int, list[int]] = {}
    for i in sorted(range(n), key=nodes.__getitem__, reverse=True):
        if up[i] >= 0:
            children.setdefault(up[i], []).append(i)
    white, grey, black = 0, 1, 2
    colour = bytearray(n)
    order: list[int] = []
    level, root, below = [0] * n, [-1] * n, [0] * n
    state, closes = [""] * n, [False] * n
    starts: dict[int, tuple[list[int], int] | None] = {}

    def descend(top: int, name: int, kind: str, lower: str) -> None:
        """One tree; units that are coloured already are not entered again."""
        state[top] = kind
        stack = [top]
        while stack:
            i = stack[-1]
            if colour[i] == white:
                colour[i] = grey
                root[i] = name
                order.append(i)
                for c in children.get(i, ()):
                    if colour[c] == white:
                        level[c], state[c] = level[i] + 1, lower
                        stack.append(c)
                continue
            stack.pop()
            colour[i] = black
            if i != top:
                below[up[i]] += below[i] + 1

    for top in range(n):
        if up[top] < 0:
            starts[top] = None
            kind = "orphan" if dangling[top] else "rooted"
            descend(top, top, kind, kind)
    rings: list[list[int]] = []
    for start in range(n):  # what no top leads to: links upwards run into cycles
        trail, i = [], start
        while colour[i] == white:
            colour[i] = grey
            trail.append(i)
            i = up[i]
        if trail and colour[i] == grey:  # a back edge
            rings.append(trail[trail.index(i) :])
        for k in trail:
            colour[k] = black
    for ring in rings:
        for k in ring:
            colour[k] = black
        least = min(ring, key=nodes.__getitem__)
        closes[least] = True
        whole = len(order)
        on_ring = set(ring)
        for at, r in enumerate(ring):
            starts[r] = (ring, at)
            hanging = [c for c in children.get(r, ()) if c not in on_ring]
            todo = hanging[:]  # the trees of a ring were coloured on the way up
            while todo:
                k = todo.pop()
                colour[k] = white
                todo += children.get(k, ())
            state[r], root[r] = "cycle", least
            order.append(r)
            for c in reversed(hanging):
                level[c] = 1
                descend(c, least, "below_cycle", "below_cycle")
        whole = len(order) - whole
        for r in ring:
            below[r] = whole - 1
    return Forest(order, level, root, state, below, closes, starts)


def _rows(space: str, forest: Forest, nodes: list, parents: list, segments: list, paths: bool) -> Iterator[pa.RecordBatch]:
    """The walked units as batches of bounded size: ancestors and paths exist for one batch at a time."""
    line, way = np.empty(64, np.int64), []
    base, cyclic = 0, False  # of the tree at hand: ancestors above its start, and whether it hangs from a cycle
    picked: list[int] = []
    above: list[np.ndarray] = []
    ways: list[str | None] = []
    loose: list[bool] = []
    held = 0

    def lists(wanted: bool) -> pa.Array:
        """Ancestors of the units of trees, or of those at cycles; the others have null."""
        none = [x is None or loop != wanted for x, loop in zip(above, loose)]
        kept = [x for x, no in zip(above, none) if not no]
        ends = np.cumsum([0, *(0 if no else len(x) for x, no in zip(above, none))])
        flat = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(none, pa.bool_()))

    def batch() -> pa.RecordBatch:
        columns = {
            "space": [space] * len(picked),
            "node": [nodes[i] for i in picked],
            "parent": [parents[i] for i in picked],
            "root": [nodes[forest.root[i]] for i in picked],
            "depth": [None if loop else forest.level[i] for i, loop in zip(picked, loose)],
            "path": ways,
            "n_descendants": [forest.below[i] for i in picked],
            "state": [forest.state[i] for i in picked],
            "closes_cycle": [forest.closes[i] for i in picked],
        }
        return pa.RecordBatch.from_arrays([lists(f.name == "cycle_ancestors") if f.name.endswith("ancestors") else pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)

    for i in forest.order:
        if i in forest.starts:
            ring = forest.starts[i]
            cyclic = ring is not None
            around = [nodes[k] for k in (*ring[0][: ring[1]][::-1], *ring[0][ring[1] + 1 :][::-1])] if ring and paths else []
            base = len(around)
            if base >= len(line):
                line = np.empty(2 * base, np.int64)
            line[:base] = around
        depth = base + forest.level[i]
        if paths:
            if depth >= len(line):
                line = np.concatenate([line, np.empty(len(line), np.int64)])
            line[depth] = nodes[i]
            above.append(line[:depth].copy())
            held += depth
            if not cyclic:
                del way[depth:]
                way.append(segments[i])
            ways.append(None if cyclic else "/".join(way))
            held += len(ways[-1] or "")
        else:
            above.append(None)
            ways.append(None)
        picked.append(i)
        loose.append(cyclic)
        if held > BATCH_SIZE or len(picked) >= BATCH_ROWS:
            yield batch()
            picked, above, ways, loose, held = [], [], [], [], 0
    if picked:
        yield batch()


def _walk_batches(batches: Iterator[pa.RecordBatch], key: str, paths: bool) -> Iterator[pa.RecordBatch]:
    for chunk in whole_groups(batches, ["space", key]):
        space = chunk.column("space").combine_chunks()
        for name in space.unique().to_pylist():
            part = chunk.filter(pa.compute.equal(space, name))
            nodes, parents, dangling, segments = (part.column(c).to_pylist() for c in ("node", "parent", "dangling", "segment"))
            yield from _rows(name, walk(nodes, parents, dangling), nodes, parents, segments, paths)


def _by_doubling(nodes: DataFrame, cuts: Cuts, paths: bool) -> DataFrame:
    """The columns of `walk` for components that are too large for one task.

    `nodes`: links with jump, label and top. Each round doubles the stretch of ancestors, path and
    descendants that a node knows of; without `paths` only sums move.
    """
    ring = nodes.where(~F.col("top")).select("space", F.col("jump").alias("node")).distinct().withColumn("on_ring", F.lit(True))
    trees = nodes.where("top")
    cut_ring = ~F.col("top") & (F.col("node") == F.col("label"))  # without this link a ring is a chain below its smallest id
    start = F.when(~cut_ring, F.col("parent")).alias("jump")
    way, line = (F.col("segment"), F.array("node")) if paths else (F.lit(None).cast("string"), F.lit(None).cast("array<bigint>"))
    rounds = Cuts(nodes.sparkSession, keep=1)  # a round needs only the one before
    known = rounds.cut(nodes.select("space", "node", "parent", start, "label", "dangling", "hops", way.alias("way"), line.alias("line"), F.lit(1).cast("bigint").alias("sum"), "top"))
    while known.where(F.col("jump").isNotNull()).limit(1).count():
        gained = known.where(F.col("jump").isNotNull()).groupBy(F.col("space").alias("s2"), F.col("jump").alias("n2")).agg(F.sum("sum").alias("more"))
        to = known.select(F.col("space").alias("s"), F.col("node").alias("n"), F.col("jump").alias("j"), F.col("way").alias("w"), F.col("line").alias("l"))
        known = rounds.cut(
            known.join(to, (F.col("space") == F.col("s")) & (F.col("jump") == F.col("n")), "left")
            .join(gained, (F.col("space") == F.col("s2")) & (F.col("node") == F.col("n2")), "left")
            .select(
                "space",
                "node",
                "parent",
                F.col("j").alias("jump"),
                "label",
                "dangling",
                "hops",
                F.when(F.col("n").isNull(), F.col("way")).otherwise(F.concat("w", F.lit("/"), "way")).alias("way"),
                F.when(F.col("n").isNull(), F.col("line")).otherwise(F.concat("l", "line")).alias("line"),
                (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"),
                "top",
            )
        )
    tops = trees.where(F.col("parent").isNull()).select("space", F.col("node").alias("label"), F.col("dangling").alias("top_dangles"))
    done = known.where("top").join(tops, ["space", "label"]).select(
        "space",
        "node",
        "parent",
        F.col("label").alias("root"),
        F.col("hops").cast("int").alias("depth"),
        F.col("way").alias("path"),
        F.slice("line", F.lit(1), F.size("line") - 1).alias("ancestors") if paths else F.col("line").alias("ancestors"),
        (F.col("sum") - 1).alias("n_descendants"),
        F.when(F.col("top_dangles"), "orphan").otherwise("rooted").alias("state"),
        F.lit(False).alias("closes_cycle"),
        F.lit(None).cast("array<bigint>").alias("cycle_ancestors"),
    )
    below = known.where(~F.col("top")).join(ring, ["space", "node"], "left")
    sizes = below.groupBy("space", "label").agg(F.count("*").alias("size"))
    looped = below.join(sizes, ["space", "label"])
    around = F.lit(None).cast("array<bigint>")
    if paths:
        chains = below.where("on_ring").groupBy("space", "label").agg(F.max_by("line", F.size("line")).alias("chain"))
        looped = looped.join(chains, ["space", "label"])
        above = F.size(F.array_intersect("line", "chain"))  # members of the ring on the way
        around = F.concat(F.slice("chain", above + 1, F.size("chain")), F.slice("line", F.lit(1), F.size("line") - 1))
    looped = looped.select(
        "space",
        "node",
        "parent",
        F.col("label").alias("root"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("array<bigint>").alias("ancestors"),
        (F.when(F.col("on_ring"), F.col("size")).otherwise(F.col("sum")) - 1).alias("n_descendants"),
        F.when(F.col("on_ring"), "cycle").otherwise("below_cycle").alias("state"),
        (F.col("node") == F.col("label")).alias("closes_cycle"),
        around.alias("cycle_ancestors"),
    )
    return done.unionByName(looped)


def hierarchy(links: DataFrame, max_component: int = 200_000, paths: bool = True) -> DataFrame:
    """Full path, depth, root, ancestors and number of descendants of each node (columns: SCHEMA).

    `links`: space, node, parent, dangling, segment, as from links_by_id and links_by_path, and scope
    where no link leaves its scope; further columns are ignored. `state` is `rooted`, `orphan` (the
    ancestors end at a missing parent; root is the topmost unit there is), `cycle` or `below_cycle`
    (root is the smallest id on the cycle; depth, path and ancestors are null; cycle_ancestors holds
    the units above, the nearest last, each unit of the cycle once and never the unit itself).
    closes_cycle marks the smallest id of a cycle. A node that is its own parent is a cycle. An empty
    table gives an empty result. Without `paths` the columns path, ancestors and cycle_ancestors are
    null, and the work is linear in the units however deep they lie. `descendants` turns ancestors
    into one row per node and descendant.
    """
    cuts = Cuts(links.sparkSession)
    scoped = "scope" in links.columns
    own = cuts.cut(links.select("space", "node", "parent", "dangling", "segment", *(["scope"] if scoped else [])))

    def above_size(rows: DataFrame, key: str) -> DataFrame:
        """Groups too large for one task; there are at most rows / max_component of them."""
        return cuts.cut(rows.groupBy("space", key).count().where(F.col("count") > max_component).select("space", F.col(key).alias("large")))

    def members(rows: DataFrame, groups: DataFrame, key: str, how: str) -> DataFrame:
        named = groups.withColumnRenamed("space", "s")
        return rows.join(named, (F.col("space") == F.col("s")) & F.col(key).eqNullSafe(F.col("large")), how)

    parts: list[DataFrame] = []
    if scoped:
        large = above_size(own, "scope")
        if not large.limit(1).count():
            return _colocated(own, "scope", paths)
        parts.append(_colocated(members(own, large, "scope", "left_anti"), "scope", paths))
        own = cuts.cut(members(own, large, "scope", "left_semi"))
    nodes = cuts.cut(own.join(components(own, cuts), ["space", "node"]))
    large = above_size(nodes, "label")
    if not large.limit(1).count():
        parts.append(_colocated(nodes, "label", paths))
    else:
        parts.append(_colocated(members(nodes, large, "label", "left_anti"), "label", paths))
        parts.append(_by_doubling(members(nodes, large, "label", "left_semi"), cuts, paths))
    return _union(parts)


def _colocated(nodes: DataFrame, key: str, paths: bool) -> DataFrame:
    together = nodes.select("space", key, "node", "parent", "dangling", "segment").repartition("space", key).sortWithinPartitions("space", key, "node")
    return together.mapInArrow(lambda batches: _walk_batches(batches, key, paths), SCHEMA)


def all_ancestors() -> Column:
    """The units above a unit, the nearest last, at cycles too."""
    return F.coalesce("ancestors", "cycle_ancestors")


def descendants(found: DataFrame) -> DataFrame:
    """One row per node and descendant: (space, ancestor, node, distance). Units of a cycle are below each other, not below themselves."""
    above = found.select("space", "node", all_ancestors().alias("above"))
    return above.select("space", "node", F.size("above").alias("n"), F.posexplode("above").alias("at", "ancestor")).select("space", "ancestor", "node", (F.col("n") - F.col("at")).alias("distance"))
