"""Rebuilding conversations from message rows.

Per thread, every step chooses its likeliest parent among candidate reply links, scored by whether
the link is stated, by time, mentions, lexical overlap, the roles at both ends, and whether the
candidate has a reply already; a stated link that exists in the thread always wins. The chosen links
form trees: one per conversation that shares the thread (`channel`). A thread is sound only if the
stated links alone form one tree; inferred links show where its pieces most likely belong.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.arrow import whole_groups
from vellum.functions.text import micros
from vellum.operators.hierarchy import components
from vellum.session import Cuts

#: Seconds in which the time score falls to 1/e.
FADE = 120.0
#: Weights of a stated link, time, mention and lexical overlap; the stated one outweighs the rest.
STATED, TIME, MENTION, OVERLAP = 10.0, 1.0, 2.0, 1.5
#: Weights of roles that follow each other, and of a candidate without a reply so far.
ROLES, OPEN = 1.0, 3.0
#: Role of a step to the roles it usually hangs from.
FOLLOWS = {"user": ("assistant", "system"), "assistant": ("user", "tool", "run"), "tool": ("user", "tool", "run"), "run": ("user", "tool", "run")}
_WORD = re.compile(r"\w{3,}")
_ROLES = {"usermessage": "user", "assistantmessage": "assistant", "systemmessage": "system", "tool": "tool", "run": "run"}

STEPS = "thread_id string, step_id string, parent_id string, inferred boolean, score double, position int, depth int, role string, text string, surplus boolean, likely string, channel string, reason string"
THREADS = "thread_id string, reason string"
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def blank(text: Column) -> Column:
    """Null, or only characters of Unicode categories Z, Cc and Cf."""
    return F.coalesce(text, F.lit("")).rlike(r"\A[\p{Z}\p{Cc}\p{Cf}]*\z")


def role(step_type: Column) -> Column:
    """The role by the letters of the type, ignoring case; other types keep their letters."""
    letters = F.lower(F.regexp_replace(F.coalesce(step_type, F.lit("")), r"\P{L}", ""))
    named = F.create_map(*(F.lit(x) for pair in _ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(named, letters), letters)


def prepared(steps: DataFrame) -> DataFrame:
    """The columns that `rebuild` reads. Rows without a thread or step id are left out."""
    return steps.where(F.col("thread_id").isNotNull() & F.col("step_id").isNotNull()).select(
        "thread_id",
        "step_id",
        "parent_id",
        F.coalesce("is_streaming", F.lit(False)).alias("is_streaming"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"),
        role(F.col("step_type")).alias("role"),
        F.col("step_name").alias("name"),
        F.col("output_text").alias("text"),
        blank(F.col("output_text")).alias("blank"),
        micros(F.col("created_at")).alias("at"),
    )


def _standing(r: dict) -> tuple:
    """Order of the rows of one step; the first stands. `_standing_column` is the same."""
    return r["is_streaming"], r["at"] is None, r["at"] or 0, r["parent_id"] or "", r["parent_id"] is None, r["text"] or "", r["text"] is None, r["is_error"], r["role"], r["name"] or "", r["name"] is None


def _standing_column() -> Column:
    parts = ["is_streaming", F.col("at").isNull(), F.coalesce("at", F.lit(0))]
    parts += [p for c in ("parent_id", "text") for p in (F.coalesce(c, F.lit("")), F.col(c).isNull())]
    parts += ["is_error", "role", F.coalesce("name", F.lit("")), F.col("name").isNull()]
    return F.struct(*(F.col(p) if isinstance(p, str) else p for p in parts))


def _time_key(r: dict) -> tuple:
    return r["at"] is None, r["at"] or 0, r["step_id"]


class _Candidates:
    """Steps as candidate parents; one pass over an inverted index scores all earlier ones.

    `steps`: step_id, at, role, name, text and kids, the number of steps that state it as their parent.
    """

    def __init__(self, steps: list[dict]):
        self.steps = sorted(steps, key=_time_key)
        self.keys = [_time_key(s) for s in self.steps]
        self.place = {s["step_id"]: i for i, s in enumerate(self.steps)}
        self.at = np.array([s["at"] or 0 for s in self.steps], np.int64)
        roles = np.array([s["role"] for s in self.steps], object)
        self.follows = {role: np.isin(roles, before) for role, before in FOLLOWS.items()}
        self.kids = np.array([s["kids"] for s in self.steps], np.int64)
        postings: dict[str, list[int]] = {}
        named: dict[str, list[int]] = {}
        sizes = []
        for i, s in enumerate(self.steps):
            words = set(_WORD.findall((s["text"] or "").lower()))
            sizes.append(len(words))
            for w in words:
                postings.setdefault(w, []).append(i)
            if s["name"]:
                named.setdefault(s["name"], []).append(i)
        self.sizes = np.array(sizes, np.int64)
        self.postings = {w: np.array(at, np.int64) for w, at in postings.items()}
        self.named = {name: np.array(at, np.int64) for name, at in named.items()}

    def best(self, child: dict) -> tuple[float, dict] | None:
        """(score, step) of the likeliest step before the child in time; of equal ones the latest.

        The child's own stated link is not held against its parent.
        """
        n = bisect_left(self.keys, _time_key(child))
        if not n:
            return None
        kids = self.kids[:n]
        if (own := self.place.get(child["parent_id"], n)) < n:
            kids = kids.copy()
            kids[own] -= 1
        score = np.where(kids > 0, 0.0, OPEN)
        if child["role"] in self.follows:
            score += ROLES * self.follows[child["role"]][:n]
        if child["at"] is not None:  # then all earlier steps have a time too
            score += TIME * np.exp(-np.abs(child["at"] - self.at[:n]) / 1e6 / FADE)
        text = child["text"] or ""
        for name, at in self.named.items():
            if name in text:
                score[at[: np.searchsorted(at, n)]] += MENTION
        words = set(_WORD.findall(text.lower()))
        hits = [self.postings[w] for w in words if w in self.postings]
        if hits:
            shared = np.bincount(np.concatenate(hits), minlength=n)[:n]
            score += OVERLAP * (shared / (len(words) + self.sizes[:n] - shared))
        at = n - 1 - int(np.argmax(score[::-1]))
        return float(score[at]), self.steps[at]


def rebuild_thread(rows: list[dict], every: bool = False) -> tuple[str | None, list[dict]]:
    """(reason, steps in order) of one thread; reason is null for a conversation to keep.

    Of rows with one step_id the first finished one stands (an unfinished one if there is no other).
    A step whose stated parent is missing hangs from the likeliest of all earlier steps (`inferred`).
    Of several steps without parent all but the earliest are `surplus`: they stay roots, and `likely`
    names their likeliest parent; with `every` it does so for all steps but the earliest root.
    `channel` is the step at the top of a step's tree, null at cycles.
    Order: depth-first from the root, siblings by time, then id; what hangs from no root comes last.
    """
    steps: dict[str, dict] = {}
    for r in sorted(rows, key=_standing):
        steps.setdefault(r["step_id"], r)
    by_time = sorted(steps.values(), key=lambda r: (r["at"] is None, r["at"] or 0, r["step_id"]))
    starts = sum(r["parent_id"] is None for r in steps.values())
    broken = starts != 1
    candidates: _Candidates | None = None
    chosen: dict[str, str | None] = {}
    rooted = False
    for r in by_time:
        r["kids"] = 0
    for r in by_time:
        if r["parent_id"] in steps:
            steps[r["parent_id"]]["kids"] += 1
    for r in by_time:
        stated = r["parent_id"]
        r |= {"inferred": False, "surplus": False, "likely": None, "score": None, "channel": None}
        if stated in steps:
            r["score"] = STATED
            if every:
                candidates = candidates or _Candidates(by_time)
                if best := candidates.best(r):
                    r["likely"] = best[1]["step_id"]
        elif stated is None and not rooted:
            rooted = True
        else:
            broken = True
            candidates = candidates or _Candidates(by_time)
            if best := candidates.best(r):
                r["score"], r["likely"] = best[0], best[1]["step_id"]
            r["inferred"], r["surplus"] = stated is not None, stated is None
            stated = r["likely"] if r["inferred"] else None
        chosen[r["step_id"]] = stated
    children: dict[str | None, list[dict]] = {}
    for r in by_time:
        children.setdefault(chosen[r["step_id"]], []).append(r)
    ordered: list[dict] = []
    seen: set[str] = set()
    answered: set[str] = set()
    asked: set[str] = set()
    stack = [(r, 0, None, r["step_id"]) for r in reversed(children.get(None, []))]
    while stack:
        r, depth, question, top = stack.pop()
        key = r["step_id"]
        seen.add(key)
        ordered.append({**r, "parent_id": chosen[key], "depth": depth, "channel": top})
        if r["role"] == "user" and not r["blank"]:
            asked.add(key)
            question = key
        elif r["role"] == "assistant" and not r["blank"] and not r["is_error"] and question is not None:
            answered.add(question)
        stack += [(c, depth + 1, question, top) for c in reversed(children.get(key, []))]
    if len(seen) < len(steps):  # the rest hangs from cycles
        broken = True
        for r in by_time:
            if r["step_id"] not in seen:
                ordered.append({**r, "parent_id": chosen[r["step_id"]], "depth": None})
    for position, r in enumerate(ordered):
        r["position"] = position
    if broken:
        return "broken", ordered
    if not asked:
        return "empty", ordered
    return ("no_reply" if asked - answered else None), ordered


def _rebuild(batches: Iterator[pa.RecordBatch], messages: bool, every: bool) -> Iterator[pa.RecordBatch]:
    schema = _arrow(STEPS if messages else THREADS)
    out: list[dict] = []

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    for chunk in whole_groups(batches, ["thread_id"], 20_000):
        rows = chunk.to_pylist()
        start = 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end]["thread_id"] == rows[start]["thread_id"]:
                continue
            reason, ordered = rebuild_thread(rows[start:end], every)
            out += [{**r, "reason": reason} for r in ordered] if messages else [{"thread_id": rows[start]["thread_id"], "reason": reason}]
            start = end
        if len(out) >= 10_000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def _in_one_task(steps: DataFrame, messages: bool, every: bool) -> DataFrame:
    together = steps.repartition("thread_id").sortWithinPartitions("thread_id")
    return together.mapInArrow(lambda batches: _rebuild(batches, messages, every), STEPS if messages else THREADS)


def _likeliest(children: DataFrame, parents: DataFrame, cuts: Cuts, block: int) -> DataFrame:
    """(thread_id, step_id, score, likely) for the children: `_Candidates.best` over blocks of their threads.

    Parents and children of a thread are spread by hash over blocks of about `block` steps; each pair
    of blocks is scored in one task, and the best of a child's blocks stands.
    """
    columns = ["step_id", "parent_id", "role", "name", "text", "at", "kids"]
    sizes = children.groupBy("thread_id").agg(F.count("*").alias("nc")).join(parents.groupBy("thread_id").agg(F.count("*").alias("np")), "thread_id")
    sizes = sizes.select("thread_id", *(F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("nc", "np")))

    def side(rows: DataFrame, child: bool) -> DataFrame:
        own, other = ("nc", "np") if child else ("np", "nc")
        at = F.pmod(F.xxhash64("step_id"), F.col(own)).cast("int").alias("own")
        spread = rows.join(sizes, "thread_id").select("thread_id", *columns, at, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        blocks = ("own", "other") if child else ("other", "own")
        return spread.select("thread_id", F.col(blocks[0]).alias("c"), F.col(blocks[1]).alias("p"), F.lit(child).alias("child"), *columns)

    ddl = "thread_id string, step_id string, score double, at_null boolean, at bigint, likely string"
    schema = pa.schema([("thread_id", pa.string()), ("step_id", pa.string()), ("score", pa.float64()), ("at_null", pa.bool_()), ("at", pa.int64()), ("likely", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, ["thread_id", "c", "p"], block):
            groups: dict[tuple, list[dict]] = {}
            for r in chunk.to_pylist():
                groups.setdefault((r["thread_id"], r["c"], r["p"]), []).append(r)
            out = []
            for (thread, _, _), rows in groups.items():
                known = _Candidates([r for r in rows if not r["child"]])
                for r in rows:
                    if r["child"] and (best := known.best(r)):
                        out.append((thread, r["step_id"], best[0], *_time_key(best[1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    keys = ["thread_id", "c", "p"]
    together = side(children, True).unionByName(side(parents, False)).repartition(*keys).sortWithinPartitions(*keys)
    best = F.max(F.struct("score", "at_null", "at", "likely")).alias("b")
    return cuts.cut(together.mapInArrow(run, ddl).groupBy("thread_id", "step_id").agg(best).select("thread_id", "step_id", "b.score", "b.likely"))


def _places(own: DataFrame, cuts: Cuts) -> DataFrame:
    """(thread_id, step_id, depth, channel, position) of large threads, as rebuild_thread walks them.

    `own`: thread_id, step_id, parent (the chosen one), at. Subtree sizes by doubling; a step's place
    is its parent's, one more, and the sizes of its earlier siblings, summed up the tree by doubling.
    What hangs from cycles comes last, by time.
    """
    placed = components(own.select(F.col("thread_id").alias("space"), F.col("step_id").alias("node"), "parent"), cuts)
    placed = placed.select(F.col("space").alias("thread_id"), F.col("node").alias("step_id"), "top", "hops", F.when(F.col("top"), F.col("label")).alias("channel"))
    state = cuts.cut(own.join(placed, ["thread_id", "step_id"]))
    trees = state.where("top").select("thread_id", "step_id", "parent", "at", F.col("hops").cast("int").alias("depth"), "channel")

    def doubled(start: DataFrame, down: bool) -> DataFrame:
        """Sums of n over all descendants (down) or ancestors, the step itself included."""
        known = cuts.cut(start)
        while known.where("jump is not null").limit(1).count():
            to = known.select(F.col("thread_id").alias("t"), F.col("step_id").alias("s"), F.col("jump").alias("j"), F.col("n").alias("m"))
            step = known.join(to, (F.col("thread_id") == F.col("t")) & (F.col("jump") == F.col("s")), "left")
            if down:
                more = known.where("jump is not null").groupBy(F.col("thread_id").alias("t2"), F.col("jump").alias("s2")).agg(F.sum("n").alias("m2"))
                step = step.join(more, (F.col("thread_id") == F.col("t2")) & (F.col("step_id") == F.col("s2")), "left")
            step = step.select("thread_id", "step_id", F.col("j").alias("jump"), (F.col("n") + F.coalesce("m2" if down else "m", F.lit(0))).alias("n"))
            known = cuts.cut(step)
        return known.select("thread_id", "step_id", "n")

    one = F.lit(1).cast("bigint")
    sizes = doubled(trees.select("thread_id", "step_id", F.col("parent").alias("jump"), one.alias("n")), True)
    by_time = [F.col("at").asc_nulls_last(), F.col("step_id")]
    earlier = Window.partitionBy("thread_id", "parent").orderBy(*by_time).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.when(F.col("parent").isNull(), 0).otherwise(1)
    offsets = trees.join(sizes, ["thread_id", "step_id"]).select("thread_id", "step_id", F.col("parent").alias("jump"), offset.alias("n"))
    tree = trees.select("thread_id", "step_id", "depth", "channel").join(doubled(offsets, False), ["thread_id", "step_id"])
    seen = trees.groupBy("thread_id").agg(F.count("*").alias("seen"))
    last = F.row_number().over(Window.partitionBy("thread_id").orderBy(*by_time)) - 1 + F.coalesce("seen", F.lit(0))
    looped = state.where(~F.col("top")).join(seen, "thread_id", "left").select("thread_id", "step_id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("channel"), last.alias("n"))
    return tree.unionByName(looped).select("thread_id", "step_id", "depth", "channel", F.col("n").cast("int").alias("position"))


def _by_doubling(steps: DataFrame, messages: bool, every: bool, cuts: Cuts, block: int = 20_000) -> DataFrame:
    """The same as `rebuild_thread` for threads too large for one task."""
    rest = [c for c in steps.columns if c not in ("thread_id", "step_id")]
    once = steps.groupBy("thread_id", "step_id").agg(F.min_by(F.struct(*rest), _standing_column()).alias("r")).select("thread_id", "step_id", "r.*")
    once = cuts.cut(once)
    known = once.select(F.col("thread_id").alias("t"), F.col("step_id").alias("known"))
    first = once.where("parent_id is null").groupBy("thread_id").agg(F.min(F.struct(F.col("at").isNull(), F.coalesce("at", F.lit(0)), "step_id"))["step_id"].alias("first"))
    own = once.join(known, (F.col("thread_id") == F.col("t")) & (F.col("parent_id") == F.col("known")), "left").drop("t").join(first, "thread_id", "left")
    own = own.withColumn("inferred", F.col("parent_id").isNotNull() & F.col("known").isNull()).withColumn("surplus", F.col("parent_id").isNull() & (F.col("step_id") != F.col("first")))
    kids = once.groupBy("thread_id", F.col("parent_id").alias("step_id")).agg(F.count("*").alias("kids"))
    own = cuts.cut(own.drop("first").join(kids, ["thread_id", "step_id"], "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    links = own.select(F.col("thread_id").alias("space"), F.col("step_id").alias("node"), F.col("known").alias("parent"))
    placed = cuts.cut(components(links, cuts))
    asks = (F.col("role") == "user") & ~F.col("blank")
    nearest = components(own.select(F.col("thread_id").alias("space"), F.col("step_id").alias("node"), F.when(~asks, F.col("known")).alias("parent")), cuts)
    replies = own.where((F.col("role") == "assistant") & ~F.col("blank") & ~F.col("is_error")).select("thread_id", "step_id")
    answered = (
        nearest.where("top")
        .join(replies, (F.col("space") == F.col("thread_id")) & (F.col("node") == F.col("step_id")))
        .select("thread_id", F.col("label").alias("step_id"))
        .distinct()
        .withColumn("answered", F.lit(True))
    )
    state = own.join(placed, (F.col("thread_id") == F.col("space")) & (F.col("step_id") == F.col("node"))).join(answered, ["thread_id", "step_id"], "left")
    reasons = state.groupBy("thread_id").agg(
        F.count_if(F.col("parent_id").isNull()).alias("starts"),
        F.max(~F.col("top") | F.col("inferred")).alias("lost"),
        F.count_if(asks).alias("asked"),
        F.count_if(asks & F.col("answered").isNull()).alias("open"),
    )
    reason = F.when((F.col("starts") != 1) | F.col("lost"), "broken").when(F.col("asked") == 0, "empty").when(F.col("open") > 0, "no_reply")
    reasons = reasons.select("thread_id", reason.alias("reason"))
    if not messages:
        return reasons
    asked = own.where("known is not null or inferred or surplus") if every else own.where("inferred or surplus")
    scored = own.join(_likeliest(asked, own, cuts, block), ["thread_id", "step_id"], "left")
    scored = cuts.cut(scored.withColumn("parent", F.coalesce("known", F.when(F.col("inferred"), F.col("likely")))))
    places = _places(scored.select("thread_id", "step_id", "parent", "at"), cuts)
    return scored.join(places, ["thread_id", "step_id"]).join(reasons, "thread_id").select(
        "thread_id",
        "step_id",
        F.col("parent").alias("parent_id"),
        "inferred",
        F.when(F.col("known").isNotNull(), F.lit(STATED)).otherwise(F.col("score")).alias("score"),
        "position",
        "depth",
        "role",
        "text",
        "surplus",
        "likely",
        "channel",
        "reason",
    )


def rebuild(steps: DataFrame, messages: bool = False, max_thread: int = 50_000, every: bool = False) -> DataFrame:
    """Threads with the reason to drop them (THREADS), or with `messages` their steps in order (STEPS).

    `steps`: the columns of `prepared`; others are ignored. A thread is `broken` if it has not exactly
    one step without parent, or a step whose parents do not lead to it; else `empty` without a
    non-blank user message; else `no_reply` if some non-blank user message has below it no non-blank,
    error-free assistant message before the next one. Threads of more than `max_thread` rows are
    solved by joins, with the same rows, and never brought to one task. With `every` the column
    `likely` holds each step's likeliest parent as if its own link were not stated.
    """
    columns = ["thread_id", "step_id", "parent_id", "is_streaming", "is_error", "role", "name", "text", "blank", "at"]
    own = steps.select(*columns)
    cuts = Cuts(steps.sparkSession)
    large = cuts.cut(own.groupBy("thread_id").count().where(F.col("count") > max_thread).select("thread_id"))
    if not large.limit(1).count():
        return _in_one_task(own, messages, every)
    small = _in_one_task(own.join(large, "thread_id", "left_anti"), messages, every)
    return small.unionByName(_by_doubling(own.join(large, "thread_id", "left_semi"), messages, every, cuts))
