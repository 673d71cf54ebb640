import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import conversations
from vellum.llm.conversations import prepared, rebuild

ROWS = "thread_id string, step_id string, parent_id string, step_type string, step_name string, is_streaming boolean, is_error boolean, output_text string, created_at string, role int, at string"


def rows(thread, *steps):
    out = []
    for i, s in enumerate(steps):
        step, parent, kind, text = s[:4]
        out.append((thread, step, parent, kind, "n", s[4] if len(s) > 4 else False, s[5] if len(s) > 5 else None, text, f"2000-01-01T00:00:{i:02d}Z", 1, "clash"))
    return out


U, A = "User-Message ", "assistant_message"
DATA = [
    *rows("ok", ("a", None, "system_message", "s"), ("b", "a", U, "question"), ("t", "b", "tool", ""), ("c", "t", A, "answer"), ("d", "c", U, "​  ")),
    *rows("two_roots", ("a", None, U, "q"), ("b", None, A, "x")),
    *rows("no_root", ("a", "b", U, "q"), ("b", "a", A, "x")),
    *rows("dangling", ("a", None, U, "price list please"), ("b", "zz", A, "the price list"), ("c", "a", A, "x")),
    *rows("loop", ("a", None, U, "q"), ("b", "a", A, "x"), ("c", "d", U, "q"), ("d", "c", A, "x")),
    *rows("empty", ("a", None, "system_message", "s"), ("b", "a", U, None)),
    *rows("error", ("a", None, U, "q"), ("b", "a", A, "x", False, True)),
    *rows("passed", ("a", None, U, "q"), ("b", "a", U, "q2"), ("c", "b", A, "x")),
    *rows("saves", ("a", None, U, "q"), ("b", "a", A, "", True), ("b", "a", A, "done", False), ("b", "a", A, "done", False)),
    (None, "q", None, U, "n", False, False, "x", None, 1, None),
]
EXPECTED = {"ok": None, "two_roots": "broken", "no_root": "broken", "dangling": "broken", "loop": "broken", "empty": "empty", "error": "no_reply", "passed": "no_reply", "saves": None}


@pytest.mark.parametrize("max_thread", [50_000, 0])
def test_reasons(spark, max_thread):
    found = rebuild(prepared(spark.createDataFrame(DATA, ROWS)), max_thread=max_thread)
    assert {r["thread_id"]: r["reason"] for r in found.collect()} == EXPECTED


@pytest.mark.parametrize("max_thread", [50_000, 0])
def test_messages_in_order(spark, max_thread):
    found = rebuild(prepared(spark.createDataFrame(DATA, ROWS)), messages=True, max_thread=max_thread)
    ok = sorted((r["position"], r["step_id"], r["role"]) for r in found.where("thread_id = 'ok'").collect())
    assert ok == [(0, "a", "system"), (1, "b", "user"), (2, "t", "tool"), (3, "c", "assistant"), (4, "d", "user")]
    assert found.where("thread_id = 'saves'").count() == 2


def test_likeliest_parent(spark):
    found = rebuild(prepared(spark.createDataFrame(DATA, ROWS)), messages=True).where("inferred").collect()
    assert [(r["step_id"], r["parent_id"]) for r in found] == [("b", "a")] and found[0]["score"] > 0


def test_empty_and_times(spark):
    assert rebuild(prepared(spark.createDataFrame([], ROWS))).count() == 0
    stamps = ["2000-01-22T21:53:33+02:00", "2000-01-22 19:53:33", "2000-01-22T19:53:33.000Z", "2000-01-22T19:53:33.000000+00:00", "later", None]
    df = spark.createDataFrame([("t", str(i), None, U, "n", False, False, "x", s, 1, "") for i, s in enumerate(stamps)], ROWS)
    at = {r["step_id"]: r["at"] for r in prepared(df).collect()}
    want = int(dt.datetime(2000, 1, 22, 19, 53, 33, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert [at[str(i)] for i in range(6)] == [want] * 4 + [None] * 2


def link_rows():
    """A true parent 61 steps back, 60 blank tool steps in a row, and a second root."""
    far = [("a", None, U, "zebra quagga okapi tapir")] + [(f"m{i:02d}", f"m{i - 1:02d}" if i else "s", A, f"filler {i}") for i in range(60)] + [("z", "gone", A, "zebra quagga okapi tapir")]
    blanks = [("a", None, U, "question")] + [(f"b{i:02d}", "a", "tool", " ") for i in range(60)] + [("z", "gone", A, "x")]
    roots = [("a", None, U, "zebra quagga"), ("b", "a", A, "okapi tapir"), ("c", None, U, "zebra quagga")]
    return [*rows("far", *far), *rows("blanks", *blanks), *rows("roots", *roots)]


def stamped(data):
    """The rows a second apart, however many there are."""
    start = dt.datetime(2000, 1, 1)
    return [(*r[:8], (start + dt.timedelta(seconds=i)).isoformat(), *r[9:]) for i, r in enumerate(data)]


def test_all_earlier_steps_are_candidates(spark):
    found = rebuild(prepared(spark.createDataFrame(stamped(link_rows()), ROWS)), messages=True).where("inferred or surplus").collect()
    assert {(r["thread_id"], r["step_id"]): r["likely"] for r in found} == {("far", "z"): "a", ("far", "m00"): "a", ("blanks", "z"): "b59", ("roots", "c"): "b"}
    assert {(r["thread_id"], r["step_id"]): r["parent_id"] for r in found} == {("far", "z"): "a", ("far", "m00"): "a", ("blanks", "z"): "b59", ("roots", "c"): None}
    assert {r["channel"] for r in rebuild(prepared(spark.createDataFrame(link_rows(), ROWS)), messages=True).where("thread_id = 'roots'").collect()} == {"a", "c"}


def branching(seed):
    """A thread with side branches, missing parents, surplus roots, loops, blank steps, clock errors and several saves."""
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    out = []
    for i in range(120):
        r = rng.random()
        parent = None if not i or r < 0.03 else "gone" if r < 0.2 else f"s{rng.randrange(120):03d}" if r < 0.25 else f"s{rng.randrange(max(0, i - 6), i):03d}"
        text = None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(0, 5)))
        at = None if rng.random() < 0.05 else f"2000-01-01T00:{rng.randrange(max(0, i // 4 - 1), i // 4 + 2):02d}:00Z"
        for _ in range(rng.choice((1, 1, 2))):
            out.append((f"t{seed}", f"s{i:03d}", parent if rng.random() < 0.9 else "s001", rng.choice((U, A, "tool")), rng.choice((*words, None)), rng.random() < 0.2, None, text, at, 1, "clash"))
    return out


@pytest.mark.parametrize("block", [20_000, 13])
def test_large_threads_have_the_same_rows(spark, monkeypatch, block):
    monkeypatch.setattr(conversations._by_doubling, "__defaults__", (block,))
    tree = [("q", None, U, "q"), ("l", "q", A, "x"), ("r", "q", A, "y"), ("ll", "l", U, "q2"), ("rr", "r", "tool", ""), ("lll", "ll", A, "z")]
    steps = prepared(spark.createDataFrame([*DATA, *branching(1), *branching(2), *stamped(link_rows()), *rows("tree", *tree)], ROWS))
    small, large = ([tuple(r) for r in rebuild(steps, messages=True, max_thread=n, every=block == 13).withColumn("score", F.round("score", 9)).collect()] for n in (50_000, 0))
    assert sorted(map(repr, small)) == sorted(map(repr, large))
    order = [r[1] for r in sorted((r for r in large if r[0] == "tree"), key=lambda r: r[5])]
    assert order == ["q", "l", "ll", "lll", "r", "rr"]


def test_hidden_links_are_found_again():
    """A thread of questions, tool steps and answers: each link, hidden in turn, is the likeliest of all."""
    thread = []
    for i in range(20):
        at, topic = i * 100_000_000, f"topic{i} matter{i} thing{i}"
        thread.append({"step_id": f"q{i}", "parent_id": f"a{i - 1}" if i else None, "role": "user", "text": topic, "at": at})
        thread.append({"step_id": f"t{i}", "parent_id": f"q{i}", "role": "tool", "text": "", "at": at + 5_000_000})
        thread.append({"step_id": f"a{i}", "parent_id": f"t{i}", "role": "assistant", "text": f"about {topic}", "at": at + 9_000_000})
    full = [{"thread_id": "t", "is_streaming": False, "is_error": False, "name": None, "blank": not r["text"], **r} for r in thread]
    reason, found = conversations.rebuild_thread(full, every=True)
    assert reason is None and sum(r["likely"] == r["parent_id"] for r in found[1:]) >= 0.9 * (len(found) - 1)
