import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.llm.quantiles import corrections, countable, day_runs, digest, latest, select_ranks, week_start

LOG = "query_id long, asked_at timestamp, logged_at timestamp, intent string, latency_ms int, extra string"


def test_multi_select_equals_sorting(spark):
    rng = random.Random(7)
    values = {"a": [rng.randint(1, 50) for _ in range(997)], "b": [5] * 300, "c": [rng.randint(1, 10**9) for _ in range(2_000)], "d": [3]}
    rows = [Row(g=g, vals=sorted(v[i::7])) for g, v in values.items() for i in range(7)]
    found = select_ranks(spark.createDataFrame(rows, "g string, vals array<bigint>"), ["g"], {"p50": (1, 2), "p95": (19, 20), "p100": (1, 1)}, finish=4)
    for r in found.collect():
        share = {"p50": (1, 2), "p95": (19, 20), "p100": (1, 1)}[r["stat"]]
        n = len(values[r["g"]])
        assert r["n"] == n and r["value"] == sorted(values[r["g"]])[(n * share[0] + share[1] - 1) // share[1] - 1]
    assert found.count() == 12


def test_runs_of_separate_days_combine(spark):
    a = spark.createDataFrame([("g", [1, 2, 9])], "g string, vals array<bigint>")
    b = spark.createDataFrame([("g", [3, 4]), ("g", None), ("g", [])], "g string, vals array<bigint>")
    assert select_ranks(a.unionByName(b), ["g"], {"p50": (1, 2)}).collect()[0]["value"] == 3


def test_late_rows_correct_earlier_runs(spark):
    at = dt.datetime(2000, 1, 3, 10)
    rng = random.Random(3)
    log = [(i % 60, at, at + dt.timedelta(minutes=rng.randrange(600)), rng.choice(("a", "b")), rng.randint(1, 99), "") for i in range(150)]
    first, late = (countable(spark.createDataFrame(part, LOG)) for part in (log[:100], log[100:]))
    whole = day_runs(countable(spark.createDataFrame(log, LOG)))
    parts = day_runs(first).unionByName(corrections(latest(first), late))
    stats = {"p50": (1, 2), "p95": (19, 20), "first": (1, 1000)}
    for finish in (1, 512):
        a, b = (sorted(map(tuple, select_ranks(runs, ["intent"], stats, finish).collect())) for runs in (whole, parts))
        assert a == b and len(a) == 6


def test_repeats_nulls_and_empty(spark):
    at = dt.datetime(2000, 1, 3, 10)
    rows = [
        (1, at, at, " Lookup\n", 10, "x"),
        (1, at, at + dt.timedelta(1), " Lookup\n", 10, "y"),
        (2, at, at, None, 0, None),
        (3, at, at, None, None, None),
        (4, at, at, "  ", -1, None),
        (5, None, at, "a", 5, None),
        (None, at, at, "a", 5, None),
        (6, at, None, "", 7, None),
    ]
    log = spark.createDataFrame(rows, LOG)
    runs = day_runs(countable(log))
    got = {(r["intent"], tuple(r["vals"])) for r in runs.collect()}
    assert got == {("lookup", (10,)), ("unknown", (7,))}
    assert digest(countable(log)).agg(F.sum("n")).collect()[0][0] == 2
    empty = spark.createDataFrame([], LOG)
    assert select_ranks(day_runs(countable(empty)), ["day"], {"p50": (1, 2)}).count() == 0


@pytest.mark.parametrize("value", [1, 127, 128, 4_000, 289_611, 2**40])
def test_digest_error(spark, value):
    rows = spark.createDataFrame([(1, None, 0, "a", value)], "query_id long, logged_at timestamp, day int, intent string, value long")
    r = digest(rows).collect()[0]
    assert r["bucket_low"] <= value < r["bucket_low"] + r["bucket_width"] and r["bucket_width"] <= max(1, value / 64)


def test_weeks_begin_on_monday(spark):
    days = spark.range(2).select(week_start((F.col("id") + F.lit(10_959)).cast("int")).alias("w"))
    assert [r["w"] for r in days.collect()] == ["2000-01-03", "2000-01-03"]
