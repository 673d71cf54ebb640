"""Exact percentiles per group over very large columns, by distributed multi-select.

`day_runs` turns rows into sorted runs per group and day. Runs of separate days or partitions are
combined by a plain union; `corrections` gives the runs for queries that are logged again after
their first row was counted. `select_ranks` finds order statistics over any union of runs: every
task proposes its local median, the weighted median of the proposals is the group's pivot, all runs
count three ways, and only the range that holds the wanted rank stays. The runs themselves never
move: a round reads them, looks the bounds up by binary search, and passes on a few numbers a group.
`digest` is the compact alternative: mergeable counts with a relative error below 1/64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import Cuts

#: A group with no more values than this left is finished by sorting them.
FINISH = 512
#: Values that a task holds while it makes runs; no run is longer.
CHUNK = 200_000


def utc_day(at: Column) -> Column:
    """Days since 1970-01-01 UTC, whatever the session's time zone."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(86_400_000_000)).cast("int")


def week_start(day: Column) -> Column:
    """The Monday of a day's week as yyyy-mm-dd."""
    return F.date_format(F.date_from_unix_date(day - F.pmod(day + 3, F.lit(7))), "yyyy-MM-dd")


def clean_intent(intent: Column) -> Column:
    """Lower case without white space around it; null and blank are `unknown`."""
    trimmed = F.lower(F.regexp_replace(F.coalesce(intent, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed == "", "unknown").otherwise(trimmed)


def countable(log: DataFrame) -> DataFrame:
    """(query_id, logged_at, day, intent, value) of rows with an id, a time and a latency above 0."""
    return log.where((F.col("latency_ms") > 0) & F.col("query_id").isNotNull() & F.col("asked_at").isNotNull()).select(
        F.col("query_id").cast("bigint").alias("query_id"),
        "logged_at",
        utc_day(F.col("asked_at")).alias("day"),
        clean_intent(F.col("intent")).alias("intent"),
        F.col("latency_ms").cast("bigint").alias("value"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """Each query_id once, its latest logged row; of equal times the greatest row. Null times are the earliest."""
    return rows.groupBy("query_id").agg(F.max(F.struct("logged_at", "day", "intent", "value")).alias("r")).select("query_id", "r.*")


def _merged(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """(*by, sign, vals): sorted runs of each task's own values, in pieces of at most CHUNK; nothing moves."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema) + ", sign int, vals array<bigint>"

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if pa.types.is_list(table.column(values).type):
            lists = table.column(values).combine_chunks()
            flat, parents = pa.compute.list_flatten(lists), pa.compute.list_parent_indices(lists)
            table = table.drop_columns([values]).take(parents).append_column(values, flat)
        grouped = table.group_by([*by, "sign"]).aggregate([(values, "list")])
        runs = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in grouped.column(f"{values}_list")]
        columns = [grouped.column(c).combine_chunks() for c in (*by, "sign")]
        for at in range(0, len(runs), 500):
            part = [pa.array(r, pa.int64()) for r in runs[at : at + 500]]
            ends = pa.array(np.cumsum([0, *map(len, part)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.concat_arrays(part))
            yield pa.RecordBatch.from_arrays([*(c.slice(at, 500) for c in columns), lists], names=[*by, "sign", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(values))
            size += len(column.flatten()) if pa.types.is_list(column.type) else batch.num_rows
            held.append(batch)
            if size >= CHUNK:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return rows.select(*by, "sign", values).mapInArrow(run, ddl)


def day_runs(rows: DataFrame) -> DataFrame:
    """(day, intent, sign, vals): sorted runs. Each query_id counts once, the latest logged row for it.

    The only shuffle is on the id, so that no group or day is hot; each task then sorts its own share
    of every group, in pieces of bounded size.
    """
    return _merged(latest(rows).withColumn("sign", F.lit(1)), ["day", "intent"], "value")


def corrections(counted: DataFrame, late: DataFrame) -> DataFrame:
    """(day, intent, sign, vals): runs that bring earlier runs up to date with rows logged later.

    `counted`: the rows of `latest` behind the earlier runs; `late`: new rows of the form of
    `countable`, of any ids. A later row of a counted id takes its old value away (sign -1) and adds
    the new one; an earlier row of it changes nothing; a new id is added. The rows of `latest` over
    both inputs are what the next correction has to be given as counted.
    """
    row = F.struct("logged_at", "day", "intent", "value")
    old = counted.select("query_id", row.alias("old"))
    both = latest(late).select("query_id", row.alias("new")).join(old, "query_id", "left").where(F.col("old").isNull() | (F.col("new") > F.col("old")))
    removed = both.where(F.col("old").isNotNull()).select("old.*", F.lit(-1).alias("sign"))
    return _merged(both.select("new.*", F.lit(1).alias("sign")).unionByName(removed), ["day", "intent"], "value")


def _weighted_median(pairs: Iterable[tuple[int, int]]) -> tuple[int | None, int]:
    """(median, weight) of (value, weight) pairs: the first value with half the weight at or below it."""
    ordered = sorted(p for p in pairs if p[1] > 0)
    whole = sum(w for _, w in ordered)
    upto = 0
    for value, weight in ordered:
        upto += weight
        if 2 * upto >= whole:
            return value, whole
    return None, 0


def _weighted_median_column(pairs: str) -> Column:
    """The same over an array column of struct(v, w)."""
    return F.expr(
        f"""aggregate(array_sort(filter({pairs}, p -> p.w > 0)), struct(0L as upto, cast(null as bigint) as v),
        (s, p) -> struct(s.upto + p.w as upto, if(s.v is null and 2 * (s.upto + p.w) >= aggregate({pairs}, 0L, (t, q) -> t + q.w), p.v, s.v) as v)).v"""
    )


def _joined(runs: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """Each run with the states of its group; small states are broadcast by Spark, so that runs stay where they are."""
    named = states.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in states.columns if c not in by))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return runs.join(named, same).drop(*(f"_{c}" for c in by))


def select_ranks(runs: DataFrame, by: list[str], stats: dict[str, tuple[int, int]], finish: int = FINISH) -> DataFrame:
    """The stats of each group: (*by, stat, n, value), value of nearest rank, ceil(n * share).

    `runs`: the columns `by`, vals, a sorted array, and sign where runs are taken away again. `stats`:
    name to share as (part, of). The stated error is 0. Every round halves what is left of a group,
    on average. A null or empty array is no run; a group with nothing left gives no row; an empty
    table gives an empty result.
    """
    cuts = Cuts(runs.sparkSession)
    key = [*by, "stat"]
    sign = F.col("sign").cast("int") if "sign" in runs.columns else F.lit(1)
    base = cuts.cut(_merged(runs.where(F.size("vals") > 0).select(*by, sign.alias("sign"), "vals"), by, "vals"))
    sizes = base.groupBy(*by).agg(F.sum(F.size("vals") * F.col("sign")).cast("bigint").alias("n")).where("n > 0")
    shares = F.array(*(F.struct(F.lit(s).alias("stat"), F.lit(p).alias("part"), F.lit(q).alias("of")) for s, (p, q) in stats.items()))
    nothing = F.lit(None).cast("bigint")
    wanted = sizes.withColumn("s", F.explode(shares)).select(
        *by, "s.stat", "n", F.expr("(n * s.part + s.of - 1) div s.of").alias("k"), F.col("n").alias("left"), nothing.alias("low"), nothing.alias("high"), nothing.alias("pivot"), nothing.alias("value")
    )
    state = cuts.cut(wanted)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    own = ["n", "k", "left", "low", "high", "pivot"]
    counted_ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, *own)) + ", below bigint, same bigint, v0 bigint, w0 bigint, v1 bigint, w1 bigint"

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, np.ndarray, int, int]]:
        """(group and state, sign, values, first, last) of each run, within its group's bounds."""
        names = batch.schema.names
        heads = list(zip(*(batch.column(names.index(c)).to_pylist() for c in (*key, *own)))) if batch.num_rows else []
        signs, lists = batch.column(names.index("sign")).to_pylist(), batch.column(names.index("vals"))
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for i, (head, sign) in enumerate(zip(heads, signs)):
            vals = flat[ends[i] : ends[i + 1]]
            low, high = head[-3], head[-2]
            yield head, sign, vals, 0 if low is None else int(np.searchsorted(vals, low, "right")), len(vals) if high is None else int(np.searchsorted(vals, high, "left"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Three-way counts, and the local medians below and above the pivot."""
        found: dict[tuple, list] = {}
        kept: list[pa.DataType] = []  # types of the key columns

        def flush() -> pa.RecordBatch:
            rows = [(*head, below, same, *_weighted_median(lower), *_weighted_median(upper)) for head, (below, same, lower, upper) in found.items()]
            types = [*kept, *[pa.int64()] * 6]
            names = [*key, *own, "below", "same", "v0", "w0", "v1", "w1"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            kept = [batch.schema.field(c).type for c in (*key, *own)]
            for head, sign, vals, i, j in stretches(batch):
                entry = found.setdefault(head, [0, 0, [], []])
                pivot = head[-1]
                if pivot is None:  # the first round only proposes
                    a, b = j, j
                else:
                    a, b = int(np.searchsorted(vals, pivot, "left")), int(np.searchsorted(vals, pivot, "right"))
                    entry[0] += sign * (a - i)
                    entry[1] += sign * (b - a)
                if sign > 0:
                    for part, (x, y) in ((entry[2], (i, a)), (entry[3], (b, j))):
                        if x < y:
                            part.append((int(vals[(x + y - 1) // 2]), y - x))
            if len(found) > 100_000:
                yield flush()
                found.clear()
        if found:
            yield flush()

    near, done = [], []
    while True:
        near.append(state.where(F.col("value").isNull() & (F.col("left") <= finish)))
        done.append(state.where(F.col("value").isNotNull()))
        open_ = state.where(F.col("value").isNull() & (F.col("left") > finish))
        if not open_.limit(1).count():
            break
        counts = _joined(base, open_.drop("value"), by).select(*key, *own, "sign", "vals").mapInArrow(count, counted_ddl)
        pairs = [F.collect_list(F.struct(F.col(f"v{i}").alias("v"), F.col(f"w{i}").alias("w"))).alias(f"p{i}") for i in (0, 1)]
        whole = counts.groupBy(*key, *own).agg(F.sum("below").alias("below"), F.sum("same").alias("same"), *pairs)
        sided = whole.withColumn("side", F.expr("case when pivot is null then null when k <= below then -1 when k <= below + same then 0 else 1 end"))
        up = F.col("side") == 1
        state = cuts.cut(
            sided.select(
                *key,
                "n",
                F.when(up, F.expr("k - below - same")).otherwise(F.col("k")).alias("k"),
                F.when(F.col("side") == -1, F.col("below")).when(up, F.expr("left - below - same")).otherwise(F.col("left")).alias("left"),
                F.when(up, F.col("pivot")).otherwise(F.col("low")).alias("low"),
                F.when(F.col("side") == -1, F.col("pivot")).otherwise(F.col("high")).alias("high"),
                F.when(up, _weighted_median_column("p1")).otherwise(_weighted_median_column("p0")).alias("pivot"),
                F.when(F.col("side") == 0, F.col("pivot")).alias("value"),
            )
        )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values left of each group, counted: at most `finish`, and what was taken away."""
        for batch in batches:
            rows = []
            for head, sign, vals, i, j in stretches(batch):
                distinct, times = np.unique(vals[i:j], return_counts=True)
                rows += [(*head[:-4], v, sign * c) for v, c in zip(distinct.tolist(), times.tolist())]
            if rows:
                types = [*(batch.schema.field(c).type for c in (*key, "n", "k")), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*key, "n", "k", "v", "c"])

    left_ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (*key, "n", "k")) + ", v bigint, c bigint"
    ends = _joined(base, reduce(DataFrame.unionByName, near).drop("value"), by).select(*key, *own, "sign", "vals").mapInArrow(rest, left_ddl)
    values = ends.groupBy(*key, "n", "k", "v").agg(F.sum("c").alias("c")).where("c > 0").groupBy(*key, "n", "k").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("vs"))
    upto = "aggregate(vs, struct(0L as upto, cast(null as bigint) as v), (s, x) -> struct(s.upto + x.c as upto, if(s.v is null and s.upto + x.c >= k, x.v, s.v) as v)).v"
    found = reduce(DataFrame.unionByName, done).select(*key, "n", "value")
    return found.unionByName(values.select(*key, "n", F.expr(upto).alias("value")))


def digest(rows: DataFrame) -> DataFrame:
    """(day, intent, bucket_low, bucket_width, n): counts in buckets of relative width below 1/64.

    Mergeable: counts of separate days or partitions add up, and any percentile read from them is
    off by less than one bucket. Values below 128 keep their own bucket.
    """
    once = latest(rows)
    shift = F.greatest(F.lit(0), F.length(F.bin("value")) - 7)
    width = F.expr("shiftleft(1L, shift)")
    return (
        once.withColumn("shift", shift)
        .withColumn("bucket_width", width)
        .withColumn("bucket_low", F.expr("value div bucket_width * bucket_width"))
        .groupBy("day", "intent", "bucket_low", "bucket_width")
        .agg(F.count("*").alias("n"))
    )
