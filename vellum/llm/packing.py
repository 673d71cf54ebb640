"""Filling containers of fixed capacity by conflict-constrained best fit.

Items are spread over blocks of bounded size by a hash of their id; each block is packed by one
task, largest items first. A block's open bins are ordered by residual. Every bin carries a bitmap
of its sources and one of its duplicate clusters; the search starts at the tightest residual that
is large enough and goes on to the next until a bin without conflict is found. Two items of one
duplicate cluster never share a bin. Two items of one source do not either while the bins in use are
below the least possible number and SLACK: an item without a compatible bin opens a new one. Beyond
it, a source may repeat in a bin, so that a frequent source costs no more space than SLACK.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.arrow import whole_groups

CAPACITY = 2_048
#: Items per block, on average.
BLOCK = 20_000
#: Share of bins above the least possible number that are opened to keep sources apart.
SLACK = 0.01
SCHEMA = "doc_id bigint, piece_no int, first int, tokens int, container_id bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("first", pa.int32()), ("tokens", pa.int32()), ("container_id", pa.int64())])


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """The bin of each item, -1 for items of size 0. Sizes are at most the capacity.

    First search: no bin gets two items of one source or of one cluster. Where the sources rule out
    all open bins with room, a new bin is opened; once the bins in use reach their least possible
    number and `slack`, a second search asks for the clusters only.
    """
    most = int(-(-sum(s for s in sizes if s > 0) // capacity) * (1 + slack))
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    times: dict = defaultdict(int)
    for c in clusters:
        times[c] += 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in times.items() if n > 1 and c is not None)}
    bins_by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    with_source: list[dict[int, int]] = [defaultdict(int) for _ in range(capacity + 1)]  # bins of a residual that have a source
    full: list[list[int]] = [[] for _ in range(capacity + 1)]  # sources that all bins of a residual have
    full_of: dict[int, int] = dict.fromkeys(source_bit.values(), 0)  # the same per source; bit r: residual r
    rooms = 0  # bit r: some bin has residual r
    bin_sources: list[int] = []
    bin_clusters: list[int] = []
    placed = [-1] * len(sizes)

    def bits(mask: int) -> Iterator[int]:
        while mask:
            low = mask & -mask
            yield low
            mask ^= low

    def move(b: int, room: int, step: int) -> None:
        """Add a bin to its residual (step 1) or take it away (-1)."""
        nonlocal rooms
        bins, counts, bit = bins_by_room[room], with_source[room], 1 << room
        if step > 0:
            bins[b] = None
        else:
            del bins[b]
        for s in bits(bin_sources[b]):
            counts[s] += step
        for s in full[room]:
            full_of[s] &= ~bit
        rooms = rooms | bit if bins else rooms & ~bit
        full[room] = [s for s in bits(bin_sources[next(iter(bins))]) if counts[s] == len(bins)] if bins else []
        for s in full[room]:
            full_of[s] |= bit

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if size <= 0:
            continue
        source, cluster = source_bit[sources[i]], cluster_bit.get(clusters[i], 0)
        chosen, room = -1, 0
        for strict in (True, False):
            if not strict and len(bin_sources) < most:
                break
            mask = (rooms & ~full_of[source] if strict else rooms) >> size
            while mask:
                low = mask & -mask
                room = size + low.bit_length() - 1
                mask ^= low
                for b in reversed(bins_by_room[room]):
                    if not bin_clusters[b] & cluster and not (strict and bin_sources[b] & source):
                        chosen = b
                        break
                if chosen >= 0:
                    break
            if chosen >= 0:
                break
        if chosen < 0:
            chosen = len(bin_sources)
            bin_sources.append(0)
            bin_clusters.append(0)
            left = capacity - size
        else:
            move(chosen, room, -1)
            left = room - size
        bin_sources[chosen] |= source
        bin_clusters[chosen] |= cluster
        placed[i] = chosen
        if left:
            move(chosen, left, 1)
    return placed


def _pack_batches(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for chunk in whole_groups(batches, ["block"], 1):
        columns = {c: chunk.column(c).to_pylist() for c in chunk.column_names}
        start, blocks = 0, columns["block"]
        for end in range(1, len(blocks) + 1):
            if end < len(blocks) and blocks[end] == blocks[start]:
                continue
            part = {c: v[start:end] for c, v in columns.items()}
            placed = pack(part["tokens"], part["source"], part["cluster"], capacity)
            ids = [(blocks[start] << 32) + b if b >= 0 else None for b in placed]
            yield pa.RecordBatch.from_arrays([*(pa.array(part[f.name], f.type) for f in list(_ARROW)[:4]), pa.array(ids, pa.int64())], schema=_ARROW)
            start = end


def fill_containers(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Every item in a container of `capacity` tokens (columns: SCHEMA).

    `items`: doc_id, tokens, source, cluster; further columns are ignored. An item above the
    capacity is split into pieces of the capacity and a rest; `first` is a piece's first token. An
    item of 0 or null tokens has one row without container. Null sources are one source; a null
    cluster conflicts with nothing.
    """
    own = items.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("tokens").cast("int"), F.lit(0)).alias("all"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("cluster").cast("bigint").alias("cluster"))
    blocks = max(1, -(-items.count() // block))
    pieces = (
        own.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(all - 1) div {capacity}")).cast("int"))))
        .withColumn("first", F.col("piece_no") * capacity)
        .withColumn("tokens", F.least(F.lit(capacity), F.col("all") - F.col("first")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    )
    together = pieces.select("block", "doc_id", "piece_no", "first", "tokens", "source", "cluster").repartition("block").sortWithinPartitions("block", "doc_id", "piece_no")
    return together.mapInArrow(lambda batches: _pack_batches(batches, capacity), SCHEMA)
