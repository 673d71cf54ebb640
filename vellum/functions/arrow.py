"""Helpers for operators that walk whole groups inside one partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that never cut through a group.

    The partition has to be sorted by `keys`. Memory is bounded by `rows` plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        last = [c[-1].as_py() for c in columns]
        start = batch.num_rows - 1
        while start and all(c[start - 1].as_py() == v for c, v in zip(columns, last)):
            start -= 1
        whole = [*held[:-1], batch.slice(0, start)]
        if not start:  # the group may have begun in an earlier batch
            back = held[:-1]
            while back:
                previous = back[-1]
                columns = [previous.column(previous.schema.get_field_index(k)) for k in keys]
                at = previous.num_rows
                while at and all(c[at - 1].as_py() == v for c, v in zip(columns, last)):
                    at -= 1
                if at:
                    break
                back.pop()
            else:
                continue
            cut_at = len(back) - 1
            whole = [*held[:cut_at], held[cut_at].slice(0, at)]
            held = [held[cut_at].slice(at), *held[cut_at + 1 :]]
        else:
            held = [batch.slice(start)]
        size = sum(b.num_rows for b in held)
        yield pa.Table.from_batches(whole)
    if held:
        yield pa.Table.from_batches(held)
