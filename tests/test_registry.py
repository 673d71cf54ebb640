import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from vellum.functions.arrow import whole_groups
from vellum.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "record_id", "state"]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", ["rrf_fusion", "token_budget_pack", "kpis", "ancestor_prefix_join", "stream_daily_counts", "p3_found"])
def test_query_equals_sql(spark, name):
    from verify import digest

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in ("candidate", "structural_unit", "parsed_unit", "query_log", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = db.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SMALL)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([c[0] for c in cursor.description], cursor.fetchall())


def test_core_does_not_need_the_llm_subpackage():
    loaded = {m for m in sys.modules if m.startswith("vellum") and not m.startswith("vellum.llm")}
    for name in loaded:
        source = importlib.import_module(name).__file__
        assert source is None or "vellum.llm" not in open(source).read()


def test_whole_groups():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 2]}) for i in range(0, 10, 2)]
    parts = [t.column("k").to_pylist() for t in whole_groups(batches, ["k"], 3)]
    assert sum(parts, []) == keys
    assert all(set(a).isdisjoint(b) for a, b in zip(parts, parts[1:]))
