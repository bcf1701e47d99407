"""Every registered query against its SQL in DuckDB on the smallest tables, and its plan."""

import math

import duckdb
import pytest

from cardiolake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def alike(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def tidy(rows):
    return sorted(rows, key=lambda r: [str(round(float(v), 4)) if isinstance(v, float) else str(v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = tidy([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = tidy([tuple(r[names.index(c)] for c in columns) for r in got.fetchall()])
    assert len(rows) == len(want) and all(all(map(alike, a, b)) for a, b in zip(rows, want))


@pytest.mark.parametrize("name", ["interval_join_gated_stats", "window_accuracy_metrics", "condition_coverage", "frame_quality_mask"])
def test_plans_have_no_nested_loops(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    # frames pass through their transform once, when they are written
    assert "MapInArrow" not in plan


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
