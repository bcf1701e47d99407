"""Queries over events that repeat with other keys, as in the larger tables: means that are halves stay halves, so results equal the SQL."""

import duckdb
import pytest

from cardiolake.plans import registry
from test_queries import DATA, TABLES, alike, tidy

REPEATS = 6
#: Perfusion of one second, in the order of rows: mean 0.45, which sums of doubles exceed by a last bit.
HALF = [20, 23, 20, 27]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    for t in TABLES:
        if t != "events":
            (folder / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    # three days of events, and one second of each kind on the fourth: three good ones, a bad one, the half
    seconds = [[80], [80], [80], [0], HALF]
    single = [f"({i * 10 + j + 10_000_000}, TIMESTAMP '2024-01-04 08:0{i}:00', 1, 'click', 70.0, '{{\"k\": {k}}}')" for i, ks in enumerate(seconds) for j, k in enumerate(ks)]
    duckdb.connect().execute(f"""COPY (SELECT event_id + 1000000 * i AS event_id, ts, user_id + 1000000 * i AS user_id, event_type, value, props FROM '{DATA}/events.parquet', range(0, {REPEATS}) t(i) WHERE ts < TIMESTAMP '2024-01-04'
        UNION ALL SELECT * FROM (VALUES {", ".join(single)})) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["reference_duplicate_merge", "nan_safe_json", "worst_windows", "monitor_csv", "interval_join_gated_stats", "comparison_csv", "aligned_centers", "accuracy_of_good_windows"])
def test_query_over_repeated_events_equals_its_sql(spark, repeated, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{repeated}/{t}.parquet'")
    df = registry.QUERIES[name](spark, repeated)
    columns = sorted(df.columns)
    rows = tidy([tuple(r[c] for c in columns) for r in df.collect()])
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    want = tidy([tuple(r[names.index(c)] for c in columns) for r in got.fetchall()])
    assert len(rows) == len(want) and all(all(map(alike, a, b)) for a, b in zip(rows, want))
