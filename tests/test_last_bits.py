"""Energies that are halves when rounded, or stand exactly at a threshold: the SQL's last bits decide them, so the query has the same ones.

One thread, as the SQL's order of additions, and so its last bits, else change from run to run."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cardiolake.plans import registry, views


def duck(folder):
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return c


def save(folder, words, labels):
    vectors = pa.array([list(w / 1024) for w in words], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(words)), "embedding": vectors, "label": pa.array(labels, pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)


def parts(words):
    """Of bin 2: four times its energy as a whole number of squared parts."""
    z = ((words[:, 0::2] + 1j * words[:, 1::2]).reshape(-1, 4, 8) * np.array([1, -1j, -1, 1j] * 2)).sum(axis=2)
    return (z.real**2 + z.imag**2).sum(axis=1).astype(np.int64)


def same(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    got = duck(folder).execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    want = sorted(got.fetchall(), key=str)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    return columns, rows, want


@pytest.fixture(scope="module")
def many():
    return np.random.default_rng(11).integers(-300, 300, (20_000, 64))


def test_energies_have_the_bits_of_the_sql(spark):
    folder = "/root/testdata/sf0.001"
    want = duck(folder).execute(f"WITH {registry.SAMPLES} SELECT session_id, frame_idx, bin_idx, energy, mr, mi FROM be").fetchall()
    got = {(r["session_id"], r["frame_idx"]): r for r in views.features(spark, folder).collect()}
    assert len(want) == 8 * len(got) == 4000
    for s, i, k, *values in want:
        assert [got[s, i][c][k] for c in ("bin_energy", "mean_re", "mean_im")] == values


def test_halves_of_energies_round_as_in_the_sql(spark, many, tmp_path):
    halves = many[parts(many) % 65536 == 32768]
    while len(halves) < 40:
        more = np.random.default_rng(len(halves)).integers(-300, 300, (400_000, 64))
        halves = np.concatenate((halves, more[parts(more) % 65536 == 32768]))
    _, rows, want = same(spark, save(tmp_path, halves, np.arange(len(halves)) % 3), "frame_quality_mask")
    assert rows == want


def test_ties_with_a_threshold_count_as_in_the_sql(spark, many, tmp_path):
    """Sessions of equal frames but one, with exactly half their energy; where rounding takes it below, it is a dropout."""
    n = parts(many)
    at = {x: i for i, x in enumerate(n)}
    pairs = [(a, at[x // 2]) for a, x in enumerate(n) if x % 2 == 0 and x // 2 in at][:40]
    assert len(pairs) == 40
    words = np.concatenate([np.stack([many[a]] * 5 + [many[b]] + [many[a]] * 5) for a, b in pairs])
    columns, rows, want = same(spark, save(tmp_path, words, np.repeat(np.arange(40), 11)), "quality_mask_stats")
    assert rows == want
    assert 0 < sum(r[columns.index("n_subject_bin_dropout_flagged")] for r in want) < 40
