"""The capture source: ranges over split files in any store, many sessions in one scan, filters that reach the ranges."""

import json

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from cardiolake.operators.vitals import Geometry
from cardiolake.sources import adc, sinks, stores

G = Geometry(chirps=2, rx=1, samples=4)


def raw(n, seed=0):
    return np.random.default_rng(seed).integers(-30000, 30000, n * G.frame_bytes // 2, dtype=np.int16).tobytes()


def frames_of(data):
    return [data[i : i + G.frame_bytes] for i in range(0, len(data), G.frame_bytes)]


def put(folder, name, data):
    (folder / name).write_bytes(data)
    return f"file://{folder}/{name}"


@pytest.fixture
def vault(tmp_path, monkeypatch):
    """A store that only its own scheme reaches; operating-system paths into it mean nothing."""
    inner = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setitem(stores.SCHEMES, "vault", lambda uri: (inner, uri.split("://", 1)[1]))
    return inner


def in_process(options):
    reader = adc.AdcReader(options)
    return [(r["session_id"], r["frame_idx"], r["raw"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_mid_frame_splits_in_a_store_without_paths(vault, tmp_path):
    data = raw(150, 1)
    for cut in (1, G.frame_bytes // 2 + 3, 75 * G.frame_bytes, len(data) - 1):
        for name, part in (("c_0.bin", data[:cut]), ("c_1.bin", data[cut:])):
            with vault.open_output_stream(name) as f:
                f.write(part)
        assert stores.sizes(["vault://c_0.bin", "vault://none", "vault://c_1.bin"]) == [cut, None, len(data) - cut]
        paths = ["vault://c_0.bin", "vault://c_1.bin"]
        options = {"paths": ";".join(paths), "session_id": "s", "chirps": "2", "rx": "1", "samples": "4", "frames_per_partition": "7"}
        assert in_process(options) == [("s", i, x) for i, x in enumerate(frames_of(data))]
        assert in_process(options | {"trim_frames": "3", "end_frame": "70"}) == [("s", i + 3, x) for i, x in enumerate(frames_of(data)[3:70])]


def test_files_cut_in_many_places(tmp_path):
    data = raw(40, 2)
    cuts = [0, 5, 5 + 3 * G.frame_bytes, 100, 1000, len(data)]
    cuts = sorted(set(cuts))
    uris = [put(tmp_path, f"p{i}", data[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    got = in_process({"paths": ";".join(uris), "session_id": "s", "chirps": "2", "rx": "1", "samples": "4"})
    assert [x for _, _, x in got] == frames_of(data)


def test_uris_and_paths_through_spark(spark, tmp_path):
    data = raw(60, 3)
    cut = 20 * G.frame_bytes + 9
    uris = [put(tmp_path, "s_0.bin", data[:cut]), put(tmp_path, "s_1.bin", data[cut:])]
    assert adc.resolve_paths(f"file://{tmp_path}", "s") == uris and adc.resolve_paths(str(tmp_path), "s") == [u.removeprefix("file://") for u in uris]
    for paths in (uris, [u.removeprefix("file://") for u in uris]):
        rows = adc.read_capture(spark, paths, "s", G).orderBy("frame_idx").collect()
        assert [bytes(r["raw"]) for r in rows] == frames_of(data) and [r["frame_idx"] for r in rows] == list(range(60))


def test_many_sessions_are_one_scan_and_filters_narrow_it(spark, tmp_path):
    data = {s: raw(30 + 10 * i, i) for i, s in enumerate("abc")}
    captures = [{"session_id": s, "paths": [put(tmp_path, f"{s}.bin", d)], "trim_frames": 5 if s == "b" else 0} for s, d in data.items()]
    every = adc.read_captures(spark, captures, G)
    assert {r["session_id"]: (r["lo"], r["n"]) for r in every.groupBy("session_id").agg(F.min("frame_idx").alias("lo"), F.count("*").alias("n")).collect()} == {"a": (0, 30), "b": (5, 35), "c": (0, 50)}
    some = every.where("frame_idx >= 10 AND frame_idx < 20 AND session_id IN ('a', 'c') AND length(raw) > 0")
    assert [(r["session_id"], r["frame_idx"], bytes(r["raw"])) for r in some.orderBy("session_id", "frame_idx").collect()] == [(s, i, frames_of(data[s])[i]) for s in "ac" for i in range(10, 20)]
    # the filters are the source's: what it reads is what comes out
    options = {"captures": json.dumps(captures), "chirps": "2", "rx": "1", "samples": "4"}
    from pyspark.sql.datasource import GreaterThan, In, IsNotNull, LessThanOrEqual

    reader = adc.AdcReader(options)
    rest = list(reader.pushFilters([GreaterThan(("frame_idx",), 9), LessThanOrEqual(("frame_idx",), 12), In(("session_id",), ("c",)), IsNotNull(("raw",))]))
    assert [type(f) for f in rest] == [IsNotNull] and [(p.capture.session_id, p.first, p.stop) for p in reader.partitions()] == [("c", 10, 13)]
    assert every.where("frame_idx > 1000").count() == 0


def test_nothing_is_read_of_bad_captures(tmp_path):
    good, short = put(tmp_path, "g", raw(3)), put(tmp_path, "h", raw(1)[:-1])
    for paths, error in ((f"{good};file://{tmp_path}/ghost", FileNotFoundError), ("", FileNotFoundError), (short, ValueError), (f"{good};{short}", ValueError), (put(tmp_path, "e", b""), ValueError)):
        with pytest.raises(error):
            adc.AdcReader({"paths": paths, "chirps": "2", "rx": "1", "samples": "4"})
    with pytest.raises(ValueError, match="trim"):
        adc.AdcReader({"paths": good, "trim_frames": "3", "chirps": "2", "rx": "1", "samples": "4"})
    with pytest.raises(FileNotFoundError):
        adc.resolve_paths(f"file://{tmp_path}", "other")


def test_a_file_that_shrank_fails(tmp_path):
    uri = put(tmp_path, "s", raw(4))
    reader = adc.AdcReader({"paths": uri, "chirps": "2", "rx": "1", "samples": "4"})
    (tmp_path / "s").write_bytes(raw(3))
    with pytest.raises(OSError, match="ends before"):
        [b for p in reader.partitions() for b in reader.read(p)]


@pytest.mark.parametrize("per_file, cut", [(1000, 0), (16, 0), (16, G.frame_bytes // 2 + 1), (7, 3)])
def test_written_captures_come_back(spark, tmp_path, per_file, cut):
    data = {s: raw(25 + 15 * i, i) for i, s in enumerate("ab")}
    rows = [(s, i, x) for s, d in data.items() for i, x in enumerate(frames_of(d))]
    listing = sinks.write_captures(spark.createDataFrame(rows, "session_id string, frame_idx long, raw binary").repartition(3), f"file://{tmp_path}/captures", per_file, cut).collect()
    assert {r["session_id"]: len(r["paths"]) for r in listing} == {s: -(-len(frames_of(d)) // per_file) * (2 if cut else 1) for s, d in data.items()}
    back = adc.read_captures(spark, [{"session_id": r["session_id"], "paths": r["paths"]} for r in listing], G)
    assert sorted((r["session_id"], r["frame_idx"], bytes(r["raw"])) for r in back.collect()) == rows
