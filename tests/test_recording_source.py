"""Recordings read in ranges: formats round-trip, every chunk once, no file is
one task, filters choose what is read."""

import json
import os

import numpy as np
import pytest

from epochloom.operators import checks
from epochloom.sources import recording_source as source
from epochloom.sources import recordings
from epochloom.sources.recording_files import edf_bytes, npz_bytes, write_bytes

RNG = np.random.default_rng(3)
DATA = RNG.uniform(-0.9, 0.9, (3, 1037)).astype(np.float32)
NAMES = ["Cz", "Fz 1", "Oz"]


def whole(rows, n_channels=3):
    """Channels put together from their chunks."""
    out = {}
    for r in rows:
        out.setdefault((r["recording_id"], r["channel_idx"]), []).append((r["chunk_id"], r["samples"]))
    assert all([c for c, _ in sorted(v)] == list(range(len(v))) for v in out.values())
    return {k: np.array([x for _, part in sorted(v) for x in part], np.float32) for k, v in out.items()}


def test_formats(spark, tmp_path):
    root = f"{tmp_path}/in"
    write_bytes(f"{root}/A one.edf", edf_bytes(NAMES, 250.0, DATA * 100, -100, 100, "uV", per_record=50, annotations=7))
    write_bytes(f"{root}/b.bdf", edf_bytes(NAMES, 250.0, DATA, -2, 1, "mV", wide=True, per_record=61, records=-1))
    write_bytes(f"{root}/c.npz", npz_bytes(NAMES, 250.0, DATA, subject_id="s1", cohort="c1"))
    write_bytes(f"{root}/d.npz", npz_bytes(NAMES, 250.0, DATA.T, packed=True))
    write_bytes(f"{root}/e.npz", npz_bytes(NAMES, 250.0, np.asfortranarray(DATA), packed=False))
    write_bytes(f"{root}/f.npz", npz_bytes(NAMES, 250.0, DATA.T.astype(np.float64)))
    write_bytes(f"{root}/g.npz", npz_bytes(NAMES, 250.0, DATA, packed=True))
    for range_bytes in (64 << 20, 700):
        got = recordings.read_signals(spark, root, chunk=100, range_bytes=range_bytes)
        rows = got.collect()
        assert max(len(r["samples"]) for r in rows) <= 100
        data = whole(rows)
        assert len(data) == 21
        for (name, k), x in data.items():
            want, near = (DATA[k] * 1e-4, 4e-9) if name == "a_one" else (DATA[k] * 1e-3, 1e-9) if name == "b" else (DATA[k], 0)
            padded = np.concatenate((want, np.zeros(len(x) - len(want), np.float32)))
            assert np.abs(x - padded).max() <= near, (name, k)
    assert recordings.read_signals(spark, root, chunk=100, range_bytes=700).rdd.getNumPartitions() > 20
    table = {r["recording_id"]: r for r in recordings.read_recordings(spark, root).collect()}
    assert {r["n_samples"] for k, r in table.items() if k > "b"} == {1037} and table["a_one"]["n_samples"] == 1050
    assert table["a_one"]["channel_names"] == NAMES and table["a_one"]["sampling_rate_hz"] == 250.0
    assert table["a_one"]["metadata"] == {"measurement_date": "2021-03-02 04:05:06+00:00"}
    assert table["c"]["subject_id"] == "s1" and table["c"]["cohort_label"] == "c1"
    assert [table[k]["provenance"]["transposed_on_load"] for k in "cdefg"] == ["false", "true", "false", "true", "false"]
    assert all(r["message"] is None and int(r["provenance"]["size_bytes"]) == os.path.getsize(r["source_path"].removeprefix("file:")) for r in table.values())


def test_as_files_read_whole(spark, tmp_path):
    """Stores that only Spark opens give the same two tables."""
    root = f"{tmp_path}/in"
    write_bytes(f"{root}/a.edf", edf_bytes(NAMES, 100.0, DATA, per_record=10))
    write_bytes(f"{root}/d.npz", npz_bytes(NAMES, 100.0, DATA.T))
    key = lambda r: json.dumps(r, default=str, sort_keys=True)
    for table in ("recordings", "signals"):
        a = [r.asDict() for r in recordings._read(spark, root, table, 100).collect()]
        b = [r.asDict() for r in recordings._whole(spark, [root], table, 100).collect()]
        assert sorted(map(key, a)) == sorted(map(key, b)), table


def test_bad_files(spark, tmp_path):
    root = f"{tmp_path}/in"
    good = edf_bytes(NAMES, 100.0, DATA)
    for name, content in {
        "short.edf": good[:300], "text.edf": b"x" * 400, "rate.npz": npz_bytes(NAMES, 0.0, DATA), "shape.npz": npz_bytes(["a"], 1.0, DATA), "zip.npz": b"PK no",
        "empty.bdf": b"", "other.csv": b"a,b", "x.fif": b"x", "cut.edf": good[:-500],
    }.items():
        write_bytes(f"{root}/{name}", content)
    got = {r["recording_id"]: r["message"] for r in recordings.read_recordings(spark, root).collect()}
    assert len(got) == 9 and [k for k, m in got.items() if m is None] == ["cut"]
    assert {r["recording_id"] for r in recordings.read_signals(spark, root).collect()} == {"cut"}
    with pytest.raises(Exception, match="nowhere"):
        recordings.read_recordings(spark, f"{tmp_path}/nowhere").collect()


def test_files_over_two_gigabytes_are_many_ranges(tmp_path):
    """A sparse file of 3 GB: its last range is read without the others."""
    path = f"{tmp_path}/big.edf"
    head = edf_bytes(["a"], 100.0, np.zeros((1, 100)), per_record=100, records=-1)[:512]
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(3 << 30)
        f.seek((3 << 30) - 2)
        f.write(np.array([32767], "<i2").tobytes())
    reader = source.Reader({"paths": json.dumps([path]), "table": "signals", "chunk": "50000"})
    parts = reader.partitions()
    assert len(parts) == 48 and all(p.high is None or p.high - p.low == 64 << 20 for p in parts)
    last = list(reader.read(parts[-1]))
    n = ((3 << 30) - 512) // 200 * 100
    ids = [b.column("chunk_id")[0].as_py() for b in last]
    assert ids[-1] == (n - 1) // 50000 and ids == list(range(ids[0], ids[-1] + 1))
    before = next(reader.read(parts[-2])).column("chunk_id")[0].as_py()
    assert before < ids[0] and abs((ids[0] - before) * 100_000 - (64 << 20)) < 200_000


def test_filters_choose_files_and_channels(spark, tmp_path):
    root = f"{tmp_path}/in"
    for name in ("a", "b", "c"):
        write_bytes(f"{root}/{name}.edf", edf_bytes(NAMES, 100.0, DATA, per_record=100))
    conf = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "true")
    try:
        got = recordings.read_signals(spark, root).filter("recording_id IN ('a', 'c') AND channel = 'Oz'")
        assert {(r["recording_id"], r["channel"]) for r in got.collect()} == {("a", "Oz"), ("c", "Oz")}
        assert got.rdd.getNumPartitions() == 2
        assert "Filter" not in got._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0] or got.count() == 2
    finally:
        spark.conf.set(conf, before)
    reader = source.PushingReader({"paths": json.dumps([root])})
    left = list(reader.pushFilters([source.EqualTo(("channel_idx",), 1), source.In(("recording_id",), ("a", "b")), source.EqualTo(("recording_id",), "b"), source.EqualTo(("chunk_id",), 0)]))
    assert [f.attribute for f in left] == [("chunk_id",)] and len(reader.partitions()) == 1
    assert [b.column("channel_idx")[0].as_py() for p in reader.partitions() for b in reader.read(p)] == [1]


def test_files_that_exist_are_found_by_the_tasks(spark, tmp_path):
    write_bytes(f"{tmp_path}/sub-1_eeg.edf", b"x")
    write_bytes(f"{tmp_path}/sub-1_channels.tsv", b"x")
    paths = [(f"file:{tmp_path}/sub-1_eeg.edf",), (f"{tmp_path}/sub-1_eeg.edf",), (f"file:{tmp_path}/sub-1_events.tsv",), (f"file:{tmp_path}",), (None,)]
    got = source.existing(spark.createDataFrame(paths + paths, "path string"))
    assert sorted(r[0] for r in got.collect()) == sorted(p[0] for p in paths[:2])
    rows = [(f"r{k}", f"file:{tmp_path}/{name}", "edf", ["a"], 1.0, 1, 1.0, {"k": "v"}, None) for k, name in enumerate(("sub-1_eeg.edf", "gone.edf"))]
    rec = spark.createDataFrame(rows, "recording_id string, source_path string, source_format string, channel_names array<string>, sampling_rate_hz double, n_samples long, duration_seconds double, provenance map<string,string>, message string")
    wanted = [p for r in rows for p in (r[1],)] + [f"file:{tmp_path}/sub-1{x}" for x in ("_eeg.json", "_channels.tsv", "_events.tsv")]
    found = checks.recording_report(rec, source.existing(spark.createDataFrame([(p,) for p in wanted], "path string")))
    assert sorted((r["code"], r["message"].rsplit("/", 1)[-1]) for r in found.collect()) == [
        ("recording.bids_sidecar_missing", "sub-1_eeg.json"), ("recording.bids_sidecar_missing", "sub-1_events.tsv"), ("recording.source_missing", "gone.edf")
    ]
