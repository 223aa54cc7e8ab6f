"""Folders of event files in mixed forms, the log of a run, epochs by phase."""

import json
import threading

import pytest

from epochloom.operators import epochs
from epochloom.plans.engine import Engine
from epochloom.sources import events as source
from epochloom.sources.recording_files import npz_bytes, write_bytes


def test_forms_are_told_file_by_file(spark, tmp_path):
    normal = {"event_id": "n1", "recording_id": "r", "onset_seconds": 3.0, "duration_seconds": 1.0, "event_family": "f", "target_label": "a", "event_subtype": "", "label_namespace": "ns", "metadata": {"allow_overlap": True, "note": "é"}}
    (tmp_path / "normal.json").write_text(json.dumps({"events": [normal]}))
    (tmp_path / "list.json").write_text(json.dumps([{"event_id": "l1", "recording_id": "r", "onset": 1, "family": "f", "label": "b", "extra": [1, 2]}]))
    (tmp_path / "partly.json").write_text(json.dumps([normal | {"event_id": "p1"}, {"onset": 5, "label": "c", "family": "f", "recording_id": "r", "metadata": {"x": 1}}]))
    (tmp_path / "a.csv").write_text('label,onset,family,recording_id,event_id,note\nd,2.5,f,r,c1,"two\nlines"\n')
    (tmp_path / "b.CSV").write_text("recording_id,event_id,onset_seconds,onset,family,label\nr,c2,,9,f,e\n")
    (tmp_path / "c.tsv").write_text("event_id\trecording_id\tstart_seconds\tfamily\tlabel\nt1\tr\t4\tf\tg\n")
    (tmp_path / "readme.md").write_text("no events")
    rows = source.read_event_folder(spark, str(tmp_path))
    forms = {r["source_path"].rsplit("/", 1)[-1]: r["form"] for r in rows.collect()}
    assert forms == {"normal.json": "normal", "list.json": "raw", "partly.json": "raw", "a.csv": "raw", "b.CSV": "raw", "c.tsv": "raw"}
    got = {r["event_id"]: r for r in source.normalise(source.read_events(spark, str(tmp_path)), ["_row"], "rec", "other").collect()}
    assert set(got) == {"n1", "l1", "p1", "r_event_0007", "c1", "c2", "t1"}
    assert {k: (r["onset_seconds"], r["target_label"]) for k, r in got.items()} == {"n1": (3.0, "a"), "l1": (1.0, "b"), "p1": (3.0, "a"), "r_event_0007": (5.0, "c"), "c1": (2.5, "d"), "c2": (0.0, "e"), "t1": (4.0, "g")}
    assert got["n1"]["metadata"] == {"allow_overlap": "true", "note": "é"} and got["n1"]["label_namespace"] == "ns"
    assert got["l1"]["metadata"] == {"extra": "[1, 2]"} and got["c1"]["metadata"] == {"note": "two\nlines"} and got["c1"]["label_namespace"] == "other"
    assert json.loads(got["p1"]["metadata"]["metadata"]) == normal["metadata"]
    assert [r["obs_idx"] for r in sorted(got.values(), key=lambda r: (r["onset_seconds"], r["event_id"]))] == [1, 2, 3, 4, 5, 6, 7]


def test_files_that_are_no_event_tables(spark, tmp_path):
    for name, text in (("a.json", '{"x": 1}'), ("b.json", "[1]"), ("c.json", "{"), ("d.csv", "a,b\n1,2,3\n"), ("e.csv", "event_id,onset\nx,1\n")):
        (tmp_path / name).write_text(text)
    found = {r["source_path"].rsplit("/", 1)[-1]: r["message"] for r in source.read_event_folder(spark, str(tmp_path)).collect()}
    assert len(found) == 5 and found["e.csv"] is None and all(found[k] for k in ("a.json", "b.json", "c.json", "d.csv"))
    with pytest.raises(ValueError, match="a.json"):
        source.read_events(spark, str(tmp_path))


def test_an_event_folder_is_ingested(spark, tmp_path):
    import numpy as np

    write_bytes(f"{tmp_path}/in/r.npz", npz_bytes(["a", "b"], 10.0, np.arange(400, dtype=np.float32).reshape(2, 200)))
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "one.csv").write_text("event_id,onset,duration,family,label\na,5,1,f,x\n")
    (folder / "two.json").write_text(json.dumps([{"event_id": "b", "onset": 9, "duration": 1, "family": "f", "label": "y"}]))
    engine = Engine(spark, f"{tmp_path}/store")
    engine.ingest(f"{tmp_path}/in", str(folder), run="i")
    assert sorted((r["event_id"], r["recording_id"]) for r in engine.table("events").collect()) == [("a", "r"), ("b", "r")]
    c = engine.epoch(epochs.Windows(), "i")
    table = engine.table("epochs").filter(f"collection_id = '{c}' AND phase = 'onset'")
    plan = table._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "phase" in pushed and table.count() == 4
    assert {r[0].rsplit("phase=", 1)[1].split("/")[0] for r in table.select("_metadata.file_path").collect()} == {"onset"}


def test_writers_of_one_log_lose_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    threads = [threading.Thread(target=lambda k=k: [engine._log("r", "s", f"{k}-{i}") for i in range(20)]) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    said = [json.loads(r["line"])["message"] for r in engine.log_lines("r").collect()]
    assert sorted(said) == sorted(f"{k}-{i}" for k in range(4) for i in range(20))
    assert all([int(m.split("-")[1]) for m in said if m.startswith(f"{k}-")] == list(range(20)) for k in range(4))
