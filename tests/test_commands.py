"""Commands, registry, event files and streams."""

import json

import numpy as np

from epochloom import cli
from epochloom.operators import checks
from epochloom.plans.models import Registry
from epochloom.sources import events as source
from epochloom.streaming import events as streaming


def test_command_chain(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    t = np.arange(2000) / 100
    for s in (1, 2):
        np.savez(tmp_path / f"in/r{s}.npz", data=np.stack([np.sin(2 * np.pi * f * t) for f in (8, 10)]).T.astype(np.float32), channel_names=np.array(["F3", "F4"]), sampling_rate_hz=np.array([100.0]), subject_id=np.array([f"s{s}"]))
    rows = [{"recording_id": f"r{s}", "start_seconds": o, "length_seconds": 2, "family": "f", "label": lab} for s in (1, 2) for o, lab in ((5, "a"), (12, "b"))]
    (tmp_path / "e.json").write_text(json.dumps({"events": rows}))
    store = f"{tmp_path}/store"
    assert cli.main([store, "ingest", f"{tmp_path}/in", "--event-table", f"{tmp_path}/e.json", "--run", "i1"]) == 0
    assert cli.main([store, "ingest", f"{tmp_path}/in", "--run", "i1"]) == 1  # exists
    assert cli.main([store, "epoch", "--collection-id", "c", "--baseline-start", "-1", "--baseline-end", "0"]) == 0
    assert cli.main([store, "epoch", "--baseline-start", "-1"]) == 1
    assert cli.main([store, "preprocess", "c", "comparison_safe", "--resample", "50", "--target-channel", "F3", "--target-channel", "CZ", "--rereference", "average"]) == 0
    assert cli.main([store, "discover", "--run", "d", "--branch", "comparison_safe", "--null-iterations", "2", "--subsample-iterations", "2"]) == 0
    assert cli.main([store, "package", "d", f"{tmp_path}/p"]) == 0
    assert cli.main([store, "validate", "package", "d", "--root", f"{tmp_path}/p"]) == 0
    assert cli.main([store, "validate", "events"]) == 0
    assert cli.main([store, "inspect", "run", "d"]) == 0
    assert cli.main([store, "models", "list"]) == 0
    assert "eegpt" in capsys.readouterr().out


def test_registry(spark, tmp_path):
    got = {r.model_id: r for r in Registry().statuses(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and not got["biot"].runnable and got["biot"].missing_assets == ["pretrained-models/EEG-six-datasets-18-channels.ckpt"]


def test_event_forms(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("onset_seconds\tonset\tfamily\ttarget_label\tallow_overlap\n\t7\tf\ta\tfalse\n1.5\t9\tf\t a \ttrue\n")
    got = source.normalise(source.read_events(spark, f"{tmp_path}/e.tsv"), ["_row"], "rec", "ns").orderBy("obs_idx").collect()
    assert [r.onset_seconds for r in got] == [0.0, 1.5]  # an alias counts by being a column
    assert [r.event_id for r in got] == ["rec_event_0001", "rec_event_0002"] and got[1].target_label == "a"
    assert got[0].metadata["allow_overlap"] == "false" and got[0].label_namespace == "ns"


def test_numbers_that_are_none(spark, tmp_path):
    (tmp_path / "e.csv").write_text("event_id,recording_id,onset,duration,family,label\na,r,abc,,f,x\nb,r,1.5,2,f,x\nc,r,0.5,-1,f,x\n")
    got = source.normalise(source.read_events(spark, f"{tmp_path}/e.csv"), ["_row"])
    at = {r.event_id: r for r in got.collect()}
    assert at["a"].onset_seconds is None and at["a"].duration_seconds == 0.0 and at["c"].obs_idx < at["b"].obs_idx
    assert sorted((r.event_id, r.message) for r in source.faults(got).collect()) == [("a", "onset_seconds is no number"), ("c", "duration_seconds is negative")]


def test_event_report(spark):
    rows = [("a", "r", 0.0, 5.0, "f", "x", "", "n", {}, 1), ("b", "r", 4.0, 1.0, "f", "x", "", "n", {"allow_overlap": "false"}, 2), ("b", "r", 9.0, 1.0, "", "x", "", "n", {}, 3), ("c", "q", -1.0, 1.0, "f", "y", "", "n", {}, 4)]
    ev = spark.createDataFrame(rows, "event_id string, recording_id string, onset_seconds double, duration_seconds double, event_family string, target_label string, event_subtype string, label_namespace string, metadata map<string,string>, obs_idx long")
    length = spark.createDataFrame([("r", 9.5)], "recording_id string, seconds double")
    codes = sorted(r.code for r in checks.event_report(ev, length).collect())
    assert codes == ["events.duplicate_id", "events.invalid", "events.invalid", "events.out_of_bounds", "events.overlap", "events.recording_mismatch"]
    assert [r.code for r in checks.event_report(ev.limit(0)).collect()] == ["events.empty"]


def test_lineage(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in checks.lineage_closure(edges).collect()}
    assert got == {("c", "b"): 1, ("b", "a"): 1, ("c", "a"): 1}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("at,event_id,recording_id,onset_seconds,duration_seconds,target_label\n2024-01-01 00:00:01,e1,r,1.0,2.0,x\n2024-01-01 00:00:02,,r,1.0,2.0,x\n")
    ev = streaming.event_stream(spark, f"{tmp_path}/in", "at timestamp, event_id string, recording_id string, onset_seconds double, duration_seconds double, target_label string")
    q = streaming.append(ev, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    assert streaming.label_counts(ev).isStreaming
