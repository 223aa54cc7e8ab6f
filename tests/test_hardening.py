"""From files to evaluated and packaged runs: lost channels, lost recordings,
models that aren't there, and every finding once."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from epochloom import cli
from epochloom.operators import checks, discovery
from epochloom.operators.backbone import Model
from epochloom.operators.epochs import Baseline, Windows
from epochloom.operators.preprocess import Branch
from epochloom.plans import packages
from epochloom.plans.engine import Engine, EngineError, report_lines
from epochloom.plans.models import Adapter, ModelLoadError, Registry

FINDING = checks.FINDING


def pooling(root, variant, device):
    """Means and deviations of channels, all rows of a batch at once."""

    def embed(x):
        return np.concatenate([x.mean(-1), x.std(-1)], axis=-1)

    return embed


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
REGISTRY = Registry((Adapter("mock", make=pooling), Adapter("lost", ("no_such_package",), make=pooling), Adapter("fileless", (), {"a": ("x.bin",)}, "a", make=pooling), Adapter("bare")))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hardening")
    (root / "in").mkdir()
    t = np.arange(1200) / 100
    rnd = np.random.default_rng(1)
    events = [{"recording_id": f"rec{s}", "onset": o, "duration": 1, "family": "f", "label": lab} for s in (1, 2, 3) for o, lab in ((2, "a"), (4, "b"), (6, "a"), (8, "b"))]
    for s in (1, 2, 3):
        x = np.stack([np.sin(2 * np.pi * f * t) for f in (8, 10, 20)]) + rnd.normal(0, 0.05, (3, 1200))
        for e in events:
            if e["recording_id"] == f"rec{s}":
                at = slice(e["onset"] * 100, e["onset"] * 100 + 100)
                x[0 if e["label"] == "a" else 2, at] *= 4
        np.savez(root / f"in/Rec{s}.npz", data=x.T.astype(np.float32), channel_names=np.array(["F3", "F4", "C3"]), sampling_rate_hz=np.array([100.0]), subject_id=np.array([f"s{s}"]), label_namespace=np.array(["n"]), cohort=np.array(["red"]))
    (root / "e.json").write_text(json.dumps({"events": [e | {"metadata": {"hand": "left"}} for e in events]}))
    engine = Engine(spark, f"{root}/store")
    engine.ingest(f"{root}/in", f"{root}/e.json", run="i")
    engine.epoch(Windows(0.5, 0.5, 0.2, 0.5, None, Baseline(-0.5, 0.0)), "i", "c")
    engine.preprocess(Branch("comparison_safe", align_channels=("F3", "CZ", "C3"), rereference="average", baseline="subtract_mean"), "c")
    run = engine.discover("d", branches=["comparison_safe"], collections=["c", "none"], null_iterations=3, subsample_iterations=3)
    return engine, run, root


def codes(found):
    return sorted({r.code for r in found.collect()})


def test_recordings_from_headers(store):
    engine, _, _ = store
    r = engine.table("recordings").filter("recording_id = 'rec1'").first()
    assert r.n_samples == 1200 and r.cohort_label == "red" and r.source_format == "npz" and r.provenance["transposed_on_load"] == "true" and int(r.provenance["size_bytes"]) > 0
    e = engine.table("events").orderBy("recording_id", "obs_idx").first()
    assert e.metadata == {"hand": "left"} and e.obs_idx == 1


def test_lost_channel_leaves_margins(store):
    """CZ is NaN in every epoch: margins are those of the other channels."""
    engine, run, _ = store
    for r in engine.table("candidates").filter("run_id = 'd'").collect():
        assert r.within is not None and np.isfinite([r.within, r.rest, r.margin, r.loso_margin, r.null_mean, r.mean_similarity, r.subject_consistency, r.trial_consistency]).all()
        assert r.margin > 0 and "CZ" in r.channels and r.subject_ids == ["s1", "s2", "s3"]
    bands = engine.table("subject_bandpower").filter("run_id = 'd'").drop("run_id")
    assert bands.filter("isnan(power)").select("channel").distinct().collect()[0].channel == "CZ"
    with_, without = (discovery.control_scores(b).orderBy("target_label").collect() for b in (bands, bands.filter("NOT isnan(power)")))
    assert [r.margin for r in with_] == pytest.approx([r.margin for r in without])
    assert engine.table("topography").filter("run_id = 'd' AND channel <> 'CZ' AND band_mean IS NULL").count() == 0


def test_axes_of_the_pair(spark):
    """A third label without a channel changes nothing between the other two."""
    rows = [("n", "f", "b", label, s, "onset", ch, k, band, float((hash((label, s, ch, band)) % 97) + 1)) for label in "xyz" for s in "12" for k, ch in enumerate("PQR") for band in ("alpha", "beta") if not (label == "z" and ch != "P")]
    cols = "label_namespace string, event_family string, branch_name string, target_label string, subject_id string, phase string, channel string, ch_pos int, band string, power double"
    bands = spark.createDataFrame(rows, cols)
    score = lambda df: {(r.target_label): r.strongest for r in discovery.control_scores(df).collect()}
    two, three = score(bands.filter("target_label <> 'z'")), score(bands)
    keys = ["target_label", "subject_id"]
    v = discovery.vectors(bands, [*discovery.GROUP, "subject_id"], False).select(*keys, "x").collect()
    assert all(len(r.x) == 6 and sum(np.isnan(r.x)) == (4 if r.target_label == "z" else 0) for r in v)
    assert three["x"] >= two["x"] - 1e-12 and three["y"] >= two["y"] - 1e-12


def test_partial_run_names_the_collection(store):
    engine, run, root = store
    manifest = json.loads((root / "store/runs/d/manifest.json").read_text())
    assert manifest["status"] == "partial"
    assert engine.table("issues").filter("run_id = 'd' AND code = 'discovery.collection_unreadable'").first().location == "none"
    log = [json.loads(r["line"]) for r in engine.log_lines("d").collect()]
    assert [x["message"] for x in log] == ["starting", "completed"] and log[0]["stage"] == "discovery"
    made = {g["path"].split("/")[-2]: g["parents"] for g in json.loads((root / "store/runs/d/lineage.json").read_text())["generated"]}
    assert any(p.endswith("topography/run_id=d") for p in [g["path"] for g in json.loads((root / "store/runs/d/lineage.json").read_text())["generated"]]) and all("difference" in p for p in made["topography"])
    assert {"run.status", "run.failure_recorded"} <= set(codes(engine.validate_run(run)))


def test_events_of_no_recording(store, spark):
    engine, _, root = store
    (root / "bad.csv").write_text("event_id,recording_id,onset,duration,family,label\nx,rec1,abc,1,f,a\n")
    with pytest.raises(EngineError, match="onset_seconds is no number"):
        Engine(spark, f"{root}/other").ingest(f"{root}/in", f"{root}/bad.csv", run="i")
    (root / "far.csv").write_text("event_id,recording_id,onset,duration,family,label\nx,nowhere,1,1,f,a\ny,rec1,1,1,f,a\n")
    other = Engine(spark, f"{root}/third")
    other.ingest(f"{root}/in", f"{root}/far.csv", run="i")
    with pytest.raises(EngineError, match="no recording nowhere"):
        other.epoch(Windows(0.5, 0.5, 0.2, 0.5), "i", "c")


def test_empty_epochs_are_issues(spark):
    cols = "label_namespace string, event_family string, target_label string, branch_name string, recording_id string, event_id string, subject_id string, phase string, samples array<float>, sampling_rate_hz double"
    rows = [("n", "f", "a", "b", f"r{s}", "e", f"s{s}", "onset", [] if s == 3 else [1.0], 100.0) for s in (1, 2, 3)]
    good, issues = discovery.usable(spark.createDataFrame(rows, cols), 2)
    assert good.count() == 2 and [(r.code, r.location) for r in issues.collect()] == [("discovery.empty_epoch", "n/f/b/a/r3/e")]


def test_loading_models(spark, tmp_path):
    for model, why in (("lost", "no_such_package"), ("fileless", "x.bin"), ("bare", "make")):
        with pytest.raises(ModelLoadError, match=why):
            REGISTRY.load(spark, str(tmp_path), model)
    with pytest.raises(ModelLoadError, match="no variant"):
        REGISTRY.load(spark, str(tmp_path), "fileless", "z")
    (tmp_path / "fileless").mkdir()
    (tmp_path / "fileless/x.bin").write_text("x")
    assert REGISTRY.load(spark, str(tmp_path), " FileLess ").embed(np.ones((1, 2, 3))).shape == (1, 4)
    with pytest.raises(KeyError):
        REGISTRY.get("unknown")


def test_ensemble_command(store, monkeypatch, capsys, spark):
    """Discovery, evaluation and packages from the shell, with a model that isn't there."""
    engine, _, root = store
    monkeypatch.setattr(cli, "REGISTRY", REGISTRY)
    at = str(root / "store")
    assert cli.main([at, "discover-ensemble", "--run", "e", "--branch-filter", "comparison_safe", "--null-iterations", "2", "--subsample-iterations", "2", "--backbone", "mock", "--backbone", "lost", "--package-root", f"{root}/packed"]) == 0
    evidence = {(r.target_label, r.model_id): r for r in engine.table("evidence").filter("run_id = 'e'").collect()}
    assert {k: r.status for k, r in evidence.items()} == {(a, m): s for a in "ab" for m, s in (("mock", "used"), ("lost", "skipped"))}
    assert all(np.isfinite(evidence[k, "mock"].margin) and evidence[k, "mock"].n_subjects == 3 for k in "ab")
    assert {r.n_used for r in engine.table("consensus").filter("run_id = 'e'").collect()} == {1}
    assert json.loads((root / "store/runs/e_backbones/manifest.json").read_text())["status"] == "partial"
    assert cli.main([at, "validate-package", "e", "--root", f"{root}/packed"]) == 0
    assert "ok: yes" in capsys.readouterr().out
    manifests = spark.read.parquet(f"{root}/packed/run_id=e/manifests").collect()
    assert len(manifests) == 2
    for m in manifests:
        assert m.analysis.source_models == ["epochloom", "lost", "mock"] and m.path == f"patterns/f/all_sexes/comparison_safe/{m.pattern_id.replace('__', '_')}"
        assert packages.manifest_faults(json.loads(json.dumps(m.asDict(recursive=True)))) == []
        for a in m.artifacts:
            assert (root / "packed/run_id=e" / a.path).exists(), a.path
    assert cli.main([at, "validate-run", "e"]) == 0 and "run.status" in capsys.readouterr().out
    assert cli.main([at, "inspect-run", "e", "--json"]) == 0 and '"models":2' in capsys.readouterr().out
    assert cli.main([at, "backbone-evaluate", "e"]) == 1
    assert cli.main([at, "backbone-evaluate", "e", "--backbone", "mock"]) == 0
    assert {r.status for r in engine.table("evidence").filter("run_id = 'e'").collect()} == {"used"}
    assert cli.main([at, "models", "probe", "mock"]) == 0 and cli.main([at, "models", "probe", "lost"]) == 1 and cli.main([at, "models", "check"]) == 1 and cli.main([at, "models", "check", "mock"]) == 0
    # lost artifacts: of one candidate, then of all
    kept = engine.table("prototypes").filter("run_id = 'e' AND target_label = 'a'").drop("run_id").collect()
    engine.spark.createDataFrame(kept, engine.table("prototypes").drop("run_id").schema).write.mode("overwrite").parquet(f"{at}/prototypes/run_id=e")
    assert engine.package("e", f"{root}/packed2").count() == 1
    (failure,) = spark.read.json(f"{root}/packed2/run_id=e/failures").collect()
    assert failure.message == "lacks prototypes" and failure.pattern_id.endswith("__b")
    assert "candidate.artifact_missing" in codes(engine.validate_candidates("e"))


def test_known_inputs_in_the_engine(store):
    """Patches, montages and sensor positions reach models from a run."""
    engine, run, _ = store
    shapes = {}
    models = [
        Model("patches", lambda x: np.array([x.ndim, *x.shape], float), input="cbramod"), Model("montage", lambda x: np.array([x.ndim, *x.shape], float), input="eegpt"),
        Model("placed", lambda x, p: np.array([*x.shape, *p.shape], float), input="brainomni"), Model("tokens", lambda x: x.mean(-1, keepdims=True) @ np.ones((1, 4)), input="biot"),
    ]
    engine.evaluate_backbones(run, models)
    held = engine.table("embeddings").filter("run_id = 'd'").collect()
    for r in held:
        shapes[r.model_id] = r.x or r.message
    assert shapes["patches"][:2] == [3.0, 3.0] and shapes["patches"][2:] == [10.0, 200.0] and shapes["montage"] == [2.0, 58.0, 512.0] and len(shapes["tokens"]) == 4
    assert shapes["placed"] == "too few channels with a position"  # three, of four needed
    assert {r.status for r in engine.table("evidence").filter("run_id = 'd' AND model_id = 'placed'").collect()} == {"failed"}


def test_create_command(spark, tmp_path, capsys):
    (tmp_path / "a.fif").write_text("x")
    (tmp_path / "b.zarr").mkdir()
    (tmp_path / "b.zarr/0").write_text("y")
    base = [f"{tmp_path}/s", "create", f"{tmp_path}/p", "--pattern-id", "Pattern 3", "--event-family", "Gusto", "--target-label", "x", "--discovery-mode", "hand", "--source-model", "m", "--band", "alpha"]
    both = ["--artifact", f"one|Best Epoch|processed_epoch|FIF|{tmp_path}/a.fif|the first", "--artifact", f"two|grid|embedding|zarr|{tmp_path}/b.zarr"]
    assert cli.main([*base, *both]) == 0
    folder = capsys.readouterr().out.strip()
    assert folder.endswith("/p/patterns/gusto/all_sexes/all_modalities/pattern_3")
    manifest = packages.load(spark, folder)
    assert [a["path"] for a in manifest["artifacts"]] == ["signals/processed/best_epoch.fif", "derived/grid"]
    assert (tmp_path / "p/patterns/gusto/all_sexes/all_modalities/pattern_3/derived/grid/0").read_text() == "y"
    assert cli.main([f"{tmp_path}/s", "validate-package", folder]) == 0 and cli.main([f"{tmp_path}/s", "inspect-package", folder]) == 0
    assert "signal_artifacts: 1" in capsys.readouterr().out
    assert cli.main([*base, *both]) == 1 and cli.main([*base, *both, "--overwrite"]) == 0  # exists
    assert cli.main([*base, "--artifact", "a|b|c"]) == 1 and cli.main([*base, "--artifact", f"a|b|c|md|{tmp_path}/none", "--overwrite"]) == 1
    assert cli.main([*base, "--artifact", f"a|b|report|md|{tmp_path}/a.fif", "--overwrite"]) == 1  # no signal


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({"pattern_id": ""}, "no pattern_id"), ({"partition": {"target_label": "x"}}, "no partition.event_family"), ({"partition": {"sensory_domain": "f"}}, "no partition.target_label"), ({"analysis": {"discovery_mode": "d"}}, "no analysis.source_models"),
        ({"summary": {"cross_subject_support": 1.5}}, "summary.cross_subject_support is not from 0 to 1"), ({"artifacts": []}, "no artifacts"), ({"artifacts": [{"representation": "report"}]}, "no signal artifact"),
        ({"artifacts": [{"path": "/abs"}]}, "absolute path"), ({"artifacts": [{"format": "exe"}]}, "unknown format"), ({"artifacts": [{}, {}]}, "artifact_id 'i' comes more than once"),
    ],
)
def test_manifest_faults(change, fault):
    one = {"artifact_id": "i", "role": "r", "representation": "raw_eeg", "format": "npz", "path": "signals/raw/r.npz"}
    manifest = {"pattern_id": "p", "partition": {"event_family": "f", "target_label": "x"}, "analysis": {"discovery_mode": "d", "source_models": ["m"]}, "summary": {}, "artifacts": [one]}
    assert packages.manifest_faults(manifest) == []
    change = {k: [one | a for a in v] if k == "artifacts" else v for k, v in change.items()}
    assert any(fault in f for f in packages.manifest_faults(manifest | change))


def test_recording_codes(spark, store):
    engine, _, root = store
    assert engine.validate_recordings().count() == 0
    row = engine.table("recordings").filter("recording_id = 'rec1'").drop("ingest_id").first().asDict()
    rows = [row | {"recording_id": ""}, row | {"recording_id": "x", "n_samples": 0}, row | {"recording_id": "y", "channel_names": ["a b", "a b", ""]}, row | {"recording_id": "z", "source_path": "/none", "provenance": {}}, row | {"recording_id": "w", "source_path": "/d/sub-1/sub-1_eeg.edf"}]
    df = spark.createDataFrame(rows, engine.table("recordings").drop("ingest_id").schema)
    known = spark.createDataFrame([(row["source_path"],), ("/d/sub-1/sub-1_eeg.edf",), ("/d/sub-1/sub-1_events.tsv",)], "path string")
    found = checks.recording_report(df, known).collect()
    assert sorted((r.level, r.code, r.location) for r in found) == sorted(
        [("error", "recording.invalid", ""), ("error", "recording.invalid", "x"), ("error", "recording.channels", "y"), ("error", "recording.channels", "y"), ("warning", "recording.channels", "y"),
         ("warning", "recording.provenance_missing", "z"), ("error", "recording.source_missing", "z"), *[("warning", "recording.bids_sidecar_missing", "w")] * 2]
    )


def test_collection_codes(spark, store):
    engine, _, _ = store
    assert engine.validate_collection("c").count() == 0 and engine.validate_branch("c", "comparison_safe").count() == 0
    assert codes(engine.validate_branch("c", "light_clean")) == ["preprocess.output_missing"]
    assert "epochs.empty" in codes(engine.validate_collection("none"))
    src = engine.table("epochs").filter("collection_id = 'c' AND branch_name = 'source_epoch'")
    one = src.filter("recording_id = 'rec1' AND target_label = 'a'").limit(1).select("event_id").first()[0]
    F = __import__("pyspark.sql.functions", fromlist=["x"])
    mine = (F.col("recording_id") == "rec1") & (F.col("event_id") == one) & (F.col("phase") == "onset")
    broken = src.filter(~(mine & (F.col("channel") == "F4"))).withColumn("samples", F.when((F.col("recording_id") == "rec2") & (F.col("phase") == "offset"), F.array().cast("array<float>")).otherwise(F.col("samples")))
    broken = broken.withColumn("sampling_rate_hz", F.when((F.col("recording_id") == "rec3") & (F.col("phase") == "onset"), 99.0).when((F.col("recording_id") == "rec3") & (F.col("phase") == "offset"), 0.0).otherwise(F.col("sampling_rate_hz")))
    broken = broken.unionByName(broken.filter("recording_id = 'rec2' AND phase = 'onset' AND channel = 'F3'")).withColumn("channel", F.when(F.col("channel") == "C3", "C 3").otherwise(F.col("channel")))
    rec = engine.table("recordings").filter("recording_id <> 'rec2'")
    ev = engine.table("events").unionByName(engine.table("events").limit(1).withColumn("event_id", F.lit("lost")))
    got = codes(checks.collection_report(broken, rec, ev, "c"))
    assert got == ["epochs.channels", "epochs.duplicate_event", "epochs.invalid", "epochs.missing_signal", "epochs.phase_shape", "epochs.recording_mismatch", "epochs.signal_contract"]


def test_candidate_codes(spark):
    cand = spark.createDataFrame([("", "", 1, 1, "", "unstable"), ("p", "x", 3, 3, "r", None)], "pattern_id string, target_label string, n_subjects int, n_events int, run_id string, tier string")
    there = spark.createDataFrame([("p", a) for a in checks.REQUIRED_ARTIFACTS], "pattern_id string, artifact string")
    embedded = spark.createDataFrame([("p", "m", False), ("p", "n", True)], "pattern_id string, model_id string, used boolean")
    found = checks.candidate_report(cand, there, spark.createDataFrame([("error", "candidate.signal_contract", "p", "x")], FINDING), embedded)
    assert codes(found) == sorted(f"candidate.{c}" for c in ("pattern_id", "target_label", "subject_support", "event_support", "run_id_missing", "reliability_missing", "low_confidence", "artifact_missing", "topography_missing", "backbone_artifact_missing", "signal_contract"))


def test_branch_commands(store):
    engine, _, _ = store
    for branch, why in ((Branch("source_epoch"), "overwrite"), (Branch("x", align_channels=("a", "a")), "repeat")):
        with pytest.raises(EngineError, match=why):
            engine.preprocess(branch, "c")
    with pytest.raises(EngineError, match="no collection"):
        engine.preprocess(Branch("x"), "nothing")


def test_lineage_of_any_depth(spark):
    chain = spark.range(150).selectExpr("concat('n', id) AS child", "concat('n', id + 1) AS parent")
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in checks.lineage_closure(chain.filter("child IN ('n0', 'n1', 'n2', 'n3')").unionByName(loop)).collect()}
    assert got["n0", "n4"] == 4 and got["x", "x"] == 2 and len(got) == 10 + 4


def test_report_lines():
    lines = report_lines("run", "r", [("warning", "run.status", "r", "status partial"), ("error", "run.path_missing", "", "no x")], {"findings": 2})
    assert lines == ["artifact_type: run", "target: r", "ok: no", "summary:", "  findings: 2", "errors:", "  - [run.path_missing] no x", "warnings:", "  - [run.status] status partial (r)"]
