"""Commands: ``python -m epochloom.cli STORE COMMAND ...``; 0 ok, 1 a handled
failure, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from .operators.epochs import Baseline, Windows
from .operators.preprocess import Branch
from .plans import packages
from .plans.engine import SOURCE_BRANCH, Engine, EngineError, report_lines
from .plans.models import ModelLoadError, Registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epochloom")
    p.add_argument("store")
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("ingest")
    x.add_argument("source")
    for o in ("event-table", "recording-id", "subject-id", "session-id", "label-namespace", "cohort-label", "run"):
        x.add_argument(f"--{o}", default="")
    x.add_argument("--overwrite", action="store_true")
    x = c.add_parser("epoch")
    for o in ("pre-event", "onset", "offset", "post-event"):
        x.add_argument(f"--{o}", type=float, default=1.0)
    for o in ("sustained", "baseline-start", "baseline-end"):
        x.add_argument(f"--{o}", type=float)
    x.add_argument("--ingest-id")
    x.add_argument("--collection-id", default="")
    x.add_argument("--overwrite", action="store_true")
    x = c.add_parser("preprocess")
    x.add_argument("collection")
    x.add_argument("branch", choices=["raw_preserving", "light_clean", "comparison_safe"])
    x.add_argument("--notch", type=float, action="append", default=[])
    x.add_argument("--notch-bandwidth", type=float, default=2.0)
    x.add_argument("--resample", type=float)
    x.add_argument("--baseline", default="none")
    x.add_argument("--target-channel", action="append", default=[])
    x.add_argument("--target-channels-file")
    x.add_argument("--rereference", default="none")
    x.add_argument("--reference-channel", action="append", default=[])
    x.add_argument("--scale", type=float)
    x.add_argument("--overwrite", action="store_true")
    for command in ("discover", "discover-ensemble"):
        x = c.add_parser(command)
        x.add_argument("--run", "--run-id", default="")
        for o in ("collection", "target-label"):
            x.add_argument(f"--{o}", action="append", default=[])
        x.add_argument("--branch", "--branch-filter", action="append", default=[])
        x.add_argument("--collection-list")
        for o, d in (("min-subjects", 2), ("max-exemplars", 6), ("seed", 0), ("null-iterations", 64), ("subsample-iterations", 32)):
            x.add_argument(f"--{o}", type=int, default=d)
        _backbones(x)
    x = c.add_parser("backbone-evaluate")
    x.add_argument("run")
    _backbones(x)
    x = c.add_parser("package")
    x.add_argument("run")
    x.add_argument("root")
    x.add_argument("--overwrite", action="store_true")
    x = c.add_parser("create")
    x.add_argument("root")
    x.add_argument("--pattern-id", required=True)
    for o in ("event-family", "target-label"):
        x.add_argument(f"--{o}", required=True)
    for o in ("event-subtype", "label-namespace", "biological-sex", "gender-identity", "stimulus-modality", "age-band", "cohort-label", "candidate-signature", "temporal-notes", "notes"):
        x.add_argument(f"--{o}", default="")
    x.add_argument("--discovery-mode", required=True)
    for o, needed in (("study-id", False), ("source-model", True), ("band", False), ("channel", False), ("artifact", True)):
        x.add_argument(f"--{o}", action="append", default=[], required=needed)
    x.add_argument("--overwrite", action="store_true")
    x = c.add_parser("validate")
    x.add_argument("kind", choices=VALIDATED)
    x.add_argument("key", nargs="?", default="")
    x.add_argument("--root", default="")
    x.add_argument("--branch", default="")
    x.add_argument("--min-subjects", type=int, default=2)
    x.add_argument("--collection", action="append", default=[])
    x.add_argument("--collection-list")
    x.add_argument("--json", action="store_true")
    x = c.add_parser("inspect")
    x.add_argument("kind", choices=["collection", "run", "candidate", "package"])
    x.add_argument("key")
    x.add_argument("--json", action="store_true")
    x = c.add_parser("models")
    x.add_argument("action", choices=["list", "show", "check", "probe"])
    x.add_argument("model", nargs="?", default="")
    x.add_argument("--variant", default="")
    x.add_argument("--device", default="cpu")
    x.add_argument("--models-root", default="")
    return p


#: The models that commands know; replace it to add some.
REGISTRY = Registry()
VALIDATED = ["events", "recordings", "collection", "branch", "study", "run", "package"]


def _backbones(x: argparse.ArgumentParser) -> None:
    x.add_argument("--backbone", action="append", default=[])
    x.add_argument("--device", default="cpu")
    x.add_argument("--models-root", default="")
    x.add_argument("--package-root", default="")
    x.add_argument("--overwrite", action="store_true")


def _aliases(argv: list[str]) -> list[str]:
    """validate-KIND and inspect-KIND as commands of their own."""
    out = list(argv)
    for i, word in enumerate(out):
        command, _, kind = word.partition("-")
        if i <= 1 and command in ("validate", "inspect") and kind:
            out[i : i + 1] = [command, kind]
            break
    return out


def _lines(path: str | None) -> list[str]:
    if not path:
        return []
    with open(path) as f:
        return [line.strip() for line in f if line.strip()]


def _print(df) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def _validated(engine: Engine, a: argparse.Namespace) -> int:
    collections = a.collection + _lines(a.collection_list)
    found = {
        "events": lambda: engine.validate_events(a.key or None), "recordings": lambda: engine.validate_recordings(a.key or None), "collection": lambda: engine.validate_collection(a.key, a.branch or SOURCE_BRANCH),
        "branch": lambda: engine.validate_branch(a.key, a.branch), "study": lambda: engine.validate_study(engine.observations(collections=collections), a.min_subjects), "run": lambda: engine.validate_run(a.key),
        "package": lambda: engine.validate_package(a.root or a.key, a.key if a.root else ""),
    }[a.kind]()
    if a.json:
        _print(found)
        return int(found.filter("level = 'error'").limit(1).count() > 0)
    rows = [tuple(r) for r in found.select("level", "code", "location", "message").toLocalIterator()]
    kept = {k: getattr(a, k) for k in ("branch", "root") if getattr(a, k)}
    print("\n".join(report_lines(a.kind, a.key, rows, kept | {"findings": len(rows)})))
    return int(any(r[0] == "error" for r in rows))


def _discovered(engine: Engine, a: argparse.Namespace) -> int:
    if a.command == "discover-ensemble" and not a.backbone:
        raise EngineError("name a backbone at least")
    run = engine.discover(a.run, a.target_label, a.branch, a.collection + _lines(a.collection_list), a.min_subjects, a.max_exemplars, a.seed, a.null_iterations, a.subsample_iterations, a.overwrite)
    print(run)
    if a.command == "discover-ensemble":
        engine.evaluate_backbones(run, a.backbone, REGISTRY, a.models_root, a.device)
    if a.package_root:
        _print(engine.package(run, a.package_root, a.overwrite).select("pattern_id", "path"))
    return 0


def _created(engine: Engine, a: argparse.Namespace) -> int:
    part = packages.Partition(a.event_family, a.target_label, a.event_subtype, a.label_namespace, a.biological_sex, a.gender_identity, a.stimulus_modality, a.age_band, a.cohort_label, tuple(a.study_id))
    summary = packages.Summary(a.candidate_signature, tuple(a.band), tuple(a.channel), a.temporal_notes)
    analysis = packages.Analysis(a.discovery_mode, tuple(a.source_model), a.notes)
    print(packages.Builder(engine.spark, a.root).create(a.pattern_id, part, analysis, summary, map(packages.parse_artifact, a.artifact), a.overwrite))
    return 0


def _models(engine: Engine, a: argparse.Namespace) -> int:
    root = a.models_root or engine.path("models")
    if a.action == "list":
        for r in REGISTRY.statuses(engine.spark, root).orderBy("model_id").collect():
            print(f"{r.model_id:<10} runnable={'yes' if r.runnable else 'no'} default={r.default}")
    elif a.action == "show":
        print(json.dumps(REGISTRY.get(a.model).__dict__, default=str))
    elif a.action == "probe":
        loaded = REGISTRY.load(engine.spark, root, a.model, a.variant, a.device)
        print(f"loaded: {loaded.model_id}\ndevice: {a.device}")
    else:
        state = REGISTRY.statuses(engine.spark, root)
        state = state.filter(state.model_id == REGISTRY.get(a.model).model_id) if a.model else state
        _print(state)
        return int(state.filter("NOT runnable").limit(1).count() > 0)
    return 0


def run(engine: Engine, a: argparse.Namespace) -> int:
    if a.command == "ingest":
        print(engine.ingest(a.source, a.event_table or None, a.recording_id, a.subject_id, a.session_id, a.label_namespace, a.cohort_label, a.run, a.overwrite))
    elif a.command == "epoch":
        if (a.baseline_start is None) != (a.baseline_end is None):
            raise EngineError("give both ends of the baseline or neither")
        base = None if a.baseline_start is None else Baseline(a.baseline_start, a.baseline_end)
        print(engine.epoch(Windows(a.pre_event, a.onset, a.offset, a.post_event, a.sustained, base), a.ingest_id, a.collection_id, a.overwrite))
    elif a.command == "preprocess":
        targets = tuple(a.target_channel + _lines(a.target_channels_file))
        branch = Branch(a.branch, tuple(a.notch), a.notch_bandwidth, a.resample, a.baseline, targets, a.rereference, tuple(a.reference_channel), a.scale)
        print(engine.preprocess(branch, a.collection, a.overwrite))
    elif a.command in ("discover", "discover-ensemble"):
        return _discovered(engine, a)
    elif a.command == "backbone-evaluate":
        if not a.backbone:
            raise EngineError("name a backbone at least")
        _print(engine.evaluate_backbones(a.run, a.backbone, REGISTRY, a.models_root, a.device))
        if a.package_root:
            _print(engine.package(a.run, a.package_root, a.overwrite).select("pattern_id", "path"))
    elif a.command == "package":
        _print(engine.package(a.run, a.root, a.overwrite))
    elif a.command == "create":
        return _created(engine, a)
    elif a.command == "validate":
        return _validated(engine, a)
    elif a.command == "inspect":
        found = engine.inspect(a.kind, a.key)
        if a.json:
            _print(found)
        else:
            for r in found.toLocalIterator():
                print("\n".join(f"{k}: {v}" for k, v in sorted(r.asDict().items())))
    elif a.command == "models":
        return _models(engine, a)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(_aliases(sys.argv[1:] if argv is None else argv))
    from pyspark.sql import SparkSession

    try:
        return run(Engine(SparkSession.builder.appName("epochloom").getOrCreate(), a.store), a)
    except (EngineError, ModelLoadError, ValueError, KeyError) as fault:
        print(fault, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
