"""Packages of patterns: made from artifacts that exist, and checked.

A package is a folder with its artifacts, ``manifest.json`` and ``report.md``.
Paths are made by the column expressions of ``functions.paths``; files are
copied by Hadoop's file systems, so any store works on either side.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import files

SCHEMA_VERSION = "1.1"
#: What older manifests call the parts of a partition.
OLDER_NAMES = {"sensory_domain": "event_family", "condition_label": "target_label", "arousal_type": "event_subtype"}
#: Scores of a summary, each from 0 to 1.
SCORES = ("reproducibility_score", "cross_model_support", "cross_subject_support")
#: Roles of the files of a run's bundle.
BUNDLE_ROLES = {"manifest.json": "run_manifest", "config.json": "config_snapshot", "environment.json": "environment", "lineage.json": "artifact_lineage", "warnings.json": "warnings", "log.jsonl": "run_log"}


class PackageError(ValueError):
    """A package that can't be made as asked."""


@dataclass(frozen=True)
class Partition:
    event_family: str = ""
    target_label: str = ""
    event_subtype: str = ""
    label_namespace: str = ""
    biological_sex: str = ""
    gender_identity: str = ""
    stimulus_modality: str = ""
    age_band: str = ""
    cohort_label: str = ""
    study_ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class Analysis:
    discovery_mode: str
    source_models: tuple[str, ...]
    notes: str = ""
    created_at_utc: str = field(default_factory=lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))


@dataclass(frozen=True)
class Summary:
    candidate_signature: str = ""
    bands: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    temporal_notes: str = ""
    reproducibility_score: float | None = None
    cross_model_support: float | None = None
    cross_subject_support: float | None = None
    artifact_risk: str = ""


@dataclass(frozen=True)
class Artifact:
    artifact_id: str
    role: str
    representation: str
    format: str
    source: str
    description: str = ""


def parse_artifact(text: str) -> Artifact:
    """An artifact written as id|role|representation|format|source|description,
    the last of which may be left out."""
    parts = [p.strip() for p in text.split("|")]
    if len(parts) < 5:
        raise ValueError(f"an artifact has five parts or more, apart by |: {text!r}")
    return Artifact(*parts[:6])


def manifest_faults(manifest: dict) -> list[str]:
    """What is wrong with a manifest."""
    partition = {OLDER_NAMES.get(k, k): v for k, v in manifest.get("partition", {}).items()}
    analysis, summary, artifacts = manifest.get("analysis", {}), manifest.get("summary", {}), manifest.get("artifacts", [])
    faults = [] if manifest.get("pattern_id") else ["no pattern_id"]
    faults += [f"no partition.{k}" for k in ("event_family", "target_label") if not partition.get(k)]
    faults += [f"no analysis.{k}" for k in ("discovery_mode", "source_models") if not analysis.get(k)]
    faults += [f"summary.{k} is not from 0 to 1" for k in SCORES if summary.get(k) is not None and not 0 <= summary[k] <= 1]
    if not artifacts:
        faults.append("no artifacts")
    for a in artifacts:
        named = a.get("artifact_id", "")
        faults += [f"artifact {named!r} has no {k}" for k in ("artifact_id", "role", "representation", "format", "path") if not a.get(k)]
        if str(a.get("path", "")).startswith("/"):
            faults.append(f"artifact {named!r} has an absolute path")
        if a.get("format") and a["format"].lower() not in paths.FORMATS:
            faults.append(f"artifact {named!r} has the unknown format {a['format']!r}")
    for key in ("artifact_id", "path"):
        seen = [a.get(key) for a in artifacts]
        faults += [f"{key} {v!r} comes more than once" for v in sorted({v for v in seen if v and seen.count(v) > 1})]
    if not any(a.get("representation") in paths.SIGNALS for a in artifacts):
        faults.append("no signal artifact")
    return faults


def report_text(manifest: dict) -> str:
    """The readable side of a manifest."""
    part, said = manifest["partition"], manifest["summary"]
    lines = [f"# Pattern {manifest['pattern_id']}", "", "## Partition", *(f"- {k}: {part.get(k) or 'unspecified'}" for k in ("event_family", "target_label", "event_subtype", "label_namespace", "biological_sex", "gender_identity", "stimulus_modality"))]
    lines += ["", "## Summary", f"- signature: {said.get('candidate_signature') or 'none'}", *(f"- {k}: {', '.join(said.get(k) or ()) or 'none'}" for k in ("bands", "channels")), f"- in time: {said.get('temporal_notes') or 'none'}"]
    lines += ["", "## Models", *(f"- {m}" for m in manifest["analysis"]["source_models"]), "", "## Artifacts", *(f"- {a['artifact_id']} ({a['role']}): {a['path']}" for a in manifest["artifacts"])]
    return "\n".join(lines) + "\n"


class Builder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, pattern_id: str, partition: Partition, analysis: Analysis, summary: Summary, artifacts: Iterable[Artifact], overwrite: bool = False) -> str:
        """The folder of a new package. Nothing is written unless all artifacts
        exist and the manifest is sound."""
        artifacts = list(artifacts)
        lost = [a.source for a in artifacts if not files.exists(self.spark, a.source)]
        if lost:
            raise PackageError(f"no such artifact: {', '.join(lost)}")
        rows = [(i, *(asdict(a)[k] for k in ("artifact_id", "role", "representation", "format", "source", "description")), files.is_folder(self.spark, a.source)) for i, a in enumerate(artifacts)]
        df = self.spark.createDataFrame(rows, "n int, artifact_id string, role string, representation string, format string, source string, description string, folder boolean")
        placed = df.select("artifact_id", "role", "representation", F.lower("format").alias("format"), paths.artifact_path("role", "representation", "format", "folder").alias("path"), "description", "source", "n")
        held = [r.asDict() for r in placed.orderBy("n").collect()]  # the artifacts of one package
        at = self.spark.range(1).select(paths.package_path(F.lit(pattern_id), **{name: F.lit(getattr(partition, name)) for name, _ in paths.PARTS})).first()[0]
        manifest = {"schema_version": SCHEMA_VERSION, "pattern_id": pattern_id, "partition": asdict(partition), "analysis": asdict(analysis), "summary": asdict(summary), "artifacts": [{k: v for k, v in a.items() if k not in ("source", "n")} for a in held]}
        if faults := manifest_faults(manifest):
            raise PackageError("; ".join(faults))
        target = f"{self.root}/{at}"
        if files.exists(self.spark, target):
            if not overwrite:
                raise PackageError(f"{target} exists")
            files.remove(self.spark, target)
        for a in held:
            files.copy(self.spark, a["source"], f"{target}/{a['path']}")
        files.write_text(self.spark, f"{target}/report.md", report_text(manifest))
        files.write_json(self.spark, f"{target}/manifest.json", manifest)
        return target


def load(spark: SparkSession, folder: str) -> dict | None:
    """A package's manifest, or None."""
    at = f"{folder.rstrip('/')}/manifest.json"
    return json.loads(files.read_text(spark, at)) if files.exists(spark, at) else None


def findings(spark: SparkSession, folder: str) -> list[tuple[str, str, str, str]]:
    """(level, code, location, message) of a package's folder."""
    folder = folder.rstrip("/")
    manifest = load(spark, folder)
    if manifest is None:
        return [("error", "package.invalid", folder, "no manifest")]
    artifacts = manifest.get("artifacts", [])
    out = [("error", "package.invalid", folder, m) for m in manifest_faults(manifest)]
    out += [("error", "package.invalid", a["artifact_id"], f"{a['path']} is missing") for a in artifacts if not files.exists(spark, f"{folder}/{a['path']}")]
    if not any(a["representation"] in paths.SIGNALS for a in artifacts):
        out.append(("error", "package.signal_missing", folder, "no artifact is a signal"))
    roles = {a["role"] for a in artifacts}
    return out + [("warning", f"package.{role}_missing", folder, f"no {role} of its run") for role in ("run_manifest", "config_snapshot") if role not in roles]


def summary(spark: SparkSession, folder: str) -> dict:
    manifest = load(spark, folder)
    if manifest is None:
        raise PackageError(f"no manifest in {folder}")
    artifacts = manifest["artifacts"]
    return {
        "pattern_id": manifest["pattern_id"], "event_family": manifest["partition"].get("event_family", ""), "target_label": manifest["partition"].get("target_label", ""), "artifacts": len(artifacts),
        "signal_artifacts": sum(a["representation"] in paths.SIGNALS for a in artifacts), "run_files": sum(a["role"] in BUNDLE_ROLES.values() for a in artifacts),
    }
