"""Registry of model adapters: what each needs, whether it can run here, and
loading it.

A model goes to the executors as a handle: where its files are, which variant
and device, and a stamp of the files. A worker process makes the model when it
first calls the handle and keeps it; weights are never part of a task.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import os
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession

from ..operators.backbone import Model
from ..sources import files
from ..sources.recording_source import opened


class ModelLoadError(RuntimeError):
    """A model that can't be loaded here."""


#: Models that this process has made, by handle.
_MADE: dict[Handle, Callable] = {}
#: Folders that this process has fetched, by folder and stamp.
_FETCHED: dict[tuple[str, str], str] = {}


@dataclass(frozen=True)
class Handle:
    """A model to be made where it is called. names: its files below ``root``;
    stamp: of their sizes and times, so that changed files make a new model."""

    model_id: str
    make: Callable | str = field(compare=False)  # another object after each task's unpickling
    root: str
    names: tuple[str, ...]
    variant: str
    device: str
    imports: str
    stamp: str

    def folder(self) -> str:
        """The files' folder on this machine: as it is if it can be opened here,
        else fetched once by the process."""
        system, at = opened(self.root)
        if os.path.isdir(at) and type(system).__name__ == "LocalFileSystem":
            return at
        if (self.root, self.stamp) not in _FETCHED:
            place = tempfile.mkdtemp(prefix="epochloom-model-")  # this process's own copy of small and large weights alike
            for name in self.names:
                os.makedirs(os.path.dirname(f"{place}/{name}"), exist_ok=True)
                with system.open_input_stream(f"{at}/{name}") as source, open(f"{place}/{name}", "wb") as target:
                    while piece := source.read(16 << 20):
                        target.write(piece)
            _FETCHED[self.root, self.stamp] = place
        return _FETCHED[self.root, self.stamp]

    def made(self) -> Callable:
        if self not in _MADE:
            folder, make = self.folder(), self.make
            if isinstance(make, str):
                module, name = make.split(":")
                place = f"{folder}/{self.imports}".rstrip("/")
                sys.path.insert(0, place)
                try:
                    make = getattr(importlib.import_module(module), name)
                except (ImportError, AttributeError) as fault:
                    raise ModelLoadError(f"{self.model_id}: {fault}") from fault
                finally:
                    sys.path.remove(place)
            _MADE[self] = make(folder, self.variant, self.device)
        return _MADE[self]

    def __call__(self, *args):
        return self.made()(*args)


@dataclass(frozen=True)
class Adapter:
    """A model family: its packages and weight files, its variants and contracts.

    folder: where its files are below the models' root; common: files that all
    variants need; variants: their own files; input: the known input it takes.
    make(root, variant, device) gives the function that embeds; it is a callable
    or the name "module:function" of one that is imported from ``imports``
    (below the folder) or the installed packages. It is called by workers.
    """

    model_id: str
    packages: tuple[str, ...] = ()
    variants: dict[str, tuple[str, ...]] = field(default_factory=dict)
    default: str = "base"
    input_contract: str = ""
    output_contract: str = ""
    folder: str = ""
    common: tuple[str, ...] = ()
    imports: str = ""
    input: str = ""
    batched: bool = True
    make: Callable | str | None = None

    def at(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.folder or self.model_id}"

    def missing_packages(self) -> list[str]:
        return [p for p in self.packages if importlib.util.find_spec(p) is None]

    def missing_assets(self, spark: SparkSession, root: str, variant: str = "") -> list[str]:
        return [a for a in (*self.common, *self.variants.get(variant or self.default, ())) if not files.exists(spark, f"{self.at(root)}/{a}")]

    def load(self, spark: SparkSession, root: str, variant: str = "", device: str = "cpu") -> Model:
        """The model as a handle that workers make the function of. One task
        makes it first, so that a model that can't be made is known here."""
        variant = variant or self.default
        if self.variants and variant not in self.variants:
            raise ModelLoadError(f"{self.model_id} has no variant {variant!r}, but {', '.join(self.variants)}")
        if lost := self.missing_packages():
            raise ModelLoadError(f"{self.model_id} needs the packages {', '.join(lost)}")
        if lost := self.missing_assets(spark, root, variant):
            raise ModelLoadError(f"{self.model_id} ({variant}) needs the files {', '.join(f'{self.at(root)}/{a}' for a in lost)}")
        if self.make is None:
            raise ModelLoadError(f"{self.model_id} has no function that makes it; give its adapter one (make)")
        names = (*self.common, *self.variants.get(variant, ()))
        stamp = hashlib.sha256(repr([files.stamp(spark, f"{self.at(root)}/{n}") for n in names]).encode()).hexdigest()
        handle = Handle(self.model_id, self.make, self.at(root), names, variant, device, self.imports, stamp)

        def attempt(batches):
            for batch in batches:
                said = batch[["id"]].astype({"id": "string"}).assign(id=None)
                try:
                    handle.made()
                except Exception as fault:  # whatever the model's own code raises
                    said["id"] = f"{type(fault).__name__}: {fault}"
                yield said

        try:
            fault = spark.range(1, numPartitions=1).mapInPandas(attempt, "id string").first()[0]
        except PythonException as lost:  # the function itself can't be had by workers
            raise ModelLoadError(f"{self.model_id} ({variant}): {str(lost).strip().splitlines()[-1]}") from lost
        if fault:
            raise ModelLoadError(f"{self.model_id} ({variant}): {fault}")
        return Model(self.model_id, handle, batched=self.batched, input=self.input)


_WEIGHTS = "pretrained_weights/pretrained_weights.pth"
#: Model ids with what they take, their variants and files as their makers name them.
ADAPTERS = (
    Adapter("biot", ("torch", "numpy", "linear_attention_transformer", "einops"), {
        "prest_16ch": ("pretrained-models/EEG-PREST-16-channels.ckpt",),
        "shhs_prest_18ch": ("pretrained-models/EEG-SHHS+PREST-18-channels.ckpt",),
        "six_datasets_18ch": ("pretrained-models/EEG-six-datasets-18-channels.ckpt",),
    }, "six_datasets_18ch", "N x 18 x 2000", "N x 256", "BIOT", input="biot"),
    Adapter("brainomni", ("torch", "einops", "einx", "vector_quantize_pytorch", "deepspeed"), {
        "tiny": ("ckpt_collection/tiny/BrainOmni.pt", "ckpt_collection/tiny/model_cfg.json"),
        "base": ("ckpt_collection/base/BrainOmni.pt", "ckpt_collection/base/model_cfg.json"),
    }, "tiny", "N x C x T with sensor positions", "token embeddings", "BrainOmni", ("ckpt_collection/braintokenizer/BrainTokenizer.pt", "ckpt_collection/braintokenizer/model_cfg.json"), input="brainomni"),
    Adapter("cbramod", ("torch", "einops"), {"foundation": (_WEIGHTS,)}, "foundation", "N x C x 10 x 200", "patch embeddings", "CBraMod", input="cbramod"),
    Adapter("eegmamba", ("torch", "einops", "mamba_ssm"), {"foundation": (_WEIGHTS,)}, "foundation", "N x C x patches x 200", "patch embeddings", "EEGMamba", input="cbramod"),
    Adapter("eegpt", ("torch", "numpy"), {"large_mixed_58ch_4s": ("checkpoint/eegpt_mcae_58chs_4s_large4E.ckpt",)}, "large_mixed_58ch_4s", "N x 58 x 512, named montage", "token embeddings", "EEGPT", imports="downstream", input="eegpt"),
)


class Registry:
    def __init__(self, adapters: tuple[Adapter, ...] = ADAPTERS):
        self._by_id = {a.model_id: a for a in sorted(adapters, key=lambda a: a.model_id)}

    def ids(self) -> list[str]:
        return list(self._by_id)

    def get(self, model_id: str) -> Adapter:
        known = model_id.strip().lower()
        if known not in self._by_id:
            raise KeyError(f"unknown model {model_id!r}; known: {', '.join(self._by_id)}")
        return self._by_id[known]

    def load(self, spark: SparkSession, root: str, model_id: str, variant: str = "", device: str = "cpu") -> Model:
        return self.get(model_id).load(spark, root, variant, device)

    def statuses(self, spark: SparkSession, root: str) -> DataFrame:
        """model_id, default, runnable (its default variant), what is missing,
        and the variants whose files are there."""
        rows = []
        for a in self._by_id.values():
            packages, assets = a.missing_packages(), a.missing_assets(spark, root)
            ready = [v for v in a.variants if not a.missing_assets(spark, root, v)]
            rows.append((a.model_id, a.default, not packages and not assets, packages, assets, ready))
        return spark.createDataFrame(rows, "model_id string, default string, runnable boolean, missing_packages array<string>, missing_assets array<string>, ready_variants array<string>")
