"""Where packages and their artifacts go, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ColumnLike, _col, slugify

#: Folders of a package by representation; all others go to the last one.
PLACES = {
    "raw_eeg": "signals/raw", "processed_epoch": "signals/processed", "time_frequency": "derived", "topography": "derived", "connectivity": "derived",
    "embedding": "derived", "report": "reports", "figure": "reports",
}
OTHER_PLACE = "support"
#: Representations that count as signals, and formats that are understood.
SIGNALS = ("raw_eeg", "processed_epoch")
FORMATS = ("bdf", "csv", "edf", "fif", "hdf5", "json", "jsonl", "md", "npy", "npz", "parquet", "png", "tsv", "zarr")
#: The parts of a package's path, and what stands for an empty one.
PARTS = (("event_family", "unspecified_event_family"), ("biological_sex", "all_sexes"), ("stimulus_modality", "all_modalities"))


def package_path(pattern_id: ColumnLike, **parts: ColumnLike) -> Column:
    """patterns/FAMILY/SEX/MODALITY/PATTERN."""
    steps = [slugify(F.coalesce(_col(parts[name]) if name in parts else F.lit(""), F.lit("")), none) for name, none in PARTS]
    return F.concat_ws("/", F.lit("patterns"), *steps, slugify(pattern_id))


def artifact_path(role: ColumnLike, representation: ColumnLike, fmt: ColumnLike, folder: ColumnLike) -> Column:
    """The place of an artifact in its package; folders have no suffix."""
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), _col(representation)), F.lit(OTHER_PLACE))
    suffix = F.lower(_col(fmt))
    name = F.when(F.coalesce(_col(folder), F.lit(False)) | (suffix == "zarr"), slugify(role)).otherwise(F.concat_ws(".", slugify(role), suffix))
    return F.concat_ws("/", place, name)
