"""Recordings: NPZ, EDF, BDF and FIF files as two tables.

recordings: recording_id, subject_id, session_id, label_namespace,
cohort_label, source_path, source_format, channel_names, sampling_rate_hz,
n_samples, duration_seconds, provenance and metadata (maps), message (why a
file couldn't be read, else null). Made from the headers of the files alone.
signals: recording_id, channel_idx, channel, chunk_id, samples.

Files are read by the data source of ``recording_source``, in ranges. Only two
kinds are still read whole, one file a row of 2 GB at most: FIF (by ``mne``), and
files in a store that Spark alone can open.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import null_nan
from .files import is_folder
from .recording_source import CHUNK, RANGE_BYTES, RECORDING, SIGNAL, Range, Reader, RecordingError, RecordingSource, reachable, recording_id_of, slug

__all__ = ["CHUNK", "RECORDING", "SIGNAL", "RecordingError", "named", "read_recordings", "read_signals", "recording_id_of", "slug"]


def _mne(path: str, content: bytes, whole: bool) -> tuple[dict, np.ndarray | None]:
    """A FIF file, if ``mne`` is installed on the executors; without ``whole``
    only the header is read."""
    try:
        import mne
    except ImportError as missing:
        raise RecordingError("reading FIF needs the optional package mne") from missing
    with tempfile.TemporaryDirectory() as folder:  # the reader wants a file; it is gone with the call
        local = os.path.join(folder, os.path.basename(path))
        with open(local, "wb") as f:
            f.write(content)
        raw = mne.io.read_raw_fif(local, preload=whole, verbose="ERROR")
        try:
            data = raw.get_data().astype(np.float32) if whole else None
            rate, n = float(raw.info["sfreq"]), int(raw.n_times)
            fields = {"channel_names": list(raw.ch_names), "sampling_rate_hz": rate, "n_samples": n, "duration_seconds": n / rate, "metadata": {"measurement_date": str(raw.info.get("meas_date") or "")}}
        finally:
            raw.close()
    return fields, data


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fif_row(p: Range, content: bytes, reader: Reader) -> tuple:
    row = dict(zip(_names(RECORDING), reader.row(p, pa.BufferReader(b""))))
    try:
        found, _ = _mne(p.path, content, False)
    except (RecordingError, ValueError, OSError) as fault:
        return tuple((row | {"message": str(fault)}).values())
    return tuple((row | found | {"message": None, "provenance": row["provenance"] | {"loader_id": "mne"}}).values())


def _fif_rows(p: Range, content: bytes, chunk: int):
    try:
        found, data = _mne(p.path, content, True)
    except (RecordingError, ValueError, OSError):
        return
    for k, name in enumerate(found["channel_names"]):
        for at in range(0, max(1, data.shape[1]), chunk):
            yield recording_id_of(p.path), k, name, at // chunk, data[k, at : at + chunk]


def _whole(spark: SparkSession, paths: list[str], table: str, chunk: int, only: str | None = None) -> DataFrame:
    """Files read by Spark as a whole; only: a pattern of their names."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", only or "*").load(paths).select("path", "modificationTime", "length", "content")
    schema = RECORDING if table == "recordings" else SIGNAL
    names = _names(schema)

    def run(batches):
        reader = Reader({"paths": "[]", "chunk": str(chunk)})
        for b in batches:
            for path, at, size, content in zip(b["path"], b["modificationTime"], b["length"], b["content"]):
                p, fif = Range(path, size, at.timestamp()), path.lower().endswith(".fif")
                if table == "recordings":
                    yield pd.DataFrame([_fif_row(p, content, reader) if fif else reader.row(p, pa.BufferReader(content))], columns=names)
                elif fif:
                    for row in _fif_rows(p, content, chunk):
                        yield pd.DataFrame([row], columns=names)
                else:
                    for batch in reader.signals(p, pa.BufferReader(content)):
                        yield batch.to_pandas()

    out = raw.mapInPandas(run, schema)
    return out.withColumn("samples", null_nan("samples")) if table == "signals" else out


def _read(spark: SparkSession, paths: list[str] | str, table: str, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not all(map(reachable, paths)):
        return _whole(spark, paths, table, chunk)
    whole = [p for p in paths if p.lower().endswith(".fif")]
    ranged = [p for p in paths if p not in whole]
    folders = [p for p in ranged if is_folder(spark, p)]
    parts = []
    if ranged:
        spark.dataSource.register(RecordingSource)
        push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
        options = {"paths": json.dumps(ranged), "table": table, "chunk": str(chunk), "range_bytes": str(range_bytes), "pushdown": push}
        parts.append(spark.read.format("recordings").options(**options).load())
    if whole or folders:
        parts.append(_whole(spark, whole + folders, table, chunk, "*.[fF][iI][fF]"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_recordings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The recordings table of files or folders; a bad file is a row with a message."""
    return _read(spark, paths, "recordings")


def read_signals(spark: SparkSession, paths: list[str] | str, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The signals table: channels in chunks, so that no row grows with the
    length of a recording. A file is read by as many tasks as it has ranges.
    Where the session pushes filters to Python sources, those on recording_id,
    channel and channel_idx choose what is read."""
    return _read(spark, paths, "signals", chunk, range_bytes)


def named(recordings: DataFrame, **given: str) -> DataFrame:
    """Ids given by the caller win over those in the file; a subject without an
    id is its recording."""
    out = recordings
    for k, v in given.items():
        if v:
            out = out.withColumn(k, F.lit(v))
    return out.withColumn("subject_id", F.coalesce(F.nullif(F.trim("subject_id"), F.lit("")), "recording_id"))
