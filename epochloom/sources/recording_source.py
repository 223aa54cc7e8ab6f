"""Recordings as a data source of byte ranges: ``spark.read.format("recordings")``.

A file is no single task's work: partitions are ranges of its bytes, and a task
reads the header (a few kilobytes) and the chunks that begin in its range. What
is read: EDF and BDF (16 and 24 bit data records), NPZ members that are stored
as they are; compressed members can't be cut and are streamed by one task,
chunk by chunk. No row is longer than a chunk.

Options: ``paths`` (a JSON list of files or folders), ``table`` (``signals`` or
``recordings``), ``chunk``, ``range_bytes``, ``pushdown`` ("true" where the
session has ``spark.sql.python.filterPushdown.enabled``): equalities on
recording_id, channel and channel_idx then choose files and channels before
anything is read.
"""

from __future__ import annotations

import json
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

RECORDING = (
    "recording_id string, subject_id string, session_id string, label_namespace string, cohort_label string, source_path string, source_format string, "
    "channel_names array<string>, sampling_rate_hz double, n_samples long, duration_seconds double, provenance map<string,string>, metadata map<string,string>, message string"
)
SIGNAL = "recording_id string, channel_idx int, channel string, chunk_id long, samples array<float>"
_SIGNAL = pa.schema([("recording_id", pa.string()), ("channel_idx", pa.int32()), ("channel", pa.string()), ("chunk_id", pa.int64()), ("samples", pa.list_(pa.float32()))])
#: Samples in a stored chunk of a channel, and bytes in a partition's range.
CHUNK = 1 << 16
RANGE_BYTES = 64 << 20
#: Suffixes that are read here, members that an NPZ recording must have, volts in a unit of an EDF header.
SUFFIXES = (".npz", ".edf", ".bdf")
MEMBERS = ("data", "channel_names", "sampling_rate_hz")
VOLTS = {"uv": 1e-6, "µv": 1e-6, "μv": 1e-6, "mv": 1e-3, "nv": 1e-9, "v": 1.0}
#: The fields of an EDF header that stand once, and those of each signal, with their widths.
HEAD = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("header_bytes", 8), ("reserved", 44), ("records", 8), ("seconds", 8), ("signals", 4))
SIGNAL_HEAD = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
ANNOTATIONS = ("EDF Annotations", "BDF Annotations")


class RecordingError(ValueError):
    """A recording file that can't be used."""


def slug(text: str, default: str) -> str:
    """Lower-case letters and digits joined by underscores."""
    parts = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return "_".join(parts) or default


def recording_id_of(path: str) -> str:
    return slug(os.path.splitext(os.path.basename(path))[0], "recording")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme = urlsplit(path).scheme
    if not scheme or scheme == "file":
        return fs.LocalFileSystem(), urlsplit(path).path if scheme else os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether ranges of files there can be read; other stores are read whole by Spark."""
    try:
        opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def existing(paths: DataFrame) -> DataFrame:
    """Those of the paths (one column) that are files, asked for by the tasks."""
    name = paths.columns[0]

    def run(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, at = opened(path)
                found.append(system.get_file_info(at).type == fs.FileType.File)
            yield batch.filter(pa.array(found, pa.bool_()))

    return paths.filter(f"`{name}` IS NOT NULL").distinct().mapInArrow(run, f"`{name}` string")


@dataclass
class Header:
    """What a file says of itself. kind: edf, bdf, stored or packed; start: the
    offset of its data; width: bytes of a sample; per_record: samples of a
    channel in a data record; places: of each channel its first sample in the
    record, gain and offset; order: "channels" if NPZ data lies channel by
    channel, else "samples"."""

    kind: str
    names: list[str]
    rate: float
    n: int
    ids: dict
    provenance: dict
    metadata: dict
    start: int = 0
    width: int = 2
    per_record: int = 1
    record: int = 0
    places: tuple = ()
    order: str = "channels"
    dtype: str = ""

    def begins(self, chunk_id: int, chunk: int) -> int:
        """The offset at which a chunk begins, counted from the data's start."""
        at = chunk_id * chunk
        if self.kind in ("edf", "bdf"):
            return at // self.per_record * self.record
        return at * self.width * (1 if self.order == "channels" else len(self.names))


def edf_header(f) -> Header:
    head = f.read(256)
    if len(head) < 256:
        raise RecordingError("file ends inside its header")
    main, at = {}, 0
    for name, width in HEAD:
        main[name], at = head[at : at + width].decode("latin-1").strip("\x00 "), at + width
    kind = "bdf" if head[0] == 255 else "edf"
    try:
        many = int(main["signals"])
        body = f.read(256 * many)
        if len(body) < 256 * many:
            raise RecordingError("file ends inside its header")
        each, at = {}, 0
        for name, width in SIGNAL_HEAD:
            each[name], at = [body[at + width * k : at + width * (k + 1)].decode("latin-1").strip("\x00 ") for k in range(many)], at + width * many
        sizes = [int(x) for x in each["samples"]]
        seconds, records, start = float(main["seconds"]), int(main["records"]), int(main["header_bytes"])
    except ValueError as bad:
        raise RecordingError(f"unreadable header: {bad}") from bad
    width = 3 if kind == "bdf" else 2
    chosen = [k for k in range(many) if each["label"][k] not in ANNOTATIONS]
    if not chosen:
        raise RecordingError("no channels but annotations")
    if len({sizes[k] for k in chosen}) > 1:
        raise RecordingError("channels of different sampling rates")
    record = width * sum(sizes)
    whole = (f.size() - start) // record if record else 0
    records = min(records, whole) if records >= 0 else whole  # -1: not known when it was written
    first = np.concatenate(([0], np.cumsum(sizes)))
    places = []
    for k in chosen:
        low, high, d_low, d_high = (float(each[name][k]) for name in ("low", "high", "digital_low", "digital_high"))
        if d_high == d_low or high == low:
            raise RecordingError(f"channel {each['label'][k]} has no range")
        gain, unit = (high - low) / (d_high - d_low), VOLTS.get(each["unit"][k].lower(), 1.0)
        places.append((int(first[k]), gain * unit, (low - d_low * gain) * unit))
    per = sizes[chosen[0]]
    if per <= 0 or seconds <= 0:
        raise RecordingError("sampling rate must be positive")
    found = re.match(r"(\d\d)\.(\d\d)\.(\d\d) (\d\d)\.(\d\d)\.(\d\d)", f"{main['date']} {main['time']}")
    said = ""
    if found:
        day, month, year, *clock = map(int, found.groups())
        said = str(datetime(year + (1900 if year >= 85 else 2000), month, day, *clock, tzinfo=timezone.utc))
    return Header(kind, [each["label"][k] for k in chosen], per / seconds, records * per, {}, {"loader_id": kind}, {"measurement_date": said}, start, width, per, record, tuple(places))


def npz_header(f) -> Header:
    with zipfile.ZipFile(f) as held:
        inside = {i.filename.removesuffix(".npy"): i for i in held.infolist()}
        missing = [k for k in MEMBERS if k not in inside]
        if missing:
            raise RecordingError(f"missing members: {', '.join(missing)}")

        def small(name: str) -> np.ndarray:
            with held.open(inside[name]) as m:
                return np.asarray(np.lib.format.read_array(m, allow_pickle=False)).ravel()

        names = [str(c) for c in small("channel_names")]
        rate = float(small("sampling_rate_hz")[0])
        ids = {k: str(small(k)[0]).strip() if k in inside else "" for k in ("subject_id", "session_id", "label_namespace", "cohort_label")}
        ids["cohort_label"] = ids["cohort_label"] or (str(small("cohort")[0]).strip() if "cohort" in inside else "")
        member = inside["data"]
        with held.open(member) as m:
            version = np.lib.format.read_magic(m)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)
            skip = m.tell()
    if len(shape) != 2 or len(names) not in shape:
        raise RecordingError(f"data of shape {shape} doesn't fit {len(names)} channels")
    if rate <= 0:
        raise RecordingError("sampling rate must be positive")
    if dtype.kind not in "fiub":
        raise RecordingError(f"data of type {dtype}")
    turned = shape[0] != len(names)  # the first axis counts, so a square stays as it is
    n = shape[0] if turned else shape[1]
    start = 0
    if member.compress_type == zipfile.ZIP_STORED:
        f.seek(member.header_offset + 26)  # the local header's own lengths of name and extra field
        name_len, extra_len = np.frombuffer(f.read(4), "<u2").tolist()
        start = member.header_offset + 30 + name_len + extra_len + skip
    order = "samples" if turned != fortran else "channels"
    return Header("stored" if start else "packed", names, rate, n, ids, {"loader_id": "npz", "transposed_on_load": str(turned).lower()}, {}, start, dtype.itemsize, order=order, dtype=dtype.str)


def header_of(path: str, f) -> Header:
    kind = os.path.splitext(path)[1].lower()
    try:
        if kind == ".npz":
            return npz_header(f)
        if kind in (".edf", ".bdf"):
            return edf_header(f)
    except RecordingError:
        raise
    except (ValueError, OSError, KeyError, EOFError, IndexError, zipfile.BadZipFile) as fault:
        raise RecordingError(str(fault)) from fault
    raise RecordingError(f"unknown recording format: {kind}")


def _edf_samples(f, h: Header, channels: list[int], first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(channel, samples first to last) from the data records that hold them."""
    a, b = first // h.per_record, -(-last // h.per_record)
    f.seek(h.start + a * h.record)
    data = f.read((b - a) * h.record)
    if h.kind == "edf":
        raw = np.frombuffer(data, "<i2").reshape(b - a, -1)
    else:
        raw = np.zeros((b - a, h.record // 3, 4), np.uint8)
        raw[:, :, 1:] = np.frombuffer(data, np.uint8).reshape(b - a, -1, 3)
        raw = raw.view("<i4")[:, :, 0] >> 8  # the sign is that of the highest byte
    for k in channels:
        at, gain, offset = h.places[k]
        yield k, (raw[:, at : at + h.per_record].ravel()[first - a * h.per_record : last - a * h.per_record] * gain + offset).astype(np.float32)


def _stored_samples(f, h: Header, channels: list[int], first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    if h.order == "channels":
        for k in channels:
            f.seek(h.start + (k * h.n + first) * h.width)
            yield k, np.frombuffer(f.read((last - first) * h.width), h.dtype).astype(np.float32)
        return
    f.seek(h.start + first * len(h.names) * h.width)
    data = np.frombuffer(f.read((last - first) * len(h.names) * h.width), h.dtype).reshape(last - first, -1)
    for k in channels:
        yield k, data[:, k].astype(np.float32)


def _packed_chunks(f, h: Header, channels: set[int], chunk: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(chunk, channel, samples) of a compressed member, in the order it has."""
    with zipfile.ZipFile(f) as held, held.open("data.npy") as m:
        version = np.lib.format.read_magic(m)
        (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(m)

        def take(n: int) -> np.ndarray:
            data = m.read(n * h.width)
            if len(data) < n * h.width:
                raise RecordingError("data ends early")
            return np.frombuffer(data, h.dtype)

        starts = range(0, max(1, h.n), chunk)
        if h.order == "channels":
            for k in range(len(h.names)):
                for at in starts:
                    x = take(min(chunk, h.n - at))
                    if k in channels:
                        yield at // chunk, k, x.astype(np.float32)
        else:
            for at in starts:
                size = min(chunk, h.n - at)
                x = take(size * len(h.names)).reshape(size, -1)
                for k in sorted(channels):
                    yield at // chunk, k, x[:, k].astype(np.float32)


@dataclass
class Range(InputPartition):
    """Bytes from ``low`` to ``high`` of a file; the last range has no end."""

    path: str
    size: int
    modified: float
    low: int = 0
    high: int | None = None

    def __post_init__(self):
        self.value = (self.path, self.low)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.table = options.get("table", "signals")
        self.chunk = int(options.get("chunk", CHUNK))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted: dict[str, set] = {}

    def files(self) -> Iterator[tuple[str, fs.FileInfo]]:
        """(path as the tables have it, info) of every file, each once."""
        seen = set()
        for path in self.paths:
            system, at = opened(path)
            info = system.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=False))
            prefix = "file:" if isinstance(system, fs.LocalFileSystem) else path[: len(path) - len(at)] if path.endswith(at) else f"{urlsplit(path).scheme}://{urlsplit(path).netloc}"
            for i in sorted(found, key=lambda i: i.path):
                name = prefix + i.path
                other = i.base_name.startswith((".", "_")) or i.base_name.lower().endswith(".fif")  # FIF isn't read in ranges
                if i.type == fs.FileType.File and not other and name not in seen:
                    seen.add(name)
                    yield name, i

    def partitions(self) -> list[Range]:
        out = []
        for path, info in self.files():
            if "recording_id" in self.wanted and recording_id_of(path) not in self.wanted["recording_id"]:
                continue
            modified = info.mtime.timestamp() if info.mtime else 0.0
            lows = range(0, max(1, info.size), self.range_bytes) if self.table == "signals" else [0]
            out += [Range(path, info.size, modified, low, low + self.range_bytes) for low in lows]
            out[-1].high = None
        return out or [Range("", 0, 0.0)]

    def read(self, partition: Range) -> Iterator:
        if not partition.path:
            return
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            if self.table == "recordings":
                yield self.row(partition, f)
            else:
                yield from self.signals(partition, f)

    def row(self, p: Range, f) -> tuple:
        """A row of the recordings table; a bad file gives a message."""
        stem, kind = os.path.splitext(os.path.basename(p.path))
        fields = {k: "" for k in ("subject_id", "session_id", "label_namespace", "cohort_label")}
        provenance = {"size_bytes": str(p.size), "modified_time_utc": datetime.fromtimestamp(p.modified, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}
        about = (p.path, kind.lower().lstrip("."))
        try:
            h = header_of(p.path, f)
        except RecordingError as fault:
            return (recording_id_of(p.path), *fields.values(), *about, [], None, 0, None, provenance, {}, str(fault))
        ids = fields | h.ids
        return (recording_id_of(p.path), *ids.values(), *about, h.names, h.rate, h.n, h.n / h.rate, h.provenance | provenance, h.metadata, None)

    def signals(self, p: Range, f) -> Iterator[pa.RecordBatch]:
        try:
            h = header_of(p.path, f)
        except RecordingError:
            return
        channels = [k for k, name in enumerate(h.names) if name in self.wanted.get("channel", {name}) and k in self.wanted.get("channel_idx", {k})]
        if not channels:
            return

        def batch(k: int, chunk_id: int, x: np.ndarray) -> pa.RecordBatch:
            offsets = pa.array([0, len(x)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([recording_id_of(p.path)]), pa.array([k], pa.int32()), pa.array([h.names[k]]), pa.array([chunk_id], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x))], schema=_SIGNAL)

        if h.kind == "packed":
            if p.low == 0:
                for chunk_id, k, x in _packed_chunks(f, h, set(channels), self.chunk):
                    yield batch(k, chunk_id, x)
            return
        take = _edf_samples if h.kind in ("edf", "bdf") else _stored_samples
        for chunk_id in range(max(1, -(-h.n // self.chunk))):
            first, last = chunk_id * self.chunk, min(h.n, (chunk_id + 1) * self.chunk)
            at = h.start + h.begins(chunk_id, self.chunk)
            if h.kind == "stored" and h.order == "channels":  # each channel's chunks lie apart
                mine = [k for k in channels if self.inside(p, at + k * h.n * h.width)]
            else:
                mine = channels if self.inside(p, at) else []
            if mine:
                for k, x in take(f, h, mine, first, last):
                    yield batch(k, chunk_id, x)

    @staticmethod
    def inside(p: Range, at: int) -> bool:
        return p.low <= at and (p.high is None or at < p.high)


class PushingReader(Reader):
    """For sessions that push filters to Python sources."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            held = name == "recording_id" or self.table == "signals" and name in ("channel", "channel_idx")
            if not held:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return RECORDING if self.options.get("table") == "recordings" else SIGNAL

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(dict(self.options))
