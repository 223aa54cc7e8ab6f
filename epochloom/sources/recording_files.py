"""Recordings written as files: EDF or BDF data records, NPZ members."""

from __future__ import annotations

import io

import numpy as np

from .recording_source import HEAD, SIGNAL_HEAD, opened


def edf_bytes(names: list[str], rate: float, data: np.ndarray, low: float = -1.0, high: float = 1.0, unit: str = "V", wide: bool = False, per_record: int = 1, annotations: int = 0, records: int | None = None, when: str = "02.03.21 04.05.06") -> bytes:
    """An EDF file (BDF if ``wide``) of data [channels, samples], quantised
    between low and high and padded to whole records. annotations: samples of an
    annotation channel in each record; records: what the header says."""
    top = (1 << 23) - 1 if wide else (1 << 15) - 1
    n = -(-data.shape[1] // per_record)
    padded = np.zeros((len(names), n * per_record))
    padded[:, : data.shape[1]] = data
    digital = np.rint((np.clip(padded, low, high) - low) / (high - low) * (2 * top) - top).astype("<i4")
    body = digital.reshape(len(names), n, per_record).transpose(1, 0, 2).reshape(n, -1)
    body = np.concatenate((body, np.zeros((n, annotations), "<i4")), axis=1)
    many = len(names) + (annotations > 0)
    date, time = when.split()
    head = {"version": "0", "patient": "X", "recording": "X", "date": date, "time": time, "header_bytes": 256 * (many + 1), "reserved": "", "records": n if records is None else records, "seconds": f"{per_record / rate:g}", "signals": many}
    each = {"label": names, "transducer": "", "unit": unit, "low": f"{low:g}", "high": f"{high:g}", "digital_low": -top, "digital_high": top, "filter": "", "samples": per_record, "reserved": ""}
    last = {"label": "BDF Annotations" if wide else "EDF Annotations", "low": "-1", "high": "1", "samples": annotations}
    out = "".join(str(head[k]).ljust(width)[:width] for k, width in HEAD)
    for k, width in SIGNAL_HEAD:
        values = [v for v in (each[k] if k == "label" else [each[k]] * len(names))] + ([last.get(k, each[k])] if annotations else [])
        out += "".join(str(v).ljust(width)[:width] for v in values)
    raw = out.encode("latin-1")
    if wide:
        return b"\xffBIOSEMI" + raw[8:] + np.ascontiguousarray(body).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return raw + body.astype("<i2").tobytes()


def npz_bytes(names: list[str], rate: float, data: np.ndarray, packed: bool = False, **more: str) -> bytes:
    out = io.BytesIO()
    (np.savez_compressed if packed else np.savez)(out, data=data, channel_names=np.array(names), sampling_rate_hz=np.array(rate), **{k: np.array(v) for k, v in more.items()})
    return out.getvalue()


def write_bytes(path: str, content: bytes) -> None:
    """A file in any store that ``recording_source`` can open."""
    system, at = opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(content)
