"""Event-centred epochs: phase windows, sample ranges, slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("pre_event", "onset", "sustained", "offset", "post_event")
BASELINE = "baseline"


@dataclass(frozen=True)
class Baseline:
    """Offsets from the onset, in seconds."""

    start: float = -1.0
    end: float = 0.0

    def check(self) -> list[str]:
        return [] if self.end > self.start else ["baseline end must be greater than baseline start"]


@dataclass(frozen=True)
class Windows:
    """Lengths of the phases around an event, in seconds."""

    pre_event: float = 1.0
    onset: float = 1.0
    offset: float = 1.0
    post_event: float = 1.0
    sustained: float | None = None
    baseline: Baseline | None = None

    def check(self) -> list[str]:
        faults = [f"{n} must be non-negative" for n in ("pre_event", "onset", "offset", "post_event") if getattr(self, n) < 0]
        if self.sustained is not None and self.sustained < 0:
            faults.append("sustained must be non-negative")
        return faults + (self.baseline.check() if self.baseline else [])

    def slug(self) -> str:
        parts = [f"pre{self.pre_event:g}", f"on{self.onset:g}", f"off{self.offset:g}", f"post{self.post_event:g}"]
        if self.sustained is not None:
            parts.append(f"sus{self.sustained:g}")
        if self.baseline:
            parts.append(f"base{self.baseline.start:g}to{self.baseline.end:g}")
        return "_".join(parts).replace("-", "m").replace(".", "p")


def phase_requests(events: DataFrame, windows: Windows, onset: str = "onset_seconds", duration: str = "duration_seconds") -> DataFrame:
    """``events`` with one row for each phase: phase, requested_start,
    requested_end in seconds. A projection; no shuffle."""
    o, d = F.col(onset).cast("double"), F.col(duration).cast("double")
    end = o + d
    lasts = d > 0
    onset_end = F.when(lasts, F.least(end, o + windows.onset)).otherwise(o + windows.onset)
    offset_start = end - windows.offset if windows.offset else end
    offset_start = F.when(lasts, F.greatest(o, offset_start)).otherwise(offset_start)
    sustained_start = F.least(onset_end, end)
    sustained_end = F.greatest(sustained_start, offset_start)
    if windows.sustained is not None:
        sustained_end = F.least(sustained_end, sustained_start + windows.sustained)
    ranges = [
        ("pre_event", o - windows.pre_event, o), ("onset", o, onset_end), ("sustained", sustained_start, sustained_end),
        ("offset", offset_start, end), ("post_event", end, end + windows.post_event),
    ]
    if windows.baseline:
        ranges.append((BASELINE, o + windows.baseline.start, o + windows.baseline.end))
    structs = [F.struct(F.lit(n).alias("phase"), a.alias("requested_start"), b.alias("requested_end")) for n, a, b in ranges]
    return events.select("*", F.inline(F.array(*structs)))


#: What is said of a phase that can't be had as asked.
REVERSED = " requested end preceded start; collapsed to zero-length"
CLIPPED = " window was clipped to the recording bounds"
EXCEEDED = " window exceeded the recording duration and was clipped"


def sample_range(requests: DataFrame, rate: Column, total: Column) -> DataFrame:
    """Requested seconds as half-open sample ranges inside the recording, with
    what was cut off: start_sample, end_sample, actual_start, actual_end,
    derived_samples, clipped, warning (of several, the first)."""
    phase, start, asked = F.col("phase"), F.col("requested_start"), F.col("requested_end")
    reversed_ = asked < start
    end = F.when(reversed_, start).otherwise(asked)
    s = F.greatest(F.lit(0.0), start)
    t = F.greatest(s, end)
    moved = (s != start) | (t != end)
    first = F.greatest(F.lit(0), F.least(total, F.floor(s * rate))).cast("long")
    last = F.greatest(first, F.least(total, F.ceil(t * rate))).cast("long")
    beyond = (last == total) & (end > total / rate)
    warning = (
        F.when(reversed_, F.concat(phase, F.lit(REVERSED)))
        .when(moved, F.concat(phase, F.lit(CLIPPED)))
        .when(beyond, F.concat(phase, F.lit(EXCEEDED)))
        .otherwise("")
    )
    return requests.withColumns(
        {
            "requested_end": end, "start_sample": first, "end_sample": last, "actual_start": first / rate, "actual_end": last / rate,
            "derived_samples": last - first, "clipped": reversed_ | moved | beyond, "warning": warning,
        }
    )


def slice_samples(samples: Column) -> Column:
    """The range's samples of a whole channel."""
    return F.slice(samples, F.col("start_sample").cast("int") + 1, F.col("derived_samples").cast("int"))


#: Samples in a stored chunk of a channel.
CHUNK = 1 << 16


def epochs(signals: DataFrame, ranges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ranges joined with chunked channels: one row per range and channel, with
    its samples in order.

    signals: recording_id, channel_idx, channel, chunk_id, samples; chunk k
    holds samples from k * chunk on. A range meets only the chunks that it
    touches: an equi join on (recording, chunk), never a range join.
    """
    touched = F.sequence(F.floor(F.col("start_sample") / chunk), F.greatest(F.floor(F.col("start_sample") / chunk), F.floor((F.col("end_sample") - 1) / chunk)))
    keys = [c for c in ranges.columns]
    wanted = ranges.withColumn("chunk_id", F.explode(touched))
    met = wanted.join(signals.withColumnRenamed("samples", "_held"), ["recording_id", "chunk_id"])
    begin = F.greatest(F.col("start_sample") - F.col("chunk_id") * chunk, F.lit(0))
    stop = F.least(F.col("end_sample") - F.col("chunk_id") * chunk, F.lit(chunk))
    part = F.slice("_held", begin.cast("int") + 1, F.greatest(stop - begin, F.lit(0)).cast("int"))
    met = met.select(*keys, "channel_idx", "channel", F.struct("chunk_id", part.alias("part")).alias("_p"))
    grouped = met.groupBy(*keys, "channel_idx", "channel").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))  # the chunks of one range
    return grouped.withColumn("samples", F.flatten(F.transform("_ps", lambda p: p["part"]))).drop("_ps")


def interval_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside half-open ranges of the same key: ranges are dealt to the
    buckets of ``width`` that they touch, so that the join is an equi join."""
    bucket = lambda c: F.floor(c / width)
    dealt = ranges.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), F.greatest(bucket(F.col(start)), bucket(F.col(end))))))
    return points.withColumn("_b", bucket(F.col(at))).join(dealt, [key, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
