"""Validation rules as queries that give one row for each violation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_dir

FINDING = "level string, code string, location string, message string"


def finding(level: str, code: str, location: Column, message: Column) -> list[Column]:
    return [F.lit(level).alias("level"), F.lit(code).alias("code"), location.cast("string").alias("location"), message.cast("string").alias("message")]


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of those that come more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def overlaps(events: DataFrame, recording: str, onset: str, end: str, item: str, allowed: Column | None = None) -> DataFrame:
    """recording, left, right: an event that begins before the one before it (by
    onset, end, id) has ended; none if either allows it."""
    order = Window.partitionBy(recording).orderBy(onset, end, item)
    ok = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(False)
    seen = events.select(recording, F.col(item).alias("left"), F.col(end).alias("_end"), ok.alias("_ok"), F.lead(item).over(order).alias("right"), F.lead(onset).over(order).alias("_next"), F.lead(ok).over(order).alias("_next_ok"))
    return seen.filter(F.col("right").isNotNull() & (F.col("_next") < F.col("_end")) & ~F.col("_ok") & ~F.col("_next_ok")).select(recording, "left", "right")


def imbalance(df: DataFrame, keys: list[str], ratio: float = 3.0) -> DataFrame:
    """smallest, largest, labels: one row if the largest label has at least
    ``ratio`` times as many rows as the smallest."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count("*").alias("labels")).filter(F.col("largest") >= ratio * F.col("smallest"))


def leakage(df: DataFrame, label: str, subject: str) -> DataFrame:
    """left_label, right_label: for each label the next one (in order) that
    shares a subject. A label list per subject, so no subject is paired with
    itself row by row."""
    held = df.select(label, subject).distinct().groupBy(subject).agg(F.array_sort(F.collect_set(label)).alias("_l")).filter(F.size("_l") > 1)
    # a subject's labels are few; its next label is enough only with all later ones
    pairs = held.select(F.explode(F.transform("_l", lambda x, i: F.struct(x.alias("a"), F.slice("_l", i + 2, F.size("_l")).alias("bs")))).alias("p")).select("p.a", F.explode("p.bs").alias("b"))
    return pairs.groupBy(F.col("a").alias("left_label")).agg(F.min("b").alias("right_label"))


def few(df: DataFrame, keys: list[str], item: str, least: int) -> DataFrame:
    """keys, n: groups with fewer than ``least`` distinct items."""
    return df.groupBy(*keys).agg(F.count_distinct(item).alias("n")).filter(F.col("n") < least)


def mixed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n: groups with more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def inconsistent_montage(df: DataFrame, branch: str, collection: str, channel: str) -> DataFrame:
    """branch, in_all, in_any: branches whose collections differ in channels."""
    held = df.select(branch, collection, channel).distinct()
    total = held.groupBy(branch).agg(F.count_distinct(collection).alias("_total"))
    seen = held.groupBy(branch, channel).agg(F.count("*").alias("_n"))
    out = seen.join(total, branch).groupBy(branch).agg(F.count_if(F.col("_n") == F.col("_total")).alias("in_all"), F.count("*").alias("in_any"))
    return out.filter("in_all < in_any")


def channel_faults(channels: Column) -> Column:
    """array<struct<level, message>>: an empty list, repeated or blank names;
    names with white space are a warning."""
    rules = [
        (F.size(channels) == 0, "error", "no channels"), (F.size(F.array_distinct(channels)) < F.size(channels), "error", "repeated channel names"),
        (F.exists(channels, lambda c: F.trim(c) == ""), "error", "blank channel name"), (F.exists(channels, lambda c: c.rlike(r"\s")), "warning", "white space in a channel name"),
    ]
    return F.filter(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(m).alias("message"))) for c, level, m in rules]), lambda m: m.isNotNull())


def _channel_findings(df: DataFrame, where: str, channels: str, code: str) -> DataFrame:
    each = df.select(F.col(where).alias("_where"), F.explode(channel_faults(F.col(channels))).alias("f"))
    return each.select(F.col("f.level").alias("level"), F.lit(code).alias("code"), F.col("_where").cast("string").alias("location"), F.col("f.message").alias("message"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_report(events: DataFrame, duration: DataFrame | None = None) -> DataFrame:
    """Findings of a normalised event table; duration: recording_id, seconds."""
    from ..sources.events import faults

    ends = events.withColumn("_end", F.col("onset_seconds") + F.col("duration_seconds"))
    allow = F.lower(F.coalesce(F.get(F.map_values(F.map_filter("metadata", lambda k, v: k == "allow_overlap")), F.lit(0)), F.lit(""))).isin("true", "1", "yes")
    empty = events.agg(F.count("*").alias("n")).filter("n = 0").select(*finding("error", "events.empty", F.lit(""), F.lit("no events")))
    parts = [
        empty,
        duplicates(events, ["recording_id", "event_id"]).select(*finding("error", "events.duplicate_id", F.col("event_id"), F.concat(F.lit("event id comes "), F.col("n"), F.lit(" times")))),
        faults(events).select(*finding("error", "events.invalid", F.col("event_id"), F.col("message"))),
        overlaps(ends, "recording_id", "onset_seconds", "_end", "event_id", allow).select(*finding("error", "events.overlap", F.col("recording_id"), F.concat_ws(" overlaps ", "right", "left"))),
        imbalance(events, ["label_namespace", "event_family", "target_label"]).select(*finding("warning", "events.class_imbalance", F.lit(""), F.lit("label counts differ by a factor of 3 or more"))),
    ]
    if duration is not None:
        known = ends.join(duration, "recording_id")
        parts.append(known.filter("_end > seconds").select(*finding("error", "events.out_of_bounds", F.col("event_id"), F.lit("ends after its recording"))))
        lost = events.join(duration, "recording_id", "left_anti")
        parts.append(lost.select(*finding("error", "events.recording_mismatch", F.col("event_id"), F.concat(F.lit("no recording "), F.col("recording_id")))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def study_report(observations: DataFrame, min_subjects: int = 2, min_trials: int = 2) -> DataFrame:
    """Findings over all collections. observations: collection_id, recording_id,
    source_path, subject_id, label_namespace, event_family, target_label,
    branch_name, event_id, sampling_rate_hz, channels."""
    key = ["label_namespace", "event_family", "target_label", "branch_name"]
    where = F.concat_ws("/", *key)
    subject = observations.withColumn("subject_id", F.coalesce(F.nullif("subject_id", F.lit("")), "recording_id"))
    trials = observations.groupBy(*key).agg(F.count("*").alias("n"))
    contexts = observations.groupBy("label_namespace", "event_family", "branch_name").agg(F.count_distinct("target_label").alias("n")).filter("n < 2")
    ids = observations.select("collection_id", "recording_id", "branch_name").distinct()
    channels = observations.select("branch_name", "collection_id", F.explode("channels").alias("channel"))
    empty = observations.agg(F.count("*").alias("n")).filter("n = 0").select(*finding("error", "study.empty", F.lit(""), F.lit("nothing to check")))
    parts = [
        empty,
        duplicates(ids, ["collection_id"]).select(*finding("warning", "study.duplicate_collection_id", F.col("collection_id"), F.lit("collection id comes more than once"))),
        mixed(observations, ["recording_id"], "source_path").select(*finding("error", "study.recording_collision", F.col("recording_id"), F.lit("several source files have this id"))),
        mixed(observations, key, "sampling_rate_hz").select(*finding("error", "study.sample_rate_mismatch", where, F.lit("mixed sampling rates"))),
        few(subject, key, "subject_id", min_subjects).select(*finding("error", "study.too_few_subjects", where, F.concat(F.lit("subjects: "), F.col("n")))),
        trials.filter(F.col("n") < min_trials).select(*finding("warning", "study.too_few_trials", where, F.concat(F.lit("trials: "), F.col("n")))),
        contexts.select(*finding("warning", "study.weak_controls", F.concat_ws("/", "label_namespace", "event_family", "branch_name"), F.lit("fewer than two labels"))),
        inconsistent_montage(channels, "branch_name", "collection_id", "channel").select(*finding("warning", "study.montage_inconsistent", F.col("branch_name"), F.lit("channels differ across collections"))),
        imbalance(observations, key).select(*finding("warning", "study.class_imbalance", F.lit(""), F.lit("label counts differ by a factor of 3 or more"))),
        leakage(subject, "target_label", "subject_id").select(*finding("warning", "study.subject_leakage_risk", F.col("left_label"), F.concat(F.lit("shares subjects with "), F.col("right_label")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lineage_closure(edges: DataFrame, shared: str | None = None) -> DataFrame:
    """child, ancestor, depth (the least) of a lineage of (child, parent)
    edges, of any depth and with cycles: a frontier of pairs goes on by one
    edge until it has no pair that wasn't seen. Each round is written to the
    shared folder (``shared``, else spark.checkpoint.dir)."""
    spark = edges.sparkSession
    folder = f"{(shared or shared_dir(spark)).rstrip('/')}/lineage-{uuid.uuid4().hex}"
    pairs = edges.select("child", "parent").distinct()
    pairs.write.parquet(f"{folder}/edges")
    pairs = spark.read.schema(pairs.schema).parquet(f"{folder}/edges")
    found = pairs.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found.write.parquet(f"{folder}/seen/depth_1")
    schema, depth = found.schema, 1
    while True:
        front = spark.read.schema(schema).parquet(f"{folder}/seen/depth_{depth}")
        seen = spark.read.schema(schema).parquet(*[f"{folder}/seen/depth_{k}" for k in range(1, depth + 1)])
        step = front.join(pairs.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        fresh = step.join(seen.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth + 1))
        fresh.write.parquet(f"{folder}/seen/depth_{depth + 1}")
        depth += 1
        if not spark.read.schema(schema).parquet(f"{folder}/seen/depth_{depth}").take(1):
            return seen


def bids_path(path: Column) -> Column:
    """Whether a path looks like a BIDS EEG file: a sub- name with _eeg below a sub- folder or of that name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.startswith("sub-") & name.contains("_eeg") & F.exists(F.split(F.lower(path), "/"), lambda p: p.startswith("sub-"))


def bids_sidecars(path: Column) -> Column:
    """array<string>: the JSON, channels and events files beside a BIDS recording."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    at = F.when(F.size(parts) > 1, F.concat(folder, F.lit("/"))).otherwise("")
    stem = F.regexp_replace(name, r"\..*$", "")
    base = F.regexp_replace(stem, "_eeg$", "")
    return F.array(F.concat(at, stem, F.lit(".json")), F.concat(at, base, F.lit("_channels.tsv")), F.concat(at, base, F.lit("_events.tsv")))


def recording_report(recordings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Findings of a recordings table; files: path, every file that exists."""
    where = F.col("recording_id")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        (empty("recording_id"), "no recording_id"), (empty("source_path"), "no source_path"), (empty("source_format"), "no source_format"), (F.col("message").isNotNull(), None),
        *[(F.col("message").isNull() & ~F.coalesce(F.col(c) > 0, F.lit(False)), f"{c} is not above 0") for c in ("sampling_rate_hz", "n_samples", "duration_seconds")],
    ]
    said = F.array(*[F.when(rule, F.lit(m) if m else F.col("message")) for rule, m in rules])
    parts = [
        recordings.select("recording_id", F.explode(F.filter(said, lambda m: m.isNotNull())).alias("m")).select(*finding("error", "recording.invalid", where, F.col("m"))),
        _channel_findings(recordings.filter("message IS NULL"), "recording_id", "channel_names", "recording.channels"),
        recordings.filter(F.coalesce(F.size("provenance"), F.lit(0)) <= 0).select(*finding("warning", "recording.provenance_missing", where, F.lit("no provenance"))),
    ]
    if files is not None:
        known = files.select(F.col("path").alias("source_path")).distinct()
        parts.append(recordings.join(known, "source_path", "left_anti").select(*finding("error", "recording.source_missing", where, F.col("source_path"))))
        wanted = recordings.join(known, "source_path", "left_semi").filter(bids_path(F.col("source_path"))).select("recording_id", F.explode(bids_sidecars(F.col("source_path"))).alias("path"))
        parts.append(wanted.join(files.select("path").distinct(), "path", "left_anti").select(*finding("warning", "recording.bids_sidecar_missing", where, F.col("path"))))
    return _all(parts)


def rate_close(a: Column, b: Column) -> Column:
    """Equal within 1e-8 plus 1e-5 of the second."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def signal_items(signals: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """A row for each item (keys): channels, shortest and longest signal, lowest
    and highest rate, rows. All that is said of the item's signals comes of it."""
    size = F.size("samples")
    return signals.groupBy(*keys).agg(
        F.count_distinct("channel").alias("_n"), F.min(size).alias("_least"), F.max(size).alias("_most"), F.min("sampling_rate_hz").alias("_low"), F.max("sampling_rate_hz").alias("_high"), F.count("*").alias("_rows"), *more
    )


def _contract(items: DataFrame, unit: list[str], item: list[str], code: str, n_channels: Column | None, rate: Column | None) -> DataFrame:
    # the rate that most items of a unit have, so that one that is off doesn't speak for the others
    first = items.groupBy(*unit).agg(F.max("_n").alias("_channels"), F.mode("_low", True).alias("_rate"))
    met = items.join(first, unit).withColumn("_want", F.col("_channels") if n_channels is None else n_channels).withColumn("_rate", F.col("_rate") if rate is None else rate)
    off = F.when(~rate_close(F.col("_low"), F.col("_rate")), F.col("_low")).when(~rate_close(F.col("_high"), F.col("_rate")), F.col("_high"))
    rules = [
        ("error", F.col("_n") != F.col("_want"), F.concat(F.lit("channels: "), F.col("_n"), F.lit(" of "), F.col("_want"))),
        ("error", off.isNotNull(), F.concat(F.lit("sampling rate "), off, F.lit(" against "), F.col("_rate"))),
        ("error", F.col("_least") != F.col("_most"), F.lit("channels of different lengths")),
        ("warning", F.col("_most") <= 0, F.lit("no samples")),
    ]
    return _told(met, [(level, code, rule, F.concat_ws("/", *[F.col(c).cast("string") for c in (*unit, *item)]), text) for level, rule, text in rules])


def _told(df: DataFrame, rules: list[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    """Findings of all rules (level, code, what is wrong, location, message) in
    one pass over the rows."""
    each = [F.when(wrong, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), where.cast("string").alias("location"), text.cast("string").alias("message"))) for level, code, wrong, where, text in rules]
    return df.select(F.inline(F.filter(F.array(*each), lambda f: f.isNotNull())))


def signal_findings(signals: DataFrame, unit: list[str], item: list[str], code: str, n_channels: Column | None = None, rate: Column | None = None) -> DataFrame:
    """Signals against their contract. signals: a row for each channel, with
    unit and item columns (an item, such as an event's phase, belongs to a
    unit, such as a collection), channel, samples and sampling_rate_hz. An
    error where an item has not all channels of its unit (``n_channels``, or as
    many as its fullest item), or where one of its channels has another rate
    than the unit's (``rate``, or the one most items have); a warning where
    there are no samples."""
    return _contract(signal_items(signals, [*unit, *item]), unit, item, code, n_channels, rate)


def collection_report(epochs: DataFrame, recordings: DataFrame, events: DataFrame, collection_id: str) -> DataFrame:
    """Findings of one branch of a collection. epochs: its rows, one for each
    event, phase and channel; events: those it was made of. The epochs are read
    once: every rule is told from one table of their items."""
    key = ["recording_id", "event_id"]
    shape = F.max((F.size("samples") != F.col("derived_samples")).cast("int")).alias("_shape")
    no_rate = F.max((~F.coalesce(F.col("sampling_rate_hz") > 0, F.lit(False))).cast("int")).alias("_no_rate")
    items = signal_items(epochs, [*key, "phase"], shape, no_rate, F.collect_set("channel").alias("_names"))  # an item's channels
    where = F.concat_ws("/", *key)
    repeated = F.col("_rows") > F.col("_n")
    ids = items.groupBy(*key).agg(F.max("_no_rate").alias("_no_rate"), F.max(repeated.cast("int")).alias("_repeated"))
    known = recordings.select("recording_id", F.lit(True).alias("_known")).distinct()
    told = _told(ids.join(known, "recording_id", "left"), [
        ("error", "epochs.invalid", F.col("_no_rate") == 1, where, F.lit("sampling_rate_hz is not above 0")),
        ("error", "epochs.duplicate_event", F.col("_repeated") == 1, F.col("event_id"), F.lit("event comes more than once")),
        ("error", "epochs.recording_mismatch", F.col("_known").isNull(), F.col("event_id"), F.concat(F.lit("no recording "), F.col("recording_id"))),
    ])
    shapes = _told(items, [("error", "epochs.phase_shape", F.col("_shape") == 1, where, F.concat(F.col("phase"), F.lit(" has another number of samples than its range")))])
    channels = items.select("recording_id", F.explode("_names").alias("channel")).groupBy("recording_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    return _all([
        items.agg(F.count("*").alias("n")).filter("n = 0").select(*finding("error", "epochs.empty", F.lit(collection_id), F.lit("no epochs"))),
        told, shapes,
        _channel_findings(channels, "recording_id", "channels", "epochs.channels"),
        events.select(*key).distinct().join(ids, key, "left_anti").select(*finding("error", "epochs.missing_signal", where, F.lit("event without epochs"))),
        _contract(items, ["recording_id"], ["event_id", "phase"], "epochs.signal_contract", None, None),
    ])


def candidate_report(candidates: DataFrame, artifacts: DataFrame, contracts: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """Findings of candidates. artifacts: pattern_id, artifact, of what there
    is; contracts: findings of their signals; embedded: pattern_id, model_id of
    embeddings, for those that evidence was used of (column used)."""
    where = F.col("pattern_id")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        ("error", "candidate.pattern_id", blank("pattern_id"), "no pattern_id"), ("error", "candidate.target_label", blank("target_label"), "no target_label"),
        ("error", "candidate.subject_support", F.coalesce("n_subjects", F.lit(0)) < 2, "fewer than two subjects"), ("warning", "candidate.event_support", F.coalesce("n_events", F.lit(0)) < 2, "fewer than two events"),
        ("warning", "candidate.run_id_missing", blank("run_id"), "no run_id"), ("warning", "candidate.reliability_missing", F.col("tier").isNull(), "no reliability"),
        ("warning", "candidate.low_confidence", F.col("tier").isin("insufficient", "unstable"), "low confidence"),
    ]
    parts = [candidates.filter(rule).select(*finding(level, code, where, F.lit(text))) for level, code, rule, text in rules]
    wanted = F.array(*map(F.lit, REQUIRED_ARTIFACTS))
    for level, code, names in (("error", "candidate.artifact_missing", wanted), ("warning", "candidate.topography_missing", F.array(F.lit("topography")))):
        each = candidates.select("pattern_id", F.explode(names).alias("artifact"))
        parts.append(each.join(artifacts, ["pattern_id", "artifact"], "left_anti").select(*finding(level, code, where, F.concat(F.lit("no "), F.col("artifact")))))
    if embedded is not None:
        parts.append(embedded.filter("NOT used").select(*finding("warning", "candidate.backbone_artifact_missing", where, F.concat(F.lit("no embeddings of "), F.col("model_id")))))
    return _all([*parts, contracts])


#: Tables that every candidate must have rows in.
REQUIRED_ARTIFACTS = ("prototypes", "subject_prototypes", "exemplars")


def branch_findings(branch) -> list[tuple[str, str, str, str]]:
    """(level, code, location, message) of a branch configuration."""
    out = [("error", "preprocess.invalid", branch.name, m) for m in branch.check()]
    if branch.rereference == "channels" and not branch.reference_channels:
        out.append(("error", "preprocess.reference_missing", branch.name, "reference channels are required"))
    if len(set(branch.align_channels)) < len(branch.align_channels):
        out.append(("error", "preprocess.align_duplicate", branch.name, "target channels repeat"))
    changed = branch.notch_hz or branch.resample_hz is not None or branch.align_channels or branch.rereference != "none" or branch.scale is not None
    if branch.name == "raw_preserving" and changed:
        out.append(("warning", "preprocess.raw_branch_modified", branch.name, "raw_preserving branch carries transforms"))
    return out
