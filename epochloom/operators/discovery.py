"""Patterns shared across subjects: prototypes, spectra, controls, branches.

observations: one row per event, phase and channel with label_namespace,
event_family, target_label, branch_name, recording_id, subject_id, session_id,
cohort_label, event_id, obs_idx (order of arrival), phase, channel_idx,
channel, samples, sampling_rate_hz. An event is (recording_id, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions
from ..functions.expr import safe_corr, severity
from . import reliability, similarity, spectral
from .epochs import PHASES

CONTEXT = ["label_namespace", "event_family", "branch_name"]
GROUP = [*CONTEXT, "target_label"]
_EVENT = ["recording_id", "event_id"]


def phase_order():
    return F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))


def selected(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have one of the values wanted; an empty list (after
    blanks are left out) wants all. On partition columns these reach the scan."""
    for column, values in wanted.items():
        kept = sorted({v.strip() for v in values if v.strip()})
        if kept:
            df = df.filter(F.col(column).isin(*kept))
    return df


def usable(observations: DataFrame, min_subjects: int) -> tuple[DataFrame, DataFrame]:
    """(observations of groups that can be compared, issues of the others):
    enough subjects, and one sampling rate. An event without a sample in any
    phase has no part and is an issue of its own."""
    known = observations.filter(F.col("phase").isin(*PHASES))
    full = known.filter(F.size("samples") > 0)
    groups = full.groupBy(*GROUP).agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct("sampling_rate_hz").alias("rates"))
    good = groups.filter((F.col("subjects") >= min_subjects) & (F.col("rates") == 1)).select(*GROUP)
    where = F.concat_ws("/", *GROUP)
    held = observations.groupBy(*GROUP, *_EVENT).agg(F.max(F.when(F.col("phase").isin(*PHASES), F.size("samples"))).alias("_most"))
    parts = [
        (held.filter(F.coalesce("_most", F.lit(0)) <= 0), "warning", "discovery.empty_epoch", F.concat_ws("/", *GROUP, *_EVENT), F.lit("no samples in any phase")),
        (groups.filter(F.col("subjects") < min_subjects), "warning", "discovery.too_few_subjects", where, F.concat(F.lit("subjects: "), F.col("subjects"))),
        (groups.filter((F.col("subjects") >= min_subjects) & (F.col("rates") > 1)), "error", "discovery.mixed_sampling_rates", where, F.concat(F.lit("sampling rates: "), F.col("rates"))),
    ]
    issues = None
    for rows, severity_, code, at, message in parts:
        one = rows.select(F.lit(severity_).alias("severity"), F.lit(code).alias("code"), at.alias("location"), message.alias("message"))
        issues = one if issues is None else issues.unionByName(one)
    return full.join(good, GROUP), issues


def aligned(observations: DataFrame) -> DataFrame:
    """Common axes of each group: only phases and channels that all of its
    events have, samples cut to the shortest; channel order is that of the
    group's first event (column ch_pos)."""
    events = observations.groupBy(*GROUP).agg(F.count_distinct(*_EVENT).alias("_events"))
    phases = observations.groupBy(*GROUP, "phase").agg(F.count_distinct(*_EVENT).alias("_n"), F.min(F.size("samples")).alias("_length")).join(events, GROUP).filter("_n = _events").select(*GROUP, "phase", "_length")
    channels = (
        observations.groupBy(*GROUP, "channel").agg(F.count_distinct(*_EVENT).alias("_n"), F.min_by("channel_idx", "obs_idx").alias("ch_pos")).join(events, GROUP).filter("_n = _events").select(*GROUP, "channel", "ch_pos")
    )
    met = observations.join(phases, [*GROUP, "phase"]).join(channels, [*GROUP, "channel"])
    return met.withColumn("samples", F.slice("samples", F.lit(1), F.col("_length"))).drop("_length")


def position_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Position-wise means of samples (NaN stays NaN), partially aggregated."""
    at = df.select(*keys, F.posexplode("samples").alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    held = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s"))
    return held.select(*keys, F.transform("_s", lambda p: p["v"].cast("float")).alias("samples"))


def prototypes(al: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subject means over their events, group means over their subjects)."""
    axes = ["phase", "channel", "ch_pos", "sampling_rate_hz"]
    subjects = position_means(al, [*GROUP, "subject_id", *axes])
    return subjects, position_means(subjects, [*GROUP, *axes])


def band_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phase, channel, ch_pos, band, power."""
    held = df.select(*keys, "phase", "channel", "ch_pos", spectral.band_power(F.col("samples"), F.col("sampling_rate_hz")).alias("_b"))
    return held.select(*keys, "phase", "channel", "ch_pos", F.inline("_b"))


def _band_order():
    return F.array_position(F.array(*[F.lit(b[0]) for b in spectral.BANDS]), F.col("band"))


def on_all_axes(bands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phase, channel, band, power, ch_pos: ``bands`` on every axis that
    any label of its context has, NaN on those its own label lacks, so that
    correlations skip what a pair of labels doesn't share. ch_pos is the
    context's place of the channel. keys: GROUP and more."""
    axis = ["phase", "channel", "band"]
    axes = bands.groupBy(*CONTEXT, *axis).agg(F.min("ch_pos").alias("ch_pos"))
    own = bands.select(*GROUP, *axis).distinct()
    lacking = own.select(*GROUP).distinct().join(axes.drop("ch_pos"), CONTEXT).join(own, [*GROUP, *axis], "left_anti")
    blank = bands.select(*keys).distinct().join(lacking, GROUP).select(*keys, *axis, F.lit(float("nan")).alias("power"))
    return bands.select(*keys, *axis, "power").unionByName(blank).join(axes, [*CONTEXT, *axis])


def vectors(bands: DataFrame, keys: list[str], logged: bool, name: str = "x") -> DataFrame:
    """keys and the power vector in (phase, channel, band) order, on all axes
    of the context. keys: GROUP and more."""
    value = F.log1p("power").cast("float").cast("double") if logged else F.col("power")
    held = on_all_axes(bands, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(phase_order().alias("p"), F.col("ch_pos").alias("c"), F.col("channel").alias("cn"), _band_order().alias("b"), value.alias("v")))).alias("_v"))
    return held.select(*keys, F.transform("_v", lambda e: e["v"]).alias(name))


def control_scores(subject_bands: DataFrame) -> DataFrame:
    """GROUP with n_subjects, within (on log powers), rest, strongest,
    strongest_label, margin (between labels on raw powers, on the axes that
    both have)."""
    keys = [*GROUP, "subject_id"]
    inside, across = (similarity.pair_totals(vectors(subject_bands, keys, logged), GROUP, "subject_id", "x") for logged in (True, False))
    within = similarity.within(inside, GROUP).withColumnRenamed("n", "n_subjects")
    return similarity.control_margin(within, similarity.between(across, CONTEXT, "target_label"), CONTEXT, "target_label")


def difference_map(subject_bands: DataFrame) -> DataFrame:
    """GROUP, phase, channel, ch_pos, band, power, rest, difference: a label's
    mean power against the mean of the other labels of its context that have
    the axis; against nothing if no label has any."""
    axis = ["phase", "channel", "band"]
    means = subject_bands.groupBy(*GROUP, *axis, "ch_pos").agg(F.avg("power").alias("power"))
    over = Window.partitionBy(*CONTEXT, *axis)
    good = F.when(~F.isnan("power"), F.col("power"))
    others = F.count(good).over(over) - F.count(good).over(Window.partitionBy(*GROUP, *axis))
    rest = F.when(others > 0, (F.sum(good).over(over) - F.coalesce(good, F.lit(0.0))) / others)
    return means.withColumn("rest", rest).withColumn("_any", F.max(F.col("rest").isNotNull()).over(Window.partitionBy(*GROUP))).select(
        *GROUP, *axis, "ch_pos", "power", "rest", F.when(F.col("_any"), F.col("power") - F.col("rest")).otherwise(F.col("power")).alias("difference")
    )


def dominant_axes(difference: DataFrame) -> DataFrame:
    """GROUP with dominant_bands, dominant_channels, strongest_phases."""
    positions = difference.select(*GROUP, F.lit("channel").alias("axis"), F.col("channel").alias("name"), F.col("ch_pos").alias("_at")).distinct()
    scores = spectral.marginals(difference.withColumn("difference", F.coalesce("difference", F.lit(float("nan")))), GROUP).join(positions, [*GROUP, "axis", "name"], "left")
    band = F.array_position(F.array(*[F.lit(b[0]) for b in spectral.BANDS]), F.col("name"))
    phase = F.array_position(F.array(*map(F.lit, PHASES)), F.col("name"))
    scores = scores.withColumn("_at", F.when(F.col("axis") == "band", band).when(F.col("axis") == "phase", phase).otherwise(F.col("_at")))
    top = spectral.dominant(scores, GROUP, "_at")
    held = top.groupBy(*GROUP, "axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]).alias("names"))
    pick = lambda a: F.max(F.when(F.col("axis") == a, F.col("names")))
    return held.groupBy(*GROUP).agg(pick("band").alias("dominant_bands"), pick("channel").alias("dominant_channels"), pick("phase").alias("strongest_phases"))


#: The sentence of a candidate; of each list so many names are
#: said, and if it is empty the words after that.
SIGNATURE = "shared %s structure centered on %s across %s during %s"
SIGNATURE_PARTS = (("dominant_bands", 2, "unspecified bands"), ("dominant_channels", 4, "unspecified channels"), ("strongest_phases", 2, "unspecified phases"))


def signature():
    """The sentence of a candidate."""
    said = [F.coalesce(F.nullif(F.array_join(F.slice(name, 1, most), ", "), F.lit("")), F.lit(none)) for name, most, none in SIGNATURE_PARTS]
    return F.format_string(SIGNATURE, "target_label", *said)


def _flat(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and all phases and channels as one vector."""
    held = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(phase_order().alias("p"), F.col("ch_pos").alias("c"), F.col("channel").alias("n"), F.col("samples").alias("s")))).alias("_v"))
    return held.select(*keys, F.flatten(F.transform("_v", lambda e: e["s"])).alias(name))


def exemplar_events(al: DataFrame, group_prototype: DataFrame, most: int) -> DataFrame:
    """GROUP, subject_id, recording_id, event_id, similarity, rank."""
    events = _flat(al, [*GROUP, "subject_id", *_EVENT, "obs_idx"], "x")
    met = events.join(_flat(group_prototype, GROUP, "proto"), GROUP)
    scored = met.select(*GROUP, "subject_id", *_EVENT, "obs_idx", safe_corr("x", "proto").alias("similarity"))
    return similarity.exemplars(scored, GROUP, "subject_id", "obs_idx", "similarity", most).drop("obs_idx")


def branch_agreement(profiles: DataFrame, label: list[str], branch: str, vector: str) -> DataFrame:
    """label, branch, reference, similarity, margin, status, overall: every
    branch of a label against its reference branch (raw_preserving, else
    source_epoch, else the largest margin). A label of one branch gives none.
    profiles: label, branch, vector, margin."""
    first = F.when(F.col(branch) == "raw_preserving", 0).when(F.col(branch) == "source_epoch", 1).otherwise(2)
    order = Window.partitionBy(*label).orderBy(first, F.col("margin").desc_nulls_last(), branch)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = profiles.withColumns(
        {"_n": F.count("*").over(Window.partitionBy(*label)), "reference": F.first(branch).over(whole), "_rv": F.first(vector).over(whole), "_rm": F.first("margin").over(whole)}
    ).filter("_n > 1")
    met = met.withColumn("similarity", safe_corr(vector, "_rv"))
    met = met.withColumn("status", decisions.branch_status(F.col(branch) == F.col("reference"), F.col("similarity"), F.col("margin"), F.col("_rm")))
    worst = F.max_by("status", severity("status")).over(Window.partitionBy(*label))
    return met.withColumn("overall", worst).select(*label, branch, "reference", "similarity", "margin", "status", "overall")


def phase_band_means(subject_bands: DataFrame) -> DataFrame:
    """GROUP, phase, band, power: means over subjects, then channels."""
    means = subject_bands.groupBy(*GROUP, "phase", "channel", "band").agg(F.avg("power").alias("power"))
    return means.groupBy(*GROUP, "phase", "band").agg(F.avg("power").alias("power"))


def branch_profiles(subject_bands: DataFrame, margins: DataFrame) -> DataFrame:
    """GROUP, profile (phase x band means on the axes that any branch of a
    label has, NaN where its own lacks one), margin."""
    label = ["label_namespace", "event_family", "target_label"]
    means = phase_band_means(subject_bands)
    axes = means.select(*label, "phase", "band").distinct()
    full = means.select(*GROUP).distinct().join(axes, label).join(means, [*GROUP, "phase", "band"], "left")
    held = full.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct(phase_order().alias("p"), _band_order().alias("b"), F.coalesce("power", F.lit(float("nan"))).alias("v")))).alias("_v"))
    return held.select(*GROUP, F.transform("_v", lambda e: e["v"]).alias("profile")).join(margins.select(*GROUP, "margin"), GROUP)


def topography(difference: DataFrame) -> DataFrame:
    """GROUP, phase, channel, ch_pos, band, mean, rest, difference, and the
    profiles channel_mean (over bands) and band_mean (over channels), NaN
    skipped. difference: of ``difference_map``."""
    good = F.when(~F.isnan("power"), F.col("power"))
    over = lambda axis: F.avg(good).over(Window.partitionBy(*GROUP, "phase", axis))
    return difference.select(*GROUP, "phase", "channel", "ch_pos", "band", F.col("power").alias("mean"), "rest", "difference", over("channel").alias("channel_mean"), over("band").alias("band_mean"))


def described(al: DataFrame) -> DataFrame:
    """GROUP with the subjects, subtypes, axes and rate of its observations."""
    listed = lambda c: F.array_sort(F.collect_set(F.nullif(c, F.lit(""))))
    return al.groupBy(*GROUP).agg(
        listed("subject_id").alias("subject_ids"), listed("event_subtype").alias("event_subtypes"), F.array_sort(F.collect_set("phase")).alias("phases"), F.array_sort(F.collect_set("channel")).alias("channels"),
        F.first("sampling_rate_hz").alias("sampling_rate_hz"),
    )


def report():
    """The readable side of a candidate."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    number = lambda c: F.coalesce(F.format_number(c, 4), F.lit("none"))
    lines = [
        F.concat(F.lit("# "), F.col("pattern_id")), F.lit(""), F.col("signature"), F.lit(""), F.concat(F.lit("- label: "), F.col("target_label")), F.concat(F.lit("- branch: "), F.col("branch_name")),
        F.concat(F.lit("- subjects: "), F.col("n_subjects")), F.concat(F.lit("- events: "), F.col("n_events")), F.concat(F.lit("- bands: "), listed("dominant_bands")), F.concat(F.lit("- channels: "), listed("dominant_channels")),
        F.concat(F.lit("- phases: "), listed("strongest_phases")), F.concat(F.lit("- within: "), number("within")), F.concat(F.lit("- rest: "), number("rest")), F.concat(F.lit("- margin: "), number("margin")),
        F.concat(F.lit("- strongest control: "), F.coalesce("strongest_label", F.lit("none"))), F.concat(F.lit("- branch agreement: "), F.coalesce("branch_status", F.lit("one branch"))), F.concat(F.lit("- tier: "), F.coalesce("tier", F.lit("none"))),
    ]
    return F.concat_ws("\n", *lines)


def assess(observations: DataFrame, subject_bands: DataFrame, margins: DataFrame, agreement: DataFrame, seed: int = 0, null_iterations: int = 64, subsample_iterations: int = 32) -> DataFrame:
    """GROUP with holdout, null and subsample figures, flags, robustness,
    fragility and tier."""
    held = observations.groupBy(*GROUP, "subject_id").agg(
        F.max_by(F.nullif("session_id", F.lit("")), F.when(F.nullif("session_id", F.lit("")).isNotNull(), F.col("obs_idx"))).alias("session_id"),
        F.max_by(F.nullif("cohort_label", F.lit("")), F.when(F.nullif("cohort_label", F.lit("")).isNotNull(), F.col("obs_idx"))).alias("cohort_label"),
    )
    events = observations.groupBy(*GROUP).agg(F.count_distinct(*_EVENT).alias("n_events"))
    x = vectors(subject_bands, [*GROUP, "subject_id"], logged=True).join(held, [*GROUP, "subject_id"])
    loso = reliability.holdout_summary(reliability.leave_one_out(x, CONTEXT, "target_label", "subject_id"), GROUP).select(*GROUP, F.col("mean_margin").alias("loso_margin"), F.col("success_rate").alias("loso"))
    rate = lambda g, n: reliability.holdout_summary(reliability.grouped_holdout(x, CONTEXT, "target_label", g), GROUP).select(*GROUP, F.col("success_rate").alias(n), F.col("n").alias(f"{n}_groups"))
    null = reliability.label_shuffle_null(x, margins.select(*GROUP, "margin"), "target_label", ["target_label", "subject_id"], null_iterations, seed, CONTEXT)
    sub = reliability.subsample_stability(x, GROUP, "subject_id", subsample_iterations, seed=seed + 1009).drop("iterations")
    overall = agreement.select(*GROUP, F.col("overall").alias("branch_status"))
    met = margins.select(*GROUP, "n_subjects", "margin").join(events, GROUP)
    for part in (loso, rate("session_id", "session"), rate("cohort_label", "cohort"), null, sub, overall):
        met = met.join(part, GROUP, "left")
    c = F.col
    flags = decisions.reliability_flags(c("n_subjects"), c("n_events"), c("margin"), c("loso"), c("session"), c("cohort"), c("branch_status"), c("p_value"), c("min_similarity"))
    met = met.withColumn("flags", flags)
    met = met.withColumn("robustness", decisions.robustness(F.coalesce("branch_status", F.lit("none")), c("margin"), c("loso"), c("session"), c("cohort"), c("p_value"), c("mean_similarity")))
    met = met.withColumn("fragility", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - c("robustness"))))
    return met.withColumn("tier", decisions.tier(c("n_subjects"), c("n_events"), c("flags"), c("loso"), c("robustness"), c("margin")))
