"""Named queries over the standard tables, with their SQL twins.

``events`` stands for event tables (user = recording, type = label, value =
duration), ``embeddings`` for feature vectors (label, id) and, cut into four
channels of sixteen samples at 100 Hz, for epochs: the first four samples of a
channel are the baseline phase, the other twelve the onset phase.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decisions, expr, paths
from ..operators import backbone, checks, discovery, epochs, preprocess, reliability, similarity, spectral
from ..sources import events as event_source
from ..sources import recording_files, recordings
from ..sources.files import shared_dir
from . import models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RATE = 100.0
TOTAL = 2_592_000 * 100
WINDOWS = epochs.Windows(60.0, 30.0, 20.0, 60.0, None, epochs.Baseline(-45.0, -5.0))


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    """Rounded to six places, so that the order of summing doesn't show."""
    return F.round(c, 6).alias(name)


# -- stand-ins


def _onset(ts: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})") / F.lit(1e6)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("recording_id"), _onset().alias("onset_seconds"), F.col("value").alias("duration_seconds"), F.col("event_type").alias("target_label"))


_EVENTS = "ev AS (SELECT event_id, user_id AS recording_id, datediff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS onset_seconds, value AS duration_seconds, event_type AS target_label FROM events)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_VECTORS = "v AS (SELECT label, vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings)"
#: Vectors centred and divided by their norm.
_UNITS = (
    _VECTORS + ", c AS (SELECT label, id, x, list_transform(x, lambda e: e - list_avg(x)) AS d FROM v), "
    "u AS (SELECT label, id, x, CASE WHEN list_dot_product(d, d) > 0 THEN list_transform(d, lambda e: e / sqrt(list_dot_product(d, d))) ELSE list_transform(d, lambda e: 0.0::DOUBLE) END AS u FROM c)"
)
_SUMS = (
    _UNITS + ", p AS (SELECT label, id, unnest(u) AS v, generate_subscripts(u, 1) AS pos FROM u), ps AS (SELECT label, pos, sum(v) AS s FROM p GROUP BY ALL), "
    "n AS (SELECT label, count(*) AS n, sum(list_dot_product(u, u)) AS q FROM u GROUP BY label), "
    "wi AS (SELECT label, n, (sum(s * s) - any_value(q)) / (n * (n - 1)) AS within FROM ps JOIN n USING (label) GROUP BY label, n), "
    "bt AS (SELECT a.label, b.label AS other_label, sum(a.s * b.s) / (any_value(na.n) * any_value(nb.n)) AS similarity FROM ps a JOIN ps b ON a.pos = b.pos AND a.label <> b.label "
    "JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY a.label, b.label)"
)


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, phase, channel_idx, channel, samples, sampling_rate_hz."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    rows = e.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel_idx"), "embedding")
    cut = lambda a, n: F.slice("embedding", F.col("channel_idx") * 16 + 1 + a, n)
    phases = F.inline(F.array(F.struct(F.lit("baseline").alias("phase"), cut(0, 4).alias("samples")), F.struct(F.lit("onset").alias("phase"), cut(4, 12).alias("samples"))))
    return rows.select("event_id", "channel_idx", F.concat(F.lit("c"), F.col("channel_idx")).alias("channel"), phases).withColumn("sampling_rate_hz", F.lit(RATE))


_EPOCHS = (
    "ep AS (SELECT vec_id AS event_id, ch AS channel_idx, 'c' || ch AS channel, phase, CASE phase WHEN 'baseline' THEN embedding[ch * 16 + 1 : ch * 16 + 4] ELSE embedding[ch * 16 + 5 : ch * 16 + 16] END AS samples "
    "FROM embeddings, (SELECT unnest(range(4)) AS ch), (SELECT unnest(['baseline', 'onset']) AS phase))"
)
_LONG = _EPOCHS + ", lg AS (SELECT event_id, channel_idx, phase, unnest(samples) AS v, generate_subscripts(samples, 1) - 1 AS pos FROM ep)"


def _exploded(df: DataFrame) -> DataFrame:
    """event_id, channel_idx, phase, pos, value: one row per sample."""
    return df.select("event_id", F.col("channel_idx").cast("int").alias("channel_idx"), "phase", F.posexplode("samples").alias("pos", "v")).select(
        "event_id", "channel_idx", "phase", F.col("pos").cast("int").alias("pos"), F.round(F.nanvl(F.col("v").cast("double"), F.lit(-999.0)), 5).alias("value")
    )


# -- events and epochs


@query(
    """WITH raw AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '  ' ELSE 'e' || event_id END AS given, 'rec_' || user_id AS recording_id, value, event_type, ts FROM events),
    named AS (SELECT *, CASE WHEN trim(given) = '' THEN recording_id || '_event_' || lpad(CAST(row_number() OVER (PARTITION BY recording_id ORDER BY ts, event_id) AS VARCHAR), 4, '0') ELSE given END AS id FROM raw)
    SELECT id AS event_id, recording_id, round(value, 6) AS onset_seconds, 0.0::DOUBLE AS duration_seconds, 'stream' AS event_family, event_type AS target_label, '' AS event_subtype, 'ns' AS label_namespace,
    row_number() OVER (PARTITION BY recording_id ORDER BY value, id) AS obs_idx FROM named"""
)
def event_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = e.select(
        F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.concat(F.lit("e"), F.col("event_id"))).alias("event_id"), F.concat(F.lit("rec_"), F.col("user_id")).alias("recording_id"),
        F.col("value").cast("string").alias("onset"), F.lit("stream").alias("family"), F.concat(F.lit(" "), F.col("event_type")).alias("label"), F.col("ts").alias("_ts"), F.col("event_id").alias("_n"),
    )
    out = event_source.normalise(raw, ["_ts", "_n"], label_namespace="ns").drop("metadata")
    return out.withColumn("onset_seconds", F.round("onset_seconds", 6))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def label_filter(spark, sf_dir):
    e = discovery.selected(table(spark, sf_dir, "events"), event_type=[" click", "view ", ""])
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


_REQUESTS = f"""rq AS (SELECT event_id, phase, a AS requested_start, b AS requested_end FROM (
    SELECT event_id, unnest(['pre_event', 'onset', 'sustained', 'offset', 'post_event', 'baseline']) AS phase, unnest([o - 60, o, ss, os, e, o - 45]) AS a, unnest([o, oe, greatest(ss, os), e, e + 60, o - 5]) AS b FROM (
    SELECT *, least(oe, e) AS ss FROM (SELECT event_id, onset_seconds AS o, onset_seconds + duration_seconds AS e,
    CASE WHEN duration_seconds > 0 THEN least(onset_seconds + duration_seconds, onset_seconds + 30) ELSE onset_seconds + 30 END AS oe,
    CASE WHEN duration_seconds > 0 THEN greatest(onset_seconds, onset_seconds + duration_seconds - 20) ELSE onset_seconds + duration_seconds - 20 END AS os FROM ev))))"""


@query(f"WITH {_EVENTS}, {_REQUESTS} SELECT event_id, phase, round(requested_start, 6) AS requested_start, round(requested_end, 6) AS requested_end FROM rq")
def phase_requests(spark, sf_dir):
    r = epochs.phase_requests(_events(spark, sf_dir), WINDOWS)
    return r.select("event_id", "phase", r6("requested_start", "requested_start"), r6("requested_end", "requested_end"))


@query(
    f"""WITH {_EVENTS}, {_REQUESTS}, g AS (SELECT *, greatest(0.0, requested_start) AS s, greatest(greatest(0.0, requested_start), CASE WHEN requested_end < requested_start THEN requested_start ELSE requested_end END) AS t FROM rq),
    h AS (SELECT *, greatest(0, least({TOTAL}, CAST(floor(s * 100.0::DOUBLE) AS BIGINT))) AS i, CASE WHEN requested_end < requested_start THEN requested_start ELSE requested_end END AS re FROM g),
    k AS (SELECT *, greatest(i, least({TOTAL}, CAST(ceil(t * 100.0::DOUBLE) AS BIGINT))) AS j FROM h)
    SELECT event_id, phase, CAST(i AS BIGINT) AS start_sample, CAST(j AS BIGINT) AS end_sample, CAST(j - i AS BIGINT) AS derived_samples,
    (requested_end < requested_start OR s <> requested_start OR t <> re OR (j = {TOTAL} AND re > {TOTAL} / 100.0)) AS clipped,
    CASE WHEN requested_end < requested_start THEN phase || ' requested end preceded start; collapsed to zero-length' WHEN s <> requested_start OR t <> re THEN phase || ' window was clipped to the recording bounds'
    WHEN j = {TOTAL} AND re > {TOTAL} / 100.0 THEN phase || ' window exceeded the recording duration and was clipped' ELSE '' END AS warning FROM k"""
)
def phase_clamp(spark, sf_dir):
    r = epochs.sample_range(epochs.phase_requests(_events(spark, sf_dir), WINDOWS), F.lit(RATE), F.lit(TOTAL))
    return r.select("event_id", "phase", "start_sample", "end_sample", "derived_samples", "clipped", "warning")


@query(
    f"""WITH {_EVENTS} SELECT a.event_id, count(*) AS n, round(avg(p.duration_seconds), 6) AS mean_value FROM ev a JOIN ev p ON a.recording_id = p.recording_id
    AND p.onset_seconds >= a.onset_seconds - 86400 AND p.onset_seconds < a.onset_seconds + 86400 WHERE a.target_label = 'purchase' GROUP BY a.event_id"""
)
def epoch_interval_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    anchors = e.filter("target_label = 'purchase'").select(F.col("event_id").alias("anchor"), "recording_id", (F.col("onset_seconds") - 86400).alias("s"), (F.col("onset_seconds") + 86400).alias("e"))
    met = epochs.interval_join(e.select("recording_id", "onset_seconds", "duration_seconds"), anchors, "recording_id", "onset_seconds", "s", "e", 172800.0)
    return met.groupBy(F.col("anchor").alias("event_id")).agg(F.count("*").alias("n"), r6(F.avg("duration_seconds"), "mean_value"))


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT vec_id AS event_id, phase, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM x JOIN (SELECT unnest(['a', 'b', 'c']) AS phase, unnest([0, 10, 30]) AS s, unnest([20, 40, 64]) AS e) r ON x.i >= r.s AND x.i < r.e GROUP BY ALL"""
)
def epoch_slices(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    chunk = 16  # channels come in chunks; ranges go over their edges
    signals = v.select(F.col("vec_id").alias("recording_id"), F.lit(0).alias("channel_idx"), F.lit("c").alias("channel"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * chunk + 1, chunk))).alias("chunk_id", "samples"))
    signals = signals.withColumn("chunk_id", F.col("chunk_id").cast("long"))
    ranges = v.select(F.col("vec_id").alias("recording_id"), F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(a).cast("long").alias("start_sample"), F.lit(b).cast("long").alias("end_sample")) for p, a, b in (("a", 0, 20), ("b", 10, 40), ("c", 30, 64))])))
    out = epochs.epochs(signals, ranges, chunk)
    return out.select(F.col("recording_id").alias("event_id"), "phase", F.size("samples").cast("long").alias("n"), F.round(expr.array_sum(F.transform("samples", lambda s: s.cast("double"))), 5).alias("total"))


@query(
    """WITH x AS (SELECT vec_id // 256 AS block, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
    SELECT 'block_' || block AS recording_id, 'd' || k AS channel, CAST(count(*) AS BIGINT) AS n, CAST((count(*) + 99) // 100 AS BIGINT) AS chunks,
    round(sum(CASE WHEN block % 2 = 0 THEN CAST(round((greatest(-1.0, least(1.0, CAST(v AS DOUBLE))) + 1) / 2 * 65534 - 32767) / 32767 AS DOUBLE) ELSE v END), 3) AS total FROM x GROUP BY block, k"""
)
def recording_scan(spark, sf_dir):
    """Vectors as files of 256 samples, EDF and NPZ in turn, read again in ranges."""
    at = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"

    def write(key, rows):
        rows = rows.sort_values("vec_id")
        data = np.stack(rows["embedding"].tolist()).T.astype(np.float32)
        names = [f"d{k}" for k in range(len(data))]
        edf = key[0] % 2 == 0
        content = recording_files.edf_bytes(names, RATE, data) if edf else recording_files.npz_bytes(names, RATE, data)
        recording_files.write_bytes(f"{at}/block_{key[0]}.{'edf' if edf else 'npz'}", content)
        return pd.DataFrame({"n": [data.shape[1]]})

    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("vec_id div 256").alias("block"))
    v.groupBy("block").applyInPandas(write, "n int").agg(F.sum("n")).collect()  # 256 ids a group
    signals = recordings.read_signals(spark, at, chunk=100, range_bytes=16384)
    total = expr.array_sum(F.transform("samples", lambda x: x.cast("double")))
    return signals.groupBy("recording_id", "channel").agg(F.sum(F.size("samples")).cast("long").alias("n"), F.count("*").alias("chunks"), F.round(F.sum(total), 3).alias("total"))


# -- preprocessing


def _branch(spark, sf_dir, **options):
    return preprocess.preprocess(_epochs(spark, sf_dir), preprocess.Branch("branch", **options), ["event_id"])


@query(
    f"WITH {_LONG}, b AS (SELECT event_id, channel_idx, avg(CAST(v AS DOUBLE)) AS m FROM lg WHERE phase = 'baseline' GROUP BY ALL) "
    "SELECT event_id, CAST(channel_idx AS INT) AS channel_idx, phase, CAST(pos AS INT) AS pos, round(CAST(CAST(v - m AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM lg JOIN b USING (event_id, channel_idx)"
)
def baseline_subtract(spark, sf_dir):
    return _exploded(_branch(spark, sf_dir, baseline="subtract_mean"))


@query(
    f"WITH {_LONG}, t AS (SELECT unnest(['c2', 'c9', 'c0']) AS channel, unnest([0, 1, 2]) AS k), w AS (SELECT DISTINCT event_id, phase, pos FROM lg) "
    "SELECT w.event_id, CAST(k AS INT) AS channel_idx, w.phase, CAST(w.pos AS INT) AS pos, round(coalesce(CAST(v AS DOUBLE), -999.0), 5) + 0.0::DOUBLE AS value FROM w CROSS JOIN t "
    "LEFT JOIN lg ON lg.event_id = w.event_id AND lg.phase = w.phase AND lg.pos = w.pos AND 'c' || lg.channel_idx = t.channel"
)
def channel_align(spark, sf_dir):
    return _exploded(_branch(spark, sf_dir, align_channels=("c2", "c9", "c0")))


@query(
    f"WITH {_EPOCHS}, c AS (SELECT event_id, list_sort(list(DISTINCT channel)) AS ch FROM (SELECT event_id, CASE WHEN channel_idx >= 2 + event_id % 3 THEN 'x' || channel_idx ELSE channel END AS channel FROM ep) GROUP BY event_id) "
    "SELECT event_id, array_to_string(list_filter(['c0', 'c2', 'c9', 'c2'], lambda x: NOT list_contains(ch, x)), ',') AS missing, array_to_string(list_filter(ch, lambda x: NOT list_contains(['c0', 'c2', 'c9'], x)), ',') AS dropped, 'c2' AS reused FROM c".replace(
        "list_filter(['c0', 'c2', 'c9', 'c2'], lambda x:", "list_filter(['c0', 'c2', 'c9'], lambda x:"
    )
)
def channel_remap_report(spark, sf_dir):
    renamed = F.when(F.col("channel_idx") >= 2 + F.col("event_id") % 3, F.concat(F.lit("x"), F.col("channel_idx"))).otherwise(F.col("channel"))
    held = _epochs(spark, sf_dir).withColumn("channel", renamed).groupBy("event_id").agg(F.array_sort(F.collect_set("channel")).alias("ch"))
    report = preprocess.remap_report(F.col("ch"), F.array(*map(F.lit, ("c0", "c2", "c9", "c2"))))
    return held.select("event_id", report.alias("r")).select("event_id", *[F.array_join(f"r.{k}", ",").alias(k) for k in ("missing", "dropped", "reused")])


@query(
    f"WITH {_LONG}, m AS (SELECT event_id, phase, pos, avg(CAST(v AS DOUBLE)) AS m FROM lg GROUP BY ALL) "
    "SELECT event_id, CAST(channel_idx AS INT) AS channel_idx, phase, CAST(pos AS INT) AS pos, round(CAST(CAST(v - m AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM lg JOIN m USING (event_id, phase, pos)"
)
def average_reference(spark, sf_dir):
    return _exploded(_branch(spark, sf_dir, rereference="average"))


@query(
    f"WITH {_LONG}, m AS (SELECT event_id, phase, pos, avg(CAST(v AS DOUBLE)) AS m FROM lg WHERE channel_idx IN (1, 3) GROUP BY ALL) "
    "SELECT event_id, CAST(channel_idx AS INT) AS channel_idx, phase, CAST(pos AS INT) AS pos, round(CAST(CAST(v - m AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM lg JOIN m USING (event_id, phase, pos)"
)
def channel_reference(spark, sf_dir):
    return _exploded(_branch(spark, sf_dir, rereference="channels", reference_channels=("c1", "c3", "c7")))


@query(f"WITH {_LONG} SELECT event_id, CAST(channel_idx AS INT) AS channel_idx, phase, CAST(pos AS INT) AS pos, round(CAST(CAST(v * 2.5::DOUBLE AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM lg")
def scale_signal(spark, sf_dir):
    return _exploded(_branch(spark, sf_dir, scale=2.5))


@query(
    f"WITH {_EPOCHS}, g AS (SELECT *, len(samples) AS n, CAST(round_even(len(samples) / 100.0::DOUBLE * 80.0, 0) AS INT) AS m FROM ep), k AS (SELECT event_id, channel_idx, phase, samples, n, unnest(range(m)) AS k, m FROM g), "
    "f AS (SELECT *, least(k * n / m::DOUBLE, n - 1) AS t FROM k), h AS (SELECT *, CAST(floor(t) AS INT) AS lo FROM f) SELECT event_id, CAST(channel_idx AS INT) AS channel_idx, phase, CAST(k AS INT) AS pos, "
    "round(CAST(CAST(samples[lo + 1] + CAST(samples[least(lo + 1, n - 1) + 1] - samples[lo + 1] AS DOUBLE) * (t - lo) AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM h"
)
def resample_linear(spark, sf_dir):
    return _exploded(_branch(spark, sf_dir, resample_hz=80.0))


@query(
    "WITH k AS (SELECT vec_id AS id, embedding AS s, unnest(range(100)) AS k FROM embeddings), f AS (SELECT *, k * 63.0::DOUBLE / 99.0 AS t0 FROM k), f2 AS (SELECT *, least(k * (63.0::DOUBLE / 99.0), 63.0) AS t FROM f), "
    "h AS (SELECT *, CAST(floor(t) AS INT) AS lo FROM f2) SELECT id, CAST(k AS INT) AS pos, round(CAST(CAST(s[lo + 1] + CAST(s[least(lo + 1, 63) + 1] - s[lo + 1] AS DOUBLE) * (t - lo) AS FLOAT) AS DOUBLE), 5) + 0.0::DOUBLE AS value FROM h"
)
def resample_inclusive(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(expr.resample_inclusive("embedding", 100)).alias("pos", "v"))
    return out.select("id", F.col("pos").cast("int").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("value"))


@query(
    # 12 samples at 100 Hz: bins of 8 1/3 Hz; the notch at 17 Hz takes bin 2. The rest is x minus that bin's part.
    f"WITH {_LONG}, o AS (SELECT event_id, channel_idx, pos, CAST(v AS DOUBLE) AS v FROM lg WHERE phase = 'onset'), "
    "d AS (SELECT event_id, channel_idx, sum(v * cos(2 * pi() * 2 * pos / 12)) AS re, sum(v * sin(2 * pi() * 2 * pos / 12)) AS im FROM o GROUP BY ALL) "
    "SELECT CAST(channel_idx AS INT) AS channel_idx, CAST(pos AS INT) AS pos, round(avg(v - 2.0 / 12 * (re * cos(2 * pi() * 2 * pos / 12) + im * sin(2 * pi() * 2 * pos / 12))), 4) + 0.0::DOUBLE AS value FROM o JOIN d USING (event_id, channel_idx) GROUP BY ALL"
)
def notch_filter(spark, sf_dir):
    out = _branch(spark, sf_dir, notch_hz=(17.0,)).filter("phase = 'onset'").select(F.col("channel_idx").cast("int").alias("channel_idx"), F.posexplode("samples").alias("pos", "v"))
    return out.groupBy("channel_idx", F.col("pos").cast("int").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 4).alias("value"))


# -- prototypes and spectra


def _prototypes(spark, sf_dir):
    """Of whole vectors as one channel's phase, three subjects a label."""
    v = table(spark, sf_dir, "embeddings")
    al = v.select(F.lit("ns").alias("label_namespace"), F.lit("f").alias("event_family"), F.lit("b").alias("branch_name"), F.col("label").alias("target_label"), (F.col("vec_id") % 3).alias("subject_id"), F.lit("onset").alias("phase"), F.lit("c0").alias("channel"), F.lit(0).alias("ch_pos"), F.lit(RATE).alias("sampling_rate_hz"), F.col("embedding").alias("samples"))
    return tuple(p.withColumnsRenamed({"target_label": "label", "subject_id": "subject"}) for p in discovery.prototypes(al))


def _positions(df: DataFrame, *keys: str) -> DataFrame:
    at = df.select(*keys, F.posexplode("samples").alias("pos", "v"))
    return at.select(*keys, F.col("pos").cast("int").alias("pos"), (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("value"))


@query(
    "WITH x AS (SELECT label, vec_id % 3 AS subject, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(subject AS BIGINT) AS subject, CAST(pos AS INT) AS pos, round(CAST(CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) + 0.0::DOUBLE AS value FROM x GROUP BY ALL"
)
def subject_prototype(spark, sf_dir):
    return _positions(_prototypes(spark, sf_dir)[0], "label", "subject")


@query(
    "WITH x AS (SELECT label, vec_id % 3 AS subject, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), s AS (SELECT label, subject, pos, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS m FROM x GROUP BY ALL) "
    "SELECT label, CAST(pos AS INT) AS pos, round(CAST(CAST(avg(CAST(m AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) + 0.0::DOUBLE AS value FROM s GROUP BY ALL"
)
def group_prototype(spark, sf_dir):
    return _positions(_prototypes(spark, sf_dir)[1], "label")


_DFT = (
    "b AS (SELECT unnest(range(33)) AS k), bn AS (SELECT k, name FROM b JOIN (SELECT unnest(['delta', 'theta', 'alpha', 'beta', 'gamma']) AS name, unnest([1.0, 4, 8, 13, 30]) AS lo, unnest([4.0, 8, 13, 30, 45]) AS hi) z ON k * 100.0 / 64 >= lo AND k * 100.0 / 64 < hi), "
    "x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), "
    "d AS (SELECT vec_id, label, name, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, sum(v * sin(2 * pi() * k * i / 64)) AS im FROM x CROSS JOIN bn GROUP BY ALL), "
    "bp AS (SELECT vec_id AS id, label, name AS band, avg(re * re + im * im) AS power FROM d GROUP BY ALL)"
)


@query(f"WITH {_DFT} SELECT id, band, round(power, 5) AS power FROM bp")
def bandpower(spark, sf_dir):
    """By FFT in Arrow batches; the twin is a relational transform."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), spectral.band_power(F.col("embedding"), F.lit(RATE)).alias("b"))
    return v.select("id", F.inline("b")).select("id", "band", F.round("power", 5).alias("power"))


@query(f"WITH {_DFT} SELECT id, band, round(power, 5) AS power FROM bp")
def bandpower_relational(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return spectral.relational_band_power(v, "id", "embedding", RATE, 64).select("id", "band", F.round("power", 5).alias("power"))


def _band_rows(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), spectral.band_power(F.col("embedding"), F.lit(RATE)).alias("b"))
    return v.select("label", "id", F.inline("b"))


def _subject_bands(spark, sf_dir):
    """Band rows of a run, each vector a subject's onset on one channel."""
    rows = _band_rows(spark, sf_dir)
    return rows.select(
        F.lit("ns").alias("label_namespace"), F.lit("f").alias("event_family"), F.lit("b").alias("branch_name"), F.col("label").alias("target_label"), F.col("id").alias("subject_id"),
        F.lit("onset").alias("phase"), F.lit("c0").alias("channel"), F.lit(0).alias("ch_pos"), "band", "power",
    )


@query(f"WITH {_DFT} SELECT label, band, round(avg(power), 5) AS power FROM bp GROUP BY ALL")
def profile_matrix(spark, sf_dir):
    return discovery.phase_band_means(_subject_bands(spark, sf_dir)).select(F.col("target_label").alias("label"), "band", F.round("power", 5).alias("power"))


@query(
    f"WITH {_DFT}, m AS (SELECT label, band, avg(power) AS power FROM bp GROUP BY ALL), t AS (SELECT a.label, a.band, any_value(a.power) - avg(b.power) AS score FROM m a JOIN m b ON a.band = b.band AND a.label <> b.label GROUP BY a.label, a.band) "
    "SELECT label, band, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, band DESC) AS rank FROM t) WHERE rank <= 3"
)
def dominant_bands(spark, sf_dir):
    difference = discovery.difference_map(_subject_bands(spark, sf_dir))
    scores = spectral.marginals(difference, ["target_label"]).filter("axis = 'band'")
    out = spectral.dominant(scores, ["target_label"], "name")
    return out.select(F.col("target_label").alias("label"), F.col("name").alias("band"), F.round("score", 5).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    f"WITH {_DFT}, m AS (SELECT label, band, 'c' || label % 3 AS ch, avg(power) AS power FROM bp GROUP BY ALL), t AS (SELECT label, ch, band, power, power - (SELECT avg(o.power) FROM m o WHERE o.band = m.band AND o.ch = m.ch AND o.label <> m.label) AS difference FROM m) "
    "SELECT label, ch AS channel, band, round(power, 5) AS mean, round(difference, 5) AS difference, round(avg(power) OVER (PARTITION BY label, ch), 5) AS channel_mean, round(avg(power) OVER (PARTITION BY label, band), 5) AS band_mean FROM t"
)
def topography_profiles(spark, sf_dir):
    """Three channels, each of which some labels have: differences are to the
    labels that share one."""
    bands = _subject_bands(spark, sf_dir).withColumn("channel", F.concat(F.lit("c"), F.col("target_label") % 3))
    out = discovery.topography(discovery.difference_map(bands))
    return out.select(F.col("target_label").alias("label"), "channel", "band", *[F.round(c, 5).alias(c) for c in ("mean", "difference", "channel_mean", "band_mean")])


@query(
    "SELECT axis, name, round(score, 6) AS score FROM (SELECT CASE WHEN grouping(event_type) = 0 THEN 'band' WHEN grouping(ch) = 0 THEN 'channel' ELSE 'phase' END AS axis, coalesce(event_type, ch, ph) AS name, avg(value) AS score "
    "FROM (SELECT event_type, 'c' || user_id % 4 AS ch, 'p' || event_id % 3 AS ph, value FROM events) GROUP BY GROUPING SETS ((event_type), (ch), (ph)))"
)
def marginal_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("band"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("channel"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("phase"), F.col("value").alias("difference"))
    return spectral.marginals(e, []).select("axis", "name", r6("score", "score"))


# -- similarity


@query(
    f"WITH {_UNITS} SELECT a.label, a.id AS a, b.id AS b, round(list_dot_product(a.u, b.u), 6) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.id < b.id"
)
def safe_corr_pairs(spark, sf_dir):
    return similarity.pairwise(_vectors(spark, sf_dir), ["label"], "id", "x", ordered=True, digits=6).select("label", "a", "b", "similarity")


@query(
    f"WITH {_UNITS} SELECT a.label, a.id AS a, b.id AS b, CASE WHEN a.id = b.id THEN 1.0 ELSE round(list_dot_product(a.u, b.u), 6) END AS similarity FROM u a JOIN u b ON a.label = b.label"
)
def similarity_matrix(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pairs = similarity.pairwise(v, ["label"], "id", "x", ordered=True, both=True, digits=6)
    return similarity.similarity_matrix(pairs, v, ["label"], "id", both=True).select("label", "a", "b", "similarity")


def _sums(spark, sf_dir):
    return similarity.pair_totals(_vectors(spark, sf_dir), ["label"], "id", "x")


@query(f"WITH {_SUMS} SELECT label, n, round(within, 6) AS within FROM wi")
def within_label_similarity(spark, sf_dir):
    return similarity.within(_sums(spark, sf_dir), ["label"]).select("label", "n", r6("within", "within"))


@query(f"WITH {_SUMS} SELECT label, other_label, round(similarity, 6) AS similarity FROM bt")
def cross_label_similarity(spark, sf_dir):
    return similarity.between(_sums(spark, sf_dir), [], "label").select("label", "other_label", r6("similarity", "similarity"))


def _margins(spark, sf_dir):
    s = _sums(spark, sf_dir)
    return similarity.control_margin(similarity.within(s, ["label"]), similarity.between(s, [], "label"), [], "label")


_MARGINS = _SUMS + ", mg AS (SELECT label, n, within, avg(similarity) AS rest, max(similarity) AS strongest, arg_max(other_label, similarity) AS strongest_label, within - avg(similarity) AS margin FROM wi JOIN bt USING (label) GROUP BY label, n, within)"


@query(f"WITH {_MARGINS} SELECT label, n, round(within, 6) AS within, round(rest, 6) AS rest, round(margin, 6) AS margin FROM mg")
def control_margin(spark, sf_dir):
    return _margins(spark, sf_dir).select("label", "n", r6("within", "within"), r6("rest", "rest"), r6("margin", "margin"))


@query(f"WITH {_MARGINS} SELECT label, strongest_label, round(strongest, 6) AS strongest FROM mg")
def strongest_control(spark, sf_dir):
    return _margins(spark, sf_dir).select("label", "strongest_label", r6("strongest", "strongest"))


#: Pairwise, over the positions that both have.
_LOST = (
    "v AS (SELECT label, vec_id AS id, list_transform(embedding, lambda e, i: CASE WHEN (label % 3 = 0 AND i IN (4, 8)) OR (vec_id % 50 = 7 AND i = 11) THEN NULL ELSE CAST(e AS DOUBLE) END) AS x FROM embeddings), "
    "pr AS (SELECT a.label AS la, b.label AS lb, list_filter(list_zip(a.x, b.x), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL) AS z FROM v a JOIN v b ON a.id < b.id), "
    "pm AS (SELECT la, lb, z, list_avg(list_transform(z, lambda p: p[1])) AS ma, list_avg(list_transform(z, lambda p: p[2])) AS mb FROM pr), "
    "pc AS (SELECT la, lb, list_sum(list_transform(z, lambda p: (p[1] - ma) * (p[2] - mb))) / sqrt(list_sum(list_transform(z, lambda p: (p[1] - ma) * (p[1] - ma))) * list_sum(list_transform(z, lambda p: (p[2] - mb) * (p[2] - mb)))) AS r FROM pm), "
    "wi AS (SELECT la AS label, avg(r) AS within FROM pc WHERE la = lb GROUP BY la), bt AS (SELECT label, other, avg(r) AS similarity FROM (SELECT la AS label, lb AS other, r FROM pc WHERE la <> lb UNION ALL SELECT lb, la, r FROM pc WHERE la <> lb) GROUP BY ALL)"
)


@query(f"WITH {_LOST} SELECT label, round(any_value(within), 6) AS within, round(avg(similarity), 6) AS rest, round(any_value(within) - avg(similarity), 6) AS margin FROM wi JOIN bt USING (label) GROUP BY label")
def control_margin_lost_values(spark, sf_dir):
    """Some labels lack two positions, some vectors another one."""
    gone = lambda i: ((F.col("label") % 3 == 0) & i.isin(3, 7)) | ((F.col("id") % 50 == 7) & (i == 10))
    v = _vectors(spark, sf_dir).withColumn("x", F.transform("x", lambda e, i: F.when(gone(i), F.lit(float("nan"))).otherwise(e)))
    s = similarity.pair_totals(v, ["label"], "id", "x")
    m = similarity.control_margin(similarity.within(s, ["label"]), similarity.between(s, [], "label"), [], "label")
    return m.select("label", *[r6(c, c) for c in ("within", "rest", "margin")])


#: corr(x, y) over lists in DuckDB.
_CORR = "list_dot_product(list_transform({a}, lambda e: e - list_avg({a})), list_transform({b}, lambda e: e - list_avg({b}))) / sqrt(list_dot_product(list_transform({a}, lambda e: e - list_avg({a})), list_transform({a}, lambda e: e - list_avg({a}))) * list_dot_product(list_transform({b}, lambda e: e - list_avg({b})), list_transform({b}, lambda e: e - list_avg({b}))))"
_CENTROIDS = _VECTORS + ", xp AS (SELECT label, id, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM v), ct AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(e) AS m FROM xp GROUP BY ALL) GROUP BY label)"


@query(f"WITH {_CENTROIDS} SELECT label, round(avg({_CORR.format(a='x', b='c')}), 6) AS consistency FROM v JOIN ct USING (label) GROUP BY label")
def subject_consistency(spark, sf_dir):
    return similarity.consistency(_vectors(spark, sf_dir), ["label"], "x").select("label", r6("consistency", "consistency"))


@query(
    f"WITH {_CENTROIDS}, s AS (SELECT label, id, id % 5 AS subject, round({_CORR.format(a='x', b='c')}, 9) AS sim FROM v JOIN ct USING (label)), b AS (SELECT *, row_number() OVER (PARTITION BY label, subject ORDER BY sim DESC, id) = 1 AS best FROM s), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY best DESC, CASE WHEN best THEN subject END, CASE WHEN NOT best THEN sim END DESC, id) AS rank FROM b) SELECT label, id, CAST(rank AS INT) AS rank FROM p WHERE rank <= 6"
)
def exemplar_selection(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    met = v.join(similarity.centroids(v, ["label"], "x"), "label").select("label", "id", (F.col("id") % 5).alias("subject"), F.round(expr.safe_corr("x", "centroid"), 9).alias("sim"))
    return similarity.exemplars(met, ["label"], "subject", "id", "sim", 6).select("label", "id", F.col("rank").cast("int").alias("rank"))


# -- reliability

_LOSO = (
    _CENTROIDS + ", sm AS (SELECT label, list(s ORDER BY pos) AS s, any_value(n) AS n FROM (SELECT label, pos, sum(e) AS s, count(*) AS n FROM xp GROUP BY ALL) GROUP BY label), "
    "r AS (SELECT v.label, v.id, x, n, list_transform(list_zip(s, x), lambda z: (z[1] - z[2]) / (n - 1)) AS rest FROM v JOIN sm USING (label)), "
    f"o AS (SELECT v.label, v.id, max({_CORR.format(a='v.x', b='ct.c')}) AS other FROM v JOIN ct ON v.label <> ct.label GROUP BY v.label, v.id), "
    f"lo AS (SELECT r.label, r.id, {_CORR.format(a='r.x', b='r.rest')} - o.other AS margin FROM r JOIN o USING (label, id) WHERE n >= 2)"
)


def _loso(spark, sf_dir):
    return reliability.leave_one_out(_vectors(spark, sf_dir), [], "label", "id")


@query(f"WITH {_LOSO} SELECT label, count(*) AS n, round(avg(margin), 6) AS mean_margin, round(min(margin), 6) AS min_margin, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM lo GROUP BY label")
def loso_holdout(spark, sf_dir):
    s = reliability.holdout_summary(_loso(spark, sf_dir), ["label"])
    return s.select("label", "n", *[r6(c, c) for c in ("mean_margin", "min_margin", "success_rate")])


def _held_groups(spark, sf_dir, k: int):
    v = _vectors(spark, sf_dir).withColumn("grp", F.concat(F.lit("g"), F.col("id") % k))
    return reliability.grouped_holdout(v, [], "label", "grp").select("label", "grp", r6("margin", "margin"))


def _held_sql(k: int) -> str:
    return (
        f"WITH {_CENTROIDS}, vg AS (SELECT *, 'g' || id % {k} AS grp FROM v), "
        "sm AS (SELECT label, list(s ORDER BY pos) AS s, any_value(n) AS n FROM (SELECT label, pos, sum(e) AS s, count(*) AS n FROM xp GROUP BY ALL) GROUP BY label), "
        f"xg AS (SELECT label, 'g' || id % {k} AS grp, pos, e FROM xp), sg AS (SELECT label, grp, list(s ORDER BY pos) AS p, any_value(m) AS m FROM (SELECT label, grp, pos, sum(e) AS s, count(*) AS m FROM xg GROUP BY ALL) GROUP BY ALL), "
        "rs AS (SELECT label, grp, list_transform(list_zip(s, p), lambda z: (z[1] - z[2]) / (n - m)) AS rest FROM sm JOIN sg USING (label) WHERE n > m), "
        f"ow AS (SELECT vg.label, vg.grp, avg({_CORR.format(a='x', b='rest')}) AS own FROM vg JOIN rs ON vg.label = rs.label AND vg.grp = rs.grp GROUP BY ALL), "
        f"ot AS (SELECT vg.label, vg.grp, max({_CORR.format(a='x', b='c')}) AS other FROM vg JOIN ct ON vg.label <> ct.label GROUP BY ALL) "
        "SELECT label, grp, round(own - other, 6) AS margin FROM ow JOIN ot USING (label, grp)"
    )


@query(_held_sql(2))
def session_holdout(spark, sf_dir):
    return _held_groups(spark, sf_dir, 2)


@query(_held_sql(3))
def cohort_holdout(spark, sf_dir):
    return _held_groups(spark, sf_dir, 3)


_NULL = (
    _MARGINS + ", it AS (SELECT unnest(range(1, 65)) AS iteration), rk AS (SELECT iteration, id, row_number() OVER (PARTITION BY iteration ORDER BY md5('0_' || iteration || '_' || id), id) AS rank FROM u CROSS JOIN it), "
    "sz AS (SELECT DISTINCT n AS k FROM n), al AS (SELECT pos, sum(v) AS a FROM p GROUP BY pos), tot AS (SELECT count(*) AS total FROM u), "
    "sk AS (SELECT iteration, k, pos, sum(v) AS s, sum(v * v) AS q FROM rk JOIN p USING (id) JOIN sz ON rk.rank <= sz.k GROUP BY ALL), "
    "nl AS (SELECT iteration, k, (sum(s * s) - sum(q)) / (k * (k - 1)) - sum(s * (a - s)) / (k * (any_value(total) - k)) AS nul FROM sk JOIN al USING (pos) CROSS JOIN tot GROUP BY iteration, k HAVING k >= 2)"
)


def _null(spark, sf_dir):
    return reliability.label_shuffle_null(_vectors(spark, sf_dir), _margins(spark, sf_dir).select("label", "margin"), "label", ["id"])


@query(
    f"WITH {_NULL} SELECT label, count(*) AS iterations, round(avg(nul), 6) AS null_mean, round(stddev_pop(nul), 6) AS null_std, round(quantile_cont(nul, 0.95), 6) AS null_p95, "
    "round((1 + count(*) FILTER (WHERE nul >= margin)) / (1.0 + count(*)), 6) AS p_value FROM mg JOIN nl ON nl.k = mg.n GROUP BY label"
)
def label_shuffle_null(spark, sf_dir):
    return _null(spark, sf_dir).select("label", "iterations", *[r6(c, c) for c in ("null_mean", "null_std", "null_p95", "p_value")])


@query(
    f"WITH {_CENTROIDS}, nn AS (SELECT label, count(*) AS n FROM v GROUP BY label), it AS (SELECT unnest(range(1, 33)) AS iteration), "
    "rk AS (SELECT label, iteration, id, n, row_number() OVER (PARTITION BY label, iteration ORDER BY md5('1009_' || iteration || '_' || id), id) AS rank FROM v JOIN nn USING (label) CROSS JOIN it), "
    "pt AS (SELECT label, iteration, list(s ORDER BY pos) AS s FROM (SELECT label, iteration, pos, sum(e) AS s FROM rk JOIN xp USING (label, id) WHERE rank <= greatest(2, ceil(n * 0.75::DOUBLE)) AND n >= 3 GROUP BY ALL) GROUP BY ALL) "
    f"SELECT label, round(avg({_CORR.format(a='s', b='c')}), 6) AS mean_similarity, round(min({_CORR.format(a='s', b='c')}), 6) AS min_similarity, count(*) AS iterations FROM pt JOIN ct USING (label) GROUP BY label"
)
def subsample_stability(spark, sf_dir):
    s = reliability.subsample_stability(_vectors(spark, sf_dir), ["label"], "id")
    return s.select("label", r6("mean_similarity", "mean_similarity"), r6("min_similarity", "min_similarity"), "iterations")


def _assessed(spark, sf_dir):
    """Margin, holdout, null, subsample and branch figures of each label with
    flags, robustness and tier."""
    margin = _margins(spark, sf_dir).select("label", "n", "margin")
    rate = lambda df, name: reliability.holdout_summary(df, ["label"]).select("label", F.col("success_rate").alias(name))
    met = margin
    for part in (
        rate(_loso(spark, sf_dir), "loso"), rate(_held_groups(spark, sf_dir, 2), "session"), rate(_held_groups(spark, sf_dir, 3), "cohort"), _null(spark, sf_dir).select("label", "p_value"),
        reliability.subsample_stability(_vectors(spark, sf_dir), ["label"], "id").drop("iterations"), _agreement(spark, sf_dir).groupBy("label").agg(F.first("overall").alias("branch")),
    ):
        met = met.join(part, "label", "left")
    c = F.col
    met = met.withColumn("flags", decisions.reliability_flags(c("n"), c("n"), c("margin"), c("loso"), c("session"), c("cohort"), c("branch"), c("p_value"), c("min_similarity")))
    met = met.withColumn("robustness", decisions.robustness(F.coalesce("branch", F.lit("none")), c("margin"), c("loso"), c("session"), c("cohort"), c("p_value"), c("mean_similarity")))
    return met.withColumn("tier", decisions.tier(c("n"), c("n"), c("flags"), c("loso"), c("robustness"), c("margin")))


_SUB = ORACLES["subsample_stability"].removeprefix(f"WITH {_CENTROIDS}, ").replace("round(avg(", "(avg(").replace("), 6) AS mean", ")) AS mean").replace("round(min(", "(min(").replace("), 6) AS min", ")) AS min")
_SUB_CTES, _SUB_SELECT = _SUB.rsplit(" SELECT label, (avg", 1)
#: Branches made of the vectors: as they are, shrunk with an offset, and every third component lost.
_BRANCHES = "br AS (SELECT label, id, b AS branch, CASE b WHEN 'raw_preserving' THEN x WHEN 'light_clean' THEN list_transform(x, lambda e: e * 0.5 + 1.0) ELSE list_transform(x, lambda e, i: CASE WHEN i % 3 = 1 THEN 0.0::DOUBLE ELSE e END) END AS x FROM v CROSS JOIN (SELECT unnest(['raw_preserving', 'light_clean', 'comparison_safe']) AS b))"


def _branch_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    made = F.array(
        F.struct(F.lit("raw_preserving").alias("branch"), F.col("x").alias("y")), F.struct(F.lit("light_clean").alias("branch"), F.transform("x", lambda e: e * 0.5 + 1.0).alias("y")),
        F.struct(F.lit("comparison_safe").alias("branch"), F.transform("x", lambda e, i: F.when(i % 3 == 0, 0.0).otherwise(e)).alias("y")),
    )
    return v.select("label", "id", F.inline(made)).withColumnRenamed("y", "x")


@query(
    f"WITH {_VECTORS}, {_BRANCHES}, c AS (SELECT *, list_transform(x, lambda e: e - list_avg(x)) AS d FROM br), uu AS (SELECT label, id, branch, list_transform(d, lambda e: e / sqrt(list_dot_product(d, d))) AS u FROM c), "
    "pp AS (SELECT label, branch, id, unnest(u) AS v, generate_subscripts(u, 1) AS pos FROM uu), ps AS (SELECT label, branch, pos, sum(v) AS s FROM pp GROUP BY ALL), nn AS (SELECT label, branch, count(*) AS n FROM uu GROUP BY ALL), "
    "wi AS (SELECT label, branch, n, (sum(s * s) - n) / (n * (n - 1)) AS within FROM ps JOIN nn USING (label, branch) GROUP BY label, branch, n), "
    "bt AS (SELECT a.label, a.branch, b.label AS ol, sum(a.s * b.s) / (any_value(na.n) * any_value(nb.n)) AS sim FROM ps a JOIN ps b ON a.branch = b.branch AND a.pos = b.pos AND a.label <> b.label JOIN nn na ON na.label = a.label AND na.branch = a.branch JOIN nn nb ON nb.label = b.label AND nb.branch = b.branch GROUP BY a.label, a.branch, b.label), "
    "mg AS (SELECT label, branch, within - avg(sim) AS margin FROM wi JOIN bt USING (label, branch) GROUP BY label, branch, within), "
    "xp AS (SELECT label, branch, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM br), ct AS (SELECT label, branch, list(m ORDER BY pos) AS c FROM (SELECT label, branch, pos, avg(e) AS m FROM xp GROUP BY ALL) GROUP BY ALL), "
    f"j AS (SELECT a.label, a.branch, {_CORR.format(a='a.c', b='r.c')} AS similarity, m.margin, mr.margin AS rm FROM ct a JOIN ct r ON r.label = a.label AND r.branch = 'raw_preserving' JOIN mg m ON m.label = a.label AND m.branch = a.branch JOIN mg mr ON mr.label = a.label AND mr.branch = 'raw_preserving'), "
    "k AS (SELECT *, CASE WHEN rm IS NULL OR rm = 0 THEN 1.0 WHEN margin IS NULL THEN 0.0 ELSE margin / rm END AS ratio FROM j) "
    "SELECT label, branch, round(similarity, 6) AS similarity, round(margin, 6) AS margin, CASE WHEN branch = 'raw_preserving' THEN 'preserved' WHEN similarity >= 0.8 AND ratio >= 0.8 THEN 'preserved' WHEN similarity >= 0.55 AND ratio >= 0.45 THEN 'weakened' WHEN similarity >= 0.35 AND ratio > 0.2 THEN 'shifted' ELSE 'branch-sensitive' END AS status FROM k"
)
def branch_agreement(spark, sf_dir):
    return _agreement(spark, sf_dir).select("label", "branch", r6("similarity", "similarity"), r6("margin", "margin"), "status")


def _agreement(spark, sf_dir):
    v = _branch_vectors(spark, sf_dir)
    sums = similarity.pair_totals(v, ["branch", "label"], "id", "x")
    margins = similarity.control_margin(similarity.within(sums, ["branch", "label"]), similarity.between(sums, ["branch"], "label"), ["branch"], "label")
    profiles = similarity.centroids(v, ["branch", "label"], "x").join(margins.select("branch", "label", "margin"), ["branch", "label"])
    return discovery.branch_agreement(profiles, ["label"], "branch", "centroid")


def _held_rate(k: int, name: str) -> str:
    return f"(SELECT label, avg(CASE WHEN margin > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS {name} FROM ({_held_sql(k)}) GROUP BY label)"


_P_VALUE = ORACLES["label_shuffle_null"].replace("round((1 + count(*) FILTER (WHERE nul >= margin)) / (1.0 + count(*)), 6)", "(1 + count(*) FILTER (WHERE nul >= margin)) / (1.0::DOUBLE + count(*))")
_CLIP = "least(1.0, greatest(0.0, {0}))"
_ASSESSED = (
    _MARGINS + ", " + _LOSO.removeprefix(_VECTORS + ", ") + ", " + _SUB_CTES + ", ss AS (SELECT label, (avg" + _SUB_SELECT + "), "
    f"lz AS (SELECT label, avg(CASE WHEN margin > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS loso FROM lo GROUP BY label), se AS {_held_rate(2, 'session')}, co AS {_held_rate(3, 'cohort')}, nu AS (SELECT label, p_value FROM ({_P_VALUE})), "
    f"ag AS (SELECT label, arg_max(status, CASE status WHEN 'preserved' THEN 0 WHEN 'weakened' THEN 1 WHEN 'shifted' THEN 2 ELSE 3 END) AS branch FROM ({ORACLES['branch_agreement']}) GROUP BY label), "
    "fa AS (SELECT mg.label, mg.n, margin, loso, session, cohort, p_value, branch, mean_similarity, min_similarity, list_filter([CASE WHEN mg.n < 3 OR mg.n < 4 THEN 'low-support' END, CASE WHEN NOT coalesce(margin > 0.05, false) THEN 'control-weak' END, CASE WHEN loso < 0.67 THEN 'holdout-weak' END, "
    "CASE WHEN session < 0.67 THEN 'session-holdout-weak' END, CASE WHEN cohort < 0.67 THEN 'cohort-holdout-weak' END, CASE WHEN branch IN ('shifted', 'branch-sensitive') THEN 'branch-sensitive' END, CASE WHEN coalesce(p_value >= 0.2, false) OR coalesce(min_similarity < 0.5, false) THEN 'unstable' END], lambda x: x IS NOT NULL) AS flags, "
    f"(CASE branch WHEN 'preserved' THEN 1.0 WHEN 'weakened' THEN 0.7 WHEN 'shifted' THEN 0.4 WHEN 'branch-sensitive' THEN 0.1 ELSE 0.5 END + {_CLIP.format('(coalesce(margin, 0.0) + 0.2) / 0.4')} + coalesce(loso, 0.0) + coalesce(session, 0.5) + coalesce(cohort, 0.5) + coalesce({_CLIP.format('1.0 - p_value')}, 0.5) + coalesce({_CLIP.format('mean_similarity')}, 0.5)) / 7 AS robustness "
    "FROM mg LEFT JOIN lz USING (label) LEFT JOIN se USING (label) LEFT JOIN co USING (label) LEFT JOIN nu USING (label) LEFT JOIN ag USING (label) LEFT JOIN ss USING (label)), "
    "ti AS (SELECT *, CASE WHEN n < 2 THEN 'insufficient' WHEN list_contains(flags, 'unstable') OR coalesce(loso < 0.5, false) THEN 'unstable' WHEN len(flags) = 0 AND robustness >= 0.78 THEN 'strong' WHEN coalesce(margin > 0.08, false) AND robustness >= 0.58 THEN 'moderate' ELSE 'exploratory' END AS tier FROM fa)"
)


@query(f"WITH {_ASSESSED} SELECT label, array_to_string(flags, ',') AS flags, round(robustness, 6) AS robustness, tier FROM ti")
def reliability_tier(spark, sf_dir):
    return _assessed(spark, sf_dir).select("label", F.array_join("flags", ",").alias("flags"), r6("robustness", "robustness"), "tier")


# -- model evidence

#: Two stand-in models: means and deviations of eight parts, and the first half.
_MODELS = (
    "em AS (SELECT label, id, 'pool' AS model, list_transform(range(8), lambda k: list_avg(x[k * 8 + 1 : k * 8 + 8])) AS x FROM v UNION ALL SELECT label, id, 'head' AS model, x[1:32] AS x FROM v), "
    "mc AS (SELECT *, list_transform(x, lambda e: e - list_avg(x)) AS d FROM em), mu AS (SELECT label, id, model, CASE WHEN list_dot_product(d, d) > 0 THEN list_transform(d, lambda e: e / sqrt(list_dot_product(d, d))) ELSE list_transform(d, lambda e: 0.0::DOUBLE) END AS u FROM mc), "
    "mp AS (SELECT label, model, unnest(u) AS v, generate_subscripts(u, 1) AS pos FROM mu), mps AS (SELECT label, model, pos, sum(v) AS s FROM mp GROUP BY ALL), mn AS (SELECT label, model, count(*) AS n, sum(list_dot_product(u, u)) AS q FROM mu GROUP BY ALL), "
    "mwi AS (SELECT label, model, n, (sum(s * s) - any_value(q)) / (n * (n - 1)) AS within FROM mps JOIN mn USING (label, model) GROUP BY label, model, n), "
    "mbt AS (SELECT a.label, a.model, b.label AS ol, sum(a.s * b.s) / (any_value(na.n) * any_value(nb.n)) AS sim FROM mps a JOIN mps b ON a.model = b.model AND a.pos = b.pos AND a.label <> b.label JOIN mn na ON na.label = a.label AND na.model = a.model JOIN mn nb ON nb.label = b.label AND nb.model = b.model GROUP BY a.label, a.model, b.label), "
    "ev AS (SELECT label, model, within - avg(sim) AS margin FROM mwi JOIN mbt USING (label, model) GROUP BY label, model, within), "
    "cs AS (SELECT label, count(*) AS n_used, count(*) FILTER (WHERE margin > 0) AS n_positive, avg(margin) AS mean_margin FROM ev GROUP BY label), "
    "cn AS (SELECT *, CASE WHEN n_used = 0 THEN 'insufficient' WHEN n_used >= 2 AND n_positive = n_used THEN 'strong_agreement' WHEN n_positive > 0 THEN 'partial_agreement' ELSE 'weak_agreement' END AS status FROM cs)"
)


def _evidence(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    pool = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: expr.array_sum(F.slice("x", k * 8 + 1, 8)) / 8)
    made = F.inline(F.array(F.struct(F.lit("pool").alias("model"), pool.alias("y")), F.struct(F.lit("head").alias("model"), F.slice("x", 1, 32).alias("y"))))
    em = v.select("label", "id", made).withColumnRenamed("y", "x")
    sums = similarity.pair_totals(em, ["model", "label"], "id", "x")
    return similarity.control_margin(similarity.within(sums, ["model", "label"]), similarity.between(sums, ["model"], "label"), ["model"], "label").select("label", "model", "margin")


@query(f"WITH {_VECTORS}, {_MODELS} SELECT label, n_used, n_positive, round(mean_margin, 6) AS mean_margin, status FROM cn")
def backbone_consensus(spark, sf_dir):
    out = backbone.consensus(_evidence(spark, sf_dir).withColumn("status", F.lit("used")), ["label"])
    return out.select("label", "n_used", "n_positive", r6("mean_margin", "mean_margin"), F.col("consensus").alias("status"))


@query(
    f"WITH {_ASSESSED}, {_MODELS} "
    "SELECT ti.label, CASE WHEN cn.status = 'strong_agreement' AND tier = 'moderate' AND NOT list_has_any(flags, ['unstable', 'holdout-weak', 'session-holdout-weak', 'cohort-holdout-weak', 'control-weak']) THEN 'strong' WHEN cn.status IN ('weak_agreement', 'insufficient') AND tier = 'strong' THEN 'moderate' WHEN cn.status IN ('weak_agreement', 'insufficient') AND tier = 'moderate' THEN 'exploratory' ELSE tier END AS tier, "
    "round(1 - (robustness + CASE cn.status WHEN 'strong_agreement' THEN 1.0 WHEN 'partial_agreement' THEN 0.72 WHEN 'weak_agreement' THEN 0.38 ELSE 0.18 END) / 2, 6) AS fragility FROM ti JOIN cn USING (label)"
)
def tier_update(spark, sf_dir):
    seen = backbone.consensus(_evidence(spark, sf_dir).withColumn("status", F.lit("used")), ["label"])
    met = _assessed(spark, sf_dir).join(seen, "label")
    return met.select(
        "label", decisions.tier_update(F.col("tier"), F.col("flags"), F.col("consensus"), F.col("n_used")).alias("tier"),
        r6(decisions.updated_fragility(F.col("robustness"), F.col("consensus"), F.col("n_used")), "fragility"),
    )


def _pooled(x):
    """Mean and deviation of each channel, for all rows of a batch at once."""
    import numpy as np

    x = x.astype(np.float64)
    return np.concatenate([x.mean(axis=-1), x.std(axis=-1)], axis=-1)


def _weighted(root: str, variant: str, device: str):
    """A model of the query below: its weights are a file beside it."""
    weights = np.load(f"{root}/{variant}.npy").astype(np.float64)
    return lambda x: np.stack((x.reshape(len(x), -1) @ weights, x.reshape(len(x), -1) @ weights[::-1]), axis=1)


@query(
    """WITH e AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), w AS (SELECT pos, avg(CAST(v AS DOUBLE)) AS w FROM e GROUP BY pos), m AS (SELECT max(pos) + 1 AS k FROM e)
    SELECT e.vec_id AS id, round(sum(v * a.w), 5) AS ahead, round(sum(v * b.w), 5) AS back FROM e JOIN w a ON a.pos = e.pos, m, w b WHERE b.pos = k - e.pos GROUP BY e.vec_id"""
)
def model_handle(spark, sf_dir):
    """Embeddings of a model that the workers load: its weights, the mean
    vector, are a file in the shared folder."""
    at = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    v = _vectors(spark, sf_dir)
    means = v.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v")).orderBy("pos")
    held = io.BytesIO()
    np.save(held, np.array([r["v"] for r in means.collect()]))  # a vector's length
    recording_files.write_bytes(f"{at}/mean/base.npy", held.getvalue())
    model = models.Adapter("mean", variants={"base": ("base.npy",)}, make=_weighted).load(spark, at)
    rows = v.select("id", F.transform("x", lambda e: e.cast("float")).alias("x"))
    data = rows.select("id", F.array("x").alias("data"), F.lit(RATE).alias("rate"), F.array(F.lit("c")).alias("channels"))
    x, _ = backbone.embeddings(data, [model], ["id"])
    return x.select("id", F.round(F.col("x")[0], 5).alias("ahead"), F.round(F.col("x")[1], 5).alias("back"))


@query(
    "WITH m AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings) "
    "SELECT id, CAST(c AS INT) AS channel, round(list_avg(x[c * 16 + 1 : c * 16 + 16]), 5) + 0.0::DOUBLE AS mean, round(list_aggregate(x[c * 16 + 1 : c * 16 + 16], 'stddev_pop'), 5) + 0.0::DOUBLE AS std FROM m, (SELECT unnest(range(4)) AS c)"
)
def embedding_udf(spark, sf_dir):
    """A model as a function in Arrow batches: channels pooled to mean and deviation."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", k * 16 + 1, 16)).alias("data"))
    x, _ = backbone.embeddings(rows.withColumn("channels", F.array(*[F.lit(f"C{k}") for k in range(4)])), [backbone.Model("pool", _pooled, batched=True)], ["id"])
    each = x.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel"))
    part = lambda k: F.round(F.get("x", F.col("channel") + k), 5) + F.lit(0.0)  # noqa: E731  (-0.0 is 0.0)
    return each.select("id", "channel", part(0).alias("mean"), part(4).alias("std"))


@query(
    "WITH w AS (SELECT unnest(['FP1', 'C9', 'C1']) AS channel, unnest([0, 1, 2]) AS k) SELECT vec_id AS id, CAST(k AS INT) AS channel_idx, CAST(p AS INT) AS patch, "
    "round(CASE channel WHEN 'FP1' THEN list_sum(list_transform(embedding[p * 8 + 1 : p * 8 + 8], lambda e: CAST(e AS DOUBLE))) WHEN 'C1' THEN list_sum(list_transform(embedding[32 + p * 8 + 1 : 32 + p * 8 + 8], lambda e: CAST(e AS DOUBLE))) ELSE 0.0 END, 5) + 0.0::DOUBLE AS total "
    "FROM embeddings, w, (SELECT unnest(range(4)) AS p)"
)
def model_input_patches(spark, sf_dir):
    """Channels matched by plain names, lost ones zero, cut into patches."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.array(F.lit("Fp-1"), F.lit("c 1")).alias("channels"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("data")
    )
    made = backbone.prepared(rows, backbone.Model("m", _pooled, montage=("FP1", "C9", "C1")))
    each = made.select("id", F.posexplode("data").alias("channel_idx", "s")).select("id", "channel_idx", F.posexplode(backbone.patches(F.col("s"), 4, 8)).alias("patch", "v"))
    return each.select("id", F.col("channel_idx").cast("int").alias("channel_idx"), F.col("patch").cast("int").alias("patch"), F.round(expr.array_sum(F.transform("v", lambda e: e.cast("double"))), 5).alias("total"))


# -- checks


@query(
    f"WITH {_EVENTS}, o AS (SELECT recording_id, event_id, onset_seconds + duration_seconds AS e, lead(event_id) OVER w AS nx, lead(onset_seconds) OVER w AS ns FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY onset_seconds, onset_seconds + duration_seconds, event_id)) "
    'SELECT recording_id, event_id AS "left", nx AS "right" FROM o WHERE nx IS NOT NULL AND ns < e'
)
def event_overlap(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("_end", F.col("onset_seconds") + F.col("duration_seconds"))
    return checks.overlaps(e, "recording_id", "onset_seconds", "_end", "event_id")


@query("WITH c AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 10 = 0 THEN 'rare' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ALL) SELECT min(n) AS smallest, max(n) AS largest, count(*) AS labels FROM c HAVING max(n) >= 3.0 * min(n)")
def class_imbalance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderkey") % 10 == 0, "rare").otherwise(F.col("o_orderstatus")))
    return checks.imbalance(o, ["o_orderpriority", "status"])


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(
    "WITH l AS (SELECT DISTINCT o_orderpriority AS label, o_custkey FROM orders), p AS (SELECT a.label AS l, b.label AS r FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.label < b.label) SELECT l AS left_label, min(r) AS right_label FROM p GROUP BY l"
)
def subject_leakage(spark, sf_dir):
    return checks.leakage(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey")


@query(
    "WITH d AS (SELECT DISTINCT user_id % 7 AS branch, user_id AS collection, CASE WHEN event_id % 97 = 0 THEN 'extra' ELSE event_type END AS channel FROM events), t AS (SELECT branch, count(DISTINCT collection) AS total FROM d GROUP BY branch), "
    "s AS (SELECT branch, channel, count(*) AS n FROM d GROUP BY ALL) SELECT branch, count(*) FILTER (WHERE n = total) AS in_all, count(*) AS in_any FROM s JOIN t USING (branch) GROUP BY branch HAVING count(*) FILTER (WHERE n = total) < count(*)"
)
def montage_consistency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("branch"), F.col("user_id").alias("collection"), F.when(F.col("event_id") % 97 == 0, "extra").otherwise(F.col("event_type")).alias("channel"))
    return checks.inconsistent_montage(e, "branch", "collection", "channel")


@query("SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS n FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) < 12")
def too_few_subjects(spark, sf_dir):
    return checks.few(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", 12)


@query("SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def rate_mismatch(spark, sf_dir):
    return checks.mixed(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


#: Events as a study's observations, with every fault that a study can have.
_STUDY = (
    "ob AS (SELECT 'col_' || user_id % 36 AS collection_id, 'r' || user_id % 40 AS recording_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 's' || user_id % 20 END AS subject_id, CASE WHEN user_id % 37 = 0 THEN 'alone' ELSE 'f' || event_id % 2 END AS fam, "
    "CASE WHEN user_id % 37 = 0 THEN 'only' WHEN event_id % 499 = 0 THEN 'single' || event_id WHEN event_id % 50 = 1 THEN 'rare' ELSE event_type END AS label, 'b' || user_id % 2 AS branch, 100.0 + CASE WHEN user_id % 13 = 0 THEN 10 ELSE 0 END AS rate, 'p' || user_id % 80 AS path, user_id % 5 = 0 AS wide FROM events), "
    "sb AS (SELECT *, coalesce(nullif(subject_id, ''), recording_id) AS subject FROM ob)"
)


@query(
    f"WITH {_STUDY} "
    "SELECT 'error' AS level, 'study.empty' AS code, CAST(count(*) = 0 AS BIGINT) AS n FROM ob UNION ALL "
    "SELECT 'warning', 'study.duplicate_collection_id', count(*) FROM (SELECT collection_id FROM (SELECT DISTINCT collection_id, recording_id, branch FROM ob) GROUP BY 1 HAVING count(*) > 1) UNION ALL "
    "SELECT 'error', 'study.recording_collision', count(*) FROM (SELECT recording_id FROM ob GROUP BY 1 HAVING count(DISTINCT path) > 1) UNION ALL "
    "SELECT 'error', 'study.sample_rate_mismatch', count(*) FROM (SELECT fam, label, branch FROM ob GROUP BY ALL HAVING count(DISTINCT rate) > 1) UNION ALL "
    "SELECT 'error', 'study.too_few_subjects', count(*) FROM (SELECT fam, label, branch FROM sb GROUP BY ALL HAVING count(DISTINCT subject) < 10) UNION ALL "
    "SELECT 'warning', 'study.too_few_trials', count(*) FROM (SELECT fam, label, branch FROM ob GROUP BY ALL HAVING count(*) < 2) UNION ALL "
    "SELECT 'warning', 'study.weak_controls', count(*) FROM (SELECT fam, branch FROM ob GROUP BY ALL HAVING count(DISTINCT label) < 2) UNION ALL "
    "SELECT 'warning', 'study.montage_inconsistent', count(*) FROM (SELECT branch FROM (SELECT branch, collection_id, bool_or(wide) AS w FROM ob GROUP BY ALL) GROUP BY branch HAVING bool_or(w) AND NOT bool_and(w)) UNION ALL "
    "SELECT 'warning', 'study.class_imbalance', count(*) FROM (SELECT 1 FROM (SELECT count(*) AS n FROM ob GROUP BY fam, label, branch) HAVING max(n) >= 3 * min(n)) UNION ALL "
    "SELECT 'warning', 'study.subject_leakage_risk', count(*) FROM (SELECT DISTINCT a.label FROM (SELECT DISTINCT label, subject FROM sb) a JOIN (SELECT DISTINCT label, subject FROM sb) b ON a.subject = b.subject AND a.label < b.label) "
)
def study_validation_report(spark, sf_dir):
    found = checks.study_report(_study(spark, sf_dir), min_subjects=10)
    codes = spark.createDataFrame([("error" if c in ("empty", "recording_collision", "sample_rate_mismatch", "too_few_subjects") else "warning", f"study.{c}") for c in STUDY_CODES], "level string, code string")
    counts = found.groupBy("level", "code").agg(F.count("*").alias("n"))
    return F.broadcast(codes).join(counts, ["level", "code"], "left").select("level", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _study(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u, i = F.col("user_id"), F.col("event_id")
    tag = lambda p, k: F.concat(F.lit(p), u % k)
    alone = u % 37 == 0
    label = F.when(alone, "only").when(i % 499 == 0, F.concat(F.lit("single"), i)).when(i % 50 == 1, "rare").otherwise(F.col("event_type"))
    return e.select(
        tag("col_", 36).alias("collection_id"), tag("r", 40).alias("recording_id"), F.when(u % 3 == 0, "").otherwise(tag("s", 20)).alias("subject_id"), F.lit("ns").alias("label_namespace"),
        F.when(alone, "alone").otherwise(F.concat(F.lit("f"), i % 2)).alias("event_family"), label.alias("target_label"), tag("b", 2).alias("branch_name"), "event_id", (F.lit(100.0) + F.when(u % 13 == 0, 10).otherwise(0)).alias("sampling_rate_hz"),
        tag("p", 80).alias("source_path"), F.when(u % 5 == 0, F.array(F.lit("c0"), F.lit("c1"))).otherwise(F.array(F.lit("c0"))).alias("channels"),
    )


STUDY_CODES = ("empty", "duplicate_collection_id", "recording_collision", "sample_rate_mismatch", "too_few_subjects", "too_few_trials", "weak_controls", "montage_inconsistent", "class_imbalance", "subject_leakage_risk")


@query(
    "WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN CAST(-value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS onset, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS label FROM events) "
    "SELECT message, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN trim(label) = '' THEN 'no target_label' END, CASE WHEN onset = 'abc' THEN 'onset_seconds is no number' END, CASE WHEN try_cast(nullif(onset, '') AS DOUBLE) < 0 THEN 'onset_seconds is negative' END], lambda x: x IS NOT NULL)) AS message FROM r) GROUP BY message"
)
def event_faults(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    onset = F.when(i % 5 == 0, "").when(i % 5 == 1, "abc").when(i % 5 == 2, (-F.col("value")).cast("string")).otherwise(F.col("value").cast("string"))
    raw = e.select(F.concat(F.lit("e"), i).alias("event_id"), F.concat(F.lit("r"), F.col("user_id")).alias("recording_id"), onset.alias("onset"), F.lit("f").alias("family"), F.when(i % 7 == 0, " ").otherwise(F.col("event_type")).alias("label"), i.alias("_n"))
    return event_source.faults(event_source.normalise(raw, ["_n"])).groupBy("message").agg(F.count("*").alias("n"))


@query(
    f"WITH {_EPOCHS}, lo AS (SELECT event_id, phase, channel, CASE WHEN event_id % 11 = 0 AND phase = 'onset' THEN 0 ELSE len(samples) END AS n, CASE WHEN event_id % 13 = 0 THEN 100.5 WHEN event_id % 17 = 0 AND channel_idx = 2 THEN 250.0 ELSE 100.0 END AS rate FROM ep WHERE NOT (event_id % 7 = 0 AND channel_idx = 3)), "
    "it AS (SELECT event_id, phase, count(DISTINCT channel) AS c, max(n) AS most, min(rate) AS low, max(rate) AS high FROM lo GROUP BY ALL) "
    "SELECT 'error' AS level, 'channels' AS what, count(*) AS n FROM it WHERE c <> 4 UNION ALL SELECT 'error', 'sampling', count(*) FROM it WHERE low <> 100.0 OR high <> 100.0 UNION ALL SELECT 'warning', 'no', count(*) FROM it WHERE most <= 0"
)
def signal_contract(spark, sf_dir):
    """Epochs with lost channels, another rate (of all channels or of one), and
    without samples; what a unit has is told by its other items."""
    ep = _epochs(spark, sf_dir).filter(~((F.col("event_id") % 7 == 0) & (F.col("channel_idx") == 3)))
    ep = ep.withColumn("samples", F.when((F.col("event_id") % 11 == 0) & (F.col("phase") == "onset"), F.array().cast("array<float>")).otherwise(F.col("samples")))
    ep = ep.withColumn("sampling_rate_hz", F.when(F.col("event_id") % 13 == 0, 100.5).when((F.col("event_id") % 17 == 0) & (F.col("channel_idx") == 2), 250.0).otherwise(RATE)).withColumn("unit", F.lit("c"))
    found = checks.signal_findings(ep, ["unit"], ["event_id", "phase"], "epochs.signal_contract")
    return found.groupBy("level", F.regexp_extract("message", "^[a-z]+", 0).alias("what")).agg(F.count("*").alias("n"))


@query(
    f"WITH {_STUDY}, lb AS (SELECT DISTINCT label, subject FROM sb) "
    "SELECT 'study.duplicate_collection_id' AS code, collection_id AS location, 'collection id comes more than once' AS message FROM (SELECT DISTINCT collection_id, recording_id, branch FROM ob) GROUP BY collection_id HAVING count(*) > 1 UNION ALL "
    "SELECT 'study.recording_collision', recording_id, 'several source files have this id' FROM ob GROUP BY recording_id HAVING count(DISTINCT path) > 1 UNION ALL "
    "SELECT 'study.sample_rate_mismatch', concat_ws('/', 'ns', fam, label, branch), 'mixed sampling rates' FROM ob GROUP BY fam, label, branch HAVING count(DISTINCT rate) > 1 UNION ALL "
    "SELECT 'study.too_few_subjects', concat_ws('/', 'ns', fam, label, branch), 'subjects: ' || count(DISTINCT subject) FROM sb GROUP BY fam, label, branch HAVING count(DISTINCT subject) < 10 UNION ALL "
    "SELECT 'study.too_few_trials', concat_ws('/', 'ns', fam, label, branch), 'trials: ' || count(*) FROM ob GROUP BY fam, label, branch HAVING count(*) < 2 UNION ALL "
    "SELECT 'study.weak_controls', concat_ws('/', 'ns', fam, branch), 'fewer than two labels' FROM ob GROUP BY fam, branch HAVING count(DISTINCT label) < 2 UNION ALL "
    "SELECT 'study.montage_inconsistent', branch, 'channels differ across collections' FROM (SELECT branch, collection_id, bool_or(wide) AS w FROM ob GROUP BY ALL) GROUP BY branch HAVING bool_or(w) AND NOT bool_and(w) UNION ALL "
    "SELECT 'study.class_imbalance', '', 'label counts differ by a factor of 3 or more' FROM (SELECT count(*) AS n FROM ob GROUP BY fam, label, branch) HAVING max(n) >= 3 * min(n) UNION ALL "
    "SELECT 'study.subject_leakage_risk', a.label, 'shares subjects with ' || min(b.label) FROM lb a JOIN lb b ON a.subject = b.subject AND a.label < b.label GROUP BY a.label"
)
def study_findings(spark, sf_dir):
    """The findings themselves, each with its place and message."""
    return checks.study_report(_study(spark, sf_dir), min_subjects=10).select("code", "location", "message")


@query(
    """WITH e AS (SELECT 'e' || event_id % 4900 AS event_id, 'r' || user_id AS recording_id, value AS onset, CASE WHEN event_id % 90 = 7 THEN -1.0 WHEN event_id % 40 = 3 THEN 4000.0 ELSE 0.01 END AS dur, CASE WHEN event_id % 77 = 5 THEN '' ELSE event_type END AS label, user_id % 5 = 0 AS lax FROM events),
    k AS (SELECT 'r' || c_custkey AS recording_id, 500.0 + c_custkey % 7 * 500 AS seconds FROM customer WHERE c_custkey % 11 <> 0),
    o AS (SELECT recording_id, event_id, onset + dur AS stop, lax, lead(event_id) OVER w AS nxt, lead(onset) OVER w AS nxt_onset, lead(lax) OVER w AS nxt_lax FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY onset, onset + dur, event_id))
    SELECT code, level, CAST(count(*) AS BIGINT) AS n, min(location) AS first_location, max(location) AS last_location, max(message) AS last_message FROM (
    SELECT 'events.duplicate_id' AS code, 'error' AS level, event_id AS location, 'event id comes ' || count(*) || ' times' AS message FROM e GROUP BY recording_id, event_id HAVING count(*) > 1 UNION ALL
    SELECT 'events.invalid', 'error', event_id, 'no target_label' FROM e WHERE label = '' UNION ALL SELECT 'events.invalid', 'error', event_id, 'duration_seconds is negative' FROM e WHERE dur < 0 UNION ALL
    SELECT 'events.overlap', 'error', recording_id, nxt || ' overlaps ' || event_id FROM o WHERE nxt IS NOT NULL AND nxt_onset < stop AND NOT lax AND NOT nxt_lax UNION ALL
    SELECT 'events.class_imbalance', 'warning', '', 'label counts differ by a factor of 3 or more' FROM (SELECT count(*) AS n FROM e GROUP BY label) HAVING max(n) >= 3 * min(n) UNION ALL
    SELECT 'events.out_of_bounds', 'error', event_id, 'ends after its recording' FROM e JOIN k USING (recording_id) WHERE onset + dur > seconds UNION ALL
    SELECT 'events.recording_mismatch', 'error', event_id, 'no recording ' || recording_id FROM e WHERE recording_id NOT IN (SELECT recording_id FROM k)) GROUP BY code, level"""
)
def event_report(spark, sf_dir):
    """Every rule of event tables: repeated ids, unusable rows, overlaps, labels
    out of balance, events beyond their recording or without one."""
    i, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), i % 4900).alias("event_id"), F.concat(F.lit("r"), u).alias("recording_id"), F.col("value").alias("onset_seconds"), F.when(i % 90 == 7, -1.0).when(i % 40 == 3, 4000.0).otherwise(0.01).alias("duration_seconds"),
        F.lit("f").alias("event_family"), F.when(i % 77 == 5, "").otherwise(F.col("event_type")).alias("target_label"), F.lit("").alias("event_subtype"), F.lit("ns").alias("label_namespace"),
        F.create_map(F.lit("allow_overlap"), F.when(u % 5 == 0, "True").otherwise("0")).alias("metadata"),
    )
    k = F.col("c_custkey")
    seconds = table(spark, sf_dir, "customer").filter(k % 11 != 0).select(F.concat(F.lit("r"), k).alias("recording_id"), (F.lit(500.0) + k % 7 * 500).alias("seconds"))
    return _summary(checks.event_report(e, seconds))


def _summary(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "level").agg(F.count("*").alias("n"), F.min("location").alias("first_location"), F.max("location").alias("last_location"), F.max("message").alias("last_message"))


@query(
    f"""WITH {_EPOCHS}, e0 AS (SELECT 'r' || event_id % 9 AS recording_id, 'e' || event_id AS event_id, phase, channel, CASE WHEN event_id % 11 = 0 AND phase = 'onset' THEN 0 ELSE len(samples) END AS n, len(samples) AS want,
        CASE WHEN event_id % 53 = 2 THEN 0.0 WHEN event_id % 17 = 0 AND channel_idx = 2 THEN 250.0 ELSE 100.0 END AS rate, event_id AS k FROM ep WHERE NOT (event_id % 7 = 0 AND channel_idx = 3) AND event_id % 29 <> 4),
    ob AS (SELECT * FROM e0 UNION ALL SELECT * FROM e0 WHERE k % 31 = 0 AND channel = 'c1'),
    it AS (SELECT recording_id, event_id, phase, count(DISTINCT channel) AS c, count(*) AS rows_, min(n) AS least, max(n) AS most, min(rate) AS low, max(rate) AS high, max(CASE WHEN n <> want THEN 1 ELSE 0 END) AS shape FROM ob GROUP BY ALL),
    id AS (SELECT recording_id, event_id, min(low) AS low, max(CASE WHEN rows_ > c THEN 1 ELSE 0 END) AS rep FROM it GROUP BY ALL)
    SELECT code, level, CAST(count(*) AS BIGINT) AS n, min(location) AS first_location, max(location) AS last_location, max(message) AS last_message FROM (
    SELECT 'epochs.invalid' AS code, 'error' AS level, recording_id || '/' || event_id AS location, 'sampling_rate_hz is not above 0' AS message FROM id WHERE low <= 0 UNION ALL
    SELECT 'epochs.duplicate_event', 'error', event_id, 'event comes more than once' FROM id WHERE rep = 1 UNION ALL
    SELECT 'epochs.recording_mismatch', 'error', event_id, 'no recording ' || recording_id FROM id WHERE recording_id = 'r8' UNION ALL
    SELECT 'epochs.phase_shape', 'error', recording_id || '/' || event_id, phase || ' has another number of samples than its range' FROM it WHERE shape = 1 UNION ALL
    SELECT 'epochs.missing_signal', 'error', 'r' || vec_id % 9 || '/e' || vec_id, 'event without epochs' FROM embeddings WHERE vec_id % 29 = 4 UNION ALL
    SELECT 'epochs.signal_contract', 'error', recording_id || '/' || event_id || '/' || phase, 'channels: ' || c || ' of 4' FROM it WHERE c <> 4 UNION ALL
    SELECT 'epochs.signal_contract', 'error', recording_id || '/' || event_id || '/' || phase, 'sampling rate ' || CAST(CASE WHEN low <> 100.0 THEN low ELSE high END AS DOUBLE) || ' against 100.0' FROM it WHERE low <> 100.0 OR high <> 100.0 UNION ALL
    SELECT 'epochs.signal_contract', 'warning', recording_id || '/' || event_id || '/' || phase, 'no samples' FROM it WHERE most <= 0) GROUP BY code, level"""
)
def collection_report(spark, sf_dir):
    """Every rule of a collection's epochs, from one pass over them."""
    k = F.col("event_id")
    ep = _epochs(spark, sf_dir).filter(~((k % 7 == 0) & (F.col("channel_idx") == 3)) & (k % 29 != 4)).withColumn("derived_samples", F.size("samples"))
    ep = ep.withColumn("samples", F.when((k % 11 == 0) & (F.col("phase") == "onset"), F.array().cast("array<float>")).otherwise(F.col("samples")))
    ep = ep.withColumn("sampling_rate_hz", F.when(k % 53 == 2, 0.0).when((k % 17 == 0) & (F.col("channel_idx") == 2), 250.0).otherwise(RATE))
    ep = ep.unionByName(ep.filter((k % 31 == 0) & (F.col("channel") == "c1")))
    name = lambda c: [F.concat(F.lit("r"), c % 9).alias("recording_id"), F.concat(F.lit("e"), c).alias("event_id")]
    ep = ep.select(*name(k), "phase", "channel", "samples", "derived_samples", "sampling_rate_hz")
    events = table(spark, sf_dir, "embeddings").select(*name(F.col("vec_id")))
    return _summary(checks.collection_report(ep, events.select("recording_id").filter("recording_id <> 'r8'"), events, "c"))


@query(
    "WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE 'r' || s_suppkey END AS id, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 10 END AS n, s_suppkey % 4 AS c, s_suppkey % 6 = 0 AS bare FROM supplier) "
    "SELECT level, code, count(*) AS n FROM (SELECT 'error' AS level, 'recording.invalid' AS code FROM r WHERE trim(id) = '' UNION ALL SELECT 'error', 'recording.invalid' FROM r WHERE n = 0 UNION ALL SELECT 'error', 'recording.channels' FROM r WHERE c = 0 UNION ALL "
    "SELECT 'error', 'recording.channels' FROM r WHERE c = 1 UNION ALL SELECT 'warning', 'recording.channels' FROM r WHERE c = 2 UNION ALL SELECT 'warning', 'recording.provenance_missing' FROM r WHERE bare) GROUP BY ALL"
)
def recording_findings(spark, sf_dir):
    k = F.col("s_suppkey")
    names = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("a"), F.lit("a"))).when(k % 4 == 2, F.array(F.lit("a b"))).otherwise(F.array(F.lit("a")))
    rec = table(spark, sf_dir, "supplier").select(
        F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("r"), k)).alias("recording_id"), F.lit("p").alias("source_path"), F.lit("npz").alias("source_format"), names.alias("channel_names"), F.lit(RATE).alias("sampling_rate_hz"),
        F.when(k % 5 == 0, 0).otherwise(10).alias("n_samples"), F.lit(0.1).alias("duration_seconds"), F.when(k % 6 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("loader_id"), F.lit("npz"))).alias("provenance"), F.lit(None).cast("string").alias("message"),
    )
    return checks.recording_report(rec).groupBy("level", "code").agg(F.count("*").alias("n"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '{1}')"


@query(
    f"SELECT p_partkey, 'patterns/' || {_SLUG.format('p_type', 'unspecified_event_family')} || '/' || {_SLUG.format('blank', 'all_sexes')} || '/' || {_SLUG.format('p_brand', 'all_modalities')} || '/' || {_SLUG.format('p_name', 'unknown')} AS package, "
    f"CASE p_size % 5 WHEN 0 THEN 'signals/raw/' WHEN 1 THEN 'signals/processed/' WHEN 2 THEN 'derived/' WHEN 3 THEN 'reports/' ELSE 'support/' END || {_SLUG.format('p_name', 'unknown')} || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.npz' END AS artifact FROM (SELECT *, '' AS blank FROM part)"
)
def package_routing(spark, sf_dir):
    """Where packages and their artifacts go."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ("raw_eeg", "processed_epoch", "topography", "figure", "other")))
    held = p.withColumn("kind", F.get(kinds, (F.col("p_size") % 5).cast("int")))
    return held.select("p_partkey", paths.package_path("p_name", event_family="p_type", stimulus_modality="p_brand").alias("package"), paths.artifact_path("p_name", "kind", F.when(F.col("p_size") % 3 == 0, "ZARR").otherwise("NPZ"), F.lit(False)).alias("artifact"))


@query(
    "WITH n AS (SELECT unnest(['C3', 'C4', 'CZ', 'F3', 'EKG']) AS channel, unnest([0, 1, 2, 3, 4]) AS idx, unnest([-0.34, 0.34, 0.0, -0.34, NULL]) AS x, unnest([0.0, 0.0, 0.0, 0.58, NULL]) AS y), "
    "z AS (SELECT *, sqrt(1 - least(0.990025, x * x + y * y)) AS z FROM n WHERE x IS NOT NULL), c AS (SELECT channel, idx, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y, z - avg(z) OVER () AS z FROM z), "
    "s AS (SELECT *, sqrt(3 * avg(x * x + y * y + z * z) OVER ()) AS r FROM c) SELECT vec_id AS id, channel, round(x / r, 5) + 0.0::DOUBLE AS x, round(y / r, 5) + 0.0::DOUBLE AS y, round(z / r, 5) + 0.0::DOUBLE AS z, round(CAST(embedding[idx * 12 + 1] AS DOUBLE), 5) + 0.0::DOUBLE AS first FROM embeddings, s"
)
def model_input_positions(spark, sf_dir):
    """Channels with a place on the head, centred and scaled; the others are left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*map(F.lit, ("C3", "C4", "CZ", "F3", "EKG"))).alias("channels"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.slice("embedding", k * 12 + 1, 12)).alias("data"))
    made = backbone.model_input(rows, "brainomni")
    each = made.select("id", F.inline(F.arrays_zip(F.col("layout").alias("l"), F.col("data").alias("d"))))
    return each.select("id", F.col("l.channel").alias("channel"), *[(F.round(F.col("l")[k], 5) + F.lit(0.0)).alias(k) for k in "xyz"], (F.round(F.get("d", F.lit(0)).cast("double"), 5) + F.lit(0.0)).alias("first"))


@query(
    "SELECT n_nationkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(r_name || ' -- ' || n_name)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def slugify_partition_path(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    met = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return met.select("n_nationkey", expr.slugify(F.concat_ws(" -- ", "r_name", "n_name")).alias("slug"))


_EDGES = "ed AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'r' || r_regionkey, 'root' FROM region)"


@query(
    f"WITH RECURSIVE {_EDGES}, up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM ed UNION ALL SELECT up.child, ed.parent, up.depth + 1 FROM up JOIN ed ON up.ancestor = ed.child) SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM up GROUP BY ALL"
)
def lineage_closure(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c))
    n = table(spark, sf_dir, "nation").select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey").alias("child"), tag("n", "s_nationkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("child"), F.lit("root").alias("parent"))
    return checks.lineage_closure(n.unionByName(s).unionByName(r))
