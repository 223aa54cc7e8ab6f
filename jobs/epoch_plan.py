"""Plan epochs of new events: an incremental job.

Event files arrive in a folder. Each run takes those that no earlier run took
(the stream's checkpoint knows), brings their rows to the normal form, sets the
unusable and the repeated ones aside with a reason, and writes for every other
event the sample range of each phase around it:

    <output>/plan/phase=.../batch=...       what the epoch step reads, phase by phase
    <output>/rejected/batch=...             rows set aside, with messages

A batch that is run again after a failure overwrites its own partitions, so the
result is the same. Output and checkpoint belong together: start both anew.

    python -m jobs.epoch_plan --source DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from epochloom.functions.expr import text_or
from epochloom.operators import epochs
from epochloom.plans import catalog
from epochloom.sources.files import shared_dir

from .common import log, main, packaged, parquet_if_any

CONFIG = "epoch_plan.json"
KEY = ["recording_id", "event_id"]
PLAN = "recording_id string, event_id string, target_label string, start_sample long, end_sample long, clipped boolean, warning string, phase string, batch long"
REJECTED = "recording_id string, event_id string, target_label string, onset_seconds double, message string, batch long"
_TEXTS = ("event_id", "recording_id", "event_family", "target_label")


def normal(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The configured expressions over the raw columns, texts trimmed."""
    made = raw.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])
    return made.select(*[text_or(c).alias(c) for c in _TEXTS], *[F.col(c).cast("double").alias(c) for c in ("onset_seconds", "duration_seconds")])


def judged(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """Distinct rows with ``message``: why a row can't be used, null if it can.
    Of rows with one key the first by onset, duration and label counts, unless
    an earlier batch had the key; equal rows are one."""
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    # messages of one row each: keyed by the row itself, so that a hot recording is spread
    told = distinct.withColumn("_fault", F.concat_ws("; ", *_messages()))
    usable = told.filter("_fault = ''")
    first = usable.groupBy(*KEY).agg(F.min(F.struct("onset_seconds", "duration_seconds", "target_label", "event_family")).alias("_first"))
    first = first.join(earlier.select(*KEY, F.lit(True).alias("_known")), KEY, "left")
    met = usable.join(first, KEY)
    own = F.struct("onset_seconds", "duration_seconds", "target_label", "event_family")
    again = F.when(F.col("_known"), F.lit("event came in an earlier batch")).when(own != F.col("_first"), F.lit("event id comes more than once"))
    good = met.select(*rows.columns, again.alias("message"))
    return good.unionByName(told.filter("_fault <> ''").select(*rows.columns, F.col("_fault").alias("message")))


def _messages():
    """The library's rules for event rows, as columns."""
    number = [(F.col(c).isNull() | F.isnan(c), f"{c} is no number") for c in ("onset_seconds", "duration_seconds")]
    rules = [(F.col(c) == "", f"no {c}") for c in ("event_id", "recording_id", "event_family", "target_label")]
    return [F.when(rule, F.lit(text)) for rule, text in [*rules, *number, *[(F.col(c) < 0, f"{c} is negative") for c in ("onset_seconds", "duration_seconds")]]]


def planned(events: DataFrame, config: dict) -> DataFrame:
    """A row for each event and phase with its sample range."""
    w = dict(config["windows"])
    base = w.pop("baseline", None)
    windows = epochs.Windows(**w, baseline=epochs.Baseline(**base) if base else None)
    if windows.check():
        raise ValueError("; ".join(windows.check()))
    ranges = epochs.sample_range(epochs.phase_requests(events, windows), F.lit(float(config["sampling_rate_hz"])), F.lit(int(config["n_samples"])))
    return ranges.select("recording_id", "event_id", "target_label", "start_sample", "end_sample", "clipped", "warning", "phase")


def as_pattern(path: str) -> str:
    """The path as a pattern that matches it alone: a stream then takes a single
    file as well as a folder."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> dict:
    """Take what is new in ``source``; returns counts of this run."""
    counts = {"batches": 0, "read": 0, "planned": 0, "rejected": 0}
    out = output.rstrip("/")

    def batch(raw: DataFrame, number: int) -> None:
        session = raw.sparkSession
        seen, kept, gone = Observation(), Observation(), Observation()
        rows = normal(raw, config["columns"]).observe(seen, F.count("*").alias("n"))
        # each event has one onset row: that partition alone has all earlier keys
        plan_so_far = parquet_if_any(session, f"{out}/plan", PLAN) if number else session.createDataFrame([], PLAN)
        earlier = plan_so_far.filter((F.col("phase") == "onset") & (F.col("batch") < number)).select(*KEY)
        verdict = f"{out}/_judged"
        judged(rows, earlier).write.mode("overwrite").parquet(verdict)  # of this batch alone: read twice below, then overwritten by the next
        held = session.read.parquet(verdict)
        whole = {"partitionOverwriteMode": "dynamic"}
        plan = planned(held.filter("message IS NULL"), config).observe(kept, F.count("*").alias("n"))
        plan.withColumn("batch", F.lit(number)).write.mode("overwrite").options(**whole).partitionBy("phase", "batch").parquet(f"{out}/plan")
        bad = held.filter("message IS NOT NULL").select("recording_id", "event_id", "target_label", "onset_seconds", "message").observe(gone, F.count("*").alias("n"))
        bad.withColumn("batch", F.lit(number)).write.mode("overwrite").options(**whole).partitionBy("batch").parquet(f"{out}/rejected")
        counts["batches"] += 1
        for name, found in (("read", seen), ("planned", kept), ("rejected", gone)):
            counts[name] += found.get.get("n", 0)
        log.info("batch %d of %s: %d rows read, %d phase rows and %d rejected rows written to %s", number, source, seen.get["n"], kept.get["n"], gone.get["n"], out)

    kind = config.get("format", "parquet")
    reader = spark.readStream.format(kind).schema(spark.read.format(kind).load(source).schema).option("maxFilesPerTrigger", config.get("max_files_per_batch", 1000))
    stream = reader.load(as_pattern(source)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    if not counts["batches"]:
        log.info("nothing new in %s", source)
    return counts


def result(spark: SparkSession, output: str) -> DataFrame:
    """The whole plan as it stands."""
    return parquet_if_any(spark, f"{output.rstrip('/')}/plan", PLAN).select("event_id", "recording_id", "target_label", "phase", "start_sample", "end_sample", "clipped", "warning")


def job1_epoch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole events table; its second run finds nothing new."""
    home = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", f"{home}/out", f"{home}/checkpoint", packaged(CONFIG))
    return result(spark, f"{home}/out")


#: Of events with one key the first counts; unusable ones give no row.
ORACLE = f"""WITH {catalog._EVENTS.replace("ev AS", "e0 AS")},
    ev AS (SELECT * FROM e0 WHERE event_id IS NOT NULL AND recording_id IS NOT NULL AND trim(coalesce(target_label, '')) <> '' AND onset_seconds >= 0 AND duration_seconds >= 0 AND NOT isnan(duration_seconds)
    QUALIFY row_number() OVER (PARTITION BY recording_id, event_id ORDER BY onset_seconds, duration_seconds, trim(target_label)) = 1),
    {catalog._REQUESTS}, g AS (SELECT *, greatest(0.0, requested_start) AS s, greatest(greatest(0.0, requested_start), CASE WHEN requested_end < requested_start THEN requested_start ELSE requested_end END) AS t FROM rq),
    h AS (SELECT *, greatest(0, least({catalog.TOTAL}, CAST(floor(s * 100.0::DOUBLE) AS BIGINT))) AS i, CASE WHEN requested_end < requested_start THEN requested_start ELSE requested_end END AS re FROM g),
    k AS (SELECT *, greatest(i, least({catalog.TOTAL}, CAST(ceil(t * 100.0::DOUBLE) AS BIGINT))) AS j FROM h)
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(recording_id AS VARCHAR) AS recording_id, trim(target_label) AS target_label, phase, CAST(i AS BIGINT) AS start_sample, CAST(j AS BIGINT) AS end_sample,
    (requested_end < requested_start OR s <> requested_start OR t <> re OR (j = {catalog.TOTAL} AND re > {catalog.TOTAL} / 100.0)) AS clipped,
    CASE WHEN requested_end < requested_start THEN phase || ' requested end preceded start; collapsed to zero-length' WHEN s <> requested_start OR t <> re THEN phase || ' window was clipped to the recording bounds'
    WHEN j = {catalog.TOTAL} AND re > {catalog.TOTAL} / 100.0 THEN phase || ' window exceeded the recording duration and was clipped' ELSE '' END AS warning FROM k JOIN ev USING (event_id)"""


if __name__ == "__main__":
    main("epoch_plan", ["source", "output", "checkpoint"], run, CONFIG)
