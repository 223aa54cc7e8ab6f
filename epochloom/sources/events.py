"""Event tables: reading CSV, TSV and JSON, and one normal form."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import text_or
from .files import is_folder

#: Column names that are understood, by normal name; the first that the table has is used.
ALIASES = {
    "onset_seconds": ("onset_seconds", "onset", "start_seconds"), "duration_seconds": ("duration_seconds", "duration", "length_seconds"),
    "event_family": ("event_family", "family"), "target_label": ("target_label", "label"), "event_subtype": ("event_subtype", "subtype"),
    "event_id": ("event_id",), "recording_id": ("recording_id",), "label_namespace": ("label_namespace",),
}


#: Fields that every row of a table in normal form has.
NORMAL = ("event_id", "recording_id", "onset_seconds", "duration_seconds", "event_family", "target_label")


def _file_rows(path: str, content: bytes) -> tuple[str, list[dict]]:
    """(form, rows) of a file: normal if every row has the fields of the normal
    form, else raw. Raises ValueError for what is no event table."""
    text, kind = content.decode("utf-8-sig"), path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        held = json.loads(text)
        rows = held.get("events") if isinstance(held, dict) else held
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValueError("a JSON event table is a list of events or an object with a list 'events'")
        normal = all(set(NORMAL) <= set(r) for r in rows)
    else:
        rows, normal = list(csv.DictReader(io.StringIO(text, newline=""), delimiter="\t" if kind == "tsv" else ",")), False
        if any(None in r for r in rows):
            raise ValueError("a row has more fields than the header")
    return ("normal" if normal else "raw"), rows


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_event_folder(spark: SparkSession, folder: str) -> DataFrame:
    """source_path, form, _row, fields (map of texts), metadata (map), message:
    the rows of all CSV, TSV and JSON files of a folder. The form is told file
    by file (normal form, else raw), so that a folder may mix them, and columns
    of one file say nothing about another. Fields of the normal form's own
    metadata are apart. A file that can't be read is a row with a message."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cCtTjJ][sS][vVoO]*").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    form, rows = _file_rows(path, content)
                except (ValueError, AttributeError) as fault:
                    yield pd.DataFrame({"source_path": [path], "form": ["unreadable"], "_row": [0], "fields": [{}], "metadata": [{}], "message": [str(fault)]})
                    continue
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    inner = [r.get("metadata") if form == "normal" and isinstance(r.get("metadata"), dict) else {} for r in part]
                    yield pd.DataFrame({
                        "source_path": path, "form": form, "_row": range(at, at + len(part)), "message": None,
                        "fields": [{k: _as_text(v) for k, v in r.items() if not (k == "metadata" and m is not None and form == "normal")} for r, m in zip(part, inner)],
                        "metadata": [{k: _as_text(v) for k, v in m.items()} for m in inner],
                    })

    return raw.mapInPandas(run, "source_path string, form string, _row long, fields map<string,string>, metadata map<string,string>, message string")


def folder_columns(rows: DataFrame) -> DataFrame:
    """The rows of ``read_event_folder`` as columns that ``normalise`` takes: an
    alias counts by being a field of the row, in the order of the aliases."""
    fields = F.col("fields")
    named = []
    for name, aliases in ALIASES.items():
        value = F.lit(None).cast("string")
        for alias in reversed(aliases):
            value = F.when(F.map_contains_key(fields, alias), F.element_at(fields, alias)).otherwise(value)
        named.append(value.alias(name))
    known = F.array(*[F.lit(a) for aliases in ALIASES.values() for a in aliases], F.lit("obs_idx"))
    rest = F.map_filter(fields, lambda k, v: ~F.array_contains(known, k) & v.isNotNull())
    kept = F.map_filter("metadata", lambda k, v: ~F.map_contains_key(rest, k) & v.isNotNull())
    return rows.filter("message IS NULL").select(*named, F.map_concat(rest, kept).alias("metadata"), "source_path", "_row")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an event file as text columns, in file order (``_row``), or of a
    folder of event files, in which forms may be mixed (ordered by file; a file
    that is no event table is refused)."""
    if is_folder(spark, path):
        rows = read_event_folder(spark, path)
        bad = rows.filter("message IS NOT NULL").select("source_path", "message").limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r['source_path']}: {r['message']}" for r in bad))
        # a place over all files, for those whose events have no id
        return folder_columns(rows).withColumn("_row", F.struct("source_path", "_row")).drop("source_path")
    low = path.lower()
    if low.endswith((".csv", ".tsv")):
        raw = spark.read.csv(path, header=True, sep="\t" if low.endswith(".tsv") else ",")
    elif low.endswith(".json"):
        raw = spark.read.json(path, multiLine=True)
        if "events" in raw.columns and dict(raw.dtypes)["events"].startswith("array<struct"):
            raw = raw.select(F.explode("events").alias("_e")).select("_e.*")
    else:
        raise ValueError(f"unknown event table format: {path}")
    return raw.withColumn("_row", F.monotonically_increasing_id())


def normalise(raw: DataFrame, order: list[str], recording_id: str = "", label_namespace: str = "") -> DataFrame:
    """event_id, recording_id, onset_seconds, duration_seconds, event_family,
    target_label, event_subtype, label_namespace, metadata, obs_idx.

    An alias counts by being a column, not by its value. Absent numbers are 0,
    texts that are no number give null (a fault); absent ids are made from the
    recording and the row's place in ``order`` within it; columns without a
    meaning go to ``metadata``. obs_idx is an event's place in its recording
    by onset, then id.
    """
    has = set(raw.columns)

    def named(name: str) -> Column | None:
        return next((F.col(f"`{a}`") for a in ALIASES[name] if a in has), None)

    def text(name: str, *other: Column) -> Column:
        c = named(name)
        return text_or(c.cast("string") if c is not None else F.lit(""), *other)

    def number(name: str) -> Column:
        """0 if the column or its value is absent, null if it isn't a number."""
        c = named(name)
        return F.lit(0.0) if c is None else F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(0.0)).otherwise(c.cast("string").try_cast("double"))

    known = {a for names in ALIASES.values() for a in names} | {"_row", "obs_idx"} | set(order)
    # a column "metadata" of an already normal table is its own map
    held = "metadata" in has and raw.schema["metadata"].dataType.typeName() == "map"
    inner = [f.name for f in raw.schema["metadata"].dataType] if "metadata" in has and raw.schema["metadata"].dataType.typeName() == "struct" else []
    rest = [c for c in raw.columns if c not in known and not (c == "metadata" and inner)]
    values = [(c, F.col(f"`{c}`")) for c in rest] + [(c, F.col("metadata")[c]) for c in inner if c not in rest]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values]) if values else None
    metadata = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())) if values else F.create_map().cast("map<string,string>")
    metadata = F.col("metadata") if held else metadata
    rows = raw.select(
        text("event_id").alias("_id"), text("recording_id", F.lit(recording_id)).alias("recording_id"), number("onset_seconds").alias("onset_seconds"), number("duration_seconds").alias("duration_seconds"),
        text("event_family").alias("event_family"), text("target_label").alias("target_label"), text("event_subtype").alias("event_subtype"), text("label_namespace", F.lit(label_namespace)).alias("label_namespace"),
        metadata.alias("metadata"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
    )
    place = Window.partitionBy("recording_id").orderBy(*[f"_o{i}" for i in range(len(order))])
    made = F.format_string("%s_event_%04d", text_or("recording_id", F.lit("recording")), F.col("_place"))
    rows = rows.withColumn("_place", F.row_number().over(place)).withColumn("event_id", text_or("_id", made))
    in_time = Window.partitionBy("recording_id").orderBy("onset_seconds", "event_id", "_place")
    return rows.withColumn("obs_idx", F.row_number().over(in_time).cast("long")).select(
        "event_id", "recording_id", "onset_seconds", "duration_seconds", "event_family", "target_label", "event_subtype", "label_namespace", "metadata", "obs_idx"
    )


def faults(events: DataFrame) -> DataFrame:
    """event_id, recording_id, message: rows that can't be used."""
    rules = [
        *[(F.col(c) == "", f"no {c}") for c in ("event_id", "recording_id", "event_family", "target_label")],
        *[(F.col(c).isNull() | F.isnan(c), f"{c} is no number") for c in ("onset_seconds", "duration_seconds")],
        *[(F.col(c) < 0, f"{c} is negative") for c in ("onset_seconds", "duration_seconds")],
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda m: m.isNotNull())
    return events.select("event_id", "recording_id", F.explode(found).alias("message"))
