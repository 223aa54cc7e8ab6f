"""WARC records: writing, reading, and revisits resolved by an as-of join.

A server-not-modified revisit is joined to the latest earlier full response of
its canonical URL. If the validators agree, the revisit gets that response's
headers, with the permitted ones replaced by its own, and its payload.

The join sorts all captures by (URL, date) over many tasks, so that a URL with
any share of the captures is spread out; what a task must know of the tasks
before it is one response per boundary.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, only, partitions, read, slices

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Fields of a 304 answer that replace the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what is shown.
TRACKING = ("fbclid", "gclid", "ref", "sessionid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


# -- one record


@dataclass
class Record:
    """A WARC record: named fields, HTTP status line and headers, payload."""

    kind: str
    fields: dict[str, str]
    status: str = ""
    headers: list[tuple[str, str]] = field(default_factory=list)
    payload: bytes = b""

    @property
    def http_status(self) -> int | None:
        m = re.match(r"HTTP/\S+\s+(\d{3})", self.status)
        return int(m[1]) if m else None


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_bytes(record: Record, packed: bool = False) -> bytes:
    """WARC/1.1 bytes; packed: as one gzip member."""
    block = b""
    if record.status:
        head = "".join(f"{k}: {v}\r\n" for k, v in record.headers)
        block = f"{record.status}\r\n{head}\r\n".encode("utf-8", "surrogateescape") + record.payload
    elif record.payload:
        block = record.payload
    lines = {"WARC-Type": record.kind, **record.fields, "Content-Length": str(len(block))}
    out = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"
    return gzip.compress(out, 6, mtime=0) if packed else out


def _named(block: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and fields; continued lines are joined."""
    lines = block.decode("utf-8", "surrogateescape").replace("\r\n", "\n").split("\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return lines[0].strip(), fields


def records_in(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or gzip (a member for each record or not).
    Bytes between records are skipped; a cut-off last record ends the file."""
    if data[:2] == b"\x1f\x8b":
        data = _unpacked(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        version, named = _named(data[at:end])
        fields = dict(named)
        low = {k.lower(): v for k, v in named}
        size = low.get("content-length", "")
        if not re.fullmatch(r"WARC/\d+\.\d+", version) or not size.isdigit():
            at += 5
            continue
        block = data[end + 4 : end + 4 + int(size)]
        if len(block) < int(size):
            return
        at = end + 4 + int(size)
        kind = low.get("warc-type", "")
        fields = {k: v for k, v in fields.items() if k.lower() not in ("warc-type", "content-length")}
        if "application/http" in low.get("content-type", "") and block[:5] == b"HTTP/":
            head, _, payload = block.partition(b"\r\n\r\n")
            status, headers = _named(head)
            yield Record(kind, fields, status, headers, payload)
        else:
            yield Record(kind, fields, payload=block)


def _unpacked(data: bytes) -> bytes:
    """All gzip members; a damaged one ends the file."""
    import zlib

    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
            out.append(d.flush())
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out)


# -- tables of captures

CAPTURE = (
    "kind string, uri string, date timestamp, profile string, http_status int, "
    "headers array<struct<name:string,value:string>>, digest string"
)
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _captures(keys: pa.Array, data: Iterable[bytes | None], id_col: str, with_payload: bool) -> pa.RecordBatch:
    """Rows of all records in some byte strings."""
    ids, rows = [], []
    for key, d in zip(keys.to_pylist(), data):
        for r in records_in(d or b""):
            ids.append(key)
            rows.append((r, {k.lower(): v for k, v in r.fields.items()}))
    cols = [
        pa.array(ids, keys.type),
        pa.array([r.kind for r, _ in rows], pa.string()),
        pa.array([f.get("warc-target-uri", "").strip("<>") or None for _, f in rows], pa.string()),
        pa.array([_date(f.get("warc-date")) for _, f in rows], pa.timestamp("us", "UTC")),
        pa.array([f.get("warc-profile") for _, f in rows], pa.string()),
        pa.array([r.http_status for r, _ in rows], pa.int32()),
        pa.array([[{"name": k, "value": v} for k, v in r.headers] for r, _ in rows], _HEADERS),
        pa.array([f.get("warc-payload-digest") or (payload_digest(r.payload) if r.kind == "response" else None) for r, f in rows], pa.string()),
    ]
    if with_payload:
        cols.append(pa.array([r.payload for r, _ in rows], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, [id_col, "kind", "uri", "date", "profile", "http_status", "headers", "digest"] + ["payload"] * with_payload)


def parse(packed: DataFrame, id_col: str, data_col: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC bytes in ``data_col``: id, the capture's
    columns and, if asked for, payload. Null bytes hold no record."""
    src = only(packed, id_col, data_col)

    def run(batches):
        for batch in slices(batches, 256):
            yield _captures(batch.column(0), batch.column(1).to_pylist(), id_col, with_payload)

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, {CAPTURE}" + ", payload binary" * with_payload)


def _date(text: str | None):
    from datetime import datetime

    try:
        return datetime.fromisoformat((text or "").replace("Z", "+00:00")) if text else None
    except ValueError:
        return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of WARC files, with ``path`` as id. A file is one row while it
    is read, so files should be of the usual size (1 GB at most)."""
    return parse(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


# -- URLs


#: Characters whose percent-encoding says nothing (RFC 3986).
_UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _plain_percents(text: Column) -> Column:
    """Needless percent-encodings undone, the others in capitals."""
    codes = F.create_map(*[F.lit(x) for c in _UNRESERVED for x in (f"{ord(c):02X}", c)])

    def decoded(part: Column, at: Column) -> Column:
        pair, rest = F.upper(F.substring(part, 1, 2)), F.substring(part, 3, 1 << 30)
        coded = F.when(pair.rlike("^[0-9A-F]{2}$"), F.coalesce(F.try_element_at(codes, pair), F.concat(F.lit("%"), pair)))
        return F.when(at == 0, part).otherwise(F.coalesce(F.concat(coded, rest), F.concat(F.lit("%"), part)))

    return F.when(F.contains(text, F.lit("%")), F.array_join(F.transform(F.split(text, "%", -1), decoded), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Dot segments resolved; the first segment (before the first slash) stays."""
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        return F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, x))

    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(F.aggregate(F.split(path, "/", -1), empty, step), "/")).otherwise(path)


def canonical(url: Column) -> Column:
    """Host and path of a URL without scheme, www., its scheme's default port,
    fragment, tracking parameters and last slash; percent-encodings and dot
    segments normalised, parameters sorted. Null stays null."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(_without_dots(_plain_percents(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1))), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).isin(*TRACKING))
    kept = F.array_sort(F.transform(kept, _plain_percents))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _header(name: str) -> Column:
    """The first header of that name, or null."""
    hit = F.filter("headers", lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)["value"])


# -- resolution


def resolve(captures: DataFrame, id_col: str) -> DataFrame:
    """One row per capture: id, kind, url (canonical), date, status, source_id,
    headers (sorted "name: value", lower-case names) and digest of the payload
    that stands for it.

    status: full (a response with a 2xx status), resolved, mismatch (the
    validators disagree), unverified (no validator on both sides), orphan (no
    earlier full response), other. Only resolved rows get headers and digest
    from their source. Earlier means a smaller date; of responses of one date
    the one with the largest id counts. Captures without URL or date meet none.
    """
    spark = captures.sparkSession
    rows = captures.select(F.col(id_col).alias("id"), "kind", "uri", "date", "profile", "http_status", F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")).alias("headers"), "digest")
    full = (F.col("kind") == "response") & F.col("http_status").between(200, 299)
    revisit = (F.col("kind") == "revisit") & (F.coalesce("profile", F.lit("")).endswith("server-not-modified") | (F.col("http_status") == 304))
    rows = rows.select(
        "id", "kind", canonical(F.col("uri")).alias("url"), "date",
        F.when(full, 1).when(revisit, 0).otherwise(2).alias("role"),
        F.regexp_replace(_header("etag"), "^W/", "").alias("etag"), _header("last-modified").alias("modified"), "digest",
        F.transform("headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))).alias("headers"),
    )
    rows = materialise(rows, "parsed")  # ranges are found in one pass and dealt in another
    # by (URL, date) over many tasks; at one date revisits come before responses
    ordered = materialise(rows.repartitionByRange(partitions(spark), "url", "date", "role", "id").withColumn("task", F.spark_partition_id()), "captures")
    source = F.when((F.col("role") == 1) & F.col("url").isNotNull() & F.col("date").isNotNull(), F.struct("id", "date", "etag", "modified", "digest", "headers"))
    here = Window.partitionBy("task", "url").orderBy("date", "role", "id").rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn("source", F.last(source, ignorenulls=True).over(here))
    # the last response of each URL in each task, for the tasks after it: only URLs that go over a boundary
    ends = ordered.filter("url IS NOT NULL").groupBy("task", "url").agg(F.max(F.when(source.isNotNull(), F.struct("date", "id", source.alias("s"))))["s"].alias("end"))
    before = Window.partitionBy("url").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("carried IS NOT NULL").select("task", "url", "carried")
    # at most one URL goes over each boundary between tasks: a row for each task
    met = local.join(F.broadcast(carried), ["task", "url"], "left").withColumn("source", F.when((F.col("role") == 0) & F.col("date").isNotNull(), F.coalesce("source", "carried")))
    by_etag = F.when(F.col("etag").isNotNull() & F.col("source.etag").isNotNull(), F.col("etag") == F.col("source.etag"))
    by_date = F.when(F.col("modified").isNotNull() & F.col("source.modified").isNotNull(), F.col("modified") == F.col("source.modified"))
    by_digest = F.when(F.col("digest").isNotNull() & F.col("source.digest").isNotNull(), F.col("digest") == F.col("source.digest"))
    valid = F.coalesce(by_etag, by_date, by_digest)
    status = (
        F.when(F.col("role") == 1, "full").when(F.col("role") == 2, "other").when(F.col("source.id").isNull(), "orphan")
        .when(valid.isNull(), "unverified").when(valid, "resolved").otherwise("mismatch")
    )
    met = met.withColumn("status", status)
    own = F.filter("headers", lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(own, lambda h: h["name"])
    merged = F.concat(F.filter("source.headers", lambda h: ~F.array_contains(names, h["name"])), own)
    resolved = F.col("status") == "resolved"
    lines = F.array_sort(F.transform(F.when(resolved, merged).otherwise(F.col("headers")), lambda h: F.concat(h["name"], F.lit(": "), h["value"])))
    return met.select(
        F.col("id").alias(id_col), "kind", "url", "date", "status", F.when(F.col("role") == 1, F.col("id")).otherwise(F.col("source.id")).alias("source_id"),
        lines.alias("headers"), F.when(resolved, F.col("source.digest")).otherwise(F.col("digest")).alias("digest"),
    )


# -- the query


def page_captures(page_id: int, url: str | None, html: str | None) -> Iterable[Record]:
    """The two captures that the query makes of a page: a response, and a
    revisit thirty days later. Every tenth page has changed in between (its
    revisit names another entity tag); every seventh names no entity tag, and
    its date of change decides."""
    from datetime import datetime, timedelta, timezone

    body = (html or "").encode("utf-8", "surrogatepass")
    first = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=page_id)
    again = first + timedelta(days=30)
    tag = f'"{hashlib.md5(body).hexdigest()}"'
    changed = f"{first - timedelta(days=1):%Y-%m-%dT%H:%M:%SZ}"
    common = {"Content-Type": "application/http"} | ({"WARC-Target-URI": url} if url else {})
    iso = "%Y-%m-%dT%H:%M:%SZ"
    yield Record(
        "response", {**common, "WARC-Date": first.strftime(iso), "WARC-Payload-Digest": payload_digest(body)}, "HTTP/1.1 200 OK",
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))), ("ETag", tag), ("Last-Modified", changed), ("Cache-Control", "max-age=60"), ("Server", "stored")], body,
    )
    validators = [("Last-Modified", changed)] if page_id % 7 == 0 else [("ETag", '"changed"' if page_id % 10 == 0 else f"W/{tag}")]
    yield Record(
        "revisit", {**common, "WARC-Date": again.strftime(iso), "WARC-Profile": NOT_MODIFIED}, "HTTP/1.1 304 Not Modified",
        [*validators, ("Cache-Control", "max-age=120"), ("Content-Length", "0"), ("Server", "revisited")],
    )


def _page_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [b"".join(map(to_bytes, page_captures(*row))) for row in zip(*(c.to_pylist() for c in batch.columns))]


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, data): each page's captures as WARC bytes. The captures' dates
    come from the ids, so pages without an id have none."""
    src = only(pages, "page_id", "url", "html").filter("page_id IS NOT NULL")

    def run(batches):
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_page_bytes(batch), pa.binary())], ["page_id", "data"])

    return src.mapInArrow(run, "page_id long, data binary")


def archived_captures(pages: DataFrame) -> DataFrame:
    """parse(archive(pages)) without payloads, the bytes made and read again in
    one task instead of travelling between two."""
    src = only(pages, "page_id", "url", "html").filter("page_id IS NOT NULL")

    def run(batches):
        for batch in slices(batches, 256):
            yield _captures(batch.column(0), _page_bytes(batch), "page_id", False)

    return src.mapInArrow(run, f"page_id long, {CAPTURE}")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archived_captures(read(spark, sf_dir, "pages"))
    out = resolve(captures, "page_id")
    return out.select(
        "page_id", "kind", "url", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "status", "source_id",
        F.array_join("headers", "\n").alias("headers"), "digest",
    )
