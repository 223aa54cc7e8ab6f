"""Letter profiles of languages, and how far they hold across sources.

Every text becomes a vector of letter shares. Languages are the labels and
sources the subjects of a pattern: the job says how alike the texts of a
language are, which other language comes closest, by what margin, and whether
the pattern holds for a source that had no part in it (left-out sources):

    <output>/profiles/lang=...   mean shares of each language and source
    <output>/report/lang=...     margins of each language, and of each left-out source

A run overwrites both tables with the same rows for the same input.

    python -m jobs.language_profiles --documents PATH --output DIR [--config FILE]
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Observation

from epochloom.functions.expr import text_or
from epochloom.functions.matrix import lists
from epochloom.operators import reliability, similarity
from epochloom.plans import catalog
from epochloom.sources.files import shared_dir

from .common import log, main, packaged

CONFIG = "language_profiles.json"


#: The most bytes of a text that are counted at a time.
CHUNK = 1 << 20


def letter_counts(text: bytes, letters: list[bytes]) -> list[int]:
    """How often each letter is in a text whose A-Z count as a-z; one pass for
    those of ASCII, whatever their number."""
    of = np.zeros(256, np.int64)
    held = np.frombuffer(text, np.uint8)
    for k in range(0, len(held), CHUNK):
        of += np.bincount(held[k : k + CHUNK], minlength=256)
    of[97:123] += of[65:91]
    of[65:91] = 0
    return [of[c[0]] if len(c) == 1 else text.count(c) for c in letters]  # no letter of UTF-8 begins inside another


def shares(rows: DataFrame, letters: str) -> DataFrame:
    """The other columns and x, the share of each letter among a text's letters,
    either case; rows without any are left out."""
    others = [c for c in rows.columns if c != "text"]
    each = [c.encode() for c in letters]

    def run(batches):
        for batch in batches:
            found = np.array([letter_counts(t or b"", each) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, len(each))
            total = found.sum(axis=1)
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in others], lists(found[at] / total[at, None])], [*others, "x"])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.mapInArrow(run, kept + "x array<double>")


def vectors(documents: DataFrame, config: dict) -> DataFrame:
    """label, subject, id, x of the texts that have letters. Blank or absent
    labels and subjects are the unknown one; rows count as often as they come."""
    name = F.lit(config["unknown"])
    rows = documents.select(
        text_or(f"`{config['label']}`", name).alias("label"), text_or(f"`{config['subject']}`", name).alias("subject"),
        F.col(f"`{config['text']}`").cast("string").cast("binary").alias("text"),
    )
    return shares(rows, config["letters"]).withColumn("id", F.lit(0))  # no step tells rows of a label apart


def report(rows: DataFrame) -> DataFrame:
    """lang, source, n_documents, held_out_margin, n_of_language, within, rest,
    strongest, margin: one row for each language and source."""
    sums = similarity.pair_totals(rows, ["label"], "id", "x")
    margins = similarity.control_margin(similarity.within(sums, ["label"]), similarity.between(sums, [], "label"), [], "label")
    held = reliability.grouped_holdout(rows, [], "label", "subject").select("label", "subject", F.col("margin").alias("held_out_margin"))
    counts = rows.groupBy("label", "subject").agg(F.count("*").alias("n_documents"))
    out = counts.join(held, ["label", "subject"], "left").join(margins, "label")  # as many rows as languages and sources
    six = lambda c: F.round(c, 6).alias(c)
    return out.select(
        F.col("label").alias("lang"), F.col("subject").alias("source"), "n_documents", six("held_out_margin"), F.col("n").alias("n_of_language"),
        six("within"), six("rest"), F.col("strongest_label").alias("strongest"), six("margin"),
    )


def profiles(rows: DataFrame, letters: str) -> DataFrame:
    """lang, source, letter, share: means over the texts."""
    means = similarity.centroids(rows, ["label", "subject"], "x")
    named = means.select(F.col("label").alias("lang"), F.col("subject").alias("source"), F.posexplode("centroid").alias("at", "share"))
    return named.select("lang", "source", F.element_at(F.array(*map(F.lit, letters)), F.col("at") + 1).alias("letter"), F.round("share", 6).alias("share"))


def run(spark: SparkSession, documents: str, output: str, config: dict) -> dict:
    """Both tables of the documents at a path; returns counts."""
    out = output.rstrip("/")
    seen, written, said = Observation(), Observation(), Observation()
    rows = vectors(spark.read.parquet(documents).observe(seen, F.count("*").alias("n")), config)
    kept = f"{out}/_vectors"
    rows.write.mode("overwrite").parquet(kept)  # the texts are read once; later steps read the shares
    rows = spark.read.parquet(kept)
    profiles(rows, config["letters"]).observe(written, F.count("*").alias("n")).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/profiles")
    report(rows).observe(said, F.count("*").alias("n")).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/report")
    counts = {"read": seen.get["n"], "profiles": written.get.get("n", 0), "report": said.get.get("n", 0)}
    log.info("%d documents read from %s; %d profile rows and %d report rows written to %s", counts["read"], documents, counts["profiles"], counts["report"], out)
    return counts


REPORT = "source string, n_documents long, held_out_margin double, n_of_language long, within double, rest double, strongest string, margin double, lang string"


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{output.rstrip('/')}/report").select("lang", "source", "n_documents", "held_out_margin", "n_of_language", "within", "rest", "strongest", "margin")


def job2_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole documents table, twice into one folder."""
    home = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{home}/out", packaged(CONFIG))
    return result(spark, f"{home}/out")


_LETTERS = packaged(CONFIG)["letters"]
_COUNTS = "[" + ", ".join(f"CAST(length(low) - length(replace(low, '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"
_V = (
    "t AS (SELECT row_number() OVER () AS id, coalesce(nullif(trim(lang), ''), 'unknown') AS label, coalesce(nullif(trim(source), ''), 'unknown') AS grp, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents), "
    f"cn AS (SELECT id, label, grp, {_COUNTS} AS k FROM t WHERE text_has(low)), v AS (SELECT id, label, grp, list_transform(k, lambda e: e / list_sum(k)) AS x FROM cn WHERE list_sum(k) > 0)"
).replace("text_has(low)", "low IS NOT NULL")
_CORR = catalog._CORR
_HELD = (
    "xp AS (SELECT label, grp, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM v), "
    "ct AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(e) AS m FROM xp GROUP BY ALL) GROUP BY label), "
    "sm AS (SELECT label, list(s ORDER BY pos) AS s, any_value(n) AS n FROM (SELECT label, pos, sum(e) AS s, count(*) AS n FROM xp GROUP BY ALL) GROUP BY label), "
    "sg AS (SELECT label, grp, list(s ORDER BY pos) AS p, any_value(m) AS m FROM (SELECT label, grp, pos, sum(e) AS s, count(*) AS m FROM xp GROUP BY ALL) GROUP BY ALL), "
    "rs AS (SELECT label, grp, list_transform(list_zip(s, p), lambda z: (z[1] - z[2]) / (n - m)) AS rest FROM sm JOIN sg USING (label) WHERE n > m), "
    f"ow AS (SELECT v.label, v.grp, avg({_CORR.format(a='x', b='rest')}) AS own FROM v JOIN rs ON v.label = rs.label AND v.grp = rs.grp GROUP BY ALL), "
    f"ob AS (SELECT v.id, v.label, v.grp, max({_CORR.format(a='x', b='c')}) AS other FROM v JOIN ct ON v.label <> ct.label GROUP BY ALL), "
    "ot AS (SELECT label, grp, max(other) AS other FROM ob GROUP BY ALL), "
    "hl AS (SELECT ow.label, ow.grp, own - coalesce(other, 0) AS held FROM ow LEFT JOIN ot USING (label, grp))"
)
#: The library's own sums of unit vectors, over the vectors of this job.
_SUMS = catalog._SUMS.removeprefix(catalog._VECTORS + ", ")
ORACLE = f"""WITH {_V}, {_SUMS}, {_HELD},
    cr AS (SELECT label, avg(similarity) AS rest, max(similarity) AS strong, arg_min(other_label, (-similarity, other_label)) AS strongest FROM bt GROUP BY label),
    nd AS (SELECT label, grp, count(*) AS n_documents FROM v GROUP BY ALL), nl AS (SELECT label, count(*) AS n FROM v GROUP BY label)
    SELECT nd.label AS lang, nd.grp AS source, nd.n_documents, round(hl.held, 6) AS held_out_margin, nl.n AS n_of_language, round(wi.within, 6) AS within, round(cr.rest, 6) AS rest, cr.strongest, round(wi.within - cr.rest, 6) AS margin
    FROM nd JOIN nl USING (label) LEFT JOIN hl ON hl.label = nd.label AND hl.grp = nd.grp LEFT JOIN wi ON wi.label = nd.label LEFT JOIN cr ON cr.label = nd.label"""


if __name__ == "__main__":
    main("language_profiles", ["documents", "output"], run, CONFIG)
