"""Secret scan in DataFrame functions alone: patterns and sliding entropy.

Base kinds are patterns. The method adds spans of kind ``entropy``: inside
candidate strings (long runs of one character class) a window of fixed width
slides along, its character counts are updated by the one character that
enters and the one that leaves, and windows whose Shannon entropy reaches the
class's threshold are merged into a span, unless an allow-list pattern or the
base spans together cover it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read, text_or_empty

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidate strings of one class: ``pattern`` finds runs, ``mixed`` must
    all be found in them, ``alphabet`` lists the counted characters."""

    name: str
    pattern: str
    alphabet: str
    threshold: float
    mixed: tuple[str, ...] = ()


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hex", r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}(?![0-9A-Za-z])", _DIGITS + "abcdefABCDEF", 2.9, ("[0-9]", "[a-fA-F]")),
    CharClass("base64", r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{20,}", _DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 3.6, ("[0-9]", "[a-z]", "[A-Z]")),
)
WINDOW = 20
#: Strings that look random but are no secrets.
ALLOW = (
    r"(?i)example", r"(?i)^(?:0x)?0+$", r"(?i)deadbeef", r"(?i)x{8,}", r"0123456789", r"(?i)abcdefghij",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)^sha(?:1|256|512)-",
)


_SPANS = "array<struct<s:int,e:int,m:string>>"


def _located(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<s, e, m>> of ``found``, the leftmost non-overlapping
    matches; code points, end exclusive. Positions come from the lengths of
    the pieces between the matches."""
    empty = F.array().cast(_SPANS)
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("p"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(found) > 0, spans).otherwise(empty)  # almost no text has a match


def _c_log_c(count: Column, width: int) -> Column:
    """c * log2(c), from a table."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)])
    return F.element_at(table, count + 1)


def _random_parts(run: Column, cls: CharClass, width: int) -> Column:
    """array<struct<s, e>>: merged windows of ``run`` whose entropy reaches
    the class's threshold. c: count of each character in the window; t: the
    sum of c log2 c, changed by the entering and the leaving character only."""
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    pairs = F.arrays_zip(codes.alias("a"), F.concat(F.array_repeat(F.lit(0), width), codes).alias("z"))
    most = width * (math.log2(width) - cls.threshold) + 1e-9
    empty = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.lit(0)
    init = F.struct(F.array_repeat(zero, len(cls.alphabet)).alias("c"), F.lit(0.0).alias("t"), zero.alias("i"), F.lit(-1).alias("s"), zero.alias("e"), empty.alias("out"))

    def step(acc, x):
        c, one = acc["c"], F.lit(1)
        count_in = F.element_at(c, F.greatest(x["a"], one))
        count_out = F.element_at(c, F.greatest(x["z"], one))
        same = x["a"] == x["z"]
        total = acc["t"] + F.when(same, F.lit(0.0)).otherwise(
            _c_log_c(count_in + 1, width) - _c_log_c(count_in, width)
            + F.when(x["z"] == 0, F.lit(0.0)).otherwise(_c_log_c(F.greatest(count_out - 1, zero), width) - _c_log_c(count_out, width))
        )
        counts = F.when(same, c).otherwise(
            F.transform(c, lambda n, k: n + F.when(k + 1 == x["a"], one).otherwise(zero) - F.when(k + 1 == x["z"], one).otherwise(zero))
        )
        start = acc["i"] + 1 - width
        hit = (start >= 0) & (total <= most)
        fresh = hit & (start > acc["e"])
        last = F.struct(acc["s"].alias("s"), acc["e"].alias("e"))
        return F.struct(
            counts.alias("c"), total.alias("t"), (acc["i"] + 1).alias("i"),
            F.when(hit & ((acc["s"] < 0) | fresh), start).otherwise(acc["s"]).alias("s"),
            F.when(hit, acc["i"] + 1).otherwise(acc["e"]).alias("e"),
            F.when(fresh & (acc["s"] >= 0), F.array_append(acc["out"], last)).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc):
        return F.when(acc["s"] >= 0, F.array_append(acc["out"], F.struct(acc["s"].alias("s"), acc["e"].alias("e")))).otherwise(acc["out"])

    # the zip is as long as its longer side: cut it to the run
    return F.aggregate(F.slice(pairs, F.lit(1), F.length(run)), init, step, finish)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``_text``, the ``keep`` columns and ``spans``: array<struct<s, k, e,
    kind>>, by start, then kind as listed. One row per row of ``docs``.

    A row alone is looked at: no shuffle, no Python. Null texts count as
    empty (no spans); null ids, repeated rows, empty tables and other columns
    pass unharmed: only the named columns are read. Entropy spans that base
    spans cover are left out, others stay whole; base spans always stay.
    """
    df = only(docs, id_col, text_col, *keep).select(F.col(id_col), text_or_empty(text_col).alias("_text"), *[F.col(c) for c in keep])
    text = F.col("_text")
    base = {"assign": ASSIGN, "access": f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", "hex": f"[0-9a-f]{{{MIN_HEX},}}"}
    patterns = base | {f"c{i}": c.pattern for i, c in enumerate(classes)}
    df = df.withColumns({f"_f_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    # a candidate needs all of its class's kinds of characters somewhere
    df = df.withColumns(
        {f"_f_c{i}": F.when(F.exists(F.col(f"_f_c{i}"), _mixed(c)), F.col(f"_f_c{i}")).otherwise(F.array().cast("array<string>")) for i, c in enumerate(classes)}
    )
    df = df.withColumns({f"_p_{k}": _located(text, p, F.col(f"_f_{k}")) for k, p in patterns.items()})
    value = F.regexp_extract  # group 2 of an assignment, matched again on the match alone
    parts = []
    for n, kind in enumerate(("assign", "access", "hex")):
        spans = F.col(f"_p_{kind}")
        if kind == "assign":
            spans = F.filter(spans, lambda x: F.length(value(x["m"], ASSIGN, 2)) >= MIN_ASSIGN)
        parts.append(F.transform(spans, _labelled(n, kind)))
    df = df.withColumn("_base", F.array_sort(F.concat(*parts)))
    more = [_class_spans(F.col(f"_p_c{i}"), c, width, allow) for i, c in enumerate(classes)]
    df = df.withColumn("_more", F.array_sort(F.array_distinct(F.concat(*more))))
    free = F.filter(F.col("_more"), lambda x: _covered_to(x, F.col("_base")) < x["e"])
    extra = F.transform(free, _labelled(len(base), "entropy"))
    return df.select(id_col, "_text", *keep, "_base", F.array_sort(F.concat("_base", extra)).alias("spans"))


def _covered_to(x: Column, base: Column) -> Column:
    """Where the cover of span x from its start by sorted base spans ends."""
    return F.aggregate(base, x["s"], lambda at, b: F.when(b["s"] <= at, F.greatest(at, b["e"])).otherwise(at))


def _labelled(rank: int, kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def _mixed(cls: CharClass):
    return lambda m: _all_in(m, cls.mixed)


def _class_spans(located: Column, cls: CharClass, width: int, allow: tuple[str, ...]) -> Column:
    """Spans in the text of the random parts of a class's candidates."""
    candidates = F.filter(located, lambda x: _all_in(x["m"], cls.mixed) & ~_any_in(x["m"], allow))

    def shifted(x):
        return F.transform(_random_parts(x["m"], cls, width), lambda w: F.struct((x["s"] + w["s"]).alias("s"), (x["s"] + w["e"]).alias("e")))

    return F.flatten(F.transform(candidates, shifted))


def _all_in(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & x.rlike(p)
    return out


def _any_in(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``."""

    def step(acc, x):
        apart = x["s"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, init, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def mask_documents(docs: DataFrame) -> DataFrame:
    """A documents table with every secret replaced; no row goes."""
    found = secret_spans(docs, keep=("lang", "source")).withColumn("text", redact(F.col("_text"), F.col("spans")))
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
