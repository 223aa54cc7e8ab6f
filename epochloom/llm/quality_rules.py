"""Line-first quality rules.

Every line is judged by itself (symbols, navigation, shouting, boilerplate,
punctuation); failing lines are removed, and a document is rejected if a base
figure is out of bounds, if what was removed is too much of its text, or if too
few words are left. All that goes counts, boilerplate, too. Of a long line with
a boilerplate phrase (a paragraph, a text without line ends) only the short
sentences with a phrase go, never the line.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WHITE, encode, only, read, slices

SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_END = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")

#: Phrases of licence, cookie and share lines.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of service",
    "terms of use", "privacy policy", "cookie policy", "accept cookies", "subscribe to our",
    "sign up for", "share this", "follow us on", "click here", "spdx-license-identifier",
    "©",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
#: Between sentences; the white space stays with the one before.
_SENTENCE = re.compile(r"(?<=[.!?…][ \t])(?=[^ \t])|(?<=[。！？])")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules; shares are of a line's or document's words."""

    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    symbols_per_word: float = 0.5
    min_bars: int = 3
    shout_share: float = 0.6
    shout_words: int = 4
    unended_words: int = 8
    max_lost_share: float = 0.5
    boilerplate_words: int = 20


def _lower(text: str) -> str:
    """Lower case, letter for letter (one capital would become two)."""
    return text.replace("\u0130", "i").lower()


def _says(text: str) -> bool:
    return _BOILERPLATE.search(_lower(text)) is not None


def _shouted(word: bytes) -> bool:
    """A capital letter and no small one, by their Unicode categories."""
    if word.isascii():
        return word.isupper()
    kinds = set(map(category, word.decode("utf-8", "surrogatepass")))
    return "Lu" in kinds and "Ll" not in kinds


def _line_fault(line: str, words: list[bytes], rules: LineRules, symbols: bool, phrases: bool) -> str | None:
    """The first rule that a line breaks, or None. symbols, phrases: whether
    the document has any, so that most lines need no search."""
    n_words = len(words)
    if symbols and line.count("|") >= rules.min_bars:
        return "navigation"
    if symbols and len(_SYMBOL.findall(line)) > rules.symbols_per_word * n_words:
        return "symbols"
    if n_words >= rules.shout_words and sum(map(_shouted, words)) > rules.shout_share * n_words:
        return "shouting"
    if phrases and _says(line):
        return "boilerplate"
    if n_words >= rules.unended_words and not _END.search(line.rstrip(WHITE)):
        return "punctuation"
    return None


def _without_boilerplate(line: str, k: int, rules: LineRules) -> str | None:
    """What stays of a line of k words with a boilerplate phrase: nothing of a
    short one, of a long one all but its short sentences with a phrase."""
    if k < rules.boilerplate_words:
        return None
    parts = [x for x in _SENTENCE.split(line) if not _says(x) or len(encode(x).split()) >= rules.boilerplate_words]
    return "".join(parts) if any(x.strip(WHITE) for x in parts) else None


def _repeat_words(words: list[bytes], width: int) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    counts, total, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + width - max(i, end)
            end = i + width
    return total


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    """Figures, verdict and cleaned text of one document."""
    text = text or ""
    data = encode(text)
    words = data.split()
    n = len(words)
    seen: set[str] = set()
    dup = gone = 0
    n_symbols = sum(map(text.count, SYMBOLS))
    phrases = _says(text)
    kept_lines, faults = [], Counter()
    for line in text.split("\n"):
        line_words = encode(line).split()
        k = len(line_words)
        if not k:
            kept_lines.append(line)
            continue
        dup += line in seen
        seen.add(line)
        fault = _line_fault(line, line_words, rules, n_symbols > 0, phrases)
        if fault is None:
            kept_lines.append(line)
        else:
            faults[fault] += 1
            gone += k
            rest = _without_boilerplate(line, k, rules) if fault == "boilerplate" else None
            if rest is not None:
                kept_lines.append(rest)
                gone -= len(encode(rest).split())
    repeat = _repeat_words(words, rules.repeat_window)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    return {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in WHITE),
        "n_symbols": n_symbols,
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "n_lines_removed": sum(faults.values()),
        "n_words_lost": gone,
        "kept": not failed and gone <= rules.max_lost_share * n and n - gone >= rules.min_words,
        "clean_text": "\n".join(kept_lines) if faults else text,
    }


_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_lines_removed long, n_words_lost long, kept boolean"
)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, figures, ``kept`` and, if asked for,
    ``clean_text`` without the failing lines.

    No shuffle; each document is judged alone. A null text counts as empty
    (no words: base_failed). Repeated rows and ids each give their own row,
    null ids stay null, an empty table gives an empty one, and columns other
    than the two named are not read.
    """
    src = only(docs, id_col, text_col)
    id_type = src.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {_SCHEMA}" + (", clean_text string" if with_text else "")
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["clean_text"] * with_text

    def run(batches):
        for batch in slices(batches):
            rows = [judge(t.as_py(), rules) for t in batch.column(1)]
            cols = [pa.array([r[k] for r in rows], pa.string() if k == "clean_text" else pa.bool_() if k in ("kept", "base_failed") else pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *names])

    return src.mapInArrow(run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), with_text=False)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept rows of a documents table with their cleaned text."""
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    src = only(docs, *schema.names)

    def run(batches):
        for batch in slices(batches):
            rows = [judge(t.as_py(), rules) for t in batch.column(1)]
            text = [r["clean_text"] for r in rows]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), batch.column(2), batch.column(3), pa.array(map(len, text), pa.int64())], schema.names
            )
            yield out.filter(pa.array([r["kept"] for r in rows], pa.bool_()))

    return src.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
