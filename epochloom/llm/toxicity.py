"""Toxicity scores after noisy-channel deobfuscation.

1. A model of four characters in a row over the whole corpus: every task counts
   those of its texts, the counts are summed by key.
2. Words that look disguised (digits or signs among letters, letters repeated)
   and runs of letters set apart become lattices: each character may stand for
   itself, for the letters it is used for, for a gap between words (a separator)
   or for nothing (a separator, a repetition), at a cost. Viterbi decoding finds
   the cheapest reading under the character model; the readings in their places
   are the restored text.
3. The words of the restored text, whole and as prefixes, are hashed features.
   Their log odds come from a bounded sample of labelled rows; a logistic curve
   turns a text's strongest evidence into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read, slices

#: Symbols of the character model: 0 is a gap, 1-26 are a-z, 27 any other letter.
SYMBOLS = 28
ORDER = 4
N_GRAMS = SYMBOLS**ORDER
#: What a character can stand for beside itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
SEPARATORS = " .-_*'~^"
_STRIP = ".,;:!?\"'()[]{}<>«»“”‘’…%&#*|$"
_BETWEEN = r"[\s.\-_*'~^]"
_SINGLE = r"[^\W_]|[@$!|€£¡]"
#: Three or more single letters or signs for letters, set apart by white space or
#: separators. Marks may stand before and after (quotes, brackets, the end of a
#: sentence), but no letter or digit.
_SPACED = re.compile(rf"(?<![^\W_])(?:(?:{_SINGLE}){_BETWEEN}+){{2,}}(?:{_SINGLE})(?![^\W_])")
_LETTER = re.compile(r"[^\W\d_]")
#: A word is looked at if a sign stands beside a letter inside it, or a letter comes three times.
_ODD = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*#.\-_'~^]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]{2}|([^\W\d_])\1\1")


@dataclass(frozen=True)
class Settings:
    """sample_rows: the most labelled rows that the fit uses, those with the
    smallest hash of their id; all else covers all rows."""

    sample_rows: int = 20_000
    bits: int = 20
    min_prefix: int = 3
    max_prefix: int = 8
    min_documents: int = 4
    min_g: float = 24.0
    sub_cost: float = 1.0
    drop_cost: float = 0.7
    gap_cost: float = 2.0
    keep_sign_cost: float = 6.0
    folds: int = 5


def _fold_table() -> np.ndarray:
    """Symbol of each code point below U+0250: accents folded."""
    table = np.zeros(0x251, np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c).lower())[:1]
        table[c] = ord(base) - 96 if "a" <= base <= "z" else 27 if chr(c).isalpha() else 0
    table[0x250] = 27  # every later one
    return table


_FOLD = _fold_table()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _FOLD[np.minimum(points, 0x250)]


def gram_codes(texts: list[str]) -> np.ndarray:
    """Numbers of all runs of ORDER symbols, gaps before and behind each text."""
    gap = np.zeros(ORDER - 1, np.uint8)
    s = np.concatenate([x for t in texts for x in (gap, symbols(t))] + [gap[:1]]).astype(np.int64)
    out = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
    for k in range(ORDER):
        out = out * SYMBOLS + s[k : k + len(out)]
    return out


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): counts over every text; at most SYMBOLS to the ORDER rows."""

    def run(batches):
        total = np.zeros(N_GRAMS, np.int64)
        for batch in slices(batches):
            texts = [t for t in batch.column(0).to_pylist() if t]
            if texts:
                total += np.bincount(gram_codes(texts), minlength=N_GRAMS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["gram", "n"])

    return only(docs, text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(symbol | those before it), interpolated with the shorter contexts;
    one row for each context."""
    levels = [counts.reshape((SYMBOLS,) * ORDER).astype(float)]
    while levels[-1].ndim > 1:
        levels.append(levels[-1].sum(0))
    p = (levels[-1] + 1) / (levels[-1].sum() + SYMBOLS)
    for c in reversed(levels[:-1]):
        p = (c + 4 * p) / (c.sum(-1, keepdims=True) + 4)
    return -np.log(p).reshape(-1, SYMBOLS)


class Decoder:
    """Viterbi decoding of character lattices under the character model."""

    def __init__(self, costs: np.ndarray, settings: Settings = Settings()):
        self.costs = costs.ravel().tolist()
        self.settings = settings

    def options(self, text: str, i: int) -> list[tuple[str, float]]:
        """Letters that position i may give, a blank for a gap, "" for none,
        each with a cost. Of several separators in a row the first may be a
        gap, and two blanks are one for sure rather than none."""
        s, c = self.settings, text[i]
        out: list[tuple[str, float]] = []
        if c.isalpha():
            out.append((c, 0.0))
            if i and text[i - 1] == c:
                out.append(("", s.drop_cost * 0.5))
            return out
        out += [(x, s.sub_cost * (1.5 if len(LEET[c]) > 2 else 1.0)) for x in LEET.get(c, "")]
        apart = c in SEPARATORS or c.isspace()
        again = i > 0 and (text[i - 1] == c or apart and (text[i - 1] in SEPARATORS or text[i - 1].isspace()))
        if apart or again:
            out.append(("", 0.0 if again and apart else s.drop_cost))
        if apart and not again:
            wide = c.isspace() and text[i + 1 : i + 2].isspace()
            out.append((" ", 0.0 if wide else s.gap_cost))
        if not out:
            out.append(("", s.keep_sign_cost))
        return out

    def decode(self, text: str) -> str:
        """The cheapest reading, its words apart by blanks; the text stands
        between gaps. A state is the number of the last symbols, so that time
        is linear in the text."""
        costs, contexts = self.costs, N_GRAMS // SYMBOLS
        # by state its cost and its reading, kept as linked pairs
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for i in range(len(text)):
            after: dict[int, tuple[float, tuple | None]] = {}
            opts = [(x, int(_FOLD[min(ord(x), 0x250)]) if x else -1, cost) for x, cost in self.options(text, i)]
            for state, (so_far, said) in states.items():
                for x, symbol, cost in opts:
                    if symbol < 0:
                        key, total, now = state, so_far + cost, said
                    else:
                        at = state * SYMBOLS + symbol
                        key, total, now = at % contexts, so_far + cost + costs[at], (said, x)
                    if key not in after or total < after[key][0]:
                        after[key] = (total, now)
            states = after
        best = min(((total + costs[state * SYMBOLS], said) for state, (total, said) in states.items()), key=lambda v: v[0])[1]
        out = []
        while best is not None:
            best, x = best
            out.append(x)
        return "".join(reversed(out))


def restore(word: str, decoder: Decoder) -> str | None:
    """The reading of a disguised word (lower case) of any length, or None if
    it isn't one."""
    core = word.strip(_STRIP) if not word[:1] in "@$!|+(€£¡" else word.rstrip(_STRIP)
    if len(core) < 3 or not _ODD.search(core):
        return None
    return decoder.decode(core)


def spaced_runs(low: str) -> list[re.Match]:
    """Runs of single letters and signs set apart, two letters among them."""
    return [m for m in _SPACED.finditer(low) if len(_LETTER.findall(m[0])) >= 2]


def _pieces(low: str, reading) -> list[str]:
    """The text between the spaced runs, and the runs' readings, in order."""
    out, at = [], 0
    for m in spaced_runs(low):
        out += [low[at : m.start()], f" {reading(m[0])} "]
        at = m.end()
    return [*out, low[at:]]


def restored_text(text: str | None, decoder: Decoder) -> str:
    """A text in lower case with its disguised words and spaced runs put right."""
    return WordReader(decoder, decoder.settings).restored(text)


def features_of(word: str, settings: Settings) -> list[int]:
    """Hashed features of a bare word: whole, and its prefixes."""
    mask = (1 << settings.bits) - 1
    out = [zlib.crc32(f"={word}".encode()) & mask]
    out += [zlib.crc32(word[:k].encode()) & mask for k in range(settings.min_prefix, min(settings.max_prefix, len(word)) + 1)]
    return out


class WordReader:
    """Restored texts and their bare words; what was made of a token or a run
    is remembered, up to a bound."""

    def __init__(self, decoder: Decoder, settings: Settings, room: int = 400_000):
        self.decoder, self.settings, self.room = decoder, settings, room
        self.memory: dict[str, object] = {}
        self.readings: dict[str, str] = {}

    def reading(self, run: str) -> str:
        """Of a run of letters set apart."""
        out = self.readings.get(run)
        if out is None:
            out = self.decoder.decode(run)
            if len(run) <= 64:
                if len(self.readings) >= self.room // 8:
                    self.readings.clear()
                self.readings[run] = out
        return out

    def token(self, token: str) -> str:
        """A token as the restored text has it."""
        return restore(token, self.decoder) or token

    def restored(self, text: str | None) -> str:
        low = "".join(_pieces((text or "").lower(), self.reading))
        return " ".join(map(self.token, low.split()))

    def bare(self, token: str) -> list[str]:
        """The bare words that a token of the text gives to the restored one."""
        return [w for w in (x.strip(_STRIP) for x in self.token(token).split()) if w]

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens between which and the readings of spaced runs the
        restored text is divided: words of readings need no second look."""
        low = text.lower()
        return set("".join(_pieces(low, self.reading) if _SPACED.search(low) else (low,)).split())


@dataclass
class Model:
    """weights: log odds by feature, positive and selected; curve: intercept
    and slopes of the strongest weight and of the number of toxic words."""

    settings: Settings
    costs: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.reader = WordReader(Decoder(model.costs, model.settings), model.settings)

    def weight(self, token: str) -> float:
        memory = self.reader.memory
        w = memory.get(token)
        if w is None:
            if len(memory) >= self.reader.room:
                memory.clear()
            get, s = self.model.weights.get, self.model.settings
            w = memory[token] = max((get(f, 0.0) for word in self.reader.bare(token) for f in features_of(word, s)), default=0.0)
        return w

    def evidence(self, text: str | None) -> tuple[float, float]:
        """(strongest weight, log of 1 + number of words with one)."""
        if not text:
            return 0.0, 0.0
        found = [w for t in self.reader.tokens(text) if (w := self.weight(t))]
        return max(found, default=0.0), math.log1p(len(found))

    def score(self, text: str | None) -> float:
        a, b, c = self.model.curve
        x, y = self.evidence(text)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, s: Settings) -> dict[int, float]:
    """Weights of the features that are clearly more frequent in toxic rows
    (documents counted once): smoothed log odds, selected by the G statistic."""
    many = np.flatnonzero((pos >= s.min_documents) & (pos * max(n_neg, 1) > neg * max(n_pos, 1)))
    out = {}
    for f in many.tolist():
        a, b = float(pos[f]), float(neg[f])
        rate = (a + b) / (n_pos + n_neg)
        g = 0.0
        for k, n in ((a, n_pos), (b, n_neg)):
            for x, e in ((k, n * rate), (n - k, n * (1 - rate))):
                if x > 0 and e > 0:
                    g += 2 * x * math.log(x / e)
        w = math.log((a + 0.5) / (n_pos + 1)) - math.log((b + 0.5) / (n_neg + 1))
        if g >= s.min_g and w > 1.5:
            out[f] = w
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve over two columns by Newton steps, slightly shrunk."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return float(math.log(rate / (1 - rate))), 0.0, 0.0
    a = np.column_stack((np.ones(len(y)), x))
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag((1e-6, 0.1, 0.1))
        step = np.linalg.solve(hess, a.T @ (y - p) - np.array((0.0, 0.1, 0.1)) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in beta)


def _fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model: characters of all texts, weights of a bounded sample of
    labels outside the held-out fold. Ids, languages and sources are no
    features."""
    counts = np.zeros(N_GRAMS, np.int64)
    found = char_counts(docs, text_col).toArrow()  # at most SYMBOLS to the ORDER rows
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    costs = gram_costs(counts)
    known = only(labels, id_col, label_col).toDF("_id", "_y").filter("_id IS NOT NULL AND _y IS NOT NULL")
    sample = known.filter(_fold("_id", settings.folds) != 0).orderBy(F.xxhash64("_id"), "_id", "_y").limit(settings.sample_rows)
    rows = only(docs, id_col, text_col).toDF("_id", "_t").join(F.broadcast(sample), "_id").select("_y", "_t")

    def features(batches):
        """For each sampled row its label and distinct features."""
        reader = WordReader(Decoder(costs, settings), settings)
        for batch in slices(batches):
            lists = []
            for cell in batch.column(1):
                seen: set[int] = set()
                for t in reader.tokens(cell.as_py() or ""):
                    for word in reader.bare(t):
                        seen.update(features_of(word, settings))
                lists.append(seen)
            y = [int(v.as_py() != 0) for v in batch.column(0)]
            size = 1 << settings.bits
            for k in (0, 1):
                mine = [np.fromiter(v, np.int64, len(v)) for v, label in zip(lists, y) if label == k]
                total = np.bincount(np.concatenate(mine), minlength=size) if mine else np.zeros(size, np.int64)
                at = np.flatnonzero(total)
                n = len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1 - k)), pa.array(np.append(total[at] if k else at * 0, n * k)), pa.array(np.append(at * 0 if k else total[at], n * (1 - k)))], ["f", "pos", "neg"])

    size = 1 << settings.bits
    pos, neg = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n_pos = n_neg = 0
    summed = rows.mapInArrow(features, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    for r in summed.filter(f"f < 0 OR pos >= {settings.min_documents}").collect():  # at most one row for each hash
        if r["f"] < 0:
            n_pos, n_neg = n_pos + r["pos"], n_neg + r["neg"]
        else:
            pos[r["f"]], neg[r["f"]] = r["pos"], r["neg"]
    model = Model(settings, costs, log_odds(pos, neg, n_pos, n_neg, settings))

    def judged(batches):
        scorer = Scorer(model)
        for batch in slices(batches):
            e = [scorer.evidence(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([int(v.as_py() != 0) for v in batch.column(0)], pa.int32()), pa.array([v[0] for v in e], pa.float64()), pa.array([v[1] for v in e], pa.float64())], ["y", "a", "b"])

    points = rows.mapInArrow(judged, "y int, a double, b double").toPandas()  # sample_rows at most, but for repeated ids
    model.curve = fit_curve(points[["a", "b"]].to_numpy(), points["y"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted: one row per row of ``docs``.

    Row by row, no shuffle. Null and empty texts get the curve's base value;
    null ids are never held out; repeated rows keep their row; an empty table
    gives an empty one.
    """
    src = only(docs, id_col, text_col)

    def run(batches):
        scorer = Scorer(model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())], [id_col, "score"])

    out = src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double")
    held = F.coalesce(_fold(id_col, model.settings.folds) == 0, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))
