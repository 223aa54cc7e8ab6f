"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Counts of all vote patterns (at most 3 to the number of labellers rows) go to
expectation maximisation, which estimates each labeller's accuracy without any
gold label; the posterior of its pattern is a document's soft label. A linear
scorer over hashed word shapes is fitted to soft labels of a bounded sample and
scores every document.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read, slices

_ENDED = (".", "!", "?", "…", ":", ";", "\"", "'", "”", "»", ")", "。")
_SYMBOLS = "#*$%&|<>"
_SYMBOL_SET = frozenset(_SYMBOLS)


@dataclass(frozen=True)
class Settings:
    """sample_rows: the most documents the scorer is fitted on, those with the
    smallest hash of id and text; votes and scores cover all."""

    sample_rows: int = 10_000
    bits: int = 12
    rounds: int = 120
    threshold: float = 0.5


def measures(text: str | None) -> dict[str, float]:
    """What the labellers look at."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return {"n": 0}
    lines = [line for line in text.split("\n") if line.strip()]
    ended = sum(len(line) for line in lines if line.rstrip().endswith(_ENDED))
    follow = words[1:]
    sentences = sum(text.count(c + gap) for c in ".!?" for gap in " \n") + text.rstrip().endswith((".", "!", "?"))
    symbols = sum(map(text.count, _SYMBOLS))
    return {
        "n": n,
        "symbols": symbols / n,
        "shouted": sum(map(str.isupper, words)) / n,
        "ended": ended / max(1, sum(map(len, lines))),
        "doubled": sum(map(operator.eq, words, follow)) / n,
        "repeated": 1 - len(set(zip(words, follow))) / (n - 1) if n > 1 else 0.0,
        "distinct": len(set(words)) / n,
        "exclaimed": text.count("!") / n,
        "sentence": n / (sentences + 1),
        "odd": sum(not _SYMBOL_SET.isdisjoint(w) for w in words) / n if symbols else 0.0,
        "barred": words.count("|") / n,
    }


def _bad(fault: bool) -> int:
    return -1 if fault else 0


#: The labellers, by name: 1 good, -1 bad, 0 no vote. Most can only object, and
#: each kind of fault is seen by two or more, so that they overlap.
LABELLERS = {
    "symbols": lambda m: _bad(m["symbols"] > 0.3),
    "odd words": lambda m: _bad(m["odd"] > 0.3),
    "bars": lambda m: _bad(m["barred"] > 0.1),
    "shouting": lambda m: _bad(m["shouted"] > 0.5 and m["n"] >= 4),
    "exclamation": lambda m: _bad(m["exclaimed"] > 0.3),
    "doubled words": lambda m: _bad(m["doubled"] > 0.2 and m["n"] >= 4),
    "repeated phrases": lambda m: _bad(m["repeated"] > 0.45 and m["n"] >= 10),
    "variety": lambda m: _bad(m["distinct"] * math.log(m["n"] + 1) < 0.9 and m["n"] >= 12),
    "line ends": lambda m: 1 if m["ended"] >= 0.8 else _bad(m["ended"] < 0.3 and m["n"] >= 8),
    "sentences": lambda m: 1 if m["sentence"] <= 30 else _bad(m["n"] >= 40 and m["sentence"] > 40),
}


def votes(text: str | None) -> tuple[int, ...]:
    """One vote of each labeller; none at all on a text without words."""
    m = measures(text)
    return tuple(f(m) for f in LABELLERS.values()) if m["n"] else (0,) * len(LABELLERS)


def pattern(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def unpack(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, r = divmod(code, 3)
        out.append(r - 1)
    return out[::-1]


@dataclass
class Accuracies:
    """prior of good; vote[k][c][v]: probability that labeller k votes v (bad,
    none, good) on class c (bad, good); posterior by pattern."""

    prior: float
    vote: np.ndarray
    posterior: dict[int, float]

    def accuracy(self) -> dict[str, float]:
        """Chance that a cast vote is right."""
        out = {}
        for name, t in zip(LABELLERS, self.vote):
            right = (1 - self.prior) * t[0, 0] + self.prior * t[1, 2]
            wrong = (1 - self.prior) * t[0, 2] + self.prior * t[1, 0]
            out[name] = float(right / max(right + wrong, 1e-12))
        return out


def expectation_maximisation(counts: dict[int, int], rounds: int = 100) -> Accuracies:
    """Class-conditional vote probabilities, from pattern counts alone. Starts
    from a plain tally; smoothing keeps every probability above 0."""
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    v = np.array([unpack(c) for c in codes], int).reshape(len(codes), len(LABELLERS))
    bad, good = (v < 0).sum(1), (v > 0).sum(1)
    post = np.clip(0.8 + 0.05 * good - 0.3 * bad, 0.02, 0.98) if len(codes) else np.zeros(0)
    prior, table = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack((n * (1 - post), n * post))
        prior = (w[1].sum() + 1) / (n.sum() + 2)
        for k in range(len(LABELLERS)):
            for c in (0, 1):
                mass = np.bincount(v[:, k] + 1, weights=w[c], minlength=3) + 0.5
                table[k, c] = mass / mass.sum()
        odds = math.log(prior / (1 - prior)) + sum(np.log(table[k, 1, v[:, k] + 1] / table[k, 0, v[:, k] + 1]) for k in range(len(LABELLERS))) if len(codes) else np.zeros(0)
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(after - post).max(initial=0) < 1e-9
        post = after
        if done:
            break
    return Accuracies(float(prior), table, dict(zip(codes, map(float, post))))


_CLASS = str.maketrans({**{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "9" for c in "0123456789"}})
_RUN = re.compile(r"(.)\1+", re.S)


#: Longer words are read in pieces of as many characters.
PIECE = 64


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, runs as one."""
    s = word.translate(_CLASS) if word.isascii() else "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", s)


def pieces(words: list[str]) -> list[str]:
    """The words, long ones (texts without white space) cut into pieces that
    follow one another, so that every character is in some shape."""
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


class _Remembered(dict):
    """Values made once and kept, up to a bound."""

    def __init__(self, make, room: int = 300_000):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        if len(self) >= self.room:
            self.clear()
        self[key] = out = self.make(key)
        return out


class ShapeReader:
    """Hashed features of texts: shares of shapes, of pairs of shapes, of
    repeated and of new words; square roots, so that rare ones count."""

    def __init__(self, bits: int):
        mask = (1 << bits) - 1
        self.shapes = _Remembered(shape)
        self.hashes = _Remembered(lambda key: zlib.crc32(repr(key).encode()) & mask)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        shapes = list(map(self.shapes.__getitem__, pieces(words)))
        n = len(shapes) + 4  # a few words say little
        seen: Counter = Counter(shapes)
        seen.update(zip(shapes, shapes[1:]))
        seen["=again"] = sum(map(operator.eq, words, words[1:]))
        seen["=new"] = len(set(words))
        values: dict[int, float] = {self.hashes["=any"]: 1.0}
        for key, k in seen.items():
            if k:
                h = self.hashes[key]
                values[h] = values.get(h, 0.0) + math.sqrt(k / n)
        return np.fromiter(values, np.int32, len(values)), np.fromiter(values.values(), np.float64, len(values))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, rounds: int) -> np.ndarray:
    """Logistic weights by accelerated gradient steps on soft labels."""
    size = 1 << bits
    w = np.zeros(size)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    weight = np.where(y < 0.5, 0.5 / max((y < 0.5).mean(), 0.05), 0.5 / max((y >= 0.5).mean(), 0.05))
    norm = np.bincount(row, val * val, len(rows)).max()
    rate, ahead, last = 4.0 / (norm * weight.max()), w.copy(), w.copy()
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * ahead[idx], len(rows)), -30, 30)))
        grad = np.bincount(idx, val * (weight * (p - y))[row], size) / len(rows) + 1e-5 * ahead
        w = ahead - rate * grad
        ahead = w + t / (t + 3) * (w - last)
        last = w
    return w


@dataclass
class Model:
    settings: Settings
    accuracies: Accuracies
    weights: np.ndarray


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, n) over every document; counted in each task first."""

    def run(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            seen.update(pattern(votes(t.as_py())) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return only(docs, text_col).mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    counts = {r["pattern"]: r["n"] for r in vote_counts(docs, text_col).collect()}  # at most 3 ** labellers rows
    accuracies = expectation_maximisation(counts)
    src = only(docs, id_col, text_col).toDF("id", "text")
    order = F.xxhash64("id", "text")
    # the smallest hashes: ids first, so that texts don't travel to be sorted
    total = max(1, sum(counts.values()))
    share = min(1.0, 1.2 * settings.sample_rows / total)
    near = src.withColumn("_h", order) if share >= 1 else src.withColumn("_h", order).filter(F.col("_h") <= int(-(2**63) + share * 2**64))

    def run(batches):
        reader = ShapeReader(settings.bits)
        for batch in slices(batches):
            f = [reader.features(t.as_py()) for t in batch.column(1)]
            y = [accuracies.posterior.get(pattern(votes(t.as_py())), 0.5) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0].tolist() for x in f], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32).tolist() for x in f], pa.list_(pa.float32())), pa.array(y, pa.float64())], ["h", "idx", "val", "y"])

    sample = near.select("_h", "text").mapInArrow(run, "h long, idx array<int>, val array<float>, y double").orderBy("h", "y").limit(settings.sample_rows).toPandas()
    rows = [(np.asarray(i), np.asarray(v, float)) for i, v in zip(sample["idx"], sample["val"])]
    return Model(settings, accuracies, fit_linear(rows, sample["y"].to_numpy(float), settings.bits, settings.rounds))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, posterior, score, quality (1 good), kept: one row per row of ``docs``.

    Row by row, no shuffle. Null and empty texts have no words: no votes, score
    0, not kept. Null ids and repeated rows keep their row; other columns
    aren't read; an empty table gives an empty one.
    """
    src = only(docs, id_col, text_col)

    def run(batches):
        reader = ShapeReader(model.settings.bits)
        for batch in slices(batches):
            post, score = [], []
            for cell in batch.column(1):
                text = cell.as_py()
                blank = not text or not text.strip()
                idx, val = reader.features(text)
                post.append(0.0 if blank else model.accuracies.posterior.get(pattern(votes(text)), 0.5))
                score.append(0.0 if blank else float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(val @ model.weights[idx])))))))
            kept = [s >= model.settings.threshold for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(post, pa.float64()), pa.array(score, pa.float64()), pa.array(map(int, kept), pa.int32()), pa.array(kept, pa.bool_())], [id_col, "posterior", "score", "quality", "kept"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, posterior double, score double, quality int, kept boolean")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, fit(docs))
