"""Reliability of shared patterns: holdouts, shuffled labels, subsamples.

Every statistic is built from sums of vectors, so a label's rows are read a
fixed number of times and never paired. vectors: context columns, label, id,
x (array<double>), and for grouped holdouts a group column. A position of a
centroid is NaN if any of its vectors lacks it, and correlations skip it; in
the null test vectors are told apart by their masks, as in ``similarity``.

Random draws are the first rows by MD5 of (seed, iteration, id), which any
engine can repeat. A histogram of the hashes says in which narrow range of them
a draw's last row lies; the rows of that range alone are ranked. With the hash
of its last row known, a draw is a comparison: each task multiplies a
draws-by-rows selection with its rows-by-positions matrix, and only sums of
draws by positions are exchanged, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_corr
from ..functions.matrix import codes, lists, matrix, unit_rows
from .similarity import _few, _mask_counts, _mask_sums, _masks, _types

_NAN = float("nan")


def _centroid(total: str, lost: str, n: Column) -> Column:
    """Means from sums; NaN where any vector was."""
    return F.zip_with(total, lost, lambda t, k: F.when(k > 0, F.lit(_NAN)).otherwise(t / n))  # n: a column, not an expression to be made again


def vector_sums(df: DataFrame, keys: list[str], vector: str = "x", name: str = "total") -> DataFrame:
    """keys, n, total, total_lost: position-wise sums without NaN, and how
    many vectors were NaN there."""
    long = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    bad = F.col("v").isNull() | F.isnan("v")
    at = long.groupBy(*keys, "pos").agg(F.sum(F.when(~bad, F.col("v")).otherwise(F.lit(0.0))).alias("v"), F.count_if(bad).alias("k"), F.count("*").alias("n"))
    held = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v", "k"))).alias("_t"), F.max("n").alias("n"))
    return held.select(*keys, "n", F.transform("_t", lambda p: p["v"]).alias(name), F.transform("_t", lambda p: p["k"]).alias(f"{name}_lost"))


def best_other(vectors: DataFrame, sums: DataFrame, context: list[str], label: str, keep: list[str]) -> DataFrame:
    """For every row the best correlation with another label's centroid, 0 if
    there is no other label. As many partners as the context has labels."""
    keys = context or ["_all"]
    if not context:
        sums, vectors = sums.withColumn("_all", F.lit(0)), vectors.withColumn("_all", F.lit(0))
    cents = sums.select(*keys, F.struct(F.col(label).alias("_other"), _centroid("total", "total_lost", F.col("n")).alias("_c")).alias("_e"))
    held = cents.groupBy(*keys).agg(F.collect_list("_e").alias("_cs"))  # a row for each context: its labels' centroids
    met = vectors.join(held, keys)
    others = F.filter("_cs", lambda c: c["_other"] != F.col(label))
    scores = F.transform(others, lambda c: safe_corr(F.col("x"), c["_c"]))
    return met.select(*keep, F.coalesce(F.array_max(scores), F.lit(0.0)).alias("other"))


def leave_one_out(vectors: DataFrame, context: list[str], label: str, item: str) -> DataFrame:
    """context, label, item, margin: correlation with the mean of the others of
    its label minus the best with another label's centroid."""
    keys = [*context, label]
    sums = vector_sums(vectors, keys)
    met = best_other(vectors, sums, context, label, [*keys, item, "x"]).join(sums.filter("n >= 2"), keys)
    # where x is NaN the position is skipped anyway, so all that are lost are lost by others
    left = F.zip_with("total", "x", lambda t, x: t - x)
    rest = _centroid("_rest", "total_lost", F.col("_n"))
    met = met.withColumn("_rest", left).withColumn("_n", F.col("n") - 1)
    return met.select(*keys, item, (safe_corr(F.col("x"), rest) - F.col("other")).alias("margin"))


def holdout_summary(margins: DataFrame, keys: list[str]) -> DataFrame:
    """mean and smallest margin, share of successes (margin above 0)."""
    return margins.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("margin").alias("mean_margin"), F.min("margin").alias("min_margin"), F.avg((F.col("margin") > 0).cast("double")).alias("success_rate"),
    )


def grouped_holdout(vectors: DataFrame, context: list[str], label: str, group: str) -> DataFrame:
    """context, label, group, margin: rows of a group against the mean of all
    rows outside it. Blank groups are never held out but stay in the means; a
    label with fewer than two groups gives no row."""
    keys = [*context, label]
    sums = vector_sums(vectors, keys)
    own = vectors.filter(F.trim(F.coalesce(F.col(group), F.lit(""))) != "").withColumn(group, F.trim(group))
    parts = vector_sums(own, [*keys, group], name="part").withColumnRenamed("n", "m")
    enough = parts.groupBy(*keys).agg(F.count("*").alias("_groups")).filter("_groups >= 2").select(*keys)
    parts = parts.join(enough, keys)
    met = best_other(own, sums, context, label, [*keys, group, "x"]).join(sums, keys).join(parts, [*keys, group]).filter("n > m")
    met = met.withColumn("_rest", F.zip_with("total", "part", lambda t, p: t - p)).withColumn("_lost", F.zip_with("total_lost", "part_lost", lambda t, p: t - p)).withColumn("_n", F.col("n") - F.col("m"))
    scored = met.select(*keys, group, safe_corr(F.col("x"), _centroid("_rest", "_lost", F.col("_n"))).alias("own"), "other")
    return scored.groupBy(*keys, group).agg((F.avg("own") - F.max("other")).alias("margin"))


#: Ranges of hashes in the histograms of draws.
BINS = 1024


def _digests(names: list[str | None], iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of each row's hash in each iteration (rows by iterations), as
    signed numbers in the order of the hashes."""
    heads = [hashlib.md5(f"{seed}_{it}".encode()) for it in range(1, iterations + 1)]
    out = bytearray()
    for name in names:
        tail = b"_" + name.encode() if name else b""
        for head in heads:
            h = head.copy()
            h.update(tail)
            out += h.digest()
    both = (np.frombuffer(bytes(out), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, iterations, 2)
    return both[:, :, 0], both[:, :, 1]


def _bins(high: np.ndarray) -> np.ndarray:
    return (high >> 54) + BINS // 2


def _by_key(batch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray, int]]:
    """(values of the keys, rows, first row) of each group in a batch."""
    code, first = codes([batch.column(k) for k in keys])
    for c, f in enumerate(first.tolist()):
        yield tuple(batch.column(k)[f].as_py() for k in keys), np.flatnonzero(code == c), f


def draw_limits(rows: DataFrame, wanted: DataFrame, keys: list[str], iterations: int, seed: int) -> dict[tuple, tuple[list[int], np.ndarray, np.ndarray]]:
    """For each key its draw sizes in order and the halves of the last hash of
    each draw, iterations by sizes. rows: keys, _name (what is hashed); wanted:
    keys, _ks (sizes). As many numbers as keys have sizes and iterations."""

    def histogram(batches):
        for batch in batches:
            heads, its, bins, counts = [], [], [], []
            for _, at, f in _by_key(batch, keys):
                high, _ = _digests(batch.column("_name").take(pa.array(at)).to_pylist(), iterations, seed)
                for it in range(iterations):
                    found, n = np.unique(_bins(high[:, it]), return_counts=True)
                    heads += [f] * len(found)
                    its += [it + 1] * len(found)
                    bins += found.tolist()
                    counts += n.tolist()
            at = pa.array(heads, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], pa.array(its, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts, pa.int64())], [*keys, "iteration", "bin", "n"])

    by = [*keys, "iteration"]
    counted = rows.select(*keys, "_name").mapInArrow(histogram, _types(rows, keys) + "iteration int, bin int, n long").groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    so_far = counted.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("bin")) - F.col("n"))  # BINS rows at most
    sizes = _few(wanted.select(*keys, F.explode("_ks").alias("k")))
    edges = so_far.join(sizes, keys).filter("before < k AND k <= before + n").select(*by, "bin", "k", (F.col("k") - F.col("before")).alias("need"))
    held: dict[tuple, dict] = {}
    for r in edges.collect():
        held.setdefault(tuple(r[: len(keys)]), {})[r["iteration"], r["k"]] = (r["bin"], r["need"])
    spark = rows.sparkSession
    narrow = {key: [np.unique([b for (it, _), (b, _) in found.items() if it == i + 1]) for i in range(iterations)] for key, found in held.items()}
    shared = spark.sparkContext.broadcast(narrow)

    def inside(batches):
        for batch in batches:
            out = []
            for key, at, f in _by_key(batch, keys):
                high, low = _digests(batch.column("_name").take(pa.array(at)).to_pylist(), iterations, seed)
                bins = _bins(high)
                for it, some in enumerate(shared.value.get(key, [])):
                    hit = np.isin(bins[:, it], some)
                    out += [(f, it + 1, b, h, x) for b, h, x in zip(bins[hit, it].tolist(), high[hit, it].tolist(), low[hit, it].tolist())]
            columns = list(zip(*out)) if out else [[]] * 5
            at = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], [*keys, "iteration", "bin", "high", "low"])

    near = rows.select(*keys, "_name").mapInArrow(inside, _types(rows, keys) + "iteration int, bin int, high long, low long")
    place = F.row_number().over(Window.partitionBy(*by, "bin").orderBy("high", "low"))
    last = near.withColumn("need", place).join(edges.select(*by, "bin", "need", "k"), [*by, "bin", "need"])
    out = {}
    for r in last.select(*by, "k", "high", "low").collect():
        out.setdefault(tuple(r[: len(keys)]), {})[r["iteration"], r["k"]] = (r["high"], r["low"])
    limits = {}
    for key, found in out.items():
        ks = sorted({k for _, k in found})
        both = np.array([[found[it + 1, k] for k in ks] for it in range(iterations)], np.int64)
        limits[key] = (ks, both[:, :, 0], both[:, :, 1])
    return limits


def _cut(high: np.ndarray, low: np.ndarray, limit: tuple[list[int], np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows by iterations: the number of the smallest draw that a row is in, as
    many as there are sizes if it is in none."""
    ks, top, tail = limit
    out = np.full(high.shape, len(ks))
    for k in reversed(range(len(ks))):
        out[(high < top[:, k]) | ((high == top[:, k]) & (low <= tail[:, k]))] = k
    return out


def _drawn_units(rows: DataFrame, limits: dict, often: DataFrame | None, keys: list[str], iterations: int, seed: int) -> DataFrame:
    """keys, iteration, _cut (a draw's size), i, j, pos, s, q: over the rows that
    are in a draw and in no smaller one the sums of their unit vectors; q, the
    squared norms, stands at the first position."""
    shared = rows.sparkSession.sparkContext.broadcast(limits)
    plain = often is None
    met = rows if plain else rows.join(_few(often), keys)

    def run(batches):
        total: dict = {}
        for batch in batches:
            x = matrix(batch.column("x"))
            masks = None if plain else _masks(x)
            for key, at, f in _by_key(batch, keys):
                if key not in shared.value:
                    continue
                ks = shared.value[key][0]
                cut = _cut(*_digests(batch.column("_name").take(pa.array(at)).to_pylist(), iterations, seed), shared.value[key])
                known = [None] if plain else batch.column("masks")[f].as_py()
                own = np.zeros(len(at), np.int64) if plain else np.array([known.index(masks[r]) for r in at])
                for i in np.unique(own).tolist():
                    some = own == i
                    part, valid = x[at[some]], ~np.isnan(x[at[some]])
                    for j, other in enumerate(known):
                        ok = valid
                        if other is not None:
                            has = np.unpackbits(np.frombuffer(other, np.uint8), count=8 * len(other)).astype(bool)
                            ok = valid & np.pad(has, (0, max(0, valid.shape[1] - len(has))))[: valid.shape[1]]
                        u = unit_rows(part, ok)
                        norms = (u * u).sum(axis=1)
                        for k in range(len(ks)):
                            chosen = (cut[some] == k).T.astype(float)  # iterations by rows
                            s, q = chosen @ u, chosen @ norms
                            if (key, k, i, j) in total:
                                a, b, head = total[key, k, i, j]
                                width = max(a.shape[1], s.shape[1])
                                s = np.pad(s, ((0, 0), (0, width - s.shape[1]))) + np.pad(a, ((0, 0), (0, width - a.shape[1])))
                                q, head = q + b, head
                            else:
                                head = [batch.column(c).slice(f, 1) for c in keys]
                            total[key, k, i, j] = (s, q, head)
        for (key, k, i, j), (s, q, head) in total.items():
            n = len(s)
            columns = [pa.concat_arrays([h] * n) for h in head]
            size = shared.value[key][0][k]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.arange(1, n + 1), pa.int32()), pa.array([size] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(q), lists(s)], [*keys, "iteration", "_cut", "i", "j", "q", "s"]
            )

    by = [*keys, "iteration", "_cut", "i", "j"]
    parts = met.mapInArrow(run, _types(rows, keys) + "iteration int, _cut long, i int, j int, q double, s array<double>")
    at = parts.select(*by, F.posexplode("s").alias("pos", "s"), "q")
    return at.groupBy(*by, "pos").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("pos") == 0, F.col("q"))).alias("q"))


def label_shuffle_null(vectors: DataFrame, margins: DataFrame, label: str, items: list[str], iterations: int = 64, seed: int = 0, context: list[str] | None = None) -> DataFrame:
    """context, label, iterations, null_mean, null_std, null_p95, p_value: what
    the margin would be if labels meant nothing. In each iteration the pooled
    rows get a new order and the first as many as the label has are its rows.
    margins: context, label, margin; items: what tells the pooled rows apart
    (rows that it doesn't tell apart are drawn together).

    Sums are made once for each distinct number of rows, not for each label.
    Every mask of a context is taken by sums here, so that tasks make as many
    products as there are pairs of masks.
    """
    context = context or []
    if not context:
        vectors, margins = vectors.withColumn("_all", F.lit(0)), margins.withColumn("_all", F.lit(0))
    keys = context or ["_all"]
    name = F.concat_ws("_", *[F.col(i).cast("string") for i in items])
    rows = vectors.select(*keys, F.col(label).alias("_label"), name.alias("_name"), F.transform("x", lambda v: v.cast("double")).alias("x"))
    counts = rows.groupBy(*keys, "_label").agg(F.count("*").alias("k"))
    sizes = counts.groupBy(*keys).agg(F.array_sort(F.collect_set("k")).alias("_ks"), F.sum("k").alias("total"))  # a row for each context
    masks = _mask_counts(rows, keys)
    one = (masks.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= 1
    often = None if one else masks.groupBy(*keys).agg(F.sort_array(F.collect_list("mask")).alias("masks"))
    limits = draw_limits(rows, sizes, keys, iterations, seed)
    parts = _drawn_units(rows, limits, often, keys, iterations, seed)
    pair = ["i", "j"]
    all_ = _mask_sums(rows, keys, often, keys).select(*keys, *pair, F.posexplode("s").alias("pos", "all"))
    each = parts.join(_few(sizes), keys).withColumn("k", F.explode(F.filter("_ks", lambda k: k >= F.col("_cut"))))
    at = each.groupBy(*keys, "iteration", "k", *pair, "pos").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    turn = lambda df, *more: df.select(*keys, F.col("i").alias("j"), F.col("j").alias("i"), "pos", *more)
    inside = at.join(turn(at, "iteration", "k", F.col("s").alias("t")), [*keys, "iteration", "k", *pair, "pos"])
    same = F.col("i") == F.col("j")
    inside = inside.groupBy(*keys, "iteration", "k").agg(F.sum(F.col("s") * F.col("t")).alias("ss"), F.sum(F.when(same, F.col("q"))).alias("qq"))
    whole = at.join(turn(all_, F.col("all").alias("a")), [*keys, *pair, "pos"]).groupBy(*keys, "iteration", "k").agg(F.sum(F.col("s") * F.col("a")).alias("sa"))
    sums = inside.join(whole, [*keys, "iteration", "k"]).join(sizes.select(*keys, "total"), keys).filter("k >= 2 AND total > k")
    null = (F.col("ss") - F.col("qq")) / (F.col("k") * (F.col("k") - 1)) - (F.col("sa") - F.col("ss")) / (F.col("k") * (F.col("total") - F.col("k")))
    met = counts.withColumnRenamed("_label", label).join(margins, [*keys, label]).filter("margin IS NOT NULL").join(sums.select(*keys, "k", null.alias("null")), [*keys, "k"])
    out = met.groupBy(*keys, label).agg(
        F.count("*").alias("iterations"), F.avg("null").alias("null_mean"), F.stddev_pop("null").alias("null_std"), F.percentile("null", F.lit(0.95)).alias("null_p95"),
        ((1 + F.count_if(F.col("null") >= F.col("margin"))) / (1 + F.count("*"))).alias("p_value"),
    )
    return out if context else out.drop("_all")


def subsample_stability(vectors: DataFrame, keys: list[str], item: str, iterations: int = 32, fraction: float = 0.75, seed: int = 1009) -> DataFrame:
    """keys, mean_similarity, min_similarity, iterations: centroids of random
    parts against the whole's; three rows at least. Rows with one item are drawn
    together."""
    sums = vector_sums(vectors, keys).filter("n >= 3")
    most = F.greatest(F.lit(2), F.ceil(F.col("n") * fraction).cast("int"))
    rows = vectors.select(*keys, F.col(item).cast("string").alias("_name"), F.transform("x", lambda v: v.cast("double")).alias("x"))
    limits = draw_limits(rows, sums.select(*keys, F.array(most).alias("_ks")), keys, iterations, seed)
    shared = rows.sparkSession.sparkContext.broadcast(limits)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            for key, at, f in _by_key(batch, keys):
                if key not in shared.value:
                    continue
                chosen = (_cut(*_digests(batch.column("_name").take(pa.array(at)).to_pylist(), iterations, seed), shared.value[key]) == 0).T.astype(float)
                lost = np.isnan(x[at])
                total, gone = chosen @ np.where(lost, 0.0, x[at]), chosen @ lost
                columns = [pa.concat_arrays([batch.column(k).slice(f, 1)] * iterations) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(1, iterations + 1), pa.int32()), pa.array(chosen.sum(axis=1).astype(np.int64)), lists(total), lists(gone)], [*keys, "iteration", "m", "part", "part_lost"])

    by = [*keys, "iteration"]
    parts = rows.mapInArrow(run, _types(rows, keys) + "iteration int, m long, part array<double>, part_lost array<double>")
    at = parts.select(*by, "m", F.posexplode(F.arrays_zip("part", "part_lost")).alias("pos", "z"))
    at = at.groupBy(*by, "pos").agg(F.sum("z.part").alias("v"), F.sum("z.part_lost").cast("long").alias("k"), F.sum("m").alias("m"))
    held = at.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "v", "k"))).alias("_t"), F.max("m").alias("m"))
    held = held.select(*by, "m", F.transform("_t", lambda p: p["v"]).alias("part"), F.transform("_t", lambda p: p["k"]).alias("part_lost"))
    met = held.join(sums, keys).withColumn("similarity", safe_corr(_centroid("part", "part_lost", F.col("m")), _centroid("total", "total_lost", F.col("n"))))
    return met.groupBy(*keys).agg(F.avg("similarity").alias("mean_similarity"), F.min("similarity").alias("min_similarity"), F.count("*").alias("iterations"))
