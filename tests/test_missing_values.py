"""Similarity and reliability with NaN in the vectors, against loops over pairs."""

import itertools

import numpy as np
import pytest

from epochloom.operators import reliability, similarity
from test_kernels import numpy_corr as corr

NAN = float("nan")


def vectors(masks: str, seed: int = 5):
    """(label, id, x) of three labels; masks: "none", "label", "rows"."""
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(17):
        x = rnd.normal(size=9) + (i % 3)
        if masks == "label" and i % 3 == 0:
            x[[2, 5]] = NAN
        if masks == "rows":
            x[rnd.integers(0, 9, rnd.integers(0, 3))] = NAN
        out.append(("abc"[i % 3], i, x))
    out.append(("a", 17, np.ones(9)))  # no variance
    out.append(("b", 18, np.array([1.0] + [NAN] * 8)))  # one position
    return out


def frame(spark, rows):
    return spark.createDataFrame([(label, i, [float(v) for v in x]) for label, i, x in rows], "label string, id long, x array<double>")


@pytest.mark.parametrize("masks,options", [("none", {}), ("label", {}), ("rows", {}), ("rows", {"frequent": 2, "tile": 3}), ("rows", {"frequent": 1})])
def test_margins(spark, masks, options):
    rows = vectors(masks)
    sums = similarity.pair_totals(frame(spark, rows), ["label"], "id", "x", **options)
    got = {r.label: r for r in similarity.control_margin(similarity.within(sums, ["label"]), similarity.between(sums, [], "label"), [], "label").collect()}
    by = {k: [x for label, _, x in rows if label == k] for k in "abc"}
    for k in "abc":
        within = np.mean([corr(a, b) for a, b in itertools.combinations(by[k], 2)])
        rest = {o: np.mean([corr(a, b) for a in by[k] for b in by[o]]) for o in "abc" if o != k}
        assert got[k].n == len(by[k]) and got[k].within == pytest.approx(within, abs=1e-12)
        assert got[k].rest == pytest.approx(np.mean(list(rest.values())), abs=1e-12)
        assert got[k].strongest_label == max(sorted(rest), key=rest.get) and got[k].margin == pytest.approx(within - np.mean(list(rest.values())), abs=1e-12)


def test_equal_controls_take_the_first_label(spark):
    rows = [(k, i, np.array([1.0, 2.0, 4.0])) for i, k in enumerate("dcbaa")]
    sums = similarity.pair_totals(frame(spark, rows), ["label"], "id", "x")
    got = {r.label: r.strongest_label for r in similarity.control_margin(similarity.within(sums, ["label"]), similarity.between(sums, [], "label"), [], "label").collect()}
    assert got == {"a": "b", "b": "a", "c": "a", "d": "a"}


def test_pairs_in_tiles(spark):
    rows = vectors("rows")
    got = {(r.a, r.b): r.similarity for r in similarity.pairwise(frame(spark, rows), ["label"], "id", "x", tile=2).collect()}
    want = {(i, j): corr(x, y) for (k, i, x), (m, j, y) in itertools.permutations(rows, 2) if k == m and i < j}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


@pytest.mark.parametrize("masks", ["none", "label", "rows"])
def test_holdouts(spark, masks):
    rows = vectors(masks)
    df = frame(spark, rows)
    by = {k: {i: x for label, i, x in rows if label == k} for k in "abc"}
    mean = lambda xs: np.mean(list(xs), axis=0)  # noqa: E731  (NaN where any is)
    other = lambda k, x: max(corr(x, mean(by[o].values())) for o in "abc" if o != k)
    got = {r.id: r.margin for r in reliability.leave_one_out(df, [], "label", "id").collect()}
    for k, i, x in rows:
        assert got[i] == pytest.approx(corr(x, mean(v for j, v in by[k].items() if j != i)) - other(k, x), abs=1e-9)
    from pyspark.sql import functions as F

    grouped = df.withColumn("grp", F.when(F.col("id") % 4 == 3, " ").otherwise(F.concat(F.lit("g"), F.col("id") % 4)))
    got = {(r.label, r.grp): r.margin for r in reliability.grouped_holdout(grouped, [], "label", "grp").collect()}
    assert len(got) == 9
    for (k, g), margin in got.items():
        held = [x for i, x in by[k].items() if i % 4 == int(g[1])]
        rest = mean(x for i, x in by[k].items() if i % 4 != int(g[1]))
        assert margin == pytest.approx(np.mean([corr(x, rest) for x in held]) - max(other(k, x) for x in held), abs=1e-9)


def test_one_group_is_no_holdout(spark):
    df = spark.createDataFrame([("a", i, [1.0 * i, 2.0, 3.0], "g" if i else "") for i in range(4)], "label string, id long, x array<double>, grp string")
    assert reliability.grouped_holdout(df, [], "label", "grp").count() == 0


@pytest.mark.parametrize("masks", ["none", "label", "rows"])
def test_null_by_pairs(spark, masks):
    rows = vectors(masks)
    df = frame(spark, rows)
    margins = spark.createDataFrame([(k, 0.1) for k in "abc"], "label string, margin double")
    got = {r.label: r for r in reliability.label_shuffle_null(df, margins, "label", ["id"], iterations=5, seed=3).collect()}
    import hashlib

    for k in "abc":
        n = sum(label == k for label, _, _ in rows)
        null = []
        for it in range(1, 6):
            order = sorted(rows, key=lambda r: (hashlib.md5(f"3_{it}_{r[1]}".encode()).hexdigest(), r[1]))
            first, rest = [r[2] for r in order[:n]], [r[2] for r in order[n:]]
            null.append(np.mean([corr(a, b) for a, b in itertools.combinations(first, 2)]) - np.mean([corr(a, b) for a in first for b in rest]))
        assert got[k].iterations == 5 and got[k].null_mean == pytest.approx(np.mean(null), abs=1e-9) and got[k].null_std == pytest.approx(np.std(null), abs=1e-9)
        assert got[k].p_value == pytest.approx((1 + sum(v >= 0.1 for v in null)) / 6)
