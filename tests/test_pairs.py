"""Pairs of large groups: what is shuffled, and blocks of parts against numpy."""

import numpy as np
import pytest

from epochloom.functions.matrix import correlations
from epochloom.operators import similarity
from epochloom.plans import catalog


def frame(spark, n, width=4):
    x = np.random.default_rng(n).normal(size=(n, width))
    return x, spark.createDataFrame([(0, i, x[i].tolist()) for i in range(n)], "label int, id long, x array<double>")


def dealt(df):
    """Rows of the result, and rows written to the largest exchange."""
    done = df._jdf.queryExecution()
    n = done.toRdd().count()
    written = []

    def walk(node):
        found = node.metrics().get("shuffleRecordsWritten")
        if found.isDefined():
            written.append(found.get().value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(done.executedPlan())
    return n, max(written)


def test_what_is_shuffled_grows_with_the_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (256, 512, 1024):
            pairs = similarity.pairwise(frame(spark, n)[1], ["label"], "id", "x", tile=16)
            made, moved = dealt(pairs)
            assert made == n * (n - 1) // 2 and moved <= 8 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def check(spark, n, **settings):
    x, df = frame(spark, n)
    got = similarity.pairwise(df, ["label"], "id", "x", **settings).toArrow()
    a, b, r = (got.column(c).to_numpy() for c in ("a", "b", "similarity"))
    assert len(a) == n * (n - 1) // 2 == len(np.unique(a * n + b)) and (a < b).all()
    assert np.abs(np.corrcoef(x)[a, b] - r).max() < 1e-12


@pytest.mark.parametrize("tile", [100_000, 750, 10])  # one part, two of two blocks each, most parts
def test_blocks_of_parts(spark, tile):
    check(spark, 1500, tile=tile)


def test_parts_of_wide_vectors_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART_MB", 0)
    monkeypatch.setattr(similarity, "BLOCK", 20)  # 15 parts, more than PARTS
    check(spark, 300)


@pytest.mark.parametrize(("pool", "least"), [(10**9, 1), (3000, 1), (3000, 2500)])  # a task's at once, few tiles at a time, the last ones as they come
def test_ordered_pairs_are_the_same(spark, monkeypatch, pool, least):
    monkeypatch.setattr(similarity, "POOL", pool)
    monkeypatch.setattr(similarity, "LEAST", least)
    monkeypatch.setattr(similarity, "BLOCK", 50)
    x = np.random.default_rng(5).normal(size=(700, 6))
    x[::9, 2] = np.nan
    df = spark.createDataFrame([(f"g{i % 3}", f"i{i:03}", x[i].tolist()) for i in range(700)], "label string, id string, x array<double>")
    plain = similarity.pairwise(df, ["label"], "id", "x", tile=20)
    rows = similarity.pairwise(df, ["label"], "id", "x", tile=20, ordered=True)
    assert sorted(rows.collect()) == sorted(plain.collect())
    if pool > 3000:
        assert all(t == sorted(t) for t in rows.select("similarity").rdd.map(lambda r: r[0]).glom().collect())


def test_files_of_pairs(spark, tmp_path):
    """Bytes a pair: 8 for each similarity, unless equal ones lie together."""
    n = 3000
    x = np.random.default_rng(2).normal(size=(n, 64)).astype(np.float32)
    spark.createDataFrame([(i, x[i].tolist(), 0) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        catalog.QUERIES["safe_corr_pairs"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(str(tmp_path / "out")).toArrow()
    a, b, r = (got.column(c).to_numpy() for c in ("a", "b", "similarity"))
    assert len(a) == n * (n - 1) // 2 == len(np.unique(a * n + b)) and (a < b).all()
    assert np.abs(np.corrcoef(x.astype(float))[a, b] - r).max() < 1e-6
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * len(a)


@pytest.mark.parametrize("tile", [10_000, 20])
@pytest.mark.parametrize("both", [False, True])
def test_equal_vectors(spark, monkeypatch, tile, both):
    """Up to 17 copies of a vector (more than are dealt as one row) and single ones
    in blocks of either kind, lost values, constant vectors, an item twice."""
    monkeypatch.setattr(similarity, "COPIES", 5)
    monkeypatch.setattr(similarity, "STRIPE", 4)
    monkeypatch.setattr(similarity, "BLOCK", 12)
    x = np.random.default_rng(8).normal(size=(40, 6))
    x[::7, 2], x[3], x[10:12, :5] = np.nan, 1.0, np.nan
    times = [17, 2, 6, 3, 9] + [4] * 15 + [1] * 20
    rows = [(f"g{i % 2}", f"i{(k * 40 + i) * 389 % 1009:04}", x[i].tolist()) for i in range(40) for k in range(times[i])]
    rows.append(rows[0])
    want = {(g, a, b): [] for g, a, _ in rows for h, b, _ in rows if g == h and (a != b if both else a < b)}
    assert len({a for _, a, _ in rows}) == len(rows) - 1
    for g, a, v in rows:
        for h, b, w in rows:
            if (g, a, b) in want and g == h:
                want[g, a, b].append(float(correlations(np.array([v]), np.array([w]))[0, 0]))
    df = spark.createDataFrame(rows, "label string, id string, x array<double>")
    for ordered in (False, True):
        monkeypatch.setattr(similarity, "LEAST", 1)
        got = {}
        for r in similarity.pairwise(df, ["label"], "id", "x", tile=tile, ordered=ordered, both=both).collect():
            got.setdefault((r.label, r.a, r.b), []).append(r.similarity)
        assert got.keys() == want.keys()
        assert all(len(got[k]) == len(want[k]) and np.abs(np.array(got[k]) - want[k]).max() < 1e-12 for k in want)


def test_items_that_are_null_or_of_other_kinds(spark):
    rows = [(0, i if i else None, [float(i % 3), 1.0, 2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "label int, id int, x array<double>")
    for kind in ("int", "double", "decimal(9,2)", "date", "binary"):
        cast = {"date": "date_add(date'2020-01-01', id)", "binary": "cast(cast(id as string) as binary)"}.get(kind, f"cast(id as {kind})")
        for vector, n in (("x", 36), ("array(double(coalesce(id, 0)), 1d, 7d)", 36)):  # copies, and none
            got = similarity.pairwise(df.selectExpr("label", f"{cast} AS id", f"{vector} AS x"), ["label"], "id", "x").collect()
            assert len(got) == n and all(r.a is None or r.a < r.b for r in got) and not any(r.b is None for r in got)


@pytest.mark.parametrize(("query", "most"), [("similarity_matrix", 1.2), ("safe_corr_pairs", 2.2)])
def test_files_of_equal_vectors(spark, tmp_path, query, most):
    """Copies with shifted keys: bytes a row, and every row."""
    n, k = 400, 6
    x = np.random.default_rng(4).normal(size=(n, 64)).astype(np.float32)
    spark.createDataFrame([(i + n * c, x[i].tolist(), 0) for c in range(k) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        catalog.QUERIES[query](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(str(tmp_path / "out")).toArrow()
    a, b, r = (got.column(c).to_numpy() for c in ("a", "b", "similarity"))
    n *= k
    assert len(a) == (n * n if query == "similarity_matrix" else n * (n - 1) // 2) == len(np.unique(a * n + b))
    assert query == "similarity_matrix" or (a < b).all()
    assert np.abs(np.corrcoef(x.astype(float))[a % 400, b % 400] - r).max() < 1e-6
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < most * len(a)
