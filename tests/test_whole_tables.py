"""Catalog queries that once read subsets, over whole tables: against brute force,
and their SQL without the clauses that cut the tables."""

import os

import numpy as np
import pytest

from epochloom.plans import catalog

from test_catalog import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

#: What the SQL of a query must not hold again.
CLAUSES = {
    "safe_corr_pairs": " WHERE a.id % 4 = 0 AND b.id % 4 = 0",
    "similarity_matrix": " WHERE a.id % 8 = 0 AND b.id % 8 = 0",
    "label_filter": " AND user_id % 3 = 0",
    "montage_consistency": " WHERE event_id % 3 = 0",
    "rate_mismatch": " WHERE p_partkey % 3 = 0",
    "class_imbalance": " WHERE o_orderstatus <> 'P' OR o_orderkey % 5 = 0",
    "study_validation_report": " WHERE event_type <> 'error' OR event_id % 20 = 0",
}


@pytest.mark.parametrize("name", sorted(CLAUSES))
def test_no_subset(name):
    assert CLAUSES[name] not in catalog.ORACLES[name]


def test_pairs_and_matrix_by_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(13, 8)).astype(np.float32)
    label = [int(i % 2) for i in range(13)]
    spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(13)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    r = np.corrcoef(x.astype(float))
    pairs = {(p.a, p.b): p.similarity for p in catalog.QUERIES["safe_corr_pairs"](spark, str(tmp_path)).collect()}
    assert set(pairs) == {(a, b) for b in range(13) for a in range(b) if label[a] == label[b]}
    assert all(abs(v - r[k]) < 2e-6 for k, v in pairs.items())
    matrix = {(p.a, p.b): p.similarity for p in catalog.QUERIES["similarity_matrix"](spark, str(tmp_path)).collect()}
    assert set(matrix) == {(a, b) for a in range(13) for b in range(13) if label[a] == label[b]}
    assert all(abs(v - r[k]) < 2e-6 for k, v in matrix.items())


@pytest.mark.parametrize(("name", "draws"), [("label_shuffle_null", 64), ("subsample_stability", 32)])
def test_all_draws(spark, name, draws):
    """As many shuffles and subsamples as the operators' defaults, in query and SQL."""
    assert f"range(1, {draws + 1})" in catalog.ORACLES[name]
    assert {r.iterations for r in catalog.QUERIES[name](spark, DATA).select("iterations").collect()} == {draws}
