"""Every operator and stage on tables with nulls everywhere, repeated rows,
clashing extra columns, and no rows at all."""

import os

import pytest

import corpus_pipeline
from epochloom.llm import decontaminate, html_text, pieces, quality_rules, secrets, simhash, suffix, toxicity, warc, weak_quality

CLASH = "id, fp, u, v, a, b, key, spans, kept, score, n_words, _text, _h, _id, _t, _y, text_, bucket, load, copied, shared, cut, posterior, fingerprint, component_id, first, root, node".split(", ")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = "Some words of a sentence that goes on and on, with token = \"abcdef0123456789\" inside. " * 40
ROWS = [(1, LONG), (1, LONG), (None, LONG), (2, None), (3, ""), (None, None), (4, "short text here."), (5, LONG + " and a tail"), (6, "é😀\x00﻿   x")]


@pytest.fixture(params=["rows", "empty"])
def docs(spark, request):
    rows = [(i, t, None, None, None, *(["x", None] * len(CLASH))[: len(CLASH)]) for i, t in ROWS]
    df = spark.createDataFrame(rows, SCHEMA)
    return df if request.param == "rows" else df.limit(0)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, LONG[:200], "x"), (None, "a b", None), (2, None, None)], "item_id long, text string, doc_id string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, "x"), (4, 0, None), (None, 1, None), (5, None, None)], "doc_id long, toxic int, text string")


def test_row_operators(spark, docs, items, labels):
    n = docs.count()
    outs = {
        "weak": weak_quality.classify(docs, weak_quality.fit(docs)), "rules": quality_rules.quality_rules(docs), "secrets": secrets.secret_spans(docs), "simhash": simhash.near_duplicates(docs),
        "suffix": suffix.remove_repeats(docs), "benchmark": decontaminate.decontaminate(docs, items), "toxicity": toxicity.score_toxicity(docs, toxicity.fit(docs, labels)), "pieces": pieces.encode_documents(docs),
    }
    for name, df in outs.items():
        assert len(df.collect()) == n, name


def test_null_ids(spark, docs):
    if not docs.count():
        return
    got = suffix.remove_repeats(docs).collect()
    assert sum(r.doc_id is None for r in got) == 2
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    ids = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert None not in ids  # each is linked to a row with an id here


def test_stages(spark, docs, tmp_path, items):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.count() <= docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("n", [0, 4])
def test_pages(spark, n):
    rows = [(1, None, None, "x"), (None, "http://a/", "<p>x", None), (2, "http://a/", "<p>x", None), (2, "http://a/", "<p>x", None)][:n]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    assert html_text.extract(pages).count() == n
    out = warc.resolve(warc.archived_captures(pages), "page_id").collect()
    assert len(out) == (6 if n else 0)
    if n:
        assert {r.status for r in out if r.page_id == 1 and r.kind == "revisit"} == {"orphan"}


def test_shared_folder_is_the_configured_one(spark):
    from epochloom.llm.common import materialise, shared_dir

    at = shared_dir(spark)
    assert at == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    before = set(os.listdir(at))
    assert materialise(spark.range(3), "t").count() == 3
    assert len(set(os.listdir(at)) - before) == 1
