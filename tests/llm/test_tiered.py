"""Tiered search against brute force: tiers, blocks, ties, nulls, repeats."""

import math
import random
import re
from collections import Counter

import pytest

from epochloom.llm import tiered

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def bag(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def brute(docs, items, k=20):
    rows = [(i, Counter(bag(t))) for i, t in docs if bag(t)]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for at, (i, c) in enumerate(rows):
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w in bag(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, at, i))
        out += [(item, r + 1, s[4], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tables(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É1", "naïve"]
    text = lambda size: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=size))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    items = [(j, text(rng.randint(1, 12))) for j in range(12)]
    items.append((50, "w1 w1 W59-w58"))
    return docs, items


@pytest.mark.parametrize("tiers", [(5, 40), (1, 2), (1000, 2000)])
def test_equals_brute_force(spark, tiers):
    docs, items = tables()
    proofs = []
    got = tiered.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tiers=tiers, proofs=proofs)
    assert result(got) == brute(docs, items)
    assert sum(sum(p) for p in proofs) == len(items)


def test_rare_terms_are_proven_by_the_first_tier(spark):
    """Thirty documents hold the item's rare words; a common word can't lift another above them."""
    docs = [(i, "common " * (1 + i % 7) + f"x{i} y{i} z{i}") for i in range(500)] + [(1000 + i, "quark gluon boson common") for i in range(30)]
    items = [(1, "common quark gluon boson"), (2, "common")]
    for broadcast_rows in (1_000_000, 0):
        proofs = []
        got = tiered.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tiers=(40, 200), broadcast_rows=broadcast_rows, proofs=proofs)
        assert result(got) == brute(docs, items)
        assert proofs[0][0] == 1 and sum(proofs[0]) == 2


def test_blocks_of_items_and_small_k(spark):
    docs, items = tables(120, 3)
    got = tiered.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3, tiers=(4, 9), block_bytes=100)
    assert result(got) == brute(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "A,B!"), (5, "?!"), (6, "a " * 70_000)] + [(i, "c") for i in range(10, 40)]
    items = [(1, "a b"), (1, "a b"), (None, "b"), (2, None), (3, ""), (4, "unseen"), (5, "c")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int")
    got = result(tiered.search(d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int"), tiers=(1, 2)))
    assert got == brute(docs, [r for r in items if r[1]])
    assert sorted(r[2] for r in got if r[0] == 5) == list(range(10, 30))  # ties by id


def test_empty_tables_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tiered.search(none, items).count() == 0
    assert tiered.search(some, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert tiered.search(some, items.limit(0)).count() == 0
    named = spark.createDataFrame([("x", "a b"), ("w", "a b"), ("v", "c")], "doc_id string, text string")
    assert [tuple(r)[:3] for r in tiered.search(named, items).orderBy("rank").collect()] == [(1, 1, "w"), (1, 2, "x")]
