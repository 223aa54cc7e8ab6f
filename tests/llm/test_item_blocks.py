"""Test items beyond one automaton: repeats, giant items, giant windows, and
what is carried between passes."""

import random

import pytest

from epochloom.llm import decontaminate


def brute(text, items, width=13):
    """(n_words, n_hit, ids) by looking for every window at every place."""
    words = decontaminate.words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        if item is None:
            continue
        w = decontaminate.words_of(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win = w[i : i + width]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def compare(spark, docs, items, **options):
    d = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(docs)], "k long, doc_id long, text string")
    got = decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), keep=("k", "text"), **options).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.item_ids) == brute(docs[r.k][1], items), r.k
        assert (r.doc_id, r.text) == docs[r.k]
        covered = {w for s, e in ((h.s, h.e) for h in r.hits) for w in range(s, e)}
        assert bool(covered) == (r.n_hit > 0)


def test_equal_items_count_once(spark):
    items = [(1, "one two three four five six")] * 60 + [(2, "one two three four five six")] * 60 + [(None, "one two")] * 60
    docs = [(1, "zero one two three four five six seven"), (1, None), (None, "one two three four five six"), (2, "one two")]
    compare(spark, docs, items, block_bytes=100)


def test_windows_larger_than_a_block(spark):
    giant = " ".join("x" * 400 + str(i) for i in range(20))
    one = "y" * 5000
    items = [(1, giant), (2, one), (3, "a b c"), (3, "a b c"), (4, " ".join(f"w{i}" for i in range(300)))]
    docs = [(1, f"start {giant} end"), (2, f"{one} and a b c"), (3, " ".join(f"w{i}" for i in range(100, 130))), (4, "a b"), (None, f"{one}")]
    compare(spark, docs, items, block_bytes=1000)


@pytest.mark.parametrize("block_bytes", [200, 2 << 20])
def test_many_blocks(spark, block_bytes):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(6)}"
    items = [(i % 25, " ".join(word() for _ in range(rng.randint(0, 18)))) for i in range(40)]
    docs = [(i % 20, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)]
    docs += [(50, "before " + items[3][1] + " after")] * 2
    compare(spark, docs, items, block_bytes=block_bytes)
