"""The Jaccard join against all pairs: near copies, hot shingles, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochloom.llm import ngram_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, percent=80, width=5):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)), key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_copies(rng, words, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def table(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)  # in a third of all rows
    texts = [text(rng.randint(1, 120)) for _ in range(60)]
    texts += [passage + " " + text(rng.randint(3, 25)) for _ in range(60)]
    texts += [text(rng.randint(3, 20)) + " " + passage for _ in range(20)]
    for edits in (2, 4, 8):
        texts += near_copies(rng, words, text(100), 40, edits)
    texts += [texts[3]] * 30 + [texts[5].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,tile,broadcast_rows", [(1, 1024, 500_000), (2, 3, 0)])
def test_equals_all_pairs(spark, seed, tile, broadcast_rows):
    docs = table(seed)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), tile=tile, broadcast_rows=broadcast_rows)
    assert result(got) == brute(docs)


def test_overlaps_are_summed_over_fragments(spark):
    docs = [(i, t) for i, (_, t) in enumerate(table(3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keys = ngram_join._sets(df, "doc_id", "text", 5, whole=True).select("k").distinct()
    sets = ngram_join.materialise(ngram_join._whole_sets(df, keys, "doc_id", "text", 5, 1000), "t")
    held = {r["c"]: set(r["h"]) for r in sets.collect()}
    every = [h for s in held.values() for h in s]
    shared = {r["c"]: r for r in ngram_join.shared_shingles(sets, lists=True).groupBy("c").agg(F.flatten(F.collect_list("h")).alias("h"), F.flatten(F.collect_list("df")).alias("df")).collect()}
    counted = Counter(every)
    assert {c: dict(zip(r["h"], r["df"])) for c, r in shared.items()} == {c: w for c, s in held.items() if (w := {h: counted[h] for h in s if counted[h] > 1})}
    segs = ngram_join.segments(sets, 80, 4)
    assert segs.select("frag").distinct().count() == 4
    rows = segs.collect()
    order = {}
    for r in rows:
        order.setdefault(r["c"], []).append((r["frag"], r["before"], [(counted[h], h) for h in r["seg"]]))
    for c, parts in order.items():
        flat = [x for _, _, seg in sorted(parts) for x in seg]
        assert flat == sorted(flat) and all(b == sum(len(s) for f, _, s in parts if f < k) for k, b, _ in parts)
    keys = sorted(order)
    pairs = [(a, b) for a in keys[:30] for b in keys[30:60]]
    got = {(r["a"], r["b"]): r["overlap"] for r in ngram_join.count_overlaps(spark.createDataFrame(pairs, "a long, b long"), segs).collect()}
    assert len(pairs) > 100 and all(got.get(p, 0) == len(held[p[0]] & held[p[1]]) for p in pairs)


def test_bounds_lose_no_pair():
    """Of random pairs of sets none that is similar enough is discarded."""
    rng = random.Random(11)
    kept = lost = 0
    for _ in range(300):
        base = rng.sample(range(100_000), 60)
        sets = [sorted({*rng.sample(base, rng.randint(45, 60)), *rng.sample(range(100_000, 200_000), rng.randint(0, 8))}) for _ in range(2)]
        common = sorted(set(sets[0]) & set(sets[1]))
        bits = np.stack([np.packbits(np.bincount(np.array(s) & (ngram_join.BITS - 1), minlength=ngram_join.BITS) & 1) for s in sets]).view(np.uint64)
        sizes = np.array([[sum(x % 4 == k for x in s) for k in range(4)] for s in sets])
        n = np.array([len(s) for s in sets])
        for token in common[:5]:
            pos = np.array([s.index(token) for s in sets])
            ok = ngram_join.chances(n, n, sizes, pos, bits, np.array([0]), np.array([1]), 80)[0]
            similar = 100 * len(common) >= 80 * len(set(sets[0]) | set(sets[1]))
            assert ok or not similar
            kept, lost = kept + ok, lost + (not ok)
    assert kept > 100 and lost > 100


def test_every_pair_left_is_counted_after_the_forests(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    docs = table(6)
    counts = {}
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), tile=4, counts=counts)
    assert result(got) == brute(docs) and counts["rest"] > 0


def test_frequent_shingles_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    docs = table(4)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert result(got) == brute(docs)


def test_a_group_of_near_copies_gives_few_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = " ".join(rng.choice(words) for _ in range(200))
    docs = list(enumerate(near_copies(rng, words, base, 300, 3)))
    counts = {}
    got = result(ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), counts=counts))
    assert {r[2] for r in got} == {0}
    assert counts["led"] + sum(counts["forests"]) + counts["rest"] < 4 * len(docs)  # of 44,850 pairs


def test_thresholds_are_exact(spark):
    """4 of 5 shingles shared is a link, 7 of 9 none."""
    w = [f"a{i}" for i in range(40)]
    docs = [(1, " ".join(w[:8])), (2, " ".join([*w[:8], "x"])), (3, " ".join([*w[20:32]])), (4, " ".join([*w[20:31], "y", "z"]))]
    assert result(ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert brute(docs)[1][2] == 1 and brute(docs)[3][2] == 4


def test_odd_rows(spark):
    long = "z " * 70_000 + " ".join(f"q{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "one"), (None, "one"), (None, "nobody else"), (6, "a b c d"), (7, "a b c d e"), (8, long), (9, long + " end"), (10, " x y")]
    rows = spark.createDataFrame([(*r, b"k", 1, [2]) for r in docs], "doc_id long, text string, key binary, n int, h array<int>")
    assert result(ngram_join.jaccard_components(rows)) == brute(docs)


def test_empty_table_and_text_ids(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", None)], "doc_id string, text string")
    assert result(ngram_join.jaccard_components(named)) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]


def test_shingles_of_the_text_alone():
    assert len(ngram_join.shingle_set("a b c d e f")) == 2
    assert (ngram_join.shingle_set("A b\tc\nd") == ngram_join.shingle_set("a b c d")).all()
    assert len(set(ngram_join.shingle_set("a b c d")) & set(ngram_join.shingle_set("a b c d a"))) == 0
