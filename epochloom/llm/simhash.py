"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a fixed set of
reference fingerprints (pivots). By the triangle inequality two fingerprints
within ``radius`` differ by at most ``radius`` in every coordinate, so a pair
whose largest coordinate difference is larger is discarded without a look at
the fingerprints; survivors are verified.

Which pairs meet at all: the 64 bits are cut into blocks; ``radius`` changed
bits leave all but ``radius`` blocks untouched, so fingerprints that agree on
one choice of so many blocks are all the candidates there are. The more
fingerprints, the more blocks (longer keys), so that buckets stay small. A
bucket that is too large for a tile all the same is dealt by the table: rings of
distance around pivots, a fingerprint as host in its own ring and as guest in
the next, for close ones are in the same ring or in neighbours. Rings that are
still too large are split into pairs of tiles. A tile gives a spanning forest of
its links instead of all pairs; links become components by alternating large-
star and small-star steps in the shared folder.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode, materialise, only, partitions, read, slices

SHINGLE, SEED, RADIUS = 4, 42, 4
N_PIVOTS = 16
#: Of them those whose rings deal full buckets.
N_RINGS = 3
#: The most fingerprints on either side of a tile.
TILE = 2048


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles; 0 for a text without words."""
    words = encode(text or "").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for any length
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fp`` (the fingerprint as a signed long); row by row."""
    src = only(docs, id_col, text_col)

    def run(batches):
        for batch in slices(batches):
            out = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "fp"])

    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, spread."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, one column for each reference."""
    return np.stack([np.bitwise_count(fps ^ r) for r in refs], axis=1).astype(np.int8)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """How many blocks make the least work for ``n`` distinct fingerprints:
    every choice of kept blocks sends each one once, and pairs it with those of
    its bucket (a look at a pair costs a hundredth of a row sent)."""
    work = {k: comb(k, radius) * (1 + n / 2 ** (64 * (k - radius) / k) / 200) for k in range(radius + 2, radius + 8)}
    return min(work, key=work.get)


def block_keys(fps: np.ndarray, n_blocks: int, radius: int = RADIUS) -> np.ndarray:
    """One key column for each choice of the blocks that stay untouched."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    columns = []
    for number, kept in enumerate(itertools.combinations(range(n_blocks), n_blocks - radius)):
        key = np.full(len(fps), number, np.uint64)
        for k in kept:
            size = edges[k + 1] - edges[k]
            key = (key << np.uint64(size)) | ((fps >> np.uint64(edges[k])) & np.uint64((1 << size) - 1))
        columns.append(key)
    return np.stack(columns, axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, radius: int, counts: list[int] | None = None) -> np.ndarray:
    """Mask of the pairs (a[i], b[i]) within ``radius``: pivot coordinates one
    by one, then the fingerprints of what is left. counts: pairs met, left by
    the table, and within the radius are added to it."""
    left = np.arange(len(a))
    for k in range(ta.shape[1]):
        left = left[np.abs(ta[left, k] - tb[left, k]) <= radius]
        if not len(left):
            break
    out = np.zeros(len(a), bool)
    out[left] = np.bitwise_count(a[left] ^ b[left]) <= radius
    if counts is not None:
        for k, n in enumerate((len(a), len(left), int(out.sum()))):
            counts[k] += n
    return out


def tile_links(group: np.ndarray, side: np.ndarray, cross: np.ndarray, guest: np.ndarray, fps: np.ndarray, radius: int, refs: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) rows of spanning forests of the links inside each run of
    equal ``group``. In tiles of two sides (``cross``) only pairs across count;
    pairs that are both guests in a ring (bits of ``guest``) meet elsewhere.
    Pairs are taken by their distance in the run, so that many small groups and
    a few large ones are both done on whole arrays."""
    table = pivot_table(fps, refs)
    root = np.arange(len(fps))
    at, lag = np.arange(len(fps)), 0
    while True:
        lag += 1
        at = at[at + lag < len(fps)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        i = at[(~cross[at] | (side[at] != side[at + lag])) & (guest[at] & guest[at + lag] == 0)]
        i = i[root[i] != root[i + lag]]
        j = i + lag
        near = close_pairs(fps[i], fps[j], table[i], table[j], radius, counts)
        if near.any():
            _unite(root, i[near], j[near])
            while len(np.flatnonzero((up := root[root]) != root)):
                root = up
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[member], fps[root[member]]


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    for x, y in zip(i.tolist(), j.tolist()):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)


def _in_rings(d: str, radius: int):
    """array<struct<cell, guest>>: the ring of a distance and the next one."""
    ring = F.floor(F.col(d) / (radius + 1)).cast("int")
    return F.array(F.struct(ring.alias("cell"), F.lit(0).alias("guest")), F.struct((ring + 1).alias("cell"), F.lit(1).alias("guest")))


def _full_buckets(met: DataFrame, radius: int, tile: int) -> DataFrame:
    """key, cell, i, j, side, guest, fp: buckets of more than a tile dealt to
    rings, one dimension for each factor of four that they are too large, and
    rings of more than a tile to pairs (i, j) of tiles."""
    plain = F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("guest")))
    for r in range(N_RINGS):
        met = met.withColumn(f"r{r}", F.explode(F.when(F.col("count") > tile * 4**r, _in_rings(f"d{r}", radius)).otherwise(plain)))
    cell, guest = F.lit(0), F.lit(0)
    for r in range(N_RINGS):
        cell, guest = cell * 64 + F.col(f"r{r}.cell"), guest * 2 + F.col(f"r{r}.guest")
    met = met.select("key", "fp", cell.cast("int").alias("cell"), guest.cast("int").alias("guest"))
    sizes = met.groupBy("key", "cell").agg(F.count("*").alias("n")).filter("n > 1").select("key", "cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    met = met.join(sizes, ["key", "cell"]).withColumn("side", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select("key", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "guest", "fp")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, n_blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect
    all fingerprints within ``radius``, at most one for each row of a tile."""
    refs = pivots()
    n_blocks = n_blocks or blocks_for(distinct.count(), radius)

    def keyed(batches):
        for batch in slices(batches, 1 << 14):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = block_keys(fps, n_blocks, radius)
            rings = pivot_table(fps, refs[:N_RINGS])
            many = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel().view(np.int64)), pa.array(np.tile(fps.view(np.int64), many)), *[pa.array(np.tile(rings[:, r], many)) for r in range(N_RINGS)]], ["key", "fp", *[f"d{r}" for r in range(N_RINGS)]])

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long" + "".join(f", d{r} tinyint" for r in range(N_RINGS)))
    shared = keys.groupBy("key").count().filter("count > 1")
    met = keys.join(shared.hint("merge"), "key")  # a small table of keys is still large unpacked: never broadcast
    none = F.lit(0)
    one_tile = met.filter(F.col("count") <= tile).select("key", none.alias("cell"), none.alias("i"), none.alias("j"), none.alias("side"), none.alias("guest"), "fp")
    tiles = one_tile.unionByName(_full_buckets(met.filter(F.col("count") > tile), radius, tile))
    tiles = tiles.repartition(partitions(distinct.sparkSession), "key", "cell", "i", "j").sortWithinPartitions("key", "cell", "i", "j", "fp")

    def run(batches):
        rest: list[np.ndarray] | None = None

        def ends(cols) -> np.ndarray:
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
            return new

        def flush(cols):
            if len(cols[0]):
                a, b = tile_links(np.cumsum(ends(cols)), cols[4], cols[2] != cols[3], cols[5], cols[6].view(np.uint64), radius, refs)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            if len(rest[0]) < 500_000:
                continue
            cut = int(np.flatnonzero(ends(rest))[-1])  # the last tile may go on
            yield from flush([c[:cut] for c in rest])
            rest = [c[cut:] for c in rest]
        if rest is not None:
            yield from flush(rest)

    return tiles.mapInArrow(run, "a long, b long")


#: Keys with more than a hundred-thousandth of all rows, and this many, are spread.
HEAVY = 200


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of their key in ``lookup`` (key, n, ...; n: how
    many of the ``total`` rows have it). Keys of very many rows are at most a
    hundred thousand by their share, so theirs are broadcast and no task holds
    all rows of one; the rest meet by the key."""
    heavy = F.col("n") > max(HEAVY, total // 100_000)
    few = lookup.filter(heavy)
    many = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(lookup.filter(~heavy), key)
    return many.unionByName(rows.join(F.broadcast(few), key))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the component's
    smallest node. Large-star and small-star steps until no edge changes; each
    round is written to the shared folder. Minima are combined before the
    shuffle, and a node with very many links is spread (``spread_join``)."""
    now = materialise(_oriented(edges), "links")
    for _ in range(rounds):
        total = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        up = both.filter("v > u")
        large = materialise(_oriented(spread_join(up, least, "u", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b"))), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = spread_join(large, least, "u", total)
        small = met.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, now = now, materialise(_oriented(small), "links")
        if now.count() == total and not now.join(before, ["u", "v"], "left_anti").take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges u > v."""
    a, b = edges.columns
    return edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (hex), component_id (smallest id reachable): one row per
    row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other;
    null ids keep their row and count for links but never name a component
    (null if it has no other id); repeated rows stay; an empty table gives an
    empty one; other columns aren't read.
    """
    base = materialise(fingerprints(docs, id_col, text_col).withColumnsRenamed({id_col: "id"}), "fingerprints")
    first = materialise(base.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "first")
    roots = components(links(first, radius))
    grouped = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(grouped, least, "root", first.count()).select("fp", F.col("rows").alias("n"), "component_id")
    out = spread_join(base, named, "fp", base.count())
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def _row_key(id_col: str, text_col: str):
    """A string that sorts by id (null last), then by hashes of the text. One
    value that is never null, so that a join and the grouping after it agree on
    how rows are dealt, and texts move once."""
    word = lambda c: F.lpad(F.hex(c), 16, "0")
    number = F.coalesce(F.col(id_col), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    return F.concat(F.when(F.col(id_col).isNull(), "1").otherwise("0"), word(number), word(F.xxhash64(text_col)), word(F.hash(text_col).cast("long")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """A documents table with one row of each component: the one with the
    smallest id, rows without an id last, then by hashes of the text. Rows that
    are nobody's copy all stay, whatever their id; of rows equal in id and text
    one stays. Texts are shuffled once."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("_row", _row_key("doc_id", "text"))
    groups = near_duplicates(rows, "_row")
    keep = materialise(groups.filter(F.col("_row") == F.col("component_id")).select("_row").distinct(), "kept-rows")
    return rows.join(keep.hint("merge"), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
