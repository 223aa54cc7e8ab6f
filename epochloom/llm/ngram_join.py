"""Near-duplicate documents by the Jaccard similarity of their word shingles,
with vertical partitioning.

1. Every document becomes the set of hashes of its shingles; documents of equal
   sets are one class. A linked partner lacks at most a fifth of a set, so all
   but a fifth of it must be shared of the shingles below any bound, too. Those
   in the lowest three tenths of the hash values are dealt by ranges of the hash
   to fragments, each fragment counts by itself how many a class shares there,
   and the counts are summed: classes that share too few have no partner. Only
   the others' whole sets go on.
2. The whole sets are dealt and counted in the same way, which gives each
   shingle its frequency. Shingles of one class alone are forgotten; the others
   are put into a global order, rare ones first, and that order is cut into
   fragments of equal numbers of postings: a class has one segment in each.
3. Candidates share a shingle among the first of both in that order. Lengths,
   positions, segment sizes and the differing bits of two bitmaps (each shingle
   turns one) bound a pair's overlap and discard it before it is counted. First
   each posting list offers its members one of them as leader, and a class is
   compared with one leader: whoever is linked to the same leader is known to be
   connected. Then the lists that still hold members of different groups are
   dealt in tiles, and a task sends a spanning forest of the pairs that it can't
   discard, never all pairs of a group; the links found make the groups larger.
   When nothing new is found, or after some rounds, every pair left between
   different groups is counted, so that no link is lost.
4. The overlap of a pair is counted segment by segment, each fragment by itself,
   and the counts are summed per pair. Links become components.

Shingles that very many classes hold are known from a sample; that they are
shared is then sure, so they need no counting and never meet in one task. Their
frequency only orders them, and any order is right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode, materialise, only, partitions, read, slices
from .simhash import HEAVY, components, spread_join

WIDTH, PERCENT, FRAGMENTS = 5, 80, 8
#: The most members of a posting list on either side of a tile.
TILE = 512
#: Bits of a class's bitmap.
BITS = 1024
#: The most rounds of forests before all pairs left are counted.
ROUNDS = 3
#: The most pairs of one class that meet its segments in one task.
PAIRS = 200
#: Frequencies above it are equal in the global order.
TOP = 65_535
#: The most classes whose keys are broadcast (8 bytes each).
BROADCAST_ROWS = 500_000
#: Entries of a sample for frequent shingles, and about as many in a fragment.
SAMPLE = 5_000_000
ENTRIES = 2_000_000
FRAGMENTS_AT_LEAST = 16

_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence of a
    shorter text is one. Made from hashes of the words, place by place."""
    words = encode(text or "").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mix(h * _C + w[k : k + len(h)])
    return np.unique(h.view(np.int64))


def needed(n: int, percent: int = PERCENT) -> int:
    """How many shingles a set of n must share with a linked one at least."""
    return (percent * n + 99) // 100


#: The share of hash values that partners are looked for by, and its bound.
SPAN = 0.3
_BOUND = int(SPAN * 2.0**64) - (1 << 63)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, whole: bool) -> DataFrame:
    """id, key (digest of the set; null: no words), k (its first eight bytes),
    n, h: the whole set or what of it has a hash below the bound."""
    src = only(docs, id_col, text_col)

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            short = pa.array([int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys], pa.int64())
            cut = sets if whole else [s[: np.searchsorted(s, _BOUND)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), short, pa.array([len(s) for s in sets], pa.int64()), _lists(cut)], ["id", "key", "k", "n", "h"])

    return src.mapInArrow(run, f"id {src.schema[0].dataType.simpleString()}, key binary, k long, n long, h array<long>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists."""
    return column.value_parent_indices().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _frequent(sets: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that very many classes of a sample hold, at
    most a hundred thousand, and about how many hold them in all."""
    part = min(1.0, SAMPLE / max(total, 1))
    sample = (sets if part == 1.0 else sets.sample(part, 7)).select("c", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y"))
    found = sorted((r["h"], round(r["n"] / part)) for r in sample.filter((F.col("n") > max(HEAVY, min(total, SAMPLE) // 100_000)) & (F.col("x") != F.col("y"))).select("h", "n").collect())
    return np.array([h for h, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def shared_shingles(sets: DataFrame, lists: bool, block: int = 1 << 13) -> DataFrame:
    """What each class (c, h) shares with others, fragment by fragment. With
    ``lists`` c, h, df: the shingles and their frequencies; else c, many: only
    how many. A class that comes twice is no other.

    Rows are packed: for each block of classes and each fragment one row with
    lists, so that an entry is ten bytes in the shuffle.
    """
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("n")).first()["n"]
    often, about = _frequent(sets, total)
    shared = spark.sparkContext.broadcast((often, np.minimum(about, TOP).astype(np.int32)))
    tasks = partitions(spark)
    n_fragments = max(FRAGMENTS_AT_LEAST, total // ENTRIES)  # by the data alone: a class has a row for each

    def deal(batches):
        often, _ = shared.value
        seen: set[int] = set()
        for batch in slices(batches, block):
            c = batch.column(0).to_numpy(zero_copy_only=False)
            doc, h = _flat(batch.column(1))
            if not lists:  # copies: once for each task, as far as it remembers
                fresh = np.array([x not in seen and not seen.add(x) for x in c.tolist()], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                doc, h = doc[fresh[doc]], h[fresh[doc]]
            place = np.minimum(np.searchsorted(often, h), max(len(often) - 1, 0))
            hot = often[place] == h if len(often) else np.zeros(len(h), bool)
            fragment = ((h / 2.0**64 + 0.5) / (1.0 if lists else SPAN) * n_fragments).astype(np.int64)  # any number will do, if equal hashes have equal ones
            fragment[hot] = -1 - doc[hot] % tasks
            order = np.argsort(fragment, kind="stable")
            at = np.flatnonzero(np.concatenate(([True], np.diff(fragment[order]) != 0))) if len(order) else order
            parts = np.split(order, at[1:]) if len(order) else []
            docs, index = zip(*(np.unique(doc[x], return_inverse=True) for x in parts)) if parts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(fragment[order][at].astype(np.int32)), _lists([c[x] for x in docs]), _lists([x.astype(np.int16) for x in index]).cast(pa.list_(pa.int16())), _lists([h[x] for x in parts])], ["fragment", "c", "at", "h"]
            )

    def counted(fragment: int, c: np.ndarray, h: np.ndarray):
        if fragment < 0:
            df = shared.value[1][np.searchsorted(shared.value[0], h)]
        else:
            order = np.lexsort((c, h))
            c, h = c[order], h[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            c, h = c[first], h[first]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            run = np.cumsum(new) - 1
            df = np.bincount(run)[run]
            c, h, df = c[df > 1], h[df > 1], np.minimum(df[df > 1], TOP).astype(np.int32)
        if not lists:
            c, many = np.unique(c, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(many)], ["c", "many"])
        order = np.argsort(c, kind="stable")
        c, h, df = c[order], h[order], df[order]
        each, at = np.unique(c, return_index=True)
        offsets = pa.array(np.append(at, len(c)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(each), pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(df))], ["c", "h", "df"])

    def count(batches):
        now, held = None, []
        for batch in batches:
            at, values = _flat(batch.column("at"))
            c = batch.column("c")
            starts = c.offsets.to_numpy()[:-1] - c.offsets[0].as_py()
            which = c.flatten().to_numpy()[starts[at] + values]
            h = batch.column("h").flatten().to_numpy()
            for k, fragment in enumerate(batch.column(0).to_pylist()):
                if fragment != now and held:
                    yield counted(now, *map(np.concatenate, zip(*held)))
                    held = []
                now = fragment
                low, high = np.searchsorted(at, (k, k + 1))
                held.append((which[low:high], h[low:high]))
        if held:
            yield counted(now, *map(np.concatenate, zip(*held)))

    dealt = sets.select("c", "h").mapInArrow(deal, "fragment int, c array<long>, at array<smallint>, h array<long>")
    dealt = dealt.repartition(tasks, "fragment").sortWithinPartitions("fragment")
    return dealt.mapInArrow(count, "c long, h array<long>, df array<int>" if lists else "c long, many long")


def _with_partners(base: DataFrame, percent: int) -> DataFrame:
    """k of the classes that share enough of their shingles below the bound, or
    have so few there that all might be their own."""
    held = base.filter("key IS NOT NULL")
    many = shared_shingles(held.select(F.col("k").alias("c"), "h"), lists=False).groupBy("c").agg(F.sum("many").alias("many"))
    least = F.size("h") - (F.col("n") - F.expr(f"({percent} * n + 99) div 100"))
    sizes = held.groupBy(F.col("k").alias("c")).agg(F.min(least).alias("least"))
    return sizes.join(many.hint("merge"), "c", "left").filter(F.coalesce("many", F.lit(0)) >= F.col("least")).select(F.col("c").alias("k"))


def _whole_sets(docs: DataFrame, partners: DataFrame, id_col: str, text_col: str, width: int, broadcast_rows: int) -> DataFrame:
    """c (a number), key, n, h: one row for each class that may have a partner.
    The keys are broadcast only if they are few."""
    few = partners.count() <= broadcast_rows
    rows = _sets(docs, id_col, text_col, width, whole=True).join(F.broadcast(partners) if few else partners.hint("merge"), "k", "left_semi")
    each = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("h").alias("h"))
    return each.withColumn("c", F.monotonically_increasing_id())  # kept, as the table is written


def _cuts(shared: DataFrame, fragments: int) -> list[tuple[int, int]]:
    """Where the global order (frequency, hash) is cut: fragments of equal
    numbers of postings; within a frequency hashes are even."""
    rows = shared.select(F.explode("df").alias("df")).groupBy("df").agg(F.count("*").alias("n")).orderBy("df").collect()  # TOP rows at most
    total = sum(r["n"] for r in rows)
    out, before = [], 0
    for r in rows:
        while len(out) < fragments - 1 and (len(out) + 1) * total / fragments <= before + r["n"]:
            part = ((len(out) + 1) * total / fragments - before) / r["n"]
            out.append((r["df"], min((1 << 63) - 1, int((part - 0.5) * 2.0**64))))
        before += r["n"]
    return out


def segments(sets: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """c, n, shared (shingles that others have, too), sizes (of all segments),
    frag, seg (hashes in global order), before (in earlier segments), bits (the
    class's bitmap, in its first row only): of the classes that share enough
    shingles to be linked."""
    shared = materialise(shared_shingles(sets, lists=True), "shared-shingles")
    cuts = _cuts(shared, fragments)
    whole = shared.groupBy("c").agg(F.flatten(F.collect_list("h")).alias("h"), F.flatten(F.collect_list("df")).alias("df"))  # one class's own
    whole = whole.join(sets.select("c", "n").hint("merge"), "c").filter(F.size("h") >= F.expr(f"({percent} * n + 99) div 100"))

    def run(batches):
        level, low = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
        for batch in slices(batches):
            out = []
            for c, n, h, df in zip(batch.column("c").to_pylist(), batch.column("n").to_pylist(), batch.column("h"), batch.column("df")):
                h, df = h.values.to_numpy(), df.values.to_numpy()
                order = np.lexsort((h, df))
                h, df = h[order], df[order]
                frag = np.zeros(len(h), np.int64)
                for a, b in zip(level, low):
                    frag += (df > a) | ((df == a) & (h >= b))
                sizes = np.bincount(frag, minlength=fragments).astype(np.int32)
                ends = np.cumsum(sizes)
                bits = np.packbits(np.bincount(h & (BITS - 1), minlength=BITS) & 1).tobytes()
                for at, k in enumerate(np.flatnonzero(sizes).tolist()):
                    out.append((c, n, len(h), sizes, k, h[ends[k] - sizes[k] : ends[k]], ends[k] - sizes[k], None if at else bits))
            cols = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), _lists(list(cols[3])).cast(pa.list_(pa.int32())), pa.array(cols[4], pa.int32()), _lists(list(cols[5])).cast(pa.list_(pa.int64())), pa.array(cols[6], pa.int32()), pa.array(cols[7], pa.binary())],
                ["c", "n", "shared", "sizes", "frag", "seg", "before", "bits"],
            )

    return whole.select("c", "n", "h", "df").mapInArrow(run, "c long, n long, shared int, sizes array<int>, frag int, seg array<long>, before int, bits binary")


def _prefixes(segs: DataFrame, percent: int) -> DataFrame:
    """h, c, n, shared, sizes, pos: the first shingles of each class. Those of
    its own came before and have used up some of the places."""
    room = F.col("shared") - F.expr(f"({percent} * n + 99) div 100") + 1 - F.col("before")
    first = segs.filter(room > 0).withColumn("first", F.slice("seg", 1, room.cast("int")))
    return first.select("c", "n", "shared", "sizes", "before", F.posexplode("first").alias("at", "h")).select("h", "c", F.col("n").alias("size"), "shared", "sizes", (F.col("before") + F.col("at")).alias("pos"))


def count_overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """a, b, overlap: for pairs of classes the shingles they share, counted
    fragment by fragment and summed. A class of very many pairs has its segments
    sent to several tasks, so many pairs to each."""
    pairs = pairs.select("a", "b")
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / PAIRS).cast("int"))
    dealt = spread_join(pairs, many, "a", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    left = segs.select(F.col("c").alias("a"), "frag", F.col("seg").alias("left")).join(many.select("a", "copies").hint("merge"), "a")
    left = left.select("a", "frag", "left", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    right = segs.select(F.col("c").alias("b"), "frag", F.col("seg").alias("right"))
    met = dealt.hint("merge").join(left, ["a", "copy"]).select("a", "b", "frag", "left").join(right.hint("merge"), ["b", "frag"])
    partial = met.select("a", "b", F.size(F.array_intersect("left", "right")).alias("overlap"))
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def linked(pairs: DataFrame, segs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: the pairs (a, b, na, nb) whose similarity is high enough."""
    pairs = materialise(pairs, "candidates")
    counted = count_overlaps(pairs, segs).join(pairs.hint("merge"), ["a", "b"])
    return counted.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b")


def _leader_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb: for each class one leader of its posting lists (each list's
    smallest class) with which it has a chance."""
    lists = prefix.groupBy("h").agg(F.min(F.struct("c", "size", "shared", "pos", "sizes")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("h", "n", "lead")
    met = spread_join(prefix, lists, "h", prefix.count()).filter("c <> lead.c")
    need = F.expr(f"({percent} * (size + lead.size) + {99 + percent}) div {100 + percent}")
    met = met.filter(100 * F.least("size", "lead.size") >= percent * F.greatest("size", "lead.size"))
    met = met.filter(F.least("pos", "lead.pos") + F.least(F.col("shared") - F.col("pos"), F.col("lead.shared") - F.col("lead.pos")) >= need)
    met = met.filter(F.expr("aggregate(zip_with(sizes, lead.sizes, (x, y) -> least(x, y)), 0, (a, x) -> a + x)") >= need)
    return met.groupBy("c", "size").agg(F.min(F.struct("lead.c", "lead.size")).alias("lead")).select(F.col("lead.c").alias("a"), F.col("c").alias("b"), F.col("lead.size").alias("na"), F.col("size").alias("nb"))


def _tiles(prefix: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """h, i, j, side and the rows of the posting lists with several groups, long
    lists dealt to pairs (i, j) of tiles. labels: c, label, bits."""
    rows = prefix.join(labels.select("c", "label").hint("merge"), "c")
    lists = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h", "n")
    met = materialise(spread_join(rows, lists, "h", rows.count()), "mixed-lists")  # the bitmaps come to these rows only
    met = met.join(labels.select("c", "bits").hint("merge"), "c").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return met.select("h", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "c", "size", "shared", "sizes", "pos", "label", "bits")


def chances(n, shared, sizes, pos, bits, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Mask of the pairs (x[i], y[i]) that meet at a shingle and may be linked: by
    length, by what comes before and after the shingle, by segment sizes, and
    by bitmaps (bits that differ stand for as many shingles that differ)."""
    need = -(-percent * (n[x] + n[y]) // (100 + percent))
    ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    ok &= np.minimum(pos[x], pos[y]) + np.minimum(shared[x] - pos[x], shared[y] - pos[y]) >= need
    left = np.flatnonzero(ok)
    ok[left] = np.minimum(sizes[x[left]], sizes[y[left]]).sum(axis=1) >= need[left]
    for at in range(0, len(left := np.flatnonzero(ok)), 1 << 16):
        k = left[at : at + (1 << 16)]
        apart = np.bitwise_count(bits[x[k]] ^ bits[y[k]]).sum(axis=1, dtype=np.int64)
        ok[k] = shared[x[k]] + shared[y[k]] - apart >= 2 * need[k]
    return ok


def _tile_pairs(tiles: DataFrame, fragments: int, percent: int, forest: bool) -> DataFrame:
    """a, b, na, nb: pairs of different groups in a tile that have a chance; with
    ``forest`` only as many as connect, in a task, all that have one."""
    tiles = tiles.repartition(partitions(tiles.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j", "label")

    def flush(t):
        at = starts(t, ["h", "i", "j"])
        group = np.cumsum(np.bincount(at, minlength=t.num_rows))
        c, label, n, shared, pos, side, i, j = (t.column(x).to_numpy().astype(np.int64) for x in ("c", "label", "size", "shared", "pos", "side", "i", "j"))
        sizes = t.column("sizes").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, fragments)
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        cross = i != j
        names, group_of = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        found, held, at, lag = [], 0, np.arange(t.num_rows), 0
        while True:
            lag += 1
            at = at[at + lag < t.num_rows]
            at = at[group[at] == group[at + lag]]
            if not len(at):
                break
            x = at[(label[at] != label[at + lag]) & (~cross[at] | (side[at] != side[at + lag]))]
            if forest:
                x = x[root[group_of[x]] != root[group_of[x + lag]]]
            x = x[chances(n, shared, sizes, pos, bits, x, x + lag, percent)]
            if forest and len(x):
                x = x[_unite(root, group_of[x], group_of[x + lag])]
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
            if len(x):
                low, high = np.where(c[x] < c[x + lag], x, x + lag), np.where(c[x] < c[x + lag], x + lag, x)
                found.append(np.stack((c[low], c[high], n[low], n[high]), axis=1))
                held += len(x)
            if held >= 500_000:
                yield out(found)
                found, held = [], 0
        if found:
            yield out(found)

    def out(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], ["a", "b", "na", "nb"])

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < 50_000:
                continue
            cut = int(starts(held, ["h", "i", "j"])[-1])  # the last tile may go on
            if cut:
                yield from flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from flush(held)

    return tiles.mapInArrow(run, "a long, b long, na long, nb long").distinct()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the groups of a[i] and b[i]; mask of the pairs that joined two."""
    new = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            new[k] = True
    return new


def groups_of(segs: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS, tile: int = TILE, counts: dict | None = None) -> DataFrame:
    """c, label: the classes of each component of the links, by its smallest.
    counts: how many rows and pairs each step has is written to it."""
    prefix = materialise(_prefixes(segs, percent), "prefixes")
    own = segs.filter("bits IS NOT NULL").select("c", "bits")
    links = materialise(linked(_leader_pairs(prefix, percent), segs, percent), "leader-links")
    # two classes of one leader are linked through it
    led = links.select(F.col("b").alias("c"), F.col("a").alias("lead"))
    labels = materialise(own.join(led.hint("merge"), "c", "left").select("c", F.coalesce("lead", "c").alias("label"), "bits"), "labels")
    said = {"classes": own.count(), "prefixes": prefix.count(), "led": links.count(), "forests": [], "rest": 0} if counts is not None else None
    closed, forest = False, 0
    while True:
        pairs = materialise(_tile_pairs(_tiles(prefix, labels, tile), fragments, percent, forest < ROUNDS), "tile-pairs")
        if not pairs.take(1):
            break
        got = materialise(linked(pairs, segs, percent), "links")
        if said:
            said |= {"forests": [*said["forests"], pairs.count()]} if forest < ROUNDS else {"rest": pairs.count()}
        last, found = forest >= ROUNDS, bool(got.take(1))
        if found:
            links = links.unionByName(got)
            labels, closed = _closed(labels, links), True
        if last:
            break
        forest = forest + 1 if found else ROUNDS  # nothing new: what is left is counted in full
    if not closed:
        labels = _closed(labels, links)
    if counts is not None:
        counts |= said
    return labels.select("c", "label")


def _closed(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels by components of all links."""
    roots = components(links).withColumnsRenamed({"node": "c", "root": "label"})
    return materialise(labels.drop("label").join(roots.hint("merge"), "c", "left").select("c", F.coalesce("label", "c").alias("label"), "bits"), "labels")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, fragments: int = FRAGMENTS, tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS, counts: dict | None = None) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links): one row
    for each row of ``docs``.

    Null and empty texts have an empty set and are linked with nothing: their
    component is their own id. Null ids keep their row and count for links but
    never name a component (null if it has no other id). Repeated rows are one
    class and stay; an empty table gives an empty one; other columns aren't
    read. Sets are of 64-bit hashes, classes of 128-bit ones.
    """
    base = materialise(_sets(docs, id_col, text_col, width, whole=False), "sets")
    partners = materialise(_with_partners(base, percent), "partners")
    sets = materialise(_whole_sets(docs, partners, id_col, text_col, width, broadcast_rows), "whole-sets")
    segs = materialise(segments(sets, percent, fragments), "segments")
    groups = groups_of(segs, percent, fragments, tile, counts)
    held = base.filter("key IS NOT NULL")
    first = materialise(held.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    joined = sets.select("c", "key").join(groups.withColumnRenamed("label", "root").hint("merge"), "c").select("key", "root")
    joined = materialise(joined.join(first.select("key", "first").hint("merge"), "key"), "linked-classes")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(joined, least, "root", joined.count()).select("key", "component_id")
    known = first.join(named.hint("merge"), "key", "left").select("key", "n", F.coalesce("component_id", "first").alias("component_id"))
    rows = held.select("id", "key", F.col("n").alias("n_shingles"))
    out = spread_join(rows, known, "key", rows.count()).select("id", "n_shingles", "component_id")
    empty = base.filter("key IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(empty).withColumnsRenamed({"id": id_col})


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
