"""Similarity of vectors within and between groups.

Sums of unit vectors give mean correlations in one pass: the sum over the pairs
of two groups is S_a . S_b, S being the sum of a group's centred unit vectors;
within a group the vectors' own products Q are taken off. Nothing is paired.

A correlation skips the positions where either side is NaN. Vectors are
therefore told apart by their mask (the positions they have). The few most
frequent masks of a context are taken by sums: for each of them a vector is
centred and scaled on what both have, and S is kept for each (own mask, other
mask); S of (a, b) times S of (b, a) is the sum over all pairs of a vector of
mask a and one of mask b, exactly. Vectors of other masks meet all others in
tiles, where matrix products give the correlations, and only their sums leave
the tile: rows never multiply by masks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_corr
from ..functions.matrix import codes, correlations, lists, matrix, runs, starts, unit_rows

#: The most masks of a context that are taken by sums.
FREQUENT = 8
#: The most items on either side of a tile of sums.
SUM_TILE = 2048
#: Of tiles of pairs: the rows up to which a group isn't cut, the parts of one
#: while they fit, the MB of a part's vectors, the rows that are multiplied at a time.
TILE, PARTS, PART_MB, BLOCK = 128, 8, 16, 512
#: Pairs that are put in order at a time, and the least for which files get smaller.
POOL, LEAST = 8_000_000, 1_500_000
#: Of equal vectors: the most items that are dealt as one row, and the vectors
#: whose correlations are repeated for them at a time.
COPIES, STRIPE = 64, 128
#: The most rows of a table of contexts that is broadcast.
CONTEXTS = 100_000


def _masks(x: np.ndarray) -> list[bytes]:
    """Which positions each row has, as bits without the last zeros."""
    return [b.tobytes().rstrip(b"\0") for b in np.packbits(~np.isnan(x), axis=1)]


def _types(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def _few(df: DataFrame) -> DataFrame:
    """A table of contexts, broadcast if it is small."""
    return F.broadcast(df) if df.limit(CONTEXTS + 1).count() <= CONTEXTS else df.hint("merge")


def _mask_counts(rows: DataFrame, context: list[str]) -> DataFrame:
    """context, mask, n of the distinct masks (counted in the tasks first)."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            mask = pa.array(_masks(x), pa.binary())
            code, first = codes([*[batch.column(c) for c in context], mask])
            if len(first):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in context], mask.take(pa.array(first)), pa.array(np.bincount(code))], [*context, "mask", "n"])

    found = rows.select(*context, "x").mapInArrow(run, _types(rows, context) + "mask binary, n long")
    return found.groupBy(*context, "mask").agg(F.sum("n").alias("n"))


def _mask_sums(rows: DataFrame, keys: list[str], often: DataFrame | None, context: list[str]) -> DataFrame:
    """keys, i, j, n, q, s: of the vectors of frequent mask i, centred on what
    mask j has too, their number, squared norms and sum, task by task; summed
    position by position. often: context, masks (None: one mask everywhere)."""
    plain = often is None
    met = rows if plain else rows.join(_few(often), context)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            if plain:
                code, first = codes([batch.column(c) for c in keys])
                own, known = np.zeros(len(x), np.int64), [[None]] * len(first)
            else:
                masks = _masks(x)
                known_of = [m.as_py() for m in batch.column("masks")]
                own = np.array([k.index(m) if m in k else -1 for m, k in zip(masks, known_of)], np.int64)
                code, first = codes([batch.column(c) for c in keys])
                known = [known_of[f] for f in first]
            out = []
            for c in range(len(first)):
                for i in np.unique(own[(code == c) & (own >= 0)]).tolist():
                    part = x[(code == c) & (own == i)]
                    for j, other in enumerate(known[c]):
                        valid = ~np.isnan(part)
                        if other is not None:
                            has = np.unpackbits(np.frombuffer(other, np.uint8), count=8 * len(other)).astype(bool)
                            valid &= np.pad(has, (0, max(0, valid.shape[1] - len(has))))[: valid.shape[1]]
                        u = unit_rows(part, valid)
                        out.append((first[c], i, j, len(u), float((u * u).sum()), u.sum(axis=0)))
            if out:
                at = pa.array([o[0] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(at) for k in keys], *[pa.array([o[k] for o in out], pa.int32()) for k in (1, 2)], pa.array([o[3] for o in out], pa.int64()), pa.array([o[4] for o in out]), lists(np.stack([o[5] for o in out]))],
                    [*keys, "i", "j", "n", "q", "s"],
                )

    parts = met.mapInArrow(run, _types(rows, keys) + "i int, j int, n long, q double, s array<double>")
    by = [*keys, "i", "j"]
    # a row for each task, group and pair of masks: the vectors themselves aren't shuffled
    at = parts.select(*by, "n", "q", F.posexplode("s").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"), F.sum(F.when(F.col("pos") == 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("pos") == 0, F.col("q"))).alias("q"))
    held = at.groupBy(*by).agg(F.max("n").alias("n"), F.max("q").alias("q"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return held.select(*by, "n", "q", F.transform("s", lambda p: p["v"]).alias("s"))


def _tile_sums(rows: DataFrame, rare: DataFrame, context: list[str], label: str, item: str, tile: int) -> DataFrame:
    """context, a, b, total, among: over the rare vectors of label a and all
    vectors of label b the sum of correlations, their own left out, and the part
    of it with vectors that aren't rare."""
    count = lambda df, name: df.groupBy(*context).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    sizes = _few(count(rare, "_p").join(count(rows, "_q"), context))
    place = lambda n: F.pmod(F.xxhash64(label, item, "x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*context, F.col(label).alias("label"), "x"]
    one = rare.join(sizes, context).select(*columns, place("_p").alias("p"), every("_q").alias("q"), F.lit(True).alias("side"), F.lit(True).alias("rare"))
    all_ = rows.join(sizes, context).select(*columns, every("_p").alias("p"), place("_q").alias("q"), F.lit(False).alias("side"), F.col("rare"))
    by = [*context, "p", "q"]
    tiles = one.unionByName(all_).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)

    def run(batches):
        yield from runs(batches, by, 4 * tile, body)

    def body(table):
        at = np.append(starts(table, by), table.num_rows)
        for low, high in zip(at[:-1], at[1:]):
            t = table.slice(low, high - low).combine_chunks()
            x = matrix(t.column("x"))
            side, rare = (t.column(c).to_numpy().astype(bool) for c in ("side", "rare"))
            code, first = codes([t.column("label")])
            mine, others = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(mine) or not len(others):
                continue
            total, among = np.zeros((len(first),) * 2), np.zeros((len(first),) * 2)
            hot = np.eye(len(first))[code[others]]
            for k in range(0, len(mine), 256):
                part = mine[k : k + 256]
                c = correlations(x[part], x[others])
                np.add.at(total, code[part], c @ hot)
                np.add.at(among, code[part], c @ (hot * ~rare[others][:, None]))
            a, b = np.nonzero(np.ones_like(total))
            label = t.column("label").take(pa.array(first)).combine_chunks()
            head = [pa.concat_arrays([t.column(c).combine_chunks().slice(0, 1)] * len(a)) for c in context]
            yield pa.RecordBatch.from_arrays([*head, label.take(pa.array(a)), label.take(pa.array(b)), pa.array(total[a, b]), pa.array(among[a, b])], [*context, "a", "b", "total", "among"])

    kind = rows.schema[label].dataType.simpleString()
    met = tiles.mapInArrow(run, _types(rows, context) + f"a {kind}, b {kind}, total double, among double")

    def selves(batches):
        for batch in batches:
            x = matrix(batch.column("x"))
            u = unit_rows(x, ~np.isnan(x))
            own = -(u * u).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in context], batch.column(label), batch.column(label), pa.array(own), pa.array(own * 0)], [*context, "a", "b", "total", "among"])

    own = rare.select(*context, label, "x").mapInArrow(selves, _types(rows, context) + f"a {kind}, b {kind}, total double, among double")
    return met.unionByName(own).groupBy(*context, "a", "b").agg(F.sum("total").alias("total"), F.sum("among").alias("among"))


def pair_totals(df: DataFrame, group: list[str], item: str, vector: str, context: list[str] | None = None, frequent: int = FREQUENT, tile: int = SUM_TILE) -> DataFrame:
    """context, label, other_label, n, m, total: for any two labels of a context
    (also a label with itself) how many vectors they have, and the sum of
    correlations over all ordered pairs, a vector's own left out. The group's
    last column is the label; context: the columns before it, if not given.

    The masks are counted first: without lost values there is one, and sums are
    all there is to make.
    """
    label = group[-1]
    context = group[:-1] if context is None else context
    fixed = not context
    rows = df.select(*group, item, F.transform(vector, lambda v: v.cast("double")).alias("x"))
    if fixed:
        context, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    keys = [*context, label]
    masks = _mask_counts(rows, context)
    many = masks.groupBy(*context).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if many <= 1:
        often = None
    else:
        place = F.row_number().over(Window.partitionBy(*context).orderBy(F.desc("n"), "mask"))
        often = masks.withColumn("_place", place).filter(F.col("_place") <= frequent).groupBy(*context).agg(F.collect_list("mask").alias("masks"))
    sums = _mask_sums(rows, keys, often, context)
    turned = sums.select(*context, F.col(label).alias("other_label"), F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"))
    own = F.when((F.col(label) == F.col("other_label")) & (F.col("i") == F.col("j")), F.col("q")).otherwise(0.0)
    total = sums.join(turned, [*context, "i", "j"]).groupBy(*context, label, "other_label").agg(F.sum(_dot("s", "t") - own).alias("total"))
    if many > frequent:
        def told(batches):
            for batch in batches:
                known = [m.as_py() for m in batch.column("masks")]
                rare = [m not in k for m, k in zip(_masks(matrix(batch.column("x"))), known)]
                names = [*keys, item, "x"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rare)], [*names, "rare"])

        seen = rows.join(_few(often), context).mapInArrow(told, _types(rows, [*keys, item]) + "x array<double>, rare boolean")
        tiles = _tile_sums(seen, seen.filter("rare"), context, label, item, tile)
        across = tiles.select(*context, F.col("b").alias(label), F.col("a").alias("other_label"), F.col("among").alias("total"))
        parts = total.unionByName(tiles.select(*context, F.col("a").alias(label), F.col("b").alias("other_label"), "total")).unionByName(across)
        total = parts.groupBy(*context, label, "other_label").agg(F.sum("total").alias("total"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    other = counts.select(*context, F.col(label).alias("other_label"), F.col("n").alias("m"))
    out = counts.join(other, context).join(total, [*context, label, "other_label"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.select(*([] if fixed else context), label, "other_label", "n", "m", "total")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def within(totals: DataFrame, group: list[str]) -> DataFrame:
    """group, n, within: mean over pairs, null with fewer than two items."""
    same = totals.filter(F.col(group[-1]).eqNullSafe(F.col("other_label")))
    return same.select(*group, "n", F.when(F.col("n") >= 2, F.col("total") / (F.col("n") * (F.col("n") - 1))).alias("within"))


def between(totals: DataFrame, context: list[str], label: str) -> DataFrame:
    """context, label, other_label, similarity: mean over cross pairs."""
    return totals.filter(F.col(label) != F.col("other_label")).select(*context, label, "other_label", (F.col("total") / (F.col("n") * F.col("m"))).alias("similarity"))


def control_margin(within_: DataFrame, between_: DataFrame, context: list[str], label: str) -> DataFrame:
    """within, mean over the other labels, the strongest of them (of equal ones
    the first by name), and margin."""
    rest = between_.groupBy(*context, label).agg(
        F.avg("similarity").alias("rest"), F.max("similarity").alias("strongest"),
        F.min_by("other_label", F.struct(-F.col("similarity"), F.col("other_label"))).alias("strongest_label"), F.count("*").alias("n_controls"),
    )
    return within_.join(rest, [*context, label], "left").withColumn("margin", F.col("within") - F.col("rest"))


def _copies(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, x, _ids: the items of equal vectors as sorted lists of COPIES at most."""
    place = F.row_number().over(Window.partitionBy(*group, "x").orderBy("_i"))
    dealt = rows.withColumn("_bundle", F.floor((place - 1) / COPIES))
    items = F.sort_array(F.collect_list(F.struct("_i")))  # of structs: a list of items would lose null
    return dealt.groupBy(*group, "x", "_bundle").agg(items.alias("_ids")).select(*group, "x", F.transform("_ids", lambda s: s["_i"]).alias("_ids"))


def pairwise(df: DataFrame, group: list[str], item: str, vector: str, tile: int = TILE, ordered: bool = False, both: bool = False, digits: int | None = None) -> DataFrame:
    """group, a, b, similarity of all pairs a < b of a group, with NaN-aware
    correlation. The result grows with the square of a group, what is shuffled
    doesn't: a group is cut into parts, PARTS at most while one has no more than
    PART_MB, and each two parts are a tile, products of matrices in one task,
    however the table came. Items of equal vectors are dealt together and multiplied
    once. tile: the rows up to which a group isn't cut. both: also all pairs b, a.
    digits: similarities are rounded (half up) to so many, before pairs are made.
    ordered: columnar files get smaller, as a task's pairs come by similarity, POOL
    of them at a time (rounded to a few digits, equal ones then lie together). Pairs
    of blocks with many equal vectors come item by item in any case: there the same
    values and items repeat within a few rows."""
    rows = df.select(*group, F.col(item).alias("_i"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    most = F.greatest(F.lit(BLOCK), F.floor(F.lit(PART_MB * 125_000) / F.greatest(F.lit(1), F.max(F.size("x")))))
    parts = F.greatest(F.least(F.lit(PARTS), F.ceil(F.count("*") / tile)), F.ceil(F.count("*") / most)).cast("int")
    tiles = rows.groupBy(*group).agg(parts.alias("_tiles"))
    dealt = _copies(rows, group)
    dealt = dealt.join(_few(tiles), group) if group else dealt.withColumn("_tiles", F.lit(tiles.first()[0]))
    dealt = dealt.withColumn("_at", F.pmod(F.xxhash64(F.col("_ids")[0]), F.col("_tiles")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    by = [*group, "_p", "_q"]
    dealt = dealt.select(*group, F.least("_at", "_o").alias("_p"), F.greatest("_at", "_o").alias("_q"), "_at", "_ids", "x")
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, "_ids")

    def run(batches):
        held, size = [], 0
        for repeats, *part in runs(batches, by, 4 * BLOCK, products):
            if repeats:
                yield from made([part], True)
                continue
            held.append(part)
            size += len(part[-1])
            if size >= (POOL if ordered else 1):
                yield from made(held, False)
                held, size = [], 0
        if size:
            yield from made(held, False)

    def products(table):
        at = np.append(starts(table, by), table.num_rows)
        for low, high in zip(at[:-1], at[1:]):
            t = table.slice(low, high - low).combine_chunks()
            x, side, first = matrix(t.column("x")), t.column("_at").to_numpy(), t.column("_p")[0].as_py()
            ids = t.column("_ids").combine_chunks()
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            begin, owner = np.cumsum(sizes) - sizes, pa.array(np.repeat(np.arange(len(sizes)), sizes))
            names = pa.table([*[t.column(g).take(owner) for g in group], ids.flatten()], [*group, "_i"])
            place = pc.rank(names.column("_i"), null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)  # equal items are no pair
            one = np.flatnonzero(side == first)
            cross = t.column("_q")[0].as_py() != first
            two = np.flatnonzero(side != first) if cross else one
            for k in range(0, len(one), BLOCK):
                for m in range(0 if cross else k, len(two), BLOCK):
                    i, j = one[k : k + BLOCK], two[m : m + BLOCK]
                    c = correlations(x[i], x[j])
                    if digits is not None:
                        c = np.sign(c) * np.floor(np.abs(c) * 10.0**digits + 0.5) / 10.0**digits + 0.0  # no -0
                    turned = cross or m > k  # else each two items meet both ways round
                    repeats = int(sizes[i].sum()) * int(sizes[j].sum()) >= 2 * len(i) * len(j)
                    for lines, u, columns, v in (repeated if repeats else plain)(begin, sizes, i, j):
                        r, of, to = c[u[:, None], v[None, :]], place[lines][:, None], place[columns][None, :]
                        chosen = [of != to] * 2 if both and repeats else [of < to, of > to]
                        for flipped in (False, True)[: 1 + turned]:
                            a, b = np.nonzero(chosen[flipped])
                            if len(a):
                                ends = lines[a].astype(np.int32), columns[b].astype(np.int32)
                                yield repeats, names, *(ends[::-1] if flipped else ends), r[a, b]

    def plain(begin, sizes, i, j):
        (lines, u, _), (columns, v, _) = spread(begin, sizes, i), spread(begin, sizes, j)
        yield lines, u, columns, v

    def repeated(begin, sizes, i, j):
        lines, u, _ = spread(begin, sizes, i)
        for k in range(0, len(j), STRIPE):
            columns, v, copy = spread(begin, sizes, j[k : k + STRIPE])
            order = np.argsort(copy, kind="stable")
            columns, v = columns[order], v[order] + k
            step = max(1, BLOCK * BLOCK // len(columns))
            for m in range(0, len(lines), step):
                yield lines[m : m + step], u[m : m + step], columns, v

    def spread(begin, sizes, of):
        """The items of some vectors, the number of each one's vector among these, and its own among the equal."""
        n = sizes[of]
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(begin[of], n) + copy, np.repeat(np.arange(len(of)), n), copy

    def made(held, repeats):
        tables, a, b, first = [], [], [], 0
        for names, i, j, _ in held:
            if not tables or names is not tables[-1]:
                first += tables[-1].num_rows if tables else 0
                tables.append(names)
            a.append(i + np.int32(first))
            b.append(j + np.int32(first))
        names = pa.concat_tables(tables).combine_chunks()
        a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate([part[-1] for part in held])
        held.clear()  # not in memory twice
        order = np.argsort(c) if ordered and not repeats and len(c) >= LEAST else np.arange(len(c))
        keys, items = [names.column(k).combine_chunks() for k in group], names.column("_i").combine_chunks()
        for k in range(0, len(c), BLOCK * BLOCK):
            at = order[k : k + BLOCK * BLOCK]
            a_, b_, c_ = a[at], b[at], c[at]
            if both and not repeats:
                a_, b_, c_ = np.stack([a_, b_], 1).ravel(), np.stack([b_, a_], 1).ravel(), np.repeat(c_, 2)
            a_, b_ = pa.array(a_), pa.array(b_)
            yield pa.RecordBatch.from_arrays([*[key.take(a_) for key in keys], items.take(a_), items.take(b_), pa.array(c_)], [*group, "a", "b", "similarity"])

    kind = rows.schema["_i"].dataType.simpleString()
    return dealt.mapInArrow(run, _types(rows, group) + f"a {kind}, b {kind}, similarity double")


def similarity_matrix(pairs: DataFrame, items: DataFrame, group: list[str], item: str, both: bool = False) -> DataFrame:
    """Both triangles and the unit diagonal, as rows. both: the pairs have both triangles."""
    turned = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    diagonal = items.select(*group, F.col(item).alias("a"), F.col(item).alias("b"), F.lit(1.0).alias("similarity")).distinct()
    made = pairs if both else pairs.select(*group, F.inline(turned), "similarity")
    return made.unionByName(diagonal.select(*group, "a", "b", "similarity"), allowMissingColumns=False)


def centroids(df: DataFrame, group: list[str], vector: str, at: str = "pos", weight: Column | None = None) -> DataFrame:
    """group, centroid: position-wise means that skip NaN."""
    long = df.select(*group, F.posexplode(vector).alias("pos", "v"))
    value = F.when(~F.isnan("v"), F.col("v").cast("double"))
    means = long.groupBy(*group, "pos").agg(F.avg(value).alias("v"))
    return means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c")).select(*group, F.transform("c", lambda p: p["v"]).alias("centroid"))


def consistency(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """group, consistency: mean correlation with the group's centroid."""
    met = df.join(centroids(df, group, vector), group)
    return met.groupBy(*group).agg(F.avg(safe_corr(vector, "centroid")).alias("consistency"))


def exemplars(df: DataFrame, group: list[str], subject: str, order: str, similarity: str, most: int) -> DataFrame:
    """``df`` with rank: the best item of every subject first (subjects in
    order), then all others by similarity, ``most`` in each group."""
    best = Window.partitionBy(*group, subject).orderBy(F.col(similarity).desc(), F.col(order))
    first = df.withColumn("_best", F.row_number().over(best) == 1)
    place = Window.partitionBy(*group).orderBy(
        F.col("_best").desc(), F.when(F.col("_best"), F.col(subject)), F.when(~F.col("_best"), F.col(similarity)).desc(), F.col(order)
    )
    return first.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most).drop("_best")
