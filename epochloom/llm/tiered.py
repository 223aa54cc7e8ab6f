"""Ranked lexical search over a tiered index.

Every document's occurrences of a term have an impact (term frequency against
the document's length). The index is one row for each document with its
impacts in three columns: the highest of each term, the next, and the rest, cut
so that a column holds at most so many postings of a term. A search reads the
first column alone (Parquet leaves the others on disk), sums what it finds, and
knows for each term the largest impact left below: its residual bound. If an
item's k-th best sum is above what a document without any posting read so far
could still reach, no unread document can enter, and only the documents whose
own bound reaches the k-th sum are completed from the lower columns. Items
without that proof fall through to the next column; the last leaves nothing
unread.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, only, read, slices
from .decontaminate import words_of

K = 20
#: The most postings of a term in the first tier, and in the first two.
TIERS = (2_000, 20_000)
#: Impacts are below a million; tiers are cut between so many equal steps.
STEPS = 64
STEP = 1_000_000 // STEPS + 1
#: The most bytes of items that are searched at once; more are several passes.
BLOCK_BYTES = 4 << 20
#: The most candidate rows that are broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 75 + (25 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Terms:
    """What a worker needs of a block of items: for each term the items that
    hold it (positions start[t]:start[t + 1] of item) and occurrences times
    weight there; tier cuts and residual bounds, one row for each tier."""

    start: np.ndarray
    item: np.ndarray
    gain: np.ndarray
    cuts: np.ndarray
    residual: np.ndarray
    n_items: int

    def only(self, chosen: np.ndarray) -> Terms:
        """The same with nothing but the chosen items."""
        keep = chosen[self.item]
        start = np.concatenate(([0], np.cumsum(keep)))[self.start]
        return Terms(start, self.item[keep], self.gain[keep], self.cuts, self.residual, self.n_items)

    def rest(self, tier: int) -> np.ndarray:
        """For each item what unread tiers can add at most."""
        term = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.item, self.gain * self.residual[tier][term])
        return out


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_parent_indices().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def sums(batch, tiers: int, terms: Terms, seen: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores of the first ``tiers`` tiers, documents by items, and if asked
    for the residual bounds of the terms that were seen."""
    out = np.zeros(batch.num_rows * terms.n_items, np.int64)
    bound = np.zeros_like(out) if seen else None
    for k in range(tiers):
        doc, term = _flat(batch.column(f"t{k}"))
        impact = _flat(batch.column(f"i{k}"))[1].astype(np.int64)
        for at in range(0, len(term), 1 << 16):  # very long documents
            d, t, i = doc[at : at + (1 << 16)], term[at : at + (1 << 16)], impact[at : at + (1 << 16)]
            many = terms.start[t + 1] - terms.start[t]
            which = np.repeat(np.arange(len(t)), many)
            pos = np.arange(len(which)) + np.repeat(terms.start[t] - (np.cumsum(many) - many), many)
            cell = d[which].astype(np.int64) * terms.n_items + terms.item[pos]
            np.add.at(out, cell, terms.gain[pos] * i[which])
            if seen:
                np.add.at(bound, cell, terms.gain[pos] * terms.residual[tiers - 1][t[which]])
    shape = (batch.num_rows, terms.n_items)
    return out.reshape(shape), bound.reshape(shape) if seen else None


def _columns(tiers: int) -> list[str]:
    return [f"{c}{k}" for k in range(tiers) for c in "ti"]


def _best(index: DataFrame, tiers: int, shared, least: np.ndarray, k: int) -> DataFrame:
    """item, row, id, score: of each task the k best of each item (by score,
    then id) that reach ``least``."""
    rows = index.select("row", "id", *_columns(tiers))
    kind = rows.schema["id"].dataType.simpleString()
    order = [("item", "ascending"), ("score", "descending"), ("id", "ascending"), ("row", "ascending")]

    def run(batches):
        terms, floor, pool = shared.value, np.maximum(least, 1), None
        for batch in slices(batches):
            total, _ = sums(batch, tiers, terms)
            at, item = np.nonzero(total >= floor)
            if not len(at):
                continue
            new = pa.table({"item": pa.array(item.astype(np.int32)), "row": batch.column(0).take(pa.array(at)), "id": batch.column(1).take(pa.array(at)), "score": pa.array(total[at, item])})
            pool = new if pool is None else pa.concat_tables([pool, new])
            if pool.num_rows > 4 * k * terms.n_items:
                pool, floor = cut(pool, floor)
        if pool is not None:
            yield from cut(pool, floor)[0].to_batches()

    def cut(pool, floor):
        pool = pool.take(pc.sort_indices(pool, order, null_placement="at_end")).combine_chunks()
        item = pool.column("item").to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        floor = floor.copy()
        last = place == k - 1
        floor[item[last]] = np.maximum(floor[item[last]], pool.column("score").to_numpy()[last])
        return pool.filter(pa.array(place < k)), floor

    return rows.mapInArrow(run, f"item int, row long, id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item: first within slices of the rows, so that no
    task sorts what all tasks sent for an item."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    part = found.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def _candidates(index: DataFrame, tiers: int, shared, least: np.ndarray, rest: np.ndarray) -> DataFrame:
    """row: documents with a posting in the first tiers whose sum, with all
    that unread postings could add, reaches ``least`` for some item."""

    def run(batches):
        for batch in slices(batches):
            total, bound = sums(batch, tiers, shared.value, seen=True)
            hit = ((total > 0) & (total + rest - bound >= least)).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], ["row"])

    return index.select("row", "id", *_columns(tiers)).mapInArrow(run, "row long")


def term_rows(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """row, id, n (terms with repeats), t, f: the terms of the vocabulary in
    every document and their frequencies."""
    src = only(docs, id_col, text_col)
    lists = pa.list_(pa.int32())

    def run(batches):
        get = vocabulary.value.get
        for batch in slices(batches):
            n, t, f = [], [], []
            for cell in batch.column(1):
                words = words_of(cell.as_py())
                found = Counter([v for w in words if (v := get(w)) is not None])
                n.append(len(words))
                t.append(list(found))
                f.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(t, lists), pa.array(f, lists)], ["id", "n", "t", "f"])

    rows = src.mapInArrow(run, f"id {src.schema[0].dataType.simpleString()}, n long, t array<int>, f array<int>")
    return rows.withColumn("row", F.monotonically_increasing_id())  # kept, as the table is written


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """Lists of (item id, text) of about ``most`` bytes, one after another."""
    src = only(items, id_col, text_col).toDF("id", "text").filter("text IS NOT NULL").distinct()
    total = src.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // most))
    for k in range(n):
        yield [(r["id"], r["text"]) for r in src.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()]


@dataclass
class Index:
    rows: DataFrame
    terms: Terms


def build_index(docs: DataFrame, bags: list[Counter], id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, int] = TIERS) -> Index:
    """The tiered index of all documents for the terms of the given bags of
    words. Counts, frequencies and residuals cover every document."""
    context = docs.sparkSession.sparkContext
    names = sorted(set().union(*bags))
    numbers = {w: i for i, w in enumerate(names)}
    found = materialise(term_rows(docs, context.broadcast(numbers), id_col, text_col), "terms")
    sizes = found.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sizes["docs"], sizes["terms"] or 0
    posting = found.select("n", F.explode(F.arrays_zip("t", "f")).alias("p")).select(F.col("p.t").alias("t"), F.col("p.f").cast("long").alias("f"), "n")
    m = f"(75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L)"
    steps = posting.withColumn("impact", F.expr(f"(1000000000L * f) div (1000L * f + 12L * {m})")).groupBy("t", F.expr(f"impact div {STEP}").cast("int").alias("step")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    so_far = F.sum("n").over(Window.partitionBy("t").orderBy(F.desc("step")))  # STEPS rows at most for a term
    steps = steps.withColumn("so_far", so_far)
    cuts = [F.min(F.when(F.col("so_far") <= q, F.col("step"))).alias(f"c{k}") for k, q in enumerate(tiers)]
    rest = [F.max(F.when(F.col("so_far") > q, F.col("top"))).alias(f"r{k}") for k, q in enumerate(tiers)]
    size = len(names)
    df = np.zeros(size, np.int64)
    cut = np.full((len(tiers) + 1, size), STEPS + 1, np.int64)
    cut[-1] = 0
    residual = np.zeros((len(tiers) + 1, size), np.int64)
    for r in steps.groupBy("t").agg(F.sum("n").alias("df"), *cuts, *rest).collect():  # one row for each term of the items
        df[r["t"]] = r["df"]
        for k in range(len(tiers)):
            cut[k, r["t"]] = STEPS + 1 if r[f"c{k}"] is None else r[f"c{k}"]
            residual[k, r["t"]] = r[f"r{k}"] or 0
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    entries = sorted((numbers[w], item, q) for item, bag in enumerate(bags) for w, q in bag.items())
    term, item, times = (np.array([e[k] for e in entries], np.int64) for k in range(3))
    start = np.searchsorted(term, np.arange(size + 1))
    terms = Terms(start, item, times * weights[term] if len(term) else times, cut, residual, len(bags))
    shared = context.broadcast((cut, weights > 0))
    lists = pa.list_(pa.int32())
    n_tiers = len(tiers) + 1

    def run(batches):
        cut, useful = shared.value
        for batch in slices(batches):
            doc, t = _flat(batch.column("t"))
            f = _flat(batch.column("f"))[1].astype(np.int64)
            value = impacts(f, batch.column("n").to_numpy()[doc], n_docs, n_terms)
            step = value // STEP
            tier = sum((step < cut[k][t]).astype(int) for k in range(n_tiers - 1)) if len(t) else np.zeros(0, int)
            columns = [batch.column("row"), batch.column("id")]
            for k in range(n_tiers):
                mine = useful[t] & (tier == k)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[mine], minlength=batch.num_rows)))).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x[mine].astype(np.int32)), type=lists) for x in (t, value)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", *_columns(n_tiers)])

    kind = found.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, " + ", ".join(f"{c} array<int>" for c in _columns(n_tiers))
    return Index(materialise(found.filter(F.size("t") > 0).select("row", "id", "n", "t", "f").mapInArrow(run, schema), "tiered-index"), terms)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", tiers: tuple[int, int] = TIERS, block_bytes: int = BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS, proofs: list | None = None) -> DataFrame:
    """item id, rank, id, score: each item's k best documents of a score above 0.

    Null and empty texts have no terms: such documents rank nowhere and count
    nowhere, such items give no row. Rows of ``docs`` with equal ids are
    documents of their own; null ids come last among equal scores. Equal items
    (id and text) count once; an item whose id is null keeps it. Empty tables
    give no row; other columns aren't read. proofs: for each block, how many
    items were proven by each tier is added to it.
    """
    spark = docs.sparkSession
    doc_type = docs.schema[id_col].dataType
    item_type = items.schema[item_col].dataType
    out = None
    for block in item_blocks(items, item_col, text_col, block_bytes):
        held = [(i, bag) for i, bag in ((i, Counter(words_of(t))) for i, t in block) if bag]
        if not held:
            continue
        index = build_index(docs, [bag for _, bag in held], id_col, text_col, tiers)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(held)], f"item int, {item_col} {item_type.simpleString()}")
        ranked = _search(spark, index, k, broadcast_rows, proofs)
        ranked = ranked.join(F.broadcast(names), "item").select(item_col, F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {item_type.simpleString()}, rank int, {id_col} {doc_type.simpleString()}, score long")
    return out


def _search(spark: SparkSession, index: Index, k: int, broadcast_rows: int, proofs: list | None) -> DataFrame:
    n_items, last = index.terms.n_items, len(index.terms.residual)
    left = np.ones(n_items, bool)
    least = np.zeros(n_items, np.int64)
    parts, counts = [], []
    for tiers in range(1, last + 1):
        terms = index.terms.only(left)
        shared = spark.sparkContext.broadcast(terms)
        some = index.rows if tiers == last else index.rows.filter(" OR ".join(f"size(t{i}) > 0" for i in range(tiers)))
        best = _ranked(_best(some, tiers, shared, least, k), k)
        if tiers == last:
            parts.append(best)
            counts.append(int(left.sum()))
            break
        for r in best.filter(F.col("rank") == k).select("item", "score").collect():  # a row for each item
            least[r["item"]] = max(least[r["item"]], r["score"])
        rest = terms.rest(tiers - 1)
        proven = left & (least > rest)
        counts.append(int(proven.sum()))
        if proven.any():
            mine = spark.sparkContext.broadcast(index.terms.only(proven))
            never = np.iinfo(np.int64).max
            rows = materialise(_candidates(some, tiers, mine, np.where(proven, least, never), np.where(proven, rest, 0)), "candidates")
            few = rows.count() <= broadcast_rows
            whole = index.rows.join(F.broadcast(rows) if few else rows.hint("merge"), "row", "left_semi")
            parts.append(_ranked(_best(whole, last, mine, np.where(proven, least, 0), k), k))
            left &= ~proven
        if not left.any():
            break
    if proofs is not None:
        proofs.append(counts)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
