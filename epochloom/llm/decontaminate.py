"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Test items are normalised to words, every window of ``width`` consecutive
words (or the whole of a shorter item) becomes a key of one automaton over
word numbers, and each text is scanned once. Word positions map back to
offsets in the original text.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encode, materialise, only, read, sha, shared_dir, slices

#: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; all
#: else is a gap. The same words as the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
WIDTH = 13
#: The most bytes of test items in one automaton (some 500 bytes of memory for each byte).
BLOCK_BYTES = 2 << 20
#: Longer items are cut into pieces of as many bytes, a window's words over the edge.
PIECE_BYTES = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return encode(text or "").translate(_TABLE).split()


class WindowIndex:
    """The automaton of all windows, with the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.numbers: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                holders[tuple(ids[i : i + width])].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in holders.items():
            self.automaton.add_word(key, (len(key), frozenset(found)))
        if holders:
            self.automaton.make_automaton()
        self.least = min(map(len, holders), default=0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged hit ranges of words, items that occur."""
        words = words_of(text)
        if not self.least or len(words) < self.least:
            return len(words), [], set()
        number = self.numbers.get
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for last, (size, holders) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            items |= holders
            start, end = last - size + 1, last + 1
            while ranges and start <= ranges[-1][1]:  # a longer window may reach back over several
                s, e = ranges.pop()
                start, end = min(s, start), max(e, end)
            ranges.append((start, end))
        return len(words), ranges, items

    @staticmethod
    def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Code-point offsets of word ranges in the original text."""
        if not ranges:
            return []
        at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        return [(at[s][0], at[e - 1][1]) for s, e in ranges]


_INDEX: dict[tuple, WindowIndex] = {}


def _index_of(shared, tag: str, width: int) -> WindowIndex:
    """The automaton of a block of items, kept by the worker for its next tasks."""
    if (tag, width) not in _INDEX:
        _INDEX.clear()  # one at a time
        _INDEX[tag, width] = WindowIndex(shared.value, width)
    return _INDEX[tag, width]


def item_pieces(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, most: int = PIECE_BYTES) -> DataFrame:
    """id, text: the words of each item, long items in overlapping pieces that
    have the same windows; equal rows are one. Items without an id or without
    words give none."""
    src = only(items, id_col, text_col).filter(F.col(f"`{id_col}`").isNotNull())

    def run(batches):
        for batch in slices(batches):
            ids, texts = [], []
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(cell.as_py())
                start = size = 0
                for at, word in enumerate(words):
                    size += len(word) + 1
                    if size >= most and at - start >= width or at == len(words) - 1:
                        ids.append(i)
                        texts.append(b" ".join(words[start : at + 1]).decode("utf-8", "surrogatepass"))
                        start, size = at - width + 2, sum(map(len, words[max(0, at - width + 2) : at + 1])) + width
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(texts, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {src.schema[0].dataType.simpleString()}, text string").distinct()


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, most: int = BLOCK_BYTES):
    """The items in blocks of about ``most`` bytes, one block after another on
    the driver: lists of (id, text). What fits is one block; else the pieces
    come partition by partition and are cut as they come, a piece that is larger
    by itself (a window of very long words) being a block of its own."""
    found = item_pieces(items, id_col, text_col, width, min(PIECE_BYTES, most // 4))
    size = F.octet_length("text") + 16
    total = found.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if total <= most:
        yield [(r[0], r[1]) for r in found.collect()]
        return
    found = materialise(found.repartition(-(-total // most)), "benchmark-pieces")
    block, held = [], 0
    for r in found.toLocalIterator():
        mine = len(encode(r[1])) + 16
        if block and held + mine > most:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += mine
    yield block


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 5, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, ``keep`` columns, n_words, n_hit, item_ids (sorted as strings),
    hits (offsets of hit ranges), contaminated: one row per row of ``docs``.

    No shuffle; the automaton goes to the executors with the task. Items of
    more than ``block_bytes`` are several automata, one at a time: the rows are
    written once, numbered, every pass reads them and writes what it found of
    the rows with hits alone, and these are joined in the end.
    Null texts have no words; null items give no window, null item ids are no
    items; repeated items count once; an empty table on either side gives no
    hit.
    """
    spark = docs.sparkSession
    rest = [c for c in keep if c != text_col]
    src = only(docs, id_col, text_col, *rest)
    names = src.columns
    held = [name for name in names if name != text_col or text_col in keep]
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in held) + ", n_words long, n_hit long, item_ids array<string>, hits array<struct<s:int,e:int>>, contaminated boolean"

    def judged(batch, rows):
        """Output rows from (text, number of words, merged ranges, items)."""
        n, hit = [r[1] for r in rows], [sum(e - s for s, e in r[2]) for r in rows]
        at = [[{"s": s, "e": e} for s, e in WindowIndex.offsets(r[0], r[2])] for r in rows]
        bad = [h > 0 and 100 * h >= percent * k for h, k in zip(hit, n)]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in held], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(r[3]) for r in rows], pa.list_(pa.string())), pa.array(at, _SPANS), pa.array(bad, pa.bool_())],
            [*held, "n_words", "n_hit", "item_ids", "hits", "contaminated"],
        )

    def whole(shared, tag):
        def run(batches):
            index = _index_of(shared, tag, width)
            for batch in slices(batches):
                texts = [t.as_py() or "" for t in batch.column(text_col)]
                rows = [(t, *index.scan(t)) for t in texts]
                yield judged(batch, [(t, n, ranges, set(map(str, found))) for t, n, ranges, found in rows])

        return run

    def one_pass(shared, tag):
        """_row, _ranges, _items of the rows that a block of items hits."""

        def run(batches):
            index = _index_of(shared, tag, width)
            for batch in slices(batches):
                found = [(row.as_py(), *index.scan(t.as_py())[1:]) for row, t in zip(batch.column(0), batch.column(1))]
                found = [f for f in found if f[1]]
                ranges = pa.array([[{"s": s, "e": e} for s, e in f[1]] for f in found], _SPANS)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), ranges, pa.array([sorted(map(str, f[2])) for f in found], pa.list_(pa.string()))], ["_row", "_ranges", "_items"])

        return run

    def joined(batches):
        for batch in slices(batches):
            rows = []
            for t, ranges, found in zip(batch.column(text_col), batch.column("_ranges"), batch.column("_items")):
                text = t.as_py() or ""
                rows.append((text, len(words_of(text)), _merged([(r["s"], r["e"]) for r in ranges.as_py() or []]), set(found.as_py() or [])))
            yield judged(batch, rows)

    blocks = item_blocks(items, width=width, most=block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return src.mapInArrow(whole(spark.sparkContext.broadcast(first), sha(repr(first))), schema)
    rows = materialise(src.withColumn("_row", F.monotonically_increasing_id()), "benchmark-rows")
    folder = f"{shared_dir(spark)}/benchmark-hits-{uuid.uuid4().hex}"
    found = "_row long, _ranges array<struct<s:int,e:int>>, _items array<string>"
    for k, block in enumerate(itertools.chain([first, second], blocks)):
        shared = spark.sparkContext.broadcast(block)
        rows.select("_row", text_col).mapInArrow(one_pass(shared, sha(repr(block))), found).write.parquet(f"{folder}/pass={k}")
        shared.destroy()
    hits = spark.read.schema(found).parquet(folder).groupBy("_row").agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.flatten(F.collect_list("_items")).alias("_items"))
    return rows.join(hits.hint("merge"), "_row", "left").mapInArrow(joined, schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of a documents table that aren't contaminated. Null and empty
    texts have no words and stay, as do null ids and repeated rows; an empty
    table gives an empty one."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return decontaminate(docs, items, keep=tuple(columns[1:])).filter("NOT contaminated").select(*columns)
