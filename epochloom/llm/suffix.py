"""Exact substring dedup with a distributed difference-cover suffix sort.

A string of ``width`` bytes is dealt to a task by its minimiser: the smallest
hash among its ``GRAM``-byte substrings. Equal strings have equal minimisers,
so a suffix sort of what a task holds brings all of them together. Stretches of
a text whose strings share a minimiser travel as one piece.

1. Texts are cut into segments at places that their bytes decide. Equal
   segments (each with the bytes that its last strings run on into) have equal
   strings; one with the smallest id stands for all, and the others, being
   copies of an earlier document's bytes, are removed without further work.
2. Minimisers of the segments left are sent, packed, to tasks by hash; those
   that occur under one id alone can't be in a repeat and are let go.
3. Of the stretches left, equal ones are reduced to one with the smallest id
   (before the shuffle, so that a much repeated text is no hot spot).
4. Each task sorts the suffixes of its stretches by a difference cover modulo
   three: sampled triples are sorted and named, the names are sorted the same
   way until they cover ``width`` bytes, the remaining suffixes are merged in,
   and neighbours are compared on ``width`` bytes. A run of equal prefixes gets
   the smallest id in it.
5. Stretches look up these ids; bytes of strings that also start in a document
   with a smaller id are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, only, partitions, read

WIDTH = 50
GRAM = 20
#: Numbers from here on stand for null ids inside the operator; ids are smaller.
NULL_IDS = 2**62
#: A segment begins where the low bits of a hash are 0: every 128 bytes or so.
CUT_MASK = np.uint64(127)
#: Owners of a minimiser from which on its stretches are spread over tasks before they are sorted.
HOT_OWNERS = 50_000
#: Text that one task of an exchange holds at most, on average.
TASK_BYTES = 64 << 20
#: Bytes of text worked on at once; longer texts are taken in overlapping parts.
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


# -- minimisers


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position (shorter by gram - 1)."""
    powers: dict[int, tuple[np.ndarray, np.uint64]] = {1: (data.astype(np.uint64) + np.uint64(1), _BASE)}
    size = 1
    with np.errstate(over="ignore"):
        while size * 2 <= gram:
            h, b = powers[size]
            powers[size * 2] = (h[:-size] * b + h[size:], b * b)
            size *= 2
        out, have = powers[size][0], size
        for part in sorted((p for p in powers if p < size), reverse=True):
            if have + part <= gram:
                h, b = powers[part]
                out = out[: len(out) - part] * b + h[have : have + len(out) - part]
                have += part
        out = out ^ (out >> np.uint64(32))
        out = out * _MIX
        out ^= out >> np.uint64(29)
    return out


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of ``span`` values from each position on."""
    size = 1
    while size * 2 <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = span - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Part:
    """Some texts of a batch in one array: ``data[bounds[i]:bounds[i + 1]]`` is
    (from offset ``at`` on) the text of row ``first + i``."""

    def __init__(self, first: int, held: list[bytes], at: int):
        self.first, self.at = first, at
        self.raw = b"".join(held)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in held])))
        self.hashes = gram_hashes(self.data) if len(self.data) >= GRAM else np.empty(0, np.uint64)

    def _inside(self, n: int, size: int) -> np.ndarray:
        """Positions whose ``size`` bytes stay inside one text."""
        out = np.ones(n, bool)
        for b in self.bounds[1:].tolist():
            out[max(0, b - size + 1) : b] = False
        return out

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first byte, end of the positions where strings start, end of
        the last string) of every segment that has a string."""
        starts = np.zeros(len(self.data) + 1, bool)
        n = len(self.hashes)
        starts[:n] = ((self.hashes & CUT_MASK) == 0) & self._inside(n, GRAM)
        starts[self.bounds] = True
        begin = np.flatnonzero(starts)
        begin, stop = begin[:-1], begin[1:]
        row = np.searchsorted(self.bounds, begin, side="right") - 1
        text_end = self.bounds[row + 1]
        last = np.minimum(stop, text_end - WIDTH + 1)
        good = last > begin
        return row[good], begin[good], last[good], np.minimum(stop + WIDTH - 1, text_end)[good]

    def stretches(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first byte, number of strings, minimiser) of every stretch of
        strings with one minimiser inside one text. wanted: positions where
        strings count."""
        n = len(self.data) - WIDTH + 1
        if n <= 0:
            return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
        least = sliding_min(self.hashes, WIDTH - GRAM + 1)
        valid = self._inside(n, WIDTH)
        if wanted is not None:
            valid &= wanted[:n]
        breaks = np.zeros(n + 1, bool)
        breaks[self.bounds[self.bounds <= n]] = True
        breaks[1:n] |= (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(breaks[:n])
        size = np.diff(np.append(start, n))
        good = valid[start]
        start, size = start[good], size[good]
        return np.searchsorted(self.bounds, start, side="right") - 1, start, size, least[start]


def parts_of(texts: list[bytes]):
    """Parts of about CHUNK bytes; texts longer than that come in parts that
    overlap by WIDTH - 1 bytes, so that each string is in one part."""
    row, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            if held:
                yield Part(row, held, 0)
            for at in range(0, len(t) - WIDTH + 1, CHUNK):
                yield Part(i, [t[at : at + CHUNK + WIDTH - 1]], at)
            row, held, size = i + 1, [], 0
            continue
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield Part(row, held, 0)
            row, held, size = i + 1, [], 0
    if held:
        yield Part(row, held, 0)


# -- suffix sort by a difference cover


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the rows of columns, equal for equal rows; and their number."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(rank.max(initial=-1)) + 1


def suffix_ranks(s: np.ndarray, need: int) -> np.ndarray:
    """Ranks of all suffixes of ``s`` (positive numbers) such that suffixes
    that differ within ``need`` symbols are in their order; others may tie."""
    n = len(s)
    if n < 8:
        padded = np.concatenate((s, np.zeros(n + 3, s.dtype)))
        return _names(*(padded[k : k + n] for k in range(n)))[0] if n else np.empty(0, np.int64)
    padded = np.concatenate((s.astype(np.int64), np.zeros(4, np.int64)))
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    # sorted sampled triples and their names
    top = int(padded.max()) + 1
    if top < 1 << 20:
        names, count = _names((padded[sample] * top + padded[sample + 1]) * top + padded[sample + 2])
    else:
        names, count = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if count < len(sample) and need > 3:  # the same again on the names; 0 keeps the halves apart
        joined = np.concatenate((names[: len(one)] + 1, [0], names[len(one) :] + 1)) + 1
        ranks = suffix_ranks(joined, -(-need // 3))
        names = _names(np.concatenate((ranks[: len(one)], ranks[len(one) + 1 :])))[0]
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names + 1  # 0: past the end
    # the remaining suffixes: one symbol, then a sampled suffix
    zero = np.arange(0, n, 3)
    big = n + 5
    by_one = padded[zero] * big + rank[zero + 1]
    order = np.argsort(by_one)
    zero, by_one = zero[order], by_one[order]
    wide = padded[: n + 2] * top + padded[1 : n + 3]  # two symbols as one
    wide = _names(wide)[0] if top * top * big > 1 << 62 else wide
    by_two = wide[zero] * big + rank[zero + 2]
    by_two.sort()  # ties and orders within `need` agree with by_one
    # merge: how many of the remaining come before each sampled suffix; asked in their order
    order = np.argsort(names)
    before = np.empty(len(sample), np.int64)
    i = order[order < len(one)]
    before[i] = np.searchsorted(by_one, padded[sample[i]] * big + rank[sample[i] + 1], side="left")
    i = order[order >= len(one)]
    before[i] = np.searchsorted(by_two, wide[sample[i]] * big + rank[sample[i] + 2], side="left")
    before[order] = np.maximum.accumulate(before[order])  # where only ties beyond `need` disagree
    out = np.empty(n, np.int64)
    place = np.empty(len(sample), np.int64)
    place[order] = np.arange(len(sample))
    place += before
    out[sample] = place
    taken = np.zeros(n, bool)
    taken[place] = True
    out[zero] = np.flatnonzero(~taken)
    return out


def smallest_holder(pieces: list[bytes], first: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For the strings of ``width`` bytes of all pieces, one after the other,
    the smallest ``first`` of the pieces that hold the same string: suffix
    sort, then neighbours compared."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + 2
    symbols[ends - 1] = 1  # between pieces
    rank = suffix_ranks(symbols, width)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    whole = np.arange(len(data)) + width < ends[piece]  # whole strings alone
    order = order[whole[order]]
    words = np.zeros(len(data), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(data)]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for at in [*range(0, width - 7, 8), width - 8]:
        w = words[order + at]
        new[1:] |= w[1:] != w[:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(data), np.int64)
    if len(order):
        least = np.minimum.reduceat(first[piece[order]], starts)
        out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out[whole]


# -- the distributed steps


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """ids and UTF-8 texts of a batch of (id, text); rows without an id, which
    neither remove nor are removed from, come as empty texts."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
    return ids, [b"" if i >= NULL_IDS else t for i, t in zip(ids.tolist(), texts)] if (ids >= NULL_IDS).any() else texts


#: A packed segment: a cryptographic digest, so that equal digests are equal bytes.
SEGMENT = np.dtype([("hash", "V16"), ("id", "<i8"), ("row_key", "<i8"), ("start", "<i4"), ("size", "<i4")])


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _send_segments(buckets: int):
    """(id, text) to (bucket, packed segments)."""

    def run(batches):
        for batch in batches:
            ids, texts = _rows(batch)
            held, size = [], 0
            for part in parts_of(texts):
                row, begin, _, end = part.segments()
                raw = part.raw
                out = np.empty(len(row), SEGMENT)
                out["hash"] = np.frombuffer(b"".join([_digest(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist())]), "V16")
                at = part.first + row
                out["id"] = ids[at]
                keys = {r: _row_key(texts[r]) for r in np.unique(at).tolist()}
                out["row_key"] = [keys[r] for r in at.tolist()]
                out["start"] = begin - part.bounds[row] + part.at
                out["size"] = end - begin
                held.append(out)
                size += len(out)
                if size > 500_000:
                    yield from _dealt(np.concatenate(held), buckets)
                    held, size = [], 0
            if held:
                yield from _dealt(np.concatenate(held), buckets)

    return run


def _dealt(rows: np.ndarray, buckets: int):
    """Rows packed by bucket of their hash."""
    bucket = (np.ascontiguousarray(rows["hash"]).view(np.uint32).reshape(-1, 4)[:, 0] % buckets).astype(np.int32) if len(rows) else np.empty(0, np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = _cuts(bucket)
    names = bucket[cuts[:-1]]
    loads = [rows[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(loads, pa.binary())], ["bucket", "load"])


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns change, with both ends."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n + 1, bool)
    new[1:n] = False
    for c in columns:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _copied_segments(batches):
    """(bucket, load) to (id, row key, starts, sizes) of segments that a
    smaller id has, too."""
    loads = [load for batch in batches for load in batch.column(1).to_pylist()]
    if not loads:
        return
    rows = np.frombuffer(b"".join(loads), SEGMENT)
    del loads
    high, low = np.ascontiguousarray(rows["hash"]).view(np.uint64).reshape(-1, 2).T
    order = np.lexsort((rows["id"], low, high))
    cuts = _cuts(high[order], low[order])
    ids = rows["id"][order]
    copied = ids > np.repeat(ids[cuts[:-1]], np.diff(cuts))  # the first of each run has the smallest id
    rows = rows[order[copied]]
    ids, row_key, start, size = (np.ascontiguousarray(rows[k]) for k in ("id", "row_key", "start", "size"))
    order = np.lexsort((start, row_key, ids))
    ids, row_key, start, size = ids[order], row_key[order], start[order], size[order]
    cuts = _cuts(ids, row_key)
    for at in range(0, len(cuts) - 1, 50_000):
        part = cuts[at : at + 50_001]
        spans = list(zip(part[:-1].tolist(), part[1:].tolist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[part[:-1]]), pa.array(row_key[part[:-1]]), pa.array([start[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([size[a:b].tobytes() for a, b in spans], pa.binary())],
            ["id", "row_key", "starts", "sizes"],
        )


class Told:
    """What is known about each row of a batch: (id, text, list of (row key,
    starts, sizes), list of (bucket, hashes, hot))."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, self.texts = _rows(batch)
        self.copied = [self._starts(i, c) for i, c in enumerate(batch.column(2).to_pylist())]
        shared = batch.column(3).to_pylist() if batch.num_columns > 3 else []
        self.shared = [self._keys(c, "hashes") for c in shared]
        self.hot = [self._keys(c, "hot") for c in shared]

    def _starts(self, i: int, held) -> np.ndarray:
        if not held:
            return np.empty(0, np.int64)
        key = _row_key(self.texts[i])
        mine = [np.frombuffer(x["starts"], np.int32) for x in held if x["row_key"] == key]
        return np.sort(np.concatenate(mine)).astype(np.int64) if mine else np.empty(0, np.int64)

    @staticmethod
    def _keys(held, name: str) -> np.ndarray:
        held = [x for x in held or () if x[name]]
        if not held:
            return np.empty(0, np.uint64)
        return np.sort(np.concatenate([(np.uint64(x["bucket"]) << np.uint64(32)) | np.frombuffer(x[name], np.uint32).astype(np.uint64) for x in held]))

    def left(self, part: Part) -> np.ndarray:
        """Positions of a part whose segment isn't a copy."""
        row, begin, last, _ = part.segments()
        out = np.zeros(len(part.data), bool)
        where = begin - part.bounds[row] + part.at
        for a, b in zip((c := _cuts(row))[:-1].tolist(), c[1:].tolist()):
            gone = self.copied[part.first + row[a]]
            if len(gone):
                at = np.minimum(np.searchsorted(gone, where[a:b]), len(gone) - 1)
                for x, y in zip(begin[a:b][gone[at] != where[a:b]].tolist(), last[a:b][gone[at] != where[a:b]].tolist()):
                    out[x:y] = True
            else:
                out[begin[a] : last[b - 1]] = True
        return out


def _send_minimisers(buckets: int):
    """(id, text, copied segments) to (bucket, packed ids, counts and hashes)."""

    def run(batches):
        for batch in batches:
            told = Told(batch)
            held, size = [], 0
            for part in parts_of(told.texts):
                row, _, _, least = part.stretches(told.left(part))
                held.append((told.ids[part.first + row], least))
                size += len(row)
                if size > 1_000_000:
                    yield from _packed(held, buckets)
                    held, size = [], 0
            if held:
                yield from _packed(held, buckets)

    return run


def _packed(held, buckets: int):
    ids, least = (np.concatenate(x) for x in zip(*held))
    bucket = ((least >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, low = bucket[order], ids[order], least[order].astype(np.uint32)
    cuts = _cuts(bucket)
    names, loads = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        i = ids[a:b]
        runs = _cuts(i)
        names.append(int(bucket[a]))
        loads.append(np.int32(len(runs) - 1).tobytes() + i[runs[:-1]].tobytes() + np.diff(runs).astype(np.int32).tobytes() + low[a:b].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(loads, pa.binary())], ["bucket", "load"])


def _shared_minimisers(batches, hot_owners: int):
    """(bucket, load) to (id, bucket, hashes, hot): those met under two ids, and
    of them those of very many documents."""
    keys, owners = [], []
    for batch in batches:
        for bucket, load in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = int(np.frombuffer(load, np.int32, 1)[0])
            ids = np.frombuffer(load, np.int64, n, 4)
            counts = np.frombuffer(load, np.int32, n, 4 + 8 * n)
            low = np.frombuffer(load, np.uint32, -1, 4 + 12 * n)
            keys.append((np.uint64(bucket) << np.uint64(32)) | low)
            owners.append(np.repeat(ids, counts))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    del keys, owners
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    starts = _cuts(key)[:-1]
    shared = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
    counts = np.diff(np.append(starts, len(key)))
    mask = np.repeat(shared, counts)
    many = np.repeat(counts > hot_owners, counts)
    key, owner, many = key[mask], owner[mask], many[mask]
    order = np.lexsort((key, owner))
    key, owner, many = key[order], owner[order], many[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner, many = key[fresh], owner[fresh], many[fresh]
    bucket, low = (key >> np.uint64(32)).astype(np.int32), key.astype(np.uint32)
    cuts = _cuts(owner, bucket)
    for at in range(0, len(cuts) - 1, 50_000):
        part = cuts[at : at + 50_001]
        spans = list(zip(part[:-1].tolist(), part[1:].tolist()))
        loads = [low[a:b].tobytes() for a, b in spans]
        hot = [low[a:b][many[a:b]].tobytes() for a, b in spans] if many.any() else [b""] * len(spans)
        yield pa.RecordBatch.from_arrays([pa.array(owner[part[:-1]]), pa.array(bucket[part[:-1]]), pa.array(loads, pa.binary()), pa.array(hot, pa.binary())], ["id", "bucket", "hashes", "hot"])


def _among(key: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(key), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, key), len(sorted_) - 1)] == key


#: Bytes of stretches that are sorted at once in a task; a cut never parts equal minimisers.
SORTED_AT_ONCE = 1_200_000


def _send_places(buckets: int, spread: int):
    """(id, text, copied segments, shared hashes) to (mini, salt, piece, id, row
    key, position): the stretches left whose minimiser is shared. salt: 0, or
    the share of a hot minimiser's documents."""

    def run(batches):
        for batch in batches:
            told = Told(batch)
            row_keys: dict[int, int] = {}
            for part in parts_of(told.texts):
                if not any(map(len, told.shared[part.first : part.first + len(part.bounds) - 1])):
                    continue
                row, start, size, least = part.stretches(told.left(part))
                key = (((least >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (least & np.uint64(0xFFFFFFFF))
                mask, hot = np.zeros(len(row), bool), np.zeros(len(row), bool)
                for a, b in zip((c := _cuts(row))[:-1].tolist(), c[1:].tolist()):
                    mask[a:b] = _among(key[a:b], told.shared[part.first + row[a]])
                    hot[a:b] = _among(key[a:b], told.hot[part.first + row[a]])
                row, start, size, least, hot = row[mask], start[mask], size[mask], least[mask], hot[mask]
                raw, at, pos = part.raw, part.first + row, start - part.bounds[row] + part.at
                pieces = [raw[x : x + n + WIDTH - 1] for x, n in zip(start.tolist(), size.tolist())]
                for r in np.unique(at).tolist():
                    if r not in row_keys:
                        row_keys[r] = _row_key(told.texts[r])
                ids = told.ids[at]
                salt = np.where(hot, 1 + (ids.astype(np.uint64) * _BASE >> np.uint64(40)).astype(np.int64) % spread, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(pieces, pa.binary()), pa.array(ids), pa.array([row_keys[r] for r in at.tolist()], pa.int64()), pa.array(pos.astype(np.int32))],
                    ["mini", "salt", "piece", "id", "row_key", "pos"],
                )

    return run


def holders_of(minis: np.ndarray, pieces: list[bytes], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, holders): for the strings of each of some distinct pieces the
    smallest id that has them. Where all stretches of a minimiser are equal, or
    all of one document, there is nothing to sort."""
    strings = np.fromiter(map(len, pieces), np.int64, len(pieces)) - WIDTH + 1
    offsets = np.concatenate(([0], np.cumsum(strings)))
    out = np.repeat(first, strings)
    order = np.argsort(minis, kind="stable")
    cuts = _cuts(minis[order])
    low = np.minimum.reduceat(first[order], cuts[:-1]) if len(order) else np.empty(0, np.int64)
    high = np.maximum.reduceat(last[order], cuts[:-1]) if len(order) else np.empty(0, np.int64)
    need = (np.diff(cuts) > 1) & (low != high)
    held: list[int] = []
    size = 0

    def sort() -> None:
        found = smallest_holder([pieces[i] for i in held], first[held])
        at = 0
        for i in held:
            n = int(strings[i])
            out[offsets[i] : offsets[i] + n] = found[at : at + n]
            at += n

    for g in np.flatnonzero(need).tolist():
        mine = order[cuts[g] : cuts[g + 1]].tolist()
        held += mine
        size += sum(len(pieces[i]) for i in mine)
        if size >= SORTED_AT_ONCE:
            sort()
            held, size = [], 0
    if held:
        sort()
    return offsets, out


def _distinct(pieces: list[bytes], ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces, each row's among them, smallest and largest id of each."""
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
    first = np.full(len(known), np.iinfo(np.int64).max)
    last = np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(first, of, ids)
    np.maximum.at(last, of, ids)
    return list(known), of, first, last


def _sort_places(batches):
    """(mini, salt, piece, id, row key, position) to (id, row key, s, e): bytes
    to remove; stretches of hot minimisers are left to others."""
    held = [b for b in map(_of_hot(False), batches) if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    minis, ids, row_key, pos = (table.column(k).to_numpy() for k in (0, 3, 4, 5))
    pieces, of, first, last = _distinct(table.column(2).to_pylist(), ids)
    del table
    mini = np.empty(len(pieces), np.int64)
    mini[of] = minis
    offsets, holders = holders_of(mini, pieces, first, last)
    for at in range(0, len(of), 200_000):
        k = of[at : at + 200_000]
        n = offsets[k + 1] - offsets[k]
        ends = np.cumsum(n)
        within = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        gone = holders[np.repeat(offsets[k], n) + within] < np.repeat(ids[at : at + 200_000], n)
        change = np.ones(len(gone) + 1, bool)
        change[1:-1] = gone[1:] != gone[:-1]
        change[ends] = True
        change[ends - n] = True
        runs = np.flatnonzero(change)
        begin, stop = runs[:-1][gone[runs[:-1]]], runs[1:][gone[runs[:-1]]]
        row = np.searchsorted(ends, begin, side="right")
        s = pos[at + row] + within[begin]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[at + row]), pa.array(row_key[at + row]), pa.array(s.astype(np.int32)), pa.array((s + (stop - begin) + WIDTH - 1).astype(np.int32))], ["id", "row_key", "s", "e"]
        )


def _of_hot(hot: bool):
    """The rows of a batch that are (not) salted. Not a filter of the plan: that
    would be pushed below the exchange, which then couldn't be shared."""

    def run(batch):
        salted = batch.column(1).to_numpy(zero_copy_only=False) > 0
        return batch if (salted == hot).all() else batch.filter(pa.array(salted == hot))

    return run


def _hot_places(batches):
    yield from (b for b in map(_of_hot(True), batches) if b.num_rows)


def _distinct_pieces(batches):
    """(mini, salt, piece, id, ...) to (mini, piece, first, last) of a task's hot stretches."""
    for batch in map(_of_hot(True), batches):
        if batch.num_rows:
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            pieces, of, first, last = _distinct(batch.column(2).to_pylist(), ids)
            mini = np.empty(len(pieces), np.int64)
            mini[of] = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(pieces, pa.binary()), pa.array(first), pa.array(last)], ["mini", "piece", "first", "last"])


def _sort_pieces(batches):
    """(mini, piece, first, last) to (mini, piece, runs of smallest holders)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    low, high = table.column(2).to_numpy(), table.column(3).to_numpy()
    pieces, of, first, _ = _distinct(table.column(1).to_pylist(), low)
    last = np.full(len(pieces), np.iinfo(np.int64).min)
    np.maximum.at(last, of, high)
    mini = np.empty(len(pieces), np.int64)
    mini[of] = table.column(0).to_numpy()
    offsets, holders = holders_of(mini, pieces, first, last)
    runs = []
    for i in range(len(pieces)):
        h = holders[offsets[i] : offsets[i + 1]]
        cuts = _cuts(h)
        runs.append([{"o": o, "n": n, "m": m} for o, n, m in zip(cuts[:-1].tolist(), np.diff(cuts).tolist(), h[cuts[:-1]].tolist())])
    kind = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32()), ("m", pa.int64())]))
    yield pa.RecordBatch.from_arrays([pa.array(mini), pa.array(pieces, pa.binary()), pa.array(runs, kind)], ["mini", "piece", "runs"])


def _row_key(text: bytes) -> int:
    """Tells rows with one id but different texts apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _cut_out(with_text: bool, id_col: str):
    """(id, text, copied segments, list of (row key, s, e)) to the result row."""

    def run(batches):
        for batch in batches:
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            copied = batch.column(2).to_pylist()
            lists = batch.column(3)
            offsets, inner = lists.offsets.to_numpy(), lists.values
            own, s, e = (inner.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            removed, spans, digests, kept_all = [], [], [], []
            for k, text in enumerate(texts):
                merged: list[tuple[int, int]] = []
                if copied[k] or offsets[k + 1] > offsets[k]:
                    key = _row_key(text)
                    a, b = offsets[k], offsets[k + 1]
                    mine = own[a:b] == key
                    held = [x for x in copied[k] or () if x["row_key"] == key]
                    starts = [np.frombuffer(x["starts"], np.int32).astype(np.int64) for x in held]
                    begin = np.concatenate([s[a:b][mine], *starts])
                    end = np.concatenate([e[a:b][mine], *(x + np.frombuffer(h["sizes"], np.int32) for x, h in zip(starts, held))])
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
                    at = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1]))) if len(begin) else np.zeros(0, np.int64)
                    merged = list(zip(begin[at].tolist(), end[np.append(at[1:], len(begin)) - 1].tolist())) if len(at) else []
                if merged:
                    edges = [0, *(x for r in merged for x in r), len(text)]
                    kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                else:
                    kept = text
                removed.append(len(text) - len(kept))
                spans.append([{"s": x, "e": y} for x, y in merged])
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_all.append(kept)
            cols = [
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(digests, pa.string()),
            ]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols += [pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept_all, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str):
    """((id, text) with ids as numbers in their order, tasks, a table (id,
    given) that leads back or None).

    Whole numbers stay. Other ids are numbered by a sort over ranges. Null ids
    become numbers above all others, by their text, so that their rows are not
    one task's.
    """
    spark = docs.sparkSession
    src = only(docs, id_col, text_col).toDF("id", "text")
    whole = src.schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    top = F.max("id").cast("long") if whole else F.lit(None).cast("long")
    seen = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), top.alias("top")).first()
    tasks = max(partitions(spark), -(-seen["n"] // TASK_BYTES))
    back = None
    if not whole or seen["top"] is not None and seen["top"] >= NULL_IDS:
        ids = src.select(F.col("id").alias("given")).filter("given IS NOT NULL").distinct().repartitionByRange(tasks, "given").sortWithinPartitions("given")
        back = materialise(ids.select(F.monotonically_increasing_id().alias("id"), "given"), "ids")  # grows with the ranges and inside them
        src = src.join(back.withColumnRenamed("id", "_n"), F.col("id") == F.col("given"), "left").select(F.col("_n").alias("id"), "text")
    spread = F.lit(NULL_IDS) + F.pmod(F.xxhash64("text"), F.lit(2**60)) if seen["nulls"] else F.lit(NULL_IDS)
    return src.withColumn("id", F.coalesce(F.col("id").cast("long"), spread)), tasks, back


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot_owners: int = HOT_OWNERS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, spans
    (byte offsets of what is removed) and kept (the bytes left): one row per
    row of ``docs``.

    Null texts are empty. A row with a null id has no order, so nothing is
    removed from it and it is no source. Rows of one id don't remove from each
    other, whether their texts are equal or not. Ids may be of any type with an
    order. Other columns aren't read. Texts go through one shuffle, used by
    every later step, in tasks of a bounded size.
    """
    id_type = docs.select(id_col).schema[0].dataType
    # no filter on ids: one below the exchange of texts would make it another exchange
    src, n, back = _numbered(docs, id_col, text_col)
    buckets = 2 * n
    dealt = src.repartition(n, "id")
    segments = src.mapInArrow(_send_segments(buckets), "bucket int, load binary").repartition(n, "bucket")
    copied = segments.mapInArrow(_copied_segments, "id long, row_key long, starts binary, sizes binary")
    copied = copied.groupBy("id").agg(F.collect_list(F.struct("row_key", "starts", "sizes")).alias("copied"))  # no more than a text's segments
    known = dealt.join(copied.hint("shuffle_hash"), "id", "left").select("id", "text", "copied")
    loads = known.mapInArrow(_send_minimisers(buckets), "bucket int, load binary")
    shared = loads.repartition(n, "bucket").mapInArrow(lambda batches: _shared_minimisers(batches, hot_owners), "id long, bucket int, hashes binary, hot binary")
    shared = shared.groupBy("id").agg(F.collect_list(F.struct("bucket", "hashes", "hot")).alias("shared"))
    suspects = known.join(shared.hint("shuffle_hash"), "id").select("id", "text", "copied", "shared")
    # one exchange: stretches of a minimiser together, those of hot ones spread by document
    places = suspects.mapInArrow(_send_places(buckets, n), "mini long, salt int, piece binary, id long, row_key long, pos int").repartition(n, "mini", "salt")
    cut = places.mapInArrow(_sort_places, "id long, row_key long, s int, e int")
    hot = places.mapInArrow(_hot_places, places.schema)
    pieces = places.mapInArrow(_distinct_pieces, "mini long, piece binary, first long, last long")
    holders = pieces.repartition(n, "mini").mapInArrow(_sort_pieces, "mini long, piece binary, runs array<struct<o:int,n:int,m:long>>")
    met = hot.join(holders, ["mini", "piece"]).select("id", "row_key", "pos", F.explode("runs").alias("r")).filter("r.m < id")
    more_cut = met.select("id", "row_key", (F.col("pos") + F.col("r.o")).alias("s"), (F.col("pos") + F.col("r.o") + F.col("r.n") + (WIDTH - 1)).alias("e"))
    cut = cut.unionByName(more_cut).groupBy("id").agg(F.collect_list(F.struct("row_key", "s", "e")).alias("cut"))
    rows = dealt.join(copied.hint("shuffle_hash"), "id", "left").join(cut.hint("shuffle_hash"), "id", "left").select("id", "text", "copied", F.coalesce("cut", F.array().cast("array<struct<row_key:bigint,s:int,e:int>>")).alias("cut"))
    more = ", spans array<struct<s:int,e:int>>, kept binary" if with_text else ""
    out = rows.mapInArrow(_cut_out(with_text, id_col), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
    if back is not None:
        out = out.join(back.withColumnsRenamed({"id": id_col}), id_col, "left").withColumn(id_col, F.col("given")).drop("given")
        return out.select(id_col, *[c for c in out.columns if c != id_col])
    return out.withColumn(id_col, F.when(F.col(f"`{id_col}`") < NULL_IDS, F.col(f"`{id_col}`")).cast(id_type))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
