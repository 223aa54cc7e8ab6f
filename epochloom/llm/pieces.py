"""Exact merge-type (BPE) encoding with a public SentencePiece model file.

Encoding is by backtracking instead of merging: take the longest piece at a
position (all longest matches come from one Aho-Corasick pass), keep it if it
is compatible with the piece before it (merging the two pieces' characters
again gives just these two), else try the next shorter one, else step back and
mark the position as failed in a bit field. A text has exactly one sequence in
which all neighbours are compatible, and it is what merging gives.

Texts are cut where no merge can cross: before each run of word marks, between
letters and others if no piece holds both, around characters that the vocabulary
lacks; encoded parts are remembered in a
table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read, slices

MARK = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_NEVER = float("-inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = 4 if kind == 5 else 8
            if kind == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class _Parts(dict):
    """Encoded parts, made when first asked for. Two generations: when the
    young one is full it becomes the old one, so parts in use stay."""

    def __init__(self, make, room: int, longest: int):
        super().__init__()
        self.make, self.room, self.longest, self.old = make, room // 2, longest, {}

    def __missing__(self, part: str) -> tuple[bytes, str]:
        out = self.old.get(part) or self.make(part)
        if len(part) <= self.longest:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[part] = out
        return out


class PieceModel:
    """Vocabulary and rules of a BPE model file, with encode and decode."""

    def __init__(self, data: bytes, remember: int = 500_000, longest_remembered: int = 64):
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix = self.escape = True
        self.byte_fallback = False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
                self.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(1) not in (b"identity", None) or spec.get(4, 1):
                    raise ValueError("only models with the identity normaliser are read")
                self.dummy_prefix = bool(spec.get(3, 1))
                self.escape = bool(spec.get(5, 1))
        if _USER in self.kinds:
            raise ValueError("models with user-defined pieces aren't read")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == _BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.widest = max(map(len, self.ids), default=1)
        self.known = {c for p in self.ids for c in p if c in self.ids}
        # parts can be cut before a run of marks only if no piece has a mark inside
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self._part = self._cutter()
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self._fits: dict[tuple[str, str], bool] = {}
        self._usable: dict[str, int] = {}
        self._parts = _Parts(self._part_of, remember, longest_remembered)
        self._unknown = re.compile("[^" + "".join(map(re.escape, sorted(self.known))) + "]", re.S)
        self._surface = [p.replace(MARK, " ") if k == _NORMAL else " ⁇ " if k == _UNKNOWN else "" for p, k in zip(self.pieces, self.kinds)]
        self._byte_ids = frozenset(self.bytes.values())

    def _cutter(self) -> re.Pattern:
        """Finds the parts of a text: a run of marks with the run of letters or
        of other characters after it. Parts end where no piece goes on: before
        marks, and between letters and others, if no piece holds both (letters
        that some piece joins with others count as others)."""
        mark = f" {MARK}" if self.escape else MARK
        if not self.cuts:
            return re.compile(".+", re.S)
        letter, others = re.compile(r"[^\W\d_]"), set()
        bare = [p.lstrip(MARK) for p in self.ids]
        while True:
            kinds = [[c for c in p if letter.match(c) and c not in others] for p in bare]
            more = {c for p, k in zip(bare, kinds) if 0 < len(k) < len(p) for c in k}
            if not more:
                break
            others |= more
        if len(others) > 1000:  # a vocabulary whose pieces join letters with others as a rule
            return re.compile(f"[{mark}]+[^{mark}]*|[^{mark}]+")
        letters = r"\W\d_" + "".join(map(re.escape, sorted(others)))
        return re.compile(f"[{mark}]*(?:[^{letters}]+|(?:(?![^{letters}])[^{mark}])+)|[{mark}]+")

    # -- merging, on two pieces at a time

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, leftmost
        among equals."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == _NEVER:
                break
            at = pairs.index(best)  # the leftmost
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], _NEVER)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the pieces can stand side by side."""
        key = (left, right)
        out = self._fits.get(key)
        if out is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            out = self._fits[key] = self.merged(left + right) == [left, right]
        return out

    def usable(self, piece: str) -> int:
        """The piece's id if merging its characters gives the piece, else -1."""
        out = self._usable.get(piece)
        if out is None:
            out = self.ids.get(piece, -1)
            if out >= 0 and self.merged(piece) != [piece]:
                out = -1
            if piece in self.ids:
                self._usable[piece] = out
        return out

    # -- encoding

    def split(self, text: str) -> list[int]:
        """The piece ids of a text of known characters, by backtracking."""
        only_piece = self.usable(text)
        if only_piece >= 0:
            return [only_piece]
        # leftmost-longest matches first: often they are compatible throughout
        known, known_fits, fits, usable = self._usable.get, self._fits.get, self.fits, self.usable
        ids: list[int] = []
        left, at = "", 0
        for end, size in self.automaton.iter_long(text):
            p = text[at : end + 1]
            i = known(p)
            if i is None:
                i = usable(p)
            if i < 0 or left and not (ok if (ok := known_fits((left, p))) is not None else fits(left, p)):
                break
            ids.append(i)
            left, at = p, end + 1
        else:
            return ids
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        pieces: list[str] = []
        ids = []
        failed, any_failed = bytearray((n >> 3) + 1), False
        at, size, left = 0, longest[0], ""
        while at < n:
            while size:  # from the longest piece to the shortest
                end = at + size
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    p = text[at:end]
                    i = known(p)
                    if i is None:
                        i = usable(p)
                    if i >= 0:
                        ok = known_fits((left, p)) if left else True
                        if ok is None:
                            ok = fits(left, p)
                        if ok:
                            break
                size -= 1
            if size:
                pieces.append(p)
                ids.append(i)
                at, left = end, p
                size = longest[at] if at < n else 0
            else:  # nothing can follow the last piece here: try a shorter one in its place
                if not pieces:
                    raise AssertionError("a text of known characters always has an encoding")
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                size = len(pieces.pop())
                ids.pop()
                left = pieces[-1] if pieces else ""
                at -= size
                size -= 1
        return ids

    def _part_of(self, part: str) -> tuple[bytes, str]:
        """The ids of a part as text, and the decoded part."""
        ids: list[int] = []
        at = 0
        marked = part.replace(" ", MARK) if self.escape else part
        for m in self._unknown.finditer(marked):
            if m.start() > at:
                ids += self.split(marked[at : m.start()])
            ids += self._fallback(m[0])
            at = m.end()
        if at < len(marked):
            ids += self.split(marked[at:])
        text = self.text_of(ids)
        return ",".join(map(str, ids)).encode(), part if text == part else text  # mostly one object for both

    def _fallback(self, char: str) -> list[int]:
        if not self.byte_fallback:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as text, decoded) of each part of a text with its first mark."""
        if not text:
            return []
        if self.dummy_prefix:
            text = " " + text
        return list(map(self._parts.__getitem__, self._part.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.parts(text or "") for i in ids.split(b",")]

    # -- decoding

    def text_of(self, ids) -> str:
        """Pieces and byte runs put together; marks become spaces."""
        surface, byte_ids = self._surface, self._byte_ids
        if byte_ids.isdisjoint(ids):
            return "".join([surface[i] for i in ids])
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in byte_ids:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(surface[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of ids; the added first mark goes."""
        text = self.text_of(ids)
        return text[1:] if self.dummy_prefix and text[:1] == " " and len(ids) and self.kinds[ids[0]] == _NORMAL else text


def _utf8(raw: bytearray) -> str:
    """UTF-8 with each byte that is out of place as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def load(data: bytes) -> PieceModel:
    """One model for a worker process, whatever the number of tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """id, ``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked
    for, ``ids`` and ``decoded``: one row per row of ``docs``.

    Row by row, no shuffle. The model file (half a megabyte) is read on the
    driver and sent along. Null texts count as empty: no ids, decoded to the
    empty text. Null ids and repeated rows each keep their row.
    """
    path = model_path or default_model_path()
    with open(path, "rb") as f:
        data = f.read()
    src = only(docs, id_col, text_col, *keep)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != text_col or text_col in keep)
    names = [id_col, *keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    schema = f"{head}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        model = load(data)
        for batch in slices(batches):
            n, a, b, ids, texts = [], [], [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                lists, pieces = zip(*model.parts(text)) if text else ((), ())
                joined = b",".join(lists)
                text = "".join(pieces)
                if pieces and model.dummy_prefix and text[:1] == " ":
                    text = text[1:]
                n.append(joined.count(b",") + 1 if joined else 0)
                a.append(hashlib.sha256(joined).hexdigest())
                b.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append([int(i) for i in joined.split(b",")] if joined else [])
                    texts.append(text)
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *more], names)

    return src.mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), with_ids=False)


def tokenise_documents(docs: DataFrame) -> DataFrame:
    """Last stage: the digest columns for every document."""
    return encode_documents(docs, with_ids=False).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
