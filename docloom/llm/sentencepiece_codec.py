"""Operator 9: SentencePiece encoding and decoding by suffix-array matching.

For each batch, the stretches of text that are new (white space with the word after it, which no piece goes beyond) are laid
end to end and indexed by a suffix array. Every piece is binary-searched for its range of occurrences; an occurrence is an
edge of the batch's lattice. Edges are sorted by where they end and relaxed in that order.

The model in use is a byte-pair one, whose segmentation is not the path of the best sum of scores. It is still a shortest
path problem with one answer: a sequence of pieces is the model's segmentation exactly where each two neighbours are the
segmentation of their own concatenation, and every prefix of a text has one such last piece. So an edge relaxes its end where
it fits the piece that reaches its start. Characters without a piece are edges of their own and become byte pieces. Unigram
models relax to the best sum of scores.

Per row, one pass over the input, no exchange.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, tidied

SPACE = "▁"
#: Characters of stretches, and pairs of pieces, that a Python worker remembers (each memory has a young and an old half: what
#: is met again moves to the young one, and the old one goes when that is full), and characters indexed together.
CACHE_CHARS, CACHE_PAIRS, BATCH_CHARS = 4_000_000, 600_000, 100_000
#: Longer stretches than this are traced and forgotten one by one; texts of so many characters are encoded together.
LONG_STRETCH, GROUP_CHARS = 400, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a SentencePiece model file says: pieces with scores and kinds, and how text is prepared."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, unigram, prefix = [], [], [], True, True
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode("utf-8"))
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))
            elif field == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models with the identity normalization are read")
                prefix = bool(own.get(3, 1))
        return cls(pieces, scores, kinds, unigram, prefix)


class Codec:
    """Encoder and decoder of one model file, with the memory of a Python worker."""

    def __init__(self, path: str):
        m = self.model = Model.load(path)
        self.score = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == 1}
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == 1}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k == 6}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == 2), 0)
        self.bytes = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() if k == 1 else b"" for p, k in zip(m.pieces, m.kinds, strict=True)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes beyond the start of a word")
        self.longest = max(map(len, self.ids))
        # characters that no longer piece holds stand alone: text can be cut on both sides of them
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\x00" if c not in inner)
        self.cut = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.fits: dict[int, bool] = {}
        alphabet = sorted({c for p in self.ids for c in p})
        self.letter = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.table = np.zeros(0x110000, np.uint16)
        self.table[list(self.letter)] = list(self.letter.values())
        # pieces as fixed-width keys, in order, for binary search; only those that are their own segmentation can be used
        usable = [p for p in self.ids if m.unigram or self._whole(p)]
        self.piece_ids = np.array([self.ids[p] for p in usable], np.int64)
        self.piece_sizes = np.array([len(p) for p in usable], np.int64)
        rows = np.zeros((len(usable), self.longest), np.uint16)
        for row, p in zip(rows, usable, strict=True):
            row[: len(p)] = self.table[[ord(c) for c in p]]
        self.low = self._keys(rows)
        high = rows.copy()
        high[np.arange(self.longest)[None, :] >= self.piece_sizes[:, None]] = 0xFFFF
        self.high = self._keys(high)
        self.size_of = np.zeros(len(m.pieces) + 1, np.int64)
        self.size_of[self.piece_ids] = self.piece_sizes

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u2")).view(f"S{2 * rows.shape[1]}").ravel()

    def _merge(self, text: str, wall: int = -1) -> list[str] | None:
        """Byte-pair merges of one short text, best score first, leftmost of equals; None where one goes across ``wall``."""
        parts, ends = list(text), list(range(1, len(text) + 1))
        score = self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            if ends[at] == wall:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ends[at]

    def _whole(self, piece: str) -> bool:
        return len(piece) == 1 or self._merge(piece) == [piece]

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether pairs ``left * n + right`` of pieces are the segmentation of their concatenation."""
        n = len(self.model.pieces)
        each, inverse = np.unique(pairs, return_inverse=True)
        out = np.empty(len(each), bool)
        fits, pieces = self.fits, self.model.pieces
        for i, key in enumerate(each.tolist()):
            known = fits.get(key)
            if known is None:
                a, b = pieces[key // n], pieces[key % n]
                known = fits[key] = self._merge(a + b, len(a)) is not None
            out[i] = known
        return out[inverse]

    def segment(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch, little-endian unsigned 32-bit, by one suffix array over all of them."""
        text = "\x00".join(stretches) + "\x00"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(s) for s in stretches], np.int64)
        start = np.cumsum(size + 1) - size - 1
        letters = self.table[points]
        owner = np.repeat(np.arange(len(stretches)), size + 1)
        letters[start + size] = 0
        wide = np.zeros((len(letters), self.longest), np.uint16)
        alive = np.ones(len(letters), bool)
        for k in range(self.longest):  # what follows each place, up to the end of its stretch or a letter without pieces
            part = letters[k:] if k else letters
            alive[: len(part)] &= part > 0
            alive[len(part) :] = False
            wide[: len(part), k] = np.where(alive[: len(part)], part, 0)
        keys = self._keys(wide)
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        lo, hi = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        count = hi - lo
        piece = np.repeat(np.arange(len(count)), count)
        begin = suffixes[np.repeat(lo, count) + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)]
        edge_id, edge_size = self.piece_ids[piece], self.piece_sizes[piece]
        bare = np.flatnonzero((letters == 0) & (np.arange(len(letters)) != (start + size)[owner]))  # no piece: an edge of one
        begin = np.r_[begin, bare]
        edge_id = np.r_[edge_id, np.full(len(bare), len(self.model.pieces))]
        end = begin + np.r_[edge_size, np.ones(len(bare), np.int64)]
        inside = end - start[owner[begin]]
        order = np.lexsort((begin, inside))
        begin, end, edge_id, inside = begin[order], end[order], edge_id[order], inside[order]
        none, n = -1, len(self.model.pieces)
        last = np.full(len(letters) + 1, none, np.int64)
        best = np.full(len(letters) + 1, -np.inf)
        fresh = np.zeros(len(letters) + 1, bool)
        fresh[start] = True
        best[start] = 0.0
        scores = np.array([*self.model.scores, min(self.score.values()) - 10.0])
        cuts = np.r_[0, np.flatnonzero(np.diff(inside)) + 1, len(inside)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, t = begin[a:b], end[a:b], edge_id[a:b]
            if self.model.unigram:
                value = best[s] + scores[t]
                rank = np.lexsort((-value, e))
                first = rank[np.r_[True, e[rank][1:] != e[rank][:-1]]]
                best[e[first]], last[e[first]] = value[first], t[first]
                continue
            free = fresh[s] | (t == n) | (last[s] == n)
            ok = free.copy()
            check = np.flatnonzero(~free & (last[s] >= 0))
            if len(check):
                ok[check] = self._fit(last[s[check]] * n + t[check])
            last[e[ok]] = t[ok]
        return self._trace(points, last, start, start + size)

    def _trace(self, points: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """Ids of each stretch from the last pieces, all stretches a piece at a time; odd and long ones each by itself."""
        n, at = len(self.model.pieces), stop.copy()
        single = stop - start > LONG_STRETCH
        open_ = np.flatnonzero((stop > start) & ~single)
        owners, steps = [open_[:0]], [last[:0]]
        while len(open_):
            t = last[at[open_]]
            plain = t < n
            single[open_[~plain]] = True
            open_, t = open_[plain], t[plain]
            owners.append(open_)
            steps.append(t)
            at[open_] -= self.size_of[t]
            open_ = open_[at[open_] > start[open_]]
        owner, ids = np.concatenate(owners)[::-1], np.concatenate(steps)[::-1]
        order = np.argsort(owner, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(start)))
        out = [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.flatnonzero(single).tolist():
            out[i] = self._back(points, last, int(start[i]), int(stop[i]))
        return out

    def _back(self, points: np.ndarray, last: np.ndarray, start: int, at: int) -> bytes:
        out: list[int] = []
        n = len(self.model.pieces)
        while at > start:
            t = int(last[at])
            if t == n:
                raw = chr(int(points[at - 1])).encode("utf-8", "surrogatepass")
                out += [self.byte_ids.get(b, self.unknown) for b in reversed(raw)] if self.byte_ids else [self.unknown]
                at -= 1
            else:
                out.append(t)
                at -= int(self.size_of[t])
        return array("I", reversed(out)).tobytes()

    def stretches(self, text: str) -> list[str]:
        if not text:
            return []
        plain = text.replace(" ", SPACE)
        return self.cut(SPACE + plain if self.model.dummy_prefix else plain)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        cut = [self.stretches(t) for t in texts]
        known, old = self.known, self.old
        new, fresh = [], {s for own in cut for s in own if s not in known}
        for s in fresh:
            ids = old.get(s)
            if ids is None:
                new.append(s)
            else:
                known[s] = ids
                self.held += len(s)
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and (end == at or held + len(new[end]) < BATCH_CHARS):
                held += len(new[end]) + 1
                end += 1
            known.update(zip(new[at:end], self.segment(new[at:end]), strict=True))
            self.held += held
            at = end
        out = [b"".join([known[s] for s in own]) for own in cut]
        for s in new:
            if len(s) > LONG_STRETCH:
                del known[s]
                self.held -= len(s) + 1
        if self.held > CACHE_CHARS // 2:
            self.known, self.old, self.held = {}, known, 0
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids: pieces joined, byte pieces as UTF-8, without the prefix that encoding put before the first word."""
        table = self.bytes
        raw = b"".join([table[i] for i in array("I", ids)])
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}
MEMORIES[__name__] = _CODECS


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model_path: str, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """Encode every text and decode it again.

    Output, one row per input row: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    decoded_sha256 (of the decoded text), round_trip (the decoded text is the text) and on request ids and decoded.

    Edge cases: null and empty texts have no ids and decode to the empty text; a text that holds the model's own space sign
    decodes to spaces in its place, so its round_trip is false; null and repeated ids are kept; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = [0, *np.flatnonzero(np.diff(size // GROUP_CHARS)) + 1, batch.num_rows] if batch.num_rows else [0]
            for at, stop in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(at, stop - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = tool.encode_batch(texts)
                back = [tool.decode(x) for x in ids]
                columns = [
                    part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                ]
                if keep_ids:
                    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))))
                if keep_text:
                    columns.append(pa.array(back))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)
