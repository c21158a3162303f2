"""Operator 10: media columns. Texts as 8-bit WAV payloads, short-time Fourier transforms, peak-pair fingerprints.

Everything is per row: one pass over the input writes the media column to the shared folder, one over the stored bytes works
out the rest; no exchange. Transforms run over ``GROUP_BYTES`` of payload, or one longer
document, in blocks of ``BLOCK`` frames, which bounds memory whatever the batch.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidied

UNIT = 576
RATE = 8000
FRAME, HOP = 2 * UNIT, UNIT
BLOCK = 256
#: Upper bin of each band; one peak a band and frame at most.
BANDS = ((4, 40), (40, 120), (120, 280), (280, 577))
FAN_OUT, REACH = 5, 12
#: Payload bytes transformed together.
GROUP_BYTES = 4 << 20

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, n_peaks long, fingerprint array<long>"
)
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
#: Media pages: bytes as they are, no dictionaries, row groups of a set size.
WRITER = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    want = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + b"\xff" * (want - len(raw)), len(raw)


def write_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def frames_of(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units of all payloads in a row, and the first unit of each frame; a frame is two units of one payload."""
    silence = b"\x80" * UNIT
    whole = [x + silence if len(x) == UNIT else x for x in samples]
    n_units = np.array([len(x) // UNIT for x in whole])
    units = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, UNIT)
    ends = np.cumsum(n_units) - 1
    starts = np.ones(len(units), bool)
    starts[ends] = False
    return units, np.flatnonzero(starts)


def peaks(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames of each payload, and (payload, frame, bin) of each spectral peak.

    A peak is the loudest bin of a band that also tops the same band in both neighbour frames.
    """
    units, first = frames_of(samples)
    n_frames = np.array([max(1, len(x) // UNIT - 1) for x in samples])
    window = np.hanning(FRAME).astype(np.float32)
    best_bin = np.empty((len(first), len(BANDS)), np.int64)
    best_mag = np.empty((len(first), len(BANDS)), np.float32)
    for a in range(0, len(first), BLOCK):
        at = first[a : a + BLOCK]
        x = (np.concatenate([units[at], units[at + 1]], axis=1).astype(np.float32) - 128.0) * window
        spectrum = np.abs(np.fft.rfft(x, axis=1))
        rows = np.arange(len(at))
        for b, (lo, hi) in enumerate(BANDS):
            k = spectrum[:, lo:hi].argmax(axis=1) + lo
            best_bin[a : a + BLOCK, b] = k
            best_mag[a : a + BLOCK, b] = spectrum[rows, k]
    doc = np.repeat(np.arange(len(samples)), n_frames)
    opens = np.cumsum(n_frames) - n_frames
    before, after = np.full_like(best_mag, -1.0), np.full_like(best_mag, -1.0)
    before[1:], after[:-1] = best_mag[:-1], best_mag[1:]
    before[opens] = -1.0
    after[opens + n_frames - 1] = -1.0
    t, b = np.nonzero((best_mag >= before) & (best_mag > after))
    return n_frames, doc[t], t - opens[doc[t]], best_bin[t, b]


def pair_codes(doc: np.ndarray, t: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload and code of each pair of near peaks; codes are frame << 32 | bin << 20 | later bin << 8 | frames between."""
    docs, codes = [doc[:0]], [t[:0]]
    for ahead in range(1, 1 + FAN_OUT):
        dt = t[ahead:] - t[:-ahead]
        ok = (doc[ahead:] == doc[:-ahead]) & (dt <= REACH)
        docs.append(doc[:-ahead][ok])
        codes.append((t[:-ahead] << 32 | k[:-ahead] << 20 | k[ahead:] << 8 | dt)[ok])
    docs, codes = np.concatenate(docs), np.concatenate(codes)
    order = np.lexsort((codes, docs))
    return docs[order], codes[order]


def media_rows(stored: list[bytes]) -> list[tuple]:
    """The payload and its features from the stored bytes of each document."""
    back = [read_wav(m) for m in stored]
    n_frames, doc, t, k = peaks(back)
    n_peaks = np.bincount(doc, minlength=len(back))
    in_doc, codes = pair_codes(doc, t, k)
    cuts = np.searchsorted(in_doc, np.arange(len(back) + 1))
    rows = []
    for i, (m, x) in enumerate(zip(stored, back, strict=True)):
        own = codes[cuts[i] : cuts[i + 1]]
        digest = hashlib.sha256(own.astype("<i8").tobytes()).hexdigest()
        feature = f"{n_frames[i]}:{n_peaks[i]}:{len(own)}:{digest}"
        rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, int(n_frames[i]), int(n_peaks[i]), own))
    return rows


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        at = 0
        while at < batch.num_rows:
            end, sizes, media = at, [], []
            held = 0
            while end < batch.num_rows and held < GROUP_BYTES:
                samples, n = payload(texts[end].as_py())
                media.append(write_wav(samples))
                sizes.append(n)
                held += len(samples)
                end += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
            at = end


def store_media(docs: DataFrame) -> DataFrame:
    """The media table, written and read back: doc_id, n_bytes (of the text) and ``media``, the bytes of a WAV file."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(picked.mapInArrow(tidied(_store), "doc_id long, n_bytes long, media binary"), "media", WRITER)


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Media form and fingerprint of every text.

    The media column is written to the shared folder; every other value is worked out from the stored bytes. Output: doc_id,
    sizes and digests, ``feature`` (a digest of the fingerprint), ``fingerprint`` (array of time-coded peak pairs, ascending)
    and, with ``keep_media``, the WAV bytes as ``media``.

    Edge cases: null and empty texts become one unit of 576 bytes 255; equal texts give equal values in every column but
    doc_id; null or repeated ids are kept; an empty table gives an empty result; columns other than doc_id and text are
    ignored. A WAV file holds 4 GB at most, and Spark's values 2 GB, so every text fits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
            cuts = [0, *np.flatnonzero(np.diff(size // GROUP_BYTES)) + 1, batch.num_rows] if batch.num_rows else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, z - a)
                rows = media_rows(part.column(2).to_pylist())
                columns = [part.column(0), part.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS))]
                yield pa.RecordBatch.from_arrays(columns + [part.column(2)] * keep_media, names)

    schema = SCHEMA + (", media binary" if keep_media else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return store_media(docs).mapInArrow(tidied(run), schema)
