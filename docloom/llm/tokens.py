"""Operator 5: token ids as Parquet list columns.

Ids are written by Spark's Parquet writer: version 2 pages (delta encoding for ids and offsets, dictionaries where they are
smaller), row groups of a set size and page indexes, so that a reader that wants only ``n_tokens`` never touches ids, and one
that wants a range of documents reads only the pages of that range.

The text is dealt out once, by range of doc_id; each task then holds a consecutive run of documents and writes it in order.
Offsets need the sums of the tasks before, one number for each file.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMORIES, materialize, tidied

END_ID = 1
END_BYTES = END_ID.to_bytes(4, "little")
#: Longer chunks than this are not remembered.
LONG_CHUNK = 200
#: Characters of chunks, and of their pieces, whose ids a Python worker remembers; a memory is emptied when full.
CACHE_CHARS = 4_000_000
# The text preparation that chunks are independent under.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PREPARATION = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


class WordEncoder:
    """Ids of whole texts by one tokenizers file, remembering what each white-space-free chunk encodes to.

    Pre-tokenization never joins characters across white space, so the ids of a text are those of its chunks in order. The
    library's BPE model encodes every run of letters, digits or punctuation that is new; chunks with special-token strings
    or unprintable characters go through its whole pipeline.
    """

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        #: A file that prepares text another way goes through the library whole, text by text.
        self.by_chunk = all(said.get(k) == v for k, v in PREPARATION.items())
        self.chunks: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.limit, self.held = cache_chars, 0
        self.split = regex.compile(SPLIT).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.byte_chars = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.byte_chars)
        known = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        self.held += len(piece)
        return known

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not chunk.isprintable():
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        plain = chunk.lower() if chunk.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])
        pieces, get = self.pieces, self.pieces.get
        if plain.isalpha():
            return get(plain) or self._piece(plain)
        if plain[:-1].isalpha() and plain[-1] in ".,;:!?":
            return (get(plain[:-1]) or self._piece(plain[:-1])) + (get(plain[-1]) or self._piece(plain[-1]))
        return b"".join([pieces[x] if x in pieces else self._piece(x) for x in self.split(plain)])

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, the end id last."""
        if not self.by_chunk:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + END_BYTES
        chunks, out = self.chunks, []
        for chunk in text.replace("\n", " ").split(" "):
            known = chunks.get(chunk)
            if known is None:
                if self.held > self.limit:
                    chunks.clear()
                    self.pieces.clear()
                    chunks[""], self.held = b"", 0
                known = self._chunk(chunk)
                if len(chunk) <= LONG_CHUNK:
                    chunks[chunk] = known
                    self.held += len(chunk)
            out.append(known)
        out.append(END_BYTES)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}
MEMORIES[__name__] = _ENCODERS


def encoder(path: str) -> WordEncoder:
    """One encoder, with its memory, for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, row = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                place = [pa.array(np.full(len(ids), task, np.int32)), pa.array(np.arange(row, row + len(ids)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), lists, *place], ["doc_id", "n_tokens", "ids", "part", "row"])
                row += len(ids)

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, label: str = "tokens") -> DataFrame:
    """Encode every text and write ``(doc_id, n_tokens, ids, part, row)`` in ascending doc_id order; returns the files as a table.

    ``part`` and ``row`` are the place of an entry: the parts follow each other, and the rows of a part. Entries of one id are
    in the order of a hash of their texts, so that an id that many rows share is no single part.
    """
    spark = docs.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = texts.repartitionByRange(width, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return materialize(ordered.mapInArrow(tidied(_encode(tokenizer_path)), "doc_id long, n_tokens int, ids array<int>, part int, row long"), label, WRITER)


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files and describe each document from what is read back: doc_id, start, n_tokens, ids_crc32.

    Edge cases: null and empty texts are the end id alone; null ids come first; repeated ids keep one entry each, ordered by
    a hash of the text; an empty table writes and returns no rows; other columns are ignored, whatever their names.
    Special-token strings in a text become their ids, as the library does by default.
    """
    return digests_of(write_tokens(docs, tokenizer_path))


def digests_of(tokens: DataFrame) -> DataFrame:
    """Offsets and id checksums of a token table; both in one pass, in the order of parts and rows."""
    spark = tokens.sparkSession
    # one row a part: as many as there were write tasks, however many documents
    sums = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    base = spark.createDataFrame(starts, "part int, base long")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_tokens"), pa.array(crc, pa.int64()), b.column("part"), b.column("row")],
                ["doc_id", "n_tokens", "ids_crc32", "part", "row"],
            )

    done = tokens.mapInArrow(tidied(digest), "doc_id long, n_tokens int, ids_crc32 long, part int, row long")
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = done.join(F.broadcast(base), "part").withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("base"))
    return placed.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
