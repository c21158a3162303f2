"""Operator 2: exact Jaccard join of word-shingle sets in a metric space.

Jaccard distance is a metric, so pivots can cut the documents into regions, and the triangle inequality says which documents
near a border must be seen from both sides.

* First regions. Documents without a common shingle are all at distance 1, and no document tells them apart as a pivot. So the
  first pivots are single shingles: a document lies in the regions of its rarest shingles. Two sets with a similarity of 0.8
  share at least ``8/18`` of their joint size, hence one of the first ``n - need + 1`` shingles in any common order; that is
  the window that replicates a document. The order is by a count sketch of the whole corpus, so that shingles which many
  documents share come last and open crowded regions only where sets hold little else.
* A region's lead is its smallest document; members within its window of size are compared with it. Members within the radius
  join its component, and a region of one component is settled.
* Crowded regions are cut by size (sets of a similarity of 0.8 differ by a quarter at most, so a member is also seen by the next
  band) and then into Voronoi cells around document pivots, again and again until a cell is small or no longer shrinks. The
  space of the cells is that of the parity bitmaps under Hamming distance: a metric, every member's distances to the pivots are
  exact in it, and no pair is farther apart there than its sets differ. A member goes to its nearest pivot and, by the
  triangle inequality, to every cell whose pivot is no farther than that by twice what a partner may differ. A first round
  compares members with their own pivots, a second one what is left of each cell.
* What the windows leave, pairs of different components, is compared exactly on the words.

Every window is a proven bound, so the join is exact. Equal sets are one class from the start. Sets are 64-bit shingle
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, tidied
from .components import connected_components
from .grouping import group_starts, whole_groups

WORDS = 5
#: Counters of the sketch and of one row of it on its way to be summed.
SKETCH_BITS, SKETCH_ROW_BITS = 20, 14
#: Shingles whose sketched count exceeds the mean counter by so many times its deviation are common.
COMMON_DEVIATIONS = 6.0
#: Members from which a region is cut into cells, members of a cell that are compared with each other, pivots of a cut, and
#: members of a region that is cut into bands of sizes, and of a tile: a band that no task should hold at once is dealt out in
#: pairs of blocks.
CROWDED, LEAF, PIVOTS, BANDED, TILE = 24, 64, 12, 256, 512
#: Rows of a shingle that many documents share are joined under so many salts.
SALTS = 32
MAX_BROADCAST_IDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest overlap with 100 * overlap >= 80 * union, that is 180 * overlap >= 80 * (n + m)."""
    return -(-80 * (n + m) // 180)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text; the whole sequence where it is shorter."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(tokens, dtype=object), categorize=False)
    k = min(words, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _scramble(x * _MIX + h[i : i + n])
    return np.unique(x)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        held: list[np.ndarray] = []
        for text in _texts(batch, 0):
            held.append(shingles(text) >> np.uint64(64 - SKETCH_BITS))
            if len(held) == 512:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
                held = []
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
    rows = counts.reshape(-1, 1 << SKETCH_ROW_BITS)
    for i in np.flatnonzero(rows.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rows[i].astype("<i8").tobytes()], pa.binary())], ["row", "counts"])


def _sum_sketch(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << SKETCH_ROW_BITS, np.int64)
    for c in frame["counts"]:
        total += np.frombuffer(c, "<i8")
    return pd.DataFrame({"row": [frame["row"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def common_levels(docs: DataFrame) -> np.ndarray:
    """Level of each counter: 0 for the crowd of rare shingles, higher by the logarithm of how far it stands out.

    A table of fixed size: ``2 ** SKETCH_BITS`` bytes on the driver and the executors, whatever the corpus.
    """
    partial = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidied(_sketch), "row int, counts binary")
    rows = partial.groupBy("row").applyInPandas(_sum_sketch, "row int, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        at = r["row"] << SKETCH_ROW_BITS
        counts[at : at + (1 << SKETCH_ROW_BITS)] = np.frombuffer(r["counts"], "<i8")
    middle = float(np.median(counts))
    above = np.maximum(counts - middle - COMMON_DEVIATIONS * np.sqrt(middle + 1.0), 0.0)
    return np.minimum(np.ceil(4 * np.log2(1.0 + above)), 255).astype(np.uint8)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of at least as many bits as the set has members (a power of two, 64 at least)."""
    bits = max(64, 1 << max(1, len(s) - 1).bit_length())
    flags = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(flags).tobytes()


def _signatures(levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = _texts(batch, 1)
            for at in range(0, len(texts), 512):
                n, key, maps, prefix, hot = [], [], [], [], []
                for text in texts[at : at + 512]:
                    s = shingles(text)
                    n.append(len(s))
                    key.append(hash_set(s))
                    maps.append(bitmap(s) if len(s) else b"")
                    lv = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.argsort(lv, kind="stable")[: len(s) - int(need(len(s), -(-80 * len(s) // 100))) + 1] if len(s) else np.empty(0, np.int64)
                    prefix.append(s[order].view(np.int64))
                    hot.append(lv[order] > 0)
                ends = pa.array(np.cumsum([0] + [len(p) for p in prefix]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + 512], pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(maps, pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefix), pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hot).astype(bool), pa.bool_())),
                    ],
                    ["doc_id", "n", "key", "bits", "prefix", "common"],
                )

    return run


def hash_set(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted (region, rep) rows, those of regions with two members or more, with their lead; common ones as they are."""
    for frame in whole_groups(batches, ["token", "part"], 20_000):
        starts = group_starts(frame, ["token", "part"])
        size = np.diff(starts)
        rep, n, part = frame["rep"].to_numpy(), frame["n"].to_numpy(), frame["part"].to_numpy()
        order = np.lexsort((rep, np.repeat(np.arange(len(size)), size)))
        lead = order[starts[:-1]]
        keep = np.repeat((size > 1) | (part[starts[:-1]] > 0), size)
        if keep.any():
            yield frame.assign(members=np.repeat(size, size), lead=np.repeat(rep[lead], size), lead_n=np.repeat(n[lead], size)).loc[keep]


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, b, na, nb, bits_a, bits_b): pairs that the bitmaps don't rule out."""
    for batch in batches:
        rows = len(batch)
        n = np.concatenate([batch["na"].to_numpy(), batch["nb"].to_numpy()])
        keep = possible(np.arange(rows), np.arange(rows, 2 * rows), n, [*batch["bits_a"], *batch["bits_b"]])
        yield batch.loc[keep, ["a", "b"]]


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Whether sets ``a[i]`` and ``b[i]`` can overlap enough.

    Members of one set only are at least the bits in which parities differ. Bitmaps of different sizes are compared at the
    smaller one: the bit index is the low end of the hash, so folding halves keeps parities.
    """
    out = np.zeros(len(a), bool)
    size = np.array([len(x) for x in bits])
    small = np.minimum(size[a], size[b]) if len(a) else np.empty(0, int)
    for width in np.unique(small):
        pairs = np.flatnonzero(small == width)
        used = np.unique(np.concatenate([a[pairs], b[pairs]]))
        folded = np.stack([_fold_bits(bits[i], width) for i in used.tolist()])
        place = np.zeros(len(bits), np.int64)
        place[used] = np.arange(len(used))
        for at in range(0, len(pairs), 16_384):
            p = pairs[at : at + 16_384]
            alone = np.bitwise_count(folded[place[a[p]]] ^ folded[place[b[p]]]).sum(axis=1, dtype=np.int64)
            out[p] = (n[a[p]] + n[b[p]] - alone) // 2 >= need(n[a[p]], n[b[p]])
    return out


def _fold_bits(bits: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(bits, np.uint8)
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed: less than half the size of their sets of hashes, which are quickly made again."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = _texts(batch, 1)
        for at in range(0, len(texts), 256):
            part = [pack(t.translate(_LOWER)) for t in texts[at : at + 256]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(part, pa.binary())], ["rep", "packed"])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    last: tuple[int, np.ndarray] | None = None
    for batch in batches:
        inter, na, nb = [], [], []
        for a, x, y in zip(batch["a"], batch["packed_a"], batch["packed_b"], strict=True):
            if last is None or last[0] != a:  # rows come sorted by a
                last = a, shingles(unpack(x))
            x, y = last[1], shingles(unpack(y))
            at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
            inter.append(int((y[at] == x).sum()) if len(y) else 0)
            na.append(len(x))
            nb.append(len(y))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "inter": inter, "na": na, "nb": nb})


class SetJoin:
    """The join's tables: documents, signatures of distinct sets, and what has been compared."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.spark = docs.sparkSession
        self.width = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def verify(self, pairs: DataFrame, label: str) -> DataFrame:
        """Those of the pairs ``(a, b)`` that link, compared exactly. Only the texts that pairs name are read again."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), f"{label}-ids")
        texts = self.docs.select(F.col("doc_id").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
        small = ids.count() <= MAX_BROADCAST_IDS
        named = texts.join(F.broadcast(ids) if small else ids, "rep")
        packed = materialize(named.mapInArrow(tidied(_packed), "rep long, packed binary"), f"{label}-texts", {"compression": "uncompressed"})
        one = pairs.join(packed.select(F.col("rep").alias("b"), F.col("packed").alias("packed_b")), "b")
        both = one.join(packed.select(F.col("rep").alias("a"), F.col("packed").alias("packed_a")), "a")
        done = both.select("a", "b", "packed_a", "packed_b").mapInPandas(tidied(_compare), "a long, b long, inter long, na long, nb long")
        done = materialize(done.where("100 * inter >= 80 * (na + nb - inter)").select("a", "b"), f"{label}-links")
        release(ids, packed)
        return done

    def prune(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Distinct pairs, smaller id first, that sizes and bitmaps leave possible."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one = pairs.hint("merge").join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
        two = one.hint("merge").join(reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
        two = two.where("100 * least(na, nb) >= 80 * greatest(na, nb)")
        return two.mapInPandas(tidied(_near), "a long, b long")


class Cells:
    """Pairs of one tile that can be similar, found in Voronoi cells of parity bitmaps under Hamming distance."""

    def __init__(self, rep, n, comp, host, block, bits: list[bytes]):
        self.rep, self.n, self.comp, self.host, self.block, self.bits = rep, n, comp, host, block, bits
        self.found: list[np.ndarray] = []

    def pairs(self, pivots_only: bool) -> np.ndarray:
        """Rows (a, b) of ids, the smaller first; with ``pivots_only`` members with their nearest pivots."""
        widths = np.array([len(b) for b in self.bits])
        for width in np.unique(widths):
            index = np.flatnonzero(widths >= width)  # a pair is compared at the width of its narrower bitmap
            self.narrow = np.zeros(len(widths), bool)
            self.narrow[widths == width] = True
            self.space = np.zeros((len(widths), width // 8), np.uint64)
            self.space[index] = np.stack([_fold_bits(self.bits[i], width).view(np.uint64) for i in index.tolist()])
            self._cut(index, pivots_only)
        if not self.found:
            return np.empty((0, 2), np.int64)
        ids = self.rep[np.concatenate(self.found)]
        return np.unique(np.sort(ids, axis=1), axis=0)

    def _cut(self, index: np.ndarray, pivots_only: bool) -> None:
        work = [index]
        while work:
            cell = work.pop()
            if len(np.unique(self.comp[cell])) < 2:
                continue
            if len(cell) <= LEAF and not pivots_only:
                self._compare(cell)
                continue
            pivots = cell[np.linspace(0, len(cell) - 1, min(PIVOTS, len(cell))).astype(np.int64)]
            far = np.stack([np.bitwise_count(self.space[cell] ^ self.space[p]).sum(axis=1, dtype=np.int64) for p in pivots], axis=1)
            own = far.argmin(axis=1)
            if pivots_only:
                self._keep(cell, pivots[own])
                if len(cell) <= LEAF:
                    continue
            # a partner differs from a set of n members by a quarter of n at most
            window = far[np.arange(len(cell)), own] + 2 * (self.n[cell] // 4)
            parts = [cell[(own == k) | (far[:, k] <= window)] for k in range(len(pivots)) if (own == k).any()]
            if sum(len(p) ** 2 for p in parts) > 0.75 * len(cell) ** 2:  # all at much the same distance: no pivot tells them apart
                if not pivots_only:
                    self._compare(cell)
                continue
            work.extend(p for p in parts if len(p) > 1)

    def _compare(self, cell: np.ndarray) -> None:
        cell = cell[np.argsort(self.n[cell], kind="stable")]
        for at in range(0, len(cell), 256):
            left = cell[at : at + 256]
            for other in range(at, len(cell), 256):
                right = cell[other : other + 256]
                if 80 * self.n[right[0]] > 100 * self.n[left[-1]]:
                    break
                a, b = np.nonzero(np.triu(np.ones((len(left), len(right)), bool), 1) if at == other else self.comp[left][:, None] != self.comp[right][None, :])
                self._keep(left[a], right[b])

    def _keep(self, a: np.ndarray, b: np.ndarray) -> None:
        n, m = self.n[a], self.n[b]
        ok = (self.comp[a] != self.comp[b]) & (100 * np.minimum(n, m) >= 80 * np.maximum(n, m)) & (self.narrow[a] | self.narrow[b])
        ok &= (self.host[a] | self.host[b]) & ((self.block[a] != self.block[b]) | (self.block[a] < 0))
        a, b = a[ok], b[ok]
        for at in range(0, len(a), 16_384):
            x, y = a[at : at + 16_384], b[at : at + 16_384]
            alone = np.bitwise_count(self.space[x] ^ self.space[y]).sum(axis=1, dtype=np.int64)
            near = (self.n[x] + self.n[y] - alone) // 2 >= need(self.n[x], self.n[y])
            if near.any():
                self.found.append(np.stack([x[near], y[near]], axis=1))


def _pairs_in_cells(pivots_only: bool):
    """Pairs of different components that sizes and bitmaps leave possible, of sorted tiles; small ones many at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["region", "band", "i", "j"]
        for frame in whole_groups(batches, key, 10_000):
            starts = group_starts(frame, key)
            rep, n, comp, host, block, i, j = (frame[c].to_numpy() for c in ("rep", "n", "comp", "host", "block", "i", "j"))
            bits = frame["bits"].to_list()
            size = np.diff(starts)
            plain = (size <= CROWDED) & (i[starts[:-1]] == j[starts[:-1]])
            found = []
            if not pivots_only and plain.any():
                pairs = np.concatenate([p for _, p in _pairs_of_small(starts[:-1], size, plain, n, comp)])
                pairs = pairs[host[pairs[:, 0]] | host[pairs[:, 1]]]
                found.append(rep[pairs[possible(pairs[:, 0], pairs[:, 1], n, bits)]])
            for lo, hi in zip(starts[:-1][~plain].tolist(), starts[1:][~plain].tolist(), strict=True):
                if host[lo:hi].any():
                    part = slice(lo, hi)
                    across = block[part] if i[lo] != j[lo] else np.full(hi - lo, -1)
                    found.append(Cells(rep[part], n[part], comp[part], host[part], across, bits[part]).pairs(pivots_only))
            if found and sum(map(len, found)):
                pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _pairs_of_small(first: np.ndarray, size: np.ndarray, pick: np.ndarray, n: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each two members of picked groups with different components and like sizes; groups of one size together."""
    yield 0, np.empty((0, 2), np.int64)
    for m in np.unique(size[pick & (size > 1)]).tolist():
        rows = first[pick & (size == m)]
        x, y = (rows[:, None] + k[None, :] for k in np.triu_indices(m, 1))
        ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= 80 * np.maximum(n[x], n[y]))
        yield m, np.stack([x[ok], y[ok]], axis=1)


def _open_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted regions, the members that may still have a partner of another component.

    Regions are named by what their members sum up to, so that the shingles of one shared passage name one region: rows that
    fall together are the same work.
    """
    for frame in whole_groups(batches, ["token"], 20_000):
        starts = group_starts(frame, ["token"])
        size = np.diff(starts)
        rep, n, comp = (frame[c].to_numpy() for c in ("rep", "n", "comp"))
        if not len(rep):
            continue
        mixed = np.maximum.reduceat(comp, starts[:-1]) != np.minimum.reduceat(comp, starts[:-1])
        keep = np.repeat(mixed & (size > CROWDED), size)
        for _, pairs in _pairs_of_small(starts[:-1], size, mixed & (size <= CROWDED), n, comp):
            keep[pairs.ravel()] = True
        if keep.any():
            name = np.add.reduceat(_scramble(rep.view(np.uint64)), starts[:-1]) ^ _scramble(size.astype(np.uint64))
            yield pd.DataFrame({"region": np.repeat(name.view(np.int64), size)[keep], "rep": rep[keep], "members": np.repeat(size, size)[keep]})


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingle sets.

    Output, one row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Edge cases: null and empty texts, and texts without words, have no shingles, link with nothing and are their own
    component; texts of fewer than five words are one shingle; equal texts link whatever their length; repeated rows and ids
    are kept, a repeated id linking its texts' components; a null doc_id gets a null component and links nothing; a doc_id
    that is no integer is an error; an empty table gives an empty result; other columns are ignored.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    join = SetJoin(docs)
    levels = spark.sparkContext.broadcast(common_levels(docs))  # 2 ** SKETCH_BITS bytes
    signed = materialize(
        docs.mapInArrow(tidied(_signatures(levels)), "doc_id long, n long, key binary, bits binary, prefix array<long>, common array<boolean>"), "sets"
    )
    filled = signed.where("doc_id is not null and n > 0").select("doc_id", "key")
    # a repeated id may stand for several sets: the join works on ids only where each is one row
    if not filled.groupBy("doc_id").count().where("count > 1").isEmpty():
        release(signed)
        return _with_row_ids(docs)
    classes = materialize(filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "set-classes")
    copies = filled.join(classes.where("copies > 1"), "key").where("doc_id <> rep").select(F.col("doc_id").alias("rep"))
    copies = materialize(copies, "set-copies")
    few = copies.count() <= MAX_BROADCAST_IDS
    reps = signed.where("doc_id is not null and n > 0").withColumnRenamed("doc_id", "rep").join(F.broadcast(copies) if few else copies, "rep", "left_anti")

    # first regions: single-shingle pivots; common ones are spread by document
    rows = reps.select("rep", "n", F.explode(F.arrays_zip("prefix", "common")).alias("p"))
    spread = F.when(F.col("p.common"), 1 + F.pmod(F.xxhash64("rep"), F.lit(1024))).otherwise(0).cast("int")
    rows = rows.select(F.col("p.prefix").alias("token"), spread.alias("part"), "rep", "n").repartition(join.width, "token", "part")
    region = "token long, part int, rep long, n long, members long, lead long, lead_n long"
    regions = materialize(rows.sortWithinPartitions("token", "part").mapInPandas(tidied(_shared), region), "regions")
    slim = materialize(reps.select("rep", "n", "bits"), "bitmaps")
    ids = materialize(signed.select("doc_id", "n", "key"), "set-keys")
    release(signed, copies)
    spread_rows = regions.where("part > 0").select("token", "part", "rep", "n", F.pmod("part", F.lit(SALTS)).alias("salt"))
    head = spread_rows.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("rep", "n")).alias("lead")).where("members > 1")
    head = head.select("token", "members", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wide = materialize(spread_rows.hint("merge").join(head, ["token", "salt"]).select("token", "part", "rep", "n", "members", "lead", "lead_n"), "wide-regions")
    members = regions.where("part = 0").unionByName(wide)

    # every member of a region with its lead
    near_lead = members.where("rep <> lead and 100 * least(n, lead_n) >= 80 * greatest(n, lead_n)").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    pairs = materialize(join.prune(near_lead, slim), "lead-pairs")
    links = [join.verify(pairs, "lead")]
    release(pairs)
    found = connected_components(links[0], "sets-lead")

    # what a region still holds of different components; a region of two is done with its lead
    def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
        side = comps.select(F.col("node").alias("rep"), "component")
        side = F.broadcast(side) if comps.count() <= MAX_BROADCAST_IDS else side
        return rows.join(side, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")

    open_ = with_components(regions.where("part = 0 and members > 2").select("token", "rep", "n"), found)
    open_ = open_.repartition(join.width, "token").sortWithinPartitions("token").mapInPandas(tidied(_open_regions), "region long, rep long, members long")
    open_ = open_.distinct().unionByName(wide.where("members > 2").select(F.col("token").alias("region"), "rep", "members"))
    tiles = materialize(_banded(open_.hint("merge").join(slim, "rep")), "open-regions")
    for pivots_only in (True, False):
        some = tiles.where(f"members > {CROWDED}") if pivots_only else tiles
        dealt = with_components(some, found).repartition(join.width, "region", "band", "i", "j").sortWithinPartitions("region", "band", "i", "j")
        pairs = materialize(dealt.mapInPandas(tidied(_pairs_in_cells(pivots_only)), "a long, b long").distinct(), "cell-pairs")
        links.append(join.verify(pairs, "cells"))
        release(pairs)
        if pivots_only:
            release(found)
            found = connected_components(links[0].union(links[1]), "sets-pivots")
    release(tiles, regions, wide, slim, found)
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    found = connected_components(every, "sets-last")
    release(*links)

    comp = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = ids.join(comp, "key", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, F.col("doc_id")).alias("component_id"))


def _banded(members: DataFrame) -> DataFrame:
    """Members of regions, those of large ones in their band of sizes and the next one, in blocks that pair up to tiles.

    Bands grow by more than a quarter, so a set and one that is at least 0.8 of its size are in one band or in neighbours.
    """
    large = F.col("members") > BANDED
    band = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26)))).otherwise(0).cast("int")
    both = members.withColumn("own", band).withColumn("next", F.explode(F.when(large, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = both.withColumn("band", F.col("own") + F.col("next")).withColumn("host", F.col("next") == 0).withColumn("blocks", F.ceil(F.col("members") / TILE).cast("int"))
    both = both.withColumn("block", F.pmod(F.xxhash64("rep", "region"), F.col("blocks")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda m: F.struct(F.least(m, F.col("block")).alias("i"), F.greatest(m, F.col("block")).alias("j")))
    tiled = both.withColumn("t", F.explode(mates))
    return tiled.select("region", "members", "band", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "rep", "n", "bits", "host", "block")


def _with_row_ids(docs: DataFrame) -> DataFrame:
    """Ids that stand for several texts: join under row numbers, then link the rows of one id."""
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    by_row = materialize(jaccard_components(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row"), "by-row")
    named = rows.select("row", "doc_id").join(by_row, "row")
    same = named.where("doc_id is not null").select("doc_id", F.col("component_id").alias("b")).distinct()
    joined = connected_components(same.join(same.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b"), "row-ids")
    whole = named.join(joined.withColumnRenamed("node", "component_id"), "component_id", "left").withColumn("c", F.coalesce("component", "component_id"))
    least = whole.groupBy("c").agg(F.min("doc_id").alias("least"))
    return whole.join(least, "c").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))
