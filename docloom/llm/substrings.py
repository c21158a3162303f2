"""Operator 4: exact removal of repeated 100-byte strings by blockwise, difference-cover suffix sorting.

A string of 100 bytes is repeated where it also starts earlier. Comparing all suffixes of the corpus would move every byte
many times; three facts bound the work.

* Buckets. Equal strings have the same minimizer: the 16-byte gram with the smallest hash, the leftmost of equals, at the same
  place. So suffixes fall into buckets by their minimizer's gram, and a bucket with one occurrence needs no sorting. One short
  row per minimizer (every 43 bytes or so) is dealt out to find the buckets that repeat. A count sketch of fixed size says
  which grams are crowded: they are known to repeat, so their rows are dealt out at random and nobody counts them.
* Blocks. Only the text around minimizers of repeated buckets is dealt out, by bucket, and sorted a block of whole buckets at a
  time. Equal stretches around a minimizer are settled by their first; what differs is sorted. Ties are resolved by the ranks of
  the block's difference-cover sample, which are computed once for the block: of any two suffixes with minimizers at the same
  residue, a shift below ``PERIOD`` leads to two ranked ones. Suffixes are compared up to that shift (12 bytes at most) before.
  Memory is that of a block. Text that repeats throughout has several times its bytes in contexts, so they are dealt out in
  rounds, by gram, and the shuffle files of one round go before the next.
* Crowded buckets are cut by place into sub-buckets, so that neither a common string nor one long document is a block of its
  own. A string that repeats within its sub-bucket is settled there; the first of each goes on to a second round, dealt out by
  its content.

Copies of a whole document are settled by digest before any of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tidied
from .grouping import group_starts, whole_groups
from .ngram_join import MAX_BROADCAST_IDS, SKETCH_BITS, SKETCH_ROW_BITS, _scramble, _sum_sketch

LENGTH, GRAM = 100, 16
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: A perfect difference set: every non-zero residue is one difference of two members, exactly once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of text hashed at once (arrays of so many words stay in a core's cache) and joined for it, occurrences in a sub-bucket and
#: contexts in a block, about.
PIECE, PORTION, SUB_BUCKET, BLOCK_CONTEXTS = 1 << 15, 1 << 20, 2_000, 6_000
#: Classes of equal rows up to which a class and 40 bits of a key are one number.
CLASSES = 1 << 24
#: Occurrences above the median counter from which a gram is dealt out at random.
CROWD = 2 * SUB_BUCKET
#: Bytes of a context, about; one round deals out contexts of as many bytes as the documents have.
CONTEXT_BYTES = 150
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _words(buf: np.ndarray, at: np.ndarray | None = None, big: bool = False) -> np.ndarray:
    """The 8 bytes at each position (or at the given ones) as unsigned numbers."""
    view = np.ndarray((len(buf) - 7,), ">u8" if big else "<u8", buf, 0, (1,))
    return (view if at is None else view[at]).astype(np.uint64)


def minimizers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers of all windows: start, gram hash, and first and last window start that each one stands for."""
    return minimizers_of([text])[1:]


def minimizers_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers of all windows of some texts: the text's number, then what ``minimizers`` gives."""
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    out, a = [], 0
    while a < len(texts):  # short texts are joined, as a few calls for each of them take longer than their bytes
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + PORTION, "right")))
        which, *rest = _joined_minimizers(b"".join(texts[a:z]), size[a:z])
        out.append((which + a, *rest))
        a = z
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(np.uint64), none, none)


def _joined_minimizers(joined: bytes, size: np.ndarray) -> tuple[np.ndarray, ...]:
    opens, n = np.cumsum(size) - size, max(0, len(joined) - LENGTH + 1)
    buf, low = np.frombuffer(joined, np.uint8), np.uint64((1 << 24) - 1)
    starts, grams, firsts = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        w = _words(buf[lo : hi + LENGTH - 1])
        h = _scramble(_scramble(w[:-8] + np.uint64(0x9E3779B97F4A7C15)) ^ w[8:])
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= SPAN:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < SPAN:
            key = np.minimum(key[: -(SPAN - span)], key[SPAN - span :])
        at = (key & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        new[opens[slice(*np.searchsorted(opens, (lo, hi)))] - lo] = True
        cut = np.flatnonzero(new)
        starts.append(at[cut] + lo)
        grams.append(h[at[cut]])
        firsts.append(cut + lo)
    start, gram, first = np.concatenate(starts), np.concatenate(grams), np.concatenate(firsts)
    which = np.searchsorted(opens, first, "right") - 1
    new = np.ones(len(first), bool)  # pieces end anywhere
    new[1:] = (start[1:] != start[:-1]) | (which[1:] != which[:-1])
    start, gram, first, which = start[new], gram[new], first[new], which[new]
    open_ = opens[which]
    final = open_ + size[which] - LENGTH  # a text's last window; later ones reach into the next text
    last = np.minimum(np.append(first[1:] - 1, n - 1)[: len(first)], final)
    own = first <= final
    open_ = open_[own]
    return which[own], start[own] - open_, gram[own], first[own] - open_, last[own] - open_


def _bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _counter(grams: np.ndarray) -> np.ndarray:
    """The sketch's counter of each gram: minimizers have small hashes, which scrambled again fill all counters alike."""
    return (_scramble(grams ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        counts += np.bincount(_counter(minimizers_of(_bytes(batch, 0))[2]), minlength=len(counts))
    rows = counts.reshape(-1, 1 << SKETCH_ROW_BITS)
    for i in np.flatnonzero(rows.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rows[i].astype("<i8").tobytes()], pa.binary())], ["row", "counts"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counters of a sketch of fixed size: an upper bound of how often a gram occurs, the same for all its occurrences."""
    rows = docs.select("text").mapInArrow(tidied(_sketch), "row int, counts binary").groupBy("row").applyInPandas(_sum_sketch, "row int, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        at = r["row"] << SKETCH_ROW_BITS
        counts[at : at + (1 << SKETCH_ROW_BITS)] = np.frombuffer(r["counts"], "<i8")
    return np.maximum(counts - int(np.median(counts)), 0).astype(np.uint32)


def _grams(counts):
    """A row for each minimizer: gram, its place, the bytes before and after that its windows reach, and for crowded grams the
    number of sub-buckets and a part at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for batch in batches:
            which, at, h, first, last = minimizers_of(_bytes(batch, 1))
            d = batch.column(0).to_numpy()[which]
            often = known[_counter(h)].astype(np.int64)
            crowded = often > CROWD
            part = np.where(crowded, 1 + (_scramble(d.view(np.uint64) ^ (at.view(np.uint64) << np.uint64(40))) & np.uint64(1023)).astype(np.int64), 0)
            subs = np.where(crowded, -(-often // SUB_BUCKET), 0)
            columns = [pa.array(h.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(d), pa.array(at)]
            columns += [pa.array(((at - first) << 8 | (at - last)).astype(np.int32)), pa.array(subs.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "part", "doc_id", "start", "span", "subs"])

    return run


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["gram", "part"], 20_000):
        starts = group_starts(frame, ["gram", "part"])
        size = np.diff(starts)
        crowded = frame["part"].to_numpy()[starts[:-1]] > 0
        keep = np.repeat((size > 1) | crowded, size)
        if keep.any():
            counted = np.repeat(np.where(crowded, 0, -(-size // SUB_BUCKET)), size)
            frame["subs"] = np.where(counted > 0, counted, frame["subs"].to_numpy()).astype(np.int32)
            yield frame.loc[keep, ["gram", "doc_id", "start", "span", "subs"]]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, sub, doc_id, first, anchor, context): the text that the windows of each listed minimizer span."""
    for batch in batches:
        ids, texts, listed = batch.column(0).to_numpy(), _bytes(batch, 1), batch.column(2)
        ends = listed.offsets.to_numpy()
        own = slice(ends[0], ends[-1])
        fields = [listed.values.field(f).to_numpy(zero_copy_only=False)[own] for f in ("gram", "start", "span", "subs")]
        which = np.repeat(np.arange(len(texts)), np.diff(ends))
        for lo in range(0, len(which), 4_096):  # rows of several documents: a batch for each would be a dozen rows
            part = slice(lo, lo + 4_096)
            text, (gram, at, span, subs) = which[part], (f[part] for f in fields)
            doc, first, end = ids[text], at - (span >> 8), at - (span & 255) + LENGTH
            mixed = _scramble(_scramble(at.astype(np.uint64)) ^ doc.view(np.uint64))
            sub = (mixed % np.maximum(subs, 1).astype(np.uint64)).astype(np.int32)
            context = [texts[k][x:y] for k, x, y in zip(text.tolist(), first.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), pa.array(sub), pa.array(subs), pa.array(doc), pa.array(first), pa.array((span >> 8).astype(np.int32)), pa.array(context, pa.binary())],
                ["gram", "sub", "subs", "doc_id", "first", "anchor", "context"],
            )


def _ordered(first: np.ndarray, *later) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``first``, then by each of ``later`` (functions of rows, to 40 bits); and which rows differ from those before them.

    Only rows that are still equal are sorted on, by single numbers that lead with their class.
    """
    order = np.argsort(first)
    keys = first[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    for key in later:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows, classes = order[at], np.cumsum(new[at])
        keys = key(rows)
        if classes[-1] < CLASSES:
            keys |= classes.astype(np.uint64) << np.uint64(40)
            by = np.argsort(keys)
        else:
            by = np.lexsort((keys, classes))
        keys = keys[by]
        order[at] = rows[by]
        new[at[1:]] |= keys[1:] != keys[:-1]
    return order, new


def _five(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 5 bytes at each position as unsigned numbers."""
    return _words(text, at, big=True) >> np.uint64(24)


_SLOT = np.full(PERIOD, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])


def cover_ranks(text: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the cover sample of a block by the next 4 * PERIOD bytes and two, in order of position: ``6 * (p // 31) + slot``."""
    rows = size // PERIOD
    sample = (np.arange(rows)[:, None] * PERIOD + np.array(COVER)).ravel()
    order, new = _ordered(_words(text, sample, big=True), *(lambda rows, k=k: _five(text, sample[rows] + k) for k in range(8, PERIOD, 5)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    step = len(COVER)
    for times in (1, 2):  # PERIOD bytes and two, then twice and four times as many
        later = np.zeros_like(rank)
        later[: -step * times] = rank[step * times :]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + later, return_inverse=True)[1].astype(np.int64)
    return rank


def sort_block(contexts: list[bytes], anchor: np.ndarray, bucket: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which windows of a block also start earlier: context of each window, its place in it, and whether it is repeated."""
    size = np.array([len(c) for c in contexts])
    slot = ((size + PERIOD - 1) // PERIOD + 1) * PERIOD
    opens = np.cumsum(slot) - slot
    lead = -anchor % PERIOD  # minimizers stand at multiples of PERIOD
    total = int(slot.sum())
    whole = bytearray(total + 8 * PERIOD)
    base = opens + lead
    for c, at in zip(contexts, base.tolist(), strict=True):
        whole[at : at + len(c)] = c
    text = np.frombuffer(whole, np.uint8)
    ranks = cover_ranks(text, total + 4 * PERIOD)

    count = size - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = base[owner] + inner
    place = bucket[owner] * 256 + (anchor[owner] - inner)  # equal strings agree on bucket and distance to the minimizer
    shifted = at + _SHIFT[at % PERIOD]
    tie = ranks[(shifted // PERIOD) * len(COVER) + _SLOT[shifted % PERIOD]].astype(np.uint64)
    lead = place.astype(np.uint64) << np.uint64(40) | _five(text, at)
    order, new = _ordered(lead, *(lambda rows, k=k: _five(text, at[rows] + k) for k in range(5, int(_SHIFT.max()), 5)), lambda rows: tie[rows])

    same = ~new  # neighbours of one place, equal up to the shift and of equal ranks; of the others, those equal up to LENGTH
    hit = np.flatnonzero(new)[1:]
    hit = hit[place[order[hit]] == place[order[hit - 1]]]
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        hit = hit[_words(text, at[order[hit]] + k) == _words(text, at[order[hit - 1]] + k)]
    same[hit] = True
    when = (np.unique(doc, return_inverse=True)[1][owner].astype(np.int64) << 40) | (first[owner] + inner)
    opens_class = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(when[order], opens_class) if len(order) else when
    repeated = np.empty(len(order), bool)
    repeated[order] = when[order] > np.repeat(earliest, np.diff(np.r_[opens_class, len(order)]))
    return owner, inner, repeated


def _firsts(bucket: np.ndarray, anchor: np.ndarray, contexts: list[bytes], doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are the earliest of their equals, and which of these stand in a bucket of different ones."""
    keep = np.zeros(len(contexts), bool)
    seen: set[tuple[int, int, bytes]] = set()
    for i in np.lexsort((first, doc)).tolist():
        key = (int(bucket[i]), int(anchor[i]), contexts[i])
        if key not in seen:
            seen.add(key)
            keep[i] = True
    return keep, keep & (np.bincount(bucket[keep], minlength=int(bucket[-1]) + 1)[bucket] > 1)


def _sort_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of repeated window starts; of cut buckets also the windows that are first in their sub-bucket."""
    key = ["gram", "sub"]
    for frame in whole_groups(batches, key, BLOCK_CONTEXTS):
        starts = group_starts(frame, key)
        at = 0
        while at < len(starts) - 1:  # blocks of whole buckets
            end = at + 1
            while end < len(starts) - 1 and starts[end + 1] - starts[at] <= BLOCK_CONTEXTS:
                end += 1
            part = frame.iloc[starts[at] : starts[end]]
            bucket = np.repeat(np.arange(end - at), np.diff(starts[at : end + 1]))
            contexts, anchor = part["context"].to_list(), part["anchor"].to_numpy().astype(np.int64)
            doc, first, cut_up = part["doc_id"].to_numpy(), part["first"].to_numpy(), part["subs"].to_numpy() > 1
            count = np.array([len(c) for c in contexts]) - LENGTH + 1
            keep, mixed = _firsts(bucket, anchor, contexts, doc, first)
            if not keep.all():  # all windows of a later equal are repeated
                yield pd.DataFrame({"doc_id": doc[~keep], "start": first[~keep], "n": count[~keep], "digest": None})
            open_owner, open_inner = [], []
            alone = np.flatnonzero(keep & ~mixed & cut_up)
            if len(alone):
                open_owner.append(np.repeat(alone, count[alone]))
                open_inner.append(np.arange(count[alone].sum()) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone]))
            pick = np.flatnonzero(mixed)
            if len(pick):
                owner, inner, repeated = sort_block([contexts[i] for i in pick.tolist()], anchor[pick], bucket[pick], doc[pick], first[pick])
                owner = pick[owner]
                cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (repeated[1:] != repeated[:-1])])
                length = np.diff(np.r_[cut, len(owner)])
                hit = repeated[cut]
                o, i = owner[cut[hit]], inner[cut[hit]]
                if len(o):
                    yield pd.DataFrame({"doc_id": doc[o], "start": first[o] + i, "n": length[hit], "digest": None})
                fresh = np.flatnonzero(~repeated & cut_up[owner])
                open_owner.append(owner[fresh])
                open_inner.append(inner[fresh])
            if open_owner:
                owner, inner = np.concatenate(open_owner), np.concatenate(open_inner)
                for a in range(0, len(owner), 50_000):
                    o, i = owner[a : a + 50_000], inner[a : a + 50_000]
                    digests = [hashlib.blake2b(contexts[x][y : y + LENGTH], digest_size=16).digest() for x, y in zip(o.tolist(), i.tolist(), strict=True)]
                    yield pd.DataFrame({"doc_id": doc[o], "start": first[o] + i, "n": 1, "digest": digests})
            at = end


def removed_spans(starts: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, from runs of repeated window starts."""
    spans: list[list[int]] = []
    for s, n in sorted(zip(starts, lengths, strict=True)):
        end = s + n - 1 + LENGTH
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([s, end])
    return [(a, b) for a, b in spans]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, runs = batch.column(0).to_pylist(), _bytes(batch, 1), batch.column(2).to_pylist()
        removed, n_spans, kept_text, sha = [], [], [], []
        for text, own in zip(texts, runs, strict=True):
            spans = removed_spans([r["start"] for r in own], [r["n"] for r in own])
            kept = b"".join(text[a:b] for a, b in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(text)], strict=True))
            removed.append(len(text) - len(kept))
            n_spans.append(len(spans))
            kept_text.append(kept)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(kept_text, pa.binary())],
            ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte that a 100-byte string covers which also starts earlier.

    Output, one row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, ``kept`` (the
    remaining bytes; null where nothing was removed or nothing is left).

    Edge cases: null and empty texts have no bytes; texts under 100 bytes stay whole; a null doc_id comes before all others;
    rows of one doc_id are ordered by text and compared like other documents; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    signed = materialize(signed, "byte-digests")
    ids = signed.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    if ids["rows"] > ids["ids"] or not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _with_ordered_rows(docs, keep_bytes)
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    firsts = signed.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = materialize(signed.join(firsts, "sha").where("doc_id <> first").select("doc_id"), "byte-copies")
    few = copies.count() <= MAX_BROADCAST_IDS
    single = docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")

    counts = docs.sparkSession.sparkContext.broadcast(gram_counts(single))  # 4 * 2 ** SKETCH_BITS bytes
    grams = single.mapInArrow(tidied(_grams(counts)), "gram long, part int, doc_id long, start long, span int, subs int")
    grams = grams.repartition(width, "gram", "part").sortWithinPartitions("gram", "part")
    repeated = materialize(grams.mapInPandas(tidied(_repeated), "gram long, doc_id long, start long, span int, subs int"), "repeated-grams")
    size = signed.agg(F.sum("n_bytes")).first()[0] or 0
    rounds = max(1, -(-repeated.count() * CONTEXT_BYTES // max(1, size)))
    sorted_ = [_sorted_round(single, repeated, r, rounds, width) for r in range(rounds)]
    release(repeated)

    every = reduce(DataFrame.union, sorted_)
    runs = every.where("digest is null").select("doc_id", "start", "n")
    rivals = every.where("digest is not null").select("digest", F.struct("doc_id", "start").alias("at"))
    best = rivals.groupBy("digest").agg(F.min("at").alias("best"), F.count("*").alias("c")).where("c > 1")
    later = rivals.join(best, "digest").where("at <> best").select("at.doc_id", "at.start", F.lit(1).cast("long").alias("n"))
    by_doc = materialize(runs.union(later).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")
    release(*sorted_)
    few = by_doc.agg(F.sum(F.size("runs") + 2)).first()[0] or 0
    cut = docs.join(F.broadcast(by_doc) if few <= MAX_BROADCAST_IDS else by_doc, "doc_id").select("doc_id", "text", "runs")
    cut = cut.mapInArrow(tidied(_cut), "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not keep_bytes:
        cut = cut.drop("kept")

    gone = signed.join(copies, "doc_id", "left_semi").select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"),
        *([F.lit(None).cast("binary").alias("kept")] if keep_bytes else []),
    )
    rest = signed.join(copies, "doc_id", "left_anti").join(cut, "doc_id", "left")
    zero = F.lit(0).cast("long")
    rest = rest.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if keep_bytes else []),
    )
    return rest.union(gone)


def _sorted_round(docs: DataFrame, repeated: DataFrame, r: int, rounds: int, width: int) -> DataFrame:
    """The buckets of one round, sorted. Equal strings agree on their gram and so on their round."""
    own = repeated.where(F.pmod("gram", F.lit(rounds)) == r)
    by_doc = own.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "start", "span", "subs")).alias("grams"))
    held = docs.hint("merge").join(by_doc, "doc_id").select("doc_id", "text", "grams")
    contexts = held.mapInArrow(tidied(_contexts), "gram long, sub int, subs int, doc_id long, first long, anchor int, context binary")
    contexts = contexts.repartition(-(-width // rounds), "gram", "sub").sortWithinPartitions("gram", "sub")
    return materialize(contexts.mapInPandas(tidied(_sort_blocks), "doc_id long, start long, n long, digest binary"), "sorted-blocks")


def _with_ordered_rows(docs: DataFrame, keep_bytes: bool) -> DataFrame:
    """Rows without an id of their own: number them in order of (doc_id, text) and work under the numbers."""
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    rows = docs.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered-rows")
    done = remove_repeats(rows.select(F.col("row").alias("doc_id"), "text"), keep_bytes).withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(done, "row").drop("row")
