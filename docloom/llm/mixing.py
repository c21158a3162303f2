"""Operator 8: mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of equal-token slots. Slot ``n`` draws the golden-ratio point ``frac((n + 1/2) * phi)`` through the
cumulative target shares, so every prefix of the mix holds each source within a few slots of its share. The k-th slot of a
source takes the k-th block of that source's shuffled word stream, which goes round at most ``max_epochs`` times. Blocks have
one size at every size of corpus; a source's last slot is cut where its target ends, and slots that the schedule leaves short of
a target follow at the end of the mix, so each source yields its target, rounded to a word.

Nothing here is keyed by source alone: a source that holds a third of all rows is spread over hash buckets, whose sums are
prefixed in a small table, and slot ranks are prefixed over schedule chunks of a fixed length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, release, tidied
from .ngram_join import MAX_BROADCAST_IDS

PHI = (math.sqrt(5) - 1) / 2
MIN_BLOCK = 16
#: Slots of one chunk of the schedule; the number of chunks grows with the corpus.
CHUNK_SLOTS = 65_536
BUCKET_ROWS, MAX_BUCKETS = 128, 65_536


def fill_targets(sizes: dict, weights: dict, max_epochs: int = 3) -> dict:
    """The plain form of ``water_level``: share the sum of ``sizes`` by weight; targets stop at ``max_epochs`` times their size and the excess is shared anew."""
    target = {s: 0.0 for s in sizes}
    active, left = [s for s in sizes if sizes[s] > 0], float(sum(sizes.values()))
    while active:
        total = sum(weights[s] for s in active)
        above = [s for s in active if left * weights[s] / total > max_epochs * sizes[s]]
        if not above:
            target.update({s: left * weights[s] / total for s in active})
            break
        for s in above:
            target[s] = float(max_epochs * sizes[s])
            left -= target[s]
        active = [s for s in active if s not in above]
    return target


def _ranked_sources(sized: DataFrame, width: int) -> DataFrame:
    """``source, source_size, sid``: sources with their place in code point order, the null source last; nothing is collected
    but the row counts of ``width`` ranges."""
    place = F.col("source").asc_nulls_last()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    dealt = per.repartitionByRange(width, place).sortWithinPartitions(place)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "mix-sources")
    firsts, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()):
        firsts.append((part, at))
        at += n
    parts, starts = [p for p, _ in firsts], [n for _, n in firsts]
    # an Arrow table needs no Python workers of another kind beside those of the operators
    first = dealt.sparkSession.createDataFrame(pa.table({"part": pa.array(parts, pa.int32()), "first": pa.array(starts, pa.int64())}))
    return dealt.join(F.broadcast(first), "part").select("source", "source_size", "rows", (F.col("first") + F.col("row")).cast("int").alias("sid"))


def water_level(sources: DataFrame, weight: Column, max_epochs: int) -> tuple[float, float] | None:
    """Words, and the weight that shares them, of the sources whose target is below ``max_epochs`` times their size, when all words
    are shared by weight and no target is above that. Each round is one sum over the table of sources; whoever is above stays
    above. None where every source is."""
    full = max_epochs * F.col("source_size")
    level, above = None, -1
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:
        over = full < F.lit(level[0]) * weight / F.lit(level[1]) if level else F.lit(False)
        r = sources.where("source_size > 0").agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, weight)).alias("weight"), F.count_if(over).alias("above")).first()
        if not r["weight"]:
            return None
        if r["above"] == above:
            return level
        level, above = (float(total - (r["full"] or 0)), float(r["weight"])), r["above"]


def _slots(bounds: np.ndarray, n_slots: int, per_chunk: int):
    """Source index of each slot, a chunk of the schedule at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["id"]:
                n = np.arange(c * per_chunk, min((c + 1) * per_chunk, n_slots))
                if not len(n):
                    continue
                sid = np.minimum(np.searchsorted(bounds, (n + 0.5) * PHI % 1.0, side="right"), len(bounds) - 1)
                order = np.argsort(sid, kind="stable")
                s = sid[order]
                first = np.r_[0, np.flatnonzero(np.diff(s)) + 1]
                local = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
                yield pd.DataFrame({"chunk": np.full(len(s), c), "sid": s, "local": local})

    return run


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 8, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Words that the mix takes of each document.

    Input needs ``doc_id``, ``text`` and ``source``; other columns are ignored, whatever their names. Output, one row per
    input row: doc_id, size, source_size, target, taken, source.

    Edge cases: null and empty texts have size 0 and take 0; a null source is a source of its own, last in order; repeated
    rows and repeated or null ids are mixed as separate documents; an empty table gives an empty result. Ties in the
    shuffle are broken by id, then by row position. Sources are a table: ranked, weighed (``weights`` in turn, in code point
    order) and given targets where they are; the schedule's tasks get their cumulative shares, eight bytes a source.
    """
    spark = docs.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    ranked_sources = _ranked_sources(sized, width)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("sid") % len(weights) + 1)
    level = water_level(ranked_sources, weight, max_epochs)
    full = F.col("source_size") * F.lit(float(max_epochs))
    target = F.least(full, F.lit(level[0]) * weight / F.lit(level[1])) if level else full
    info = ranked_sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).withColumn("quota", F.floor(F.col("target") + 0.5))
    info = materialize(info, "mix-targets")
    totals = info.agg(F.sum("source_size").alias("words"), F.sum("rows").alias("rows"), F.count("*").alias("sources")).first()
    words, rows = totals["words"] or 0, totals["rows"] or 0
    few = totals["sources"] <= MAX_BROADCAST_IDS
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    block = MIN_BLOCK
    n_slots = -(-words // block)
    buckets = min(max(1, rows // BUCKET_ROWS), MAX_BUCKETS)
    named = info.select(F.col("source").alias("name"), "sid", "source_size", "target", "quota")
    known = sized.join(small(named), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    if not words:
        return known.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source")

    # each document's place in its source's shuffled word stream
    mixed = known.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = mixed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = mixed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(base, ["sid", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    placed = materialize(placed.select("rid", "doc_id", "source", "sid", "size", "source_size", "target", "quota", "at"), "mix-placed")

    # slots, ranked within their source
    shares = np.cumsum(info.orderBy("sid").select("target").toArrow()["target"].to_numpy())  # eight bytes a source
    n_chunks = -(-n_slots // CHUNK_SLOTS)
    chunks = spark.range(0, n_chunks, 1, min(n_chunks, max(64, n_chunks // 8)))
    slots = chunks.mapInPandas(tidied(_slots(shares / shares[-1], n_slots, CHUNK_SLOTS)), "chunk long, sid int, local long")
    counts = materialize(slots.groupBy("chunk", "sid").agg(F.count("*").alias("n")), "mix-counts")
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "sid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    need = info.select("sid", F.ceil(F.col("quota") / block).alias("need"))
    ranked = slots.hint("merge").join(offsets, ["chunk", "sid"]).join(small(need), "sid").withColumn("rank", F.col("first") + F.col("local"))
    drawn = need.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    closing = drawn.where("n < need").select("sid", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank"))
    slots = ranked.where("rank < need").select("sid", F.col("rank").alias("block")).unionByName(closing.withColumnRenamed("rank", "block"))

    # each document's share of the blocks, a round of its source's stream at a time; the last round ends with the quota
    rounds = placed.where("size > 0").withColumn("last", F.floor((F.col("quota") - 1 - F.col("at")) / F.col("source_size"))).where("last >= 0")
    rounds = rounds.select("rid", "sid", "size", "source_size", "quota", "at", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("round"))
    rounds = rounds.withColumn("at", F.col("at") + F.col("round") * F.col("source_size")).withColumn("end", F.least("quota", F.col("at") + F.col("size")))
    pieces = rounds.select(
        "rid", "sid", "at", "end", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("block")
    )
    overlap = F.least("end", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    taken = pieces.hint("merge").join(slots, ["sid", "block"]).groupBy("rid").agg(F.sum(overlap).alias("taken"))
    taken = materialize(taken, "mix-taken")
    release(counts, info)
    return placed.join(taken, "rid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )
