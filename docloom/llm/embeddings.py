"""Operator 7: near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each table rotates a vector by three rounds of random signs and a fast Walsh-Hadamard transform and hashes it to the axis it
comes nearest; ``n_hashes`` axes make a bucket. Multiprobe also puts the vector in the buckets of its next best axes. Members
of a bucket are compared in double precision in tiles of a bounded size; a pair that meets in several buckets counts in the
first only.

Equal vectors with equal labels are one class before hashing, so copies cost nothing. A crowded bucket is cut into salted
blocks and its tiles spread over the cluster: every tile is small and none is dropped. Tiles give each vector's number of
links and a spanning set of links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, tidied
from .components import connected_components
from .grouping import group_starts, local_roots, whole_groups

TILE, TABLES = 512, 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 7) -> np.ndarray:
    """``tables * probes`` bucket codes of each row; the table is part of the code.

    Probe 0 is the nearest axis of every hash; probe p changes the hash whose next axis is the p-th least bit worse.
    """
    width = 1 << max(1, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))) if width > x.shape[1] else x
    codes = np.empty((len(x), tables * probes), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        best, swap, loss = [], [], []
        for h in range(hashes):
            rng = np.random.default_rng([seed, width, t, h])
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            first = size.argmax(axis=1)
            top = size[rows, first].copy()
            size[rows, first] = -1.0
            second = size.argmax(axis=1)
            best.append(first * 2 + (y[rows, first] > 0))
            swap.append(second * 2 + (y[rows, second] > 0))
            loss.append(top - size[rows, second])
        order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
        for p in range(probes):
            code = np.full(len(x), t, np.int64)
            for h in range(hashes):
                axis = best[h] if p == 0 else np.where(order[:, min(p, hashes) - 1] == h, swap[h], best[h])
                code = code * (2 * width) + axis
            codes[:, t * probes + p] = code
    return codes


def unit(rows: list) -> np.ndarray:
    """Vectors of length one in double precision; components are scaled first, so that no square overflows or vanishes."""
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def layout(n: int, dim: int, bucket_rows: int) -> tuple[int, int]:
    """Hashes of a bucket and tables, for ``n`` vectors.

    Hashes grow with the logarithm of the number of vectors, so that a bucket of unrelated ones holds about ``bucket_rows``;
    tables grow with the hashes, as near vectors meet less often in a longer code.
    """
    width = 1 << max(1, dim - 1).bit_length()
    hashes = max(1, round(math.log(max(2.0, n / bucket_rows)) / math.log(2 * width)))
    return hashes, TABLES + TABLES // 2 * (hashes - 1)


def _hash_rows(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy()
            for d in np.unique(sizes):
                part = batch[sizes == d]
                codes = bucket_codes(unit(part["embedding"].to_list()), tables, hashes, min(probes, hashes + 1))
                # 32 bits of each code: buckets that fall together are only larger
                codes = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pd.DataFrame({"rep": part["rep"], "label": part["label"], "copies": part["copies"], "embedding": part["embedding"], "codes": list(codes)})

    return run


def _tiles(threshold: float):
    def tile(frame: pd.DataFrame, x: np.ndarray, codes: np.ndarray):
        """Links of one tile: between blocks i and j, or within block i."""
        i, j, code = (int(frame[c].iloc[0]) for c in ("i", "j", "code"))
        block = frame["block"].to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        close = x[left] @ x[right].T >= threshold
        if i == j:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        ok = np.ones(len(a), bool)
        for at in range(0, len(a), 100_000):  # counted only where the pair meets first
            s = slice(at, at + 100_000)
            ca, cb = codes[a[s]], codes[b[s]]
            shared = np.where((ca[:, :, None] == cb[:, None, :]).any(axis=2), ca, np.iinfo(np.int64).max)
            ok[s] = shared.min(axis=1) == code
        return a[ok], b[ok]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = ["label", "dim", "code", "i", "j"]
        for frame in whole_groups(batches, key, 2_000):
            starts = group_starts(frame, key)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi - lo < 2:
                    continue
                part = frame.iloc[lo:hi]
                a, b = tile(part, unit(part["embedding"].to_list()), np.stack(part["codes"].to_list()))
                if not len(a):
                    continue
                rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
                links = np.zeros(len(part), np.int64)
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                order = np.argsort(rep, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                root = rep[order][local_roots(len(part), place[a], place[b])][place]
                hit = links > 0
                yield pd.DataFrame({"rep": rep[hit], "links": links[hit], "root": root[hit]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, probes: int = 2, bucket_rows: int = 64) -> DataFrame:
    """Links and components of vectors with equal labels: vec_id, n_links, component_id, kept.

    Hashes and tables follow the number of vectors (``layout``).

    Edge cases: a vector that is null, empty, zero or holds a null or non-finite component, and one without label, links with
    nothing and is kept as its own component; vectors of different lengths never link; equal vectors (repeated rows and
    repeated ids among them) are classes whose members all link; a null vec_id gets a null component and is kept; an empty
    table gives an empty result; other columns are ignored.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    base = materialize(base.withColumn("class", F.when(good, F.sha2(F.to_json(F.struct("label", "embedding")).cast("binary"), 256))), "vectors")
    classes = base.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = materialize(classes, "vector-classes")
    n = classes.count()
    dim = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    hashes, tables = layout(n, dim, bucket_rows)
    schema = f"rep long, label long, copies long, embedding {kind}, codes array<int>"
    hashed = classes.select("rep", "label", "copies", "embedding").mapInPandas(tidied(_hash_rows(tables, hashes, probes)), schema)
    hashed = materialize(hashed.withColumn("dim", F.size("embedding")), "vector-codes")

    spread = hashed.select("rep", "label", "dim", F.explode(F.array_distinct("codes")).alias("code"))
    bucket = ["label", "dim", "code"]
    sizes = spread.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int"))
    sizes = materialize(sizes.select(*bucket, "blocks"), "vector-buckets")
    placed = spread.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rep", "code"), F.col("blocks")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda m: F.struct(F.least(m, F.col("block")).alias("i"), F.greatest(m, F.col("block")).alias("j")))
    tiles = placed.select("rep", *bucket, "block", F.explode(mates).alias("t")).select("rep", *bucket, "block", "t.i", "t.j")
    tiles = tiles.join(hashed.select("rep", "copies", "embedding", "codes"), "rep")
    width = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = [*bucket, "i", "j"]
    dealt = tiles.repartition(width, *key).sortWithinPartitions(*key)
    found = materialize(dealt.mapInPandas(tidied(_tiles(threshold)), "rep long, links long, root long"), "vector-links")
    release(hashed, sizes)

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors")
    reps = classes.select("class", "rep", "copies").join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("vec_id", "class").join(reps, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
