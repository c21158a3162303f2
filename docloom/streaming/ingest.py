"""Incremental ingest: micro-batches of chunks upserted into a bucketed index, one writer for each checkpoint.

The index is a folder of versions, each holding some buckets, and a small file that names the version of every bucket. A
batch writes the buckets it touches as a new version and then replaces the file in one rename: readers see the state before or
after a batch, never a part of it, and a job that fails changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.search import index_entries
from docloom.sources.reports import read_file, write_json

BUCKETS = 16
CURRENT = "_current"


def latest(chunks: DataFrame) -> DataFrame:
    """Of each (checksum, chunk) the row with the greatest version."""
    own = Window.partitionBy("checksum", "section_id", "entry_ord").orderBy(F.col("version").desc())
    return chunks.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def _current(spark: SparkSession, index_path: str) -> dict[str, str]:
    """Version of each bucket."""
    return json.loads(read_file(spark, f"{index_path}/{CURRENT}") or b"{}")


def _replace_current(spark: SparkSession, index_path: str, versions: dict[str, str]) -> None:
    write_json(spark, f"{index_path}/{CURRENT}", versions)


def read_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    """The index as the last finished batch left it; None before the first."""
    versions = _current(spark, index_path)
    if not versions:
        return None
    out = None
    for version in sorted(set(versions.values())):
        own = [int(b) for b, v in versions.items() if v == version]
        part = spark.read.parquet(f"{index_path}/{version}").where(F.col("bucket").isin(own))
        out = part if out is None else out.unionByName(part)
    return out


def upsert(batch: DataFrame, index_path: str, buckets: int = BUCKETS) -> None:
    """Replace the index entries of the sources in ``batch``; only the buckets they fall in are read and written."""
    spark = batch.sparkSession
    new = index_entries(latest(batch)).withColumn("bucket", F.pmod(F.xxhash64("checksum"), F.lit(buckets)).cast("int"))
    sources = new.select(F.col("checksum").alias("_source")).distinct()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    known = read_index(spark, index_path)
    merged = new
    if known is not None:
        merged = known.where(F.col("bucket").isin(touched)).join(sources, F.col("checksum").eqNullSafe(F.col("_source")), "left_anti").unionByName(new.select(*known.columns))
    version = f"v-{uuid.uuid4().hex}"
    merged.write.partitionBy("bucket").parquet(f"{index_path}/{version}")
    versions = _current(spark, index_path) | {str(b): version for b in touched}
    _replace_current(spark, index_path, versions)


def start(chunks: DataFrame, index_path: str, checkpoint: str):
    """Start a stream of chunks (with ``version``) into the index; a chunk that is seen again replaces itself."""
    return chunks.writeStream.foreachBatch(lambda df, _: upsert(df, index_path)).option("checkpointLocation", checkpoint).start()
