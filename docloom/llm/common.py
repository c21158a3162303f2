"""Shared helpers of the training-data operators: table access, durable cut points, hashing."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space, tab, LF, VT, FF, CR. Words are the runs between them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Spark settings of a write that cuts a plan: shuffle files go when it ends, and Python workers see batches of few rows, so that
#: long texts don't add up.
CUT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: What modules remember in a Python worker between partitions, by module.
MEMORIES: dict[str, dict] = {}
#: Materialized tables that have not been deleted.
_LIVE: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "docloom-shared")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a replicated file set: a lost executor costs a re-read, never a recomputation of
    everything before, and what follows plans on exact sizes. Shuffle files of the write go with it; the table stays until
    ``release`` or ``release_unread``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = {k: spark.conf.get(k) for k in CUT}
    for k, v in CUT.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**({"compression": "zstd"} | (options or {}))).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _LIVE.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _LIVE.discard(path)


def release(*tables: DataFrame | None) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path in _LIVE:
            _delete(t.sparkSession, path)


def release_unread(docs: DataFrame) -> None:
    """Delete every materialized table that ``docs`` doesn't read: what finished stages left behind."""
    if _LIVE:
        read = [f for f in docs.inputFiles() if "/docloom/" in f]
        for path in [p for p in _LIVE if not any(p.split("/docloom/")[-1] in f for f in read)]:
            _delete(docs.sparkSession, path)


def shrink_executors(spark: SparkSession) -> None:
    """Collect garbage in every executor's JVM, which then hands the heap it no longer fills back to the system.

    A heap grows by what its busiest stage threw away and stays so; with the Python workers of the next stage it shares one limit.
    As many tasks as there are cores, so that each executor gets some; executors that get none keep their heap, nothing else.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def give_back() -> None:
    """Hand memory that is free in this Python worker back to the system: workers outlive their tasks and share an executor's limit."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget_others(owner: str) -> None:
    """Empty what modules other than ``owner`` remember in this Python worker: a worker serves one stage after the other."""
    for name, memory in MEMORIES.items():
        if name != owner:
            memory.clear()


def tidied(run):
    """A batch function that starts without other stages' memories and gives memory back when its partition is done."""
    owner = run.__module__

    def wrapped(batches):
        forget_others(owner)
        yield from run(batches)
        give_back()

    return wrapped


def text_or_empty(df: DataFrame, col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id) -> "F.Column":
    """crc32(doc_id as text) mod 5 is 0: rows that no model may learn labels from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
