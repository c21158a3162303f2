"""Report sinks: whole files replaced in one step, JSON and Markdown, and guards of the folders they go to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

LIMIT = 100


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(where)


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a file beside ``path`` and rename it there: readers see the old content or the new one."""
    files, where = _path(spark, path)
    _, draft = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(draft, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, where, options)
    except Exception:
        files.delete(draft, False)
        raise


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """Content of a small file; None where there is none."""
    files, where = _path(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, payload: Mapping) -> None:
    """A payload as indented JSON, letters of all scripts as they are."""
    replace_file(spark, path, json.dumps(payload, ensure_ascii=False, indent=2, default=str).encode())


def payload_of(tables: Mapping[str, DataFrame], limit: int = LIMIT) -> dict:
    """Report tables as lists of rows, ``limit`` of each at most: a report is read by people."""
    return {name: [row.asDict(recursive=True) for row in table.limit(limit).collect()] for name, table in tables.items()}


def markdown(title: str, payload: Mapping) -> str:
    """A report as Markdown: plain values as a list, lists of records as tables."""
    lines = [f"# {title}", ""]
    lines += [f"- {k}: {v}" for k, v in payload.items() if not isinstance(v, (list, dict))]
    for name, value in payload.items():
        if isinstance(value, dict):
            lines += ["", f"## {name}", "", *(f"- {k}: {v}" for k, v in value.items())]
        elif isinstance(value, list):
            lines += ["", f"## {name}", "", *_table(value)]
    return "\n".join(lines).rstrip() + "\n"


def _table(rows: Iterable) -> list[str]:
    rows = list(rows)
    if not rows or not all(isinstance(r, Mapping) for r in rows):
        return [f"- {r}" for r in rows] or ["none"]
    names = list(dict.fromkeys(k for r in rows for k in r))
    cell = lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    return ["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(cell(r.get(n)) for n in names) + " |" for r in rows)]


def write_markdown(spark: SparkSession, path: str, title: str, payload: Mapping) -> None:
    replace_file(spark, path, markdown(title, payload).encode())


def safe_workspace(spark: SparkSession, path: str, production: Iterable[str]) -> str:
    """``path``, qualified, if it is neither a root nor a production folder, nor inside or above one."""
    _, where = _path(spark, path)
    own = where.toString().rstrip("/")
    if where.isRoot() or not own:
        raise ValueError(f"a workspace can't be the root: {path}")
    for other in production:
        kept = _path(spark, other)[1].toString().rstrip("/")
        if own == kept or own.startswith(kept + "/") or kept.startswith(own + "/"):
            raise ValueError(f"{path} is, holds or lies in the production folder {other}")
    return own


def prepare_workspace(spark: SparkSession, path: str, production: Iterable[str], clean: bool = False) -> str:
    """An existing workspace folder, emptied first if asked."""
    own = safe_workspace(spark, path, production)
    files, where = _path(spark, own)
    if clean and files.exists(where):
        files.delete(where, True)
    files.mkdirs(where)
    return own
