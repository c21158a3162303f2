"""Question tables: CSV or TSV of unknown delimiter and headers, and JSON query specifications."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header names by which columns are known.
ALIASES = {
    "question": ("question", "вопрос", "query", "запрос"),
    "answer": ("answer", "expected_answer", "ответ", "expected answer"),
    "document": ("document", "expected_document", "source", "file", "документ", "источник", "файл"),
}
DELIMITERS = ("\t", ";", ",", "|")


def header_key(name: str | None) -> str:
    return (name or "").strip().lstrip("﻿").lower().replace("ё", "е")


def choose_delimiter(head: str, override: str | None = None) -> str:
    """The delimiter under which most header names are known, then the widest rows, then most headers."""
    if override:
        return {"tab": "\t", "\\t": "\t"}.get(override, override)
    guesses = []
    try:
        guesses.append(csv.Sniffer().sniff(head, "".join(DELIMITERS)).delimiter)
    except csv.Error:
        pass
    known = {a for names in ALIASES.values() for a in names}

    def fit(d: str) -> tuple[int, int, int]:
        rows = [r for r, _ in zip(csv.reader(head.splitlines(), delimiter=d), range(5))]
        names = [header_key(x) for x in rows[0]] if rows else []
        return sum(n in known for n in names), max(map(len, rows), default=0), len([n for n in names if n])

    return max(dict.fromkeys([*guesses, *DELIMITERS]), key=fit)


def resolve(columns: list[str], role: str, override: str | None = None) -> str | None:
    keys = {header_key(c): c for c in reversed(columns)}
    if override:
        if header_key(override) not in keys:
            raise ValueError(f"no column {override!r} for {role}")
        return keys[header_key(override)]
    return next((keys[a] for a in ALIASES[role] if a in keys), None)


def read_questions(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", keep_empty: bool = False) -> DataFrame:
    """``row_number, question, expected_answer, expected_document``; row numbers follow the header, from 2."""
    head = "\n".join(r["value"] for r in spark.read.option("encoding", encoding).text(path).limit(40).collect())[:4096]
    sep = choose_delimiter(head, delimiter)
    raw = spark.read.option("encoding", encoding).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    names = {r: resolve([c for c in raw.columns if c != "_at"], r) for r in ALIASES}
    if not names["question"]:
        raise ValueError("no question column")
    pick = lambda r: F.coalesce(F.trim(F.col(f"`{names[r]}`")), F.lit("")) if names[r] else F.lit("")
    # one small table read from one file in order
    rows = raw.select((F.row_number().over(Window.orderBy("_at")) + 1).alias("row_number"), pick("question").alias("question"), pick("answer").alias("expected_answer"), pick("document").alias("expected_document"))
    return rows if keep_empty else rows.where("question <> ''")


SPEC = "id string, query string, expected_files array<string>, expected_document_ids array<string>, must_have_results boolean"


def read_query_specs(spark: SparkSession, path: str) -> DataFrame:
    """Query specifications of a JSON list; a missing id is a slug of the query."""
    specs = spark.read.schema(SPEC).option("multiLine", True).json(path)
    slug = F.regexp_replace(F.regexp_replace(F.lower("query"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    none = F.array().cast("array<string>")
    return specs.select(
        F.coalesce("id", F.when(slug != "", slug), F.lit("query")).alias("id"), "query", F.coalesce("expected_files", none).alias("expected_files"),
        F.coalesce("expected_document_ids", none).alias("expected_document_ids"), F.coalesce("must_have_results", F.lit(True)).alias("must_have_results"),
    )
