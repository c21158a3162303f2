"""Requirement and table evidence by configurable vocabularies, as Column expressions over literal term arrays."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.vocabulary import DOMAIN_HINTS, REQUIREMENT_SCORES, SECTION_TABLE_HINTS, Rules

WINDOW_CHARS = 700


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


_SPACE = re.compile(r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SENTENCE_END = re.compile(r"(?<=[.!?;]) ")


def window_list(text: str | None, limit: int = WINDOW_CHARS) -> list[str]:
    """Windows of one text: as many whole sentences as a window holds, and cuts of those that alone are too long."""
    sentences = [s for s in _SENTENCE_END.split(_SPACE.sub(" ", text or "").strip(" ")) if s]
    ends = list(accumulate((len(s) + 1 for s in sentences), initial=0))
    out: list[str] = []
    at = 0
    while at < len(sentences):
        stop = bisect_right(ends, ends[at] + limit + 1) - 1
        if stop > at:
            out.append(" ".join(sentences[at:stop]))
        else:
            out += [sentences[at][i : i + limit].strip(" ") for i in range(0, len(sentences[at]), limit)]
            stop = at + 1
        at = stop
    return out


def windows(text: Column, limit: int = WINDOW_CHARS) -> Column:
    """Sentences packed into windows of at most ``limit`` characters; longer sentences are cut at that length.

    An ordered fold: Spark's own is interpreted and copies what is packed at every sentence, so it runs on Arrow batches.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([window_list(t, limit) for t in texts])

    return F.pandas_udf(run, "array<string>")(text)


def held_terms(low: Column, terms) -> Column:
    """The terms that stand in ``low``, in order: one plain search each, which stays in generated code."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms])) if terms else literals(())


def classify_windows(sources: DataFrame, rules: Rules, squeezed: bool = False) -> DataFrame:
    """Candidates of windows (columns document_id, filename, ord, source_type, section_id, section_title, page, text).

    Windows without any term go first; only what is left is looked at by category. ``squeezed`` says that texts have single
    blanks already.
    """
    flat = F.col("text") if squeezed else T.squeeze(F.col("text"))
    out, hits, scores = sources.withColumn("text", flat).withColumn("_low", T.fold_yo(F.col("text"))), {}, []
    low = F.col("_low")
    every = sorted({t for terms in rules.requirements.values() for t in terms})
    out = out.where(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in every]) if every else F.lit(False))
    out = out.withColumns({f"_{category}": held_terms(low, terms) for category, terms in rules.requirements.items()})
    for category in rules.requirements:
        found = F.col(f"_{category}")
        hits[category] = found
        scores.append(F.when(F.size(found) > 0, F.struct(F.lit(REQUIREMENT_SCORES[category]).alias("base"), F.lit(category).alias("category"))))
    best = F.array_max(F.array_compact(F.array(*scores)))
    terms = F.array_sort(F.array_distinct(F.concat(*hits.values())))
    hints = F.size(held_terms(low, DOMAIN_HINTS))
    is_table, titled = F.col("source_type") == "table", F.coalesce(F.col("section_title"), F.lit("")) != ""
    reasons = F.array_compact(
        F.array(
            *[F.when(F.size(v) > 0, f"{k}_marker") for k, v in hits.items()], F.when(hints > 0, "domain_hint"), F.when(is_table, "table_context"),
            F.when(titled, "section_context"),
        )
    )
    score = (
        F.col("best.base") + F.least(F.lit(0.12), 0.03 * (F.size("matched_terms") - 1)) + F.least(F.lit(0.12), 0.04 * F.col("hints"))
        + F.when(is_table, 0.03).otherwise(0.0) + F.when(titled, 0.02).otherwise(0.0)
    )
    out = out.withColumn("best", best).withColumn("matched_terms", terms).withColumn("hints", hints).withColumn("reason_codes", F.array_sort(F.array_distinct(reasons)))
    out = out.where("best is not null").withColumn("category", F.col("best.category")).withColumn("score", F.round(F.least(score, F.lit(0.95)), 2))
    return out.withColumn("snippet", T.preview(F.col("text"), 240)).drop("best", "hints", "_low", *(f"_{c}" for c in rules.requirements))


def requirements(sources: DataFrame, rules: Rules, min_score: float = 0.45, max_per_document: int | None = None, query: str | None = None) -> DataFrame:
    """Requirement candidates of text sources: the first of equal texts in a section, best first within a document."""
    if max_per_document is not None and max_per_document < 1:
        raise ValueError("max_per_document is 1 or more")
    split = sources.withColumn("w", F.explode(F.transform(windows(F.col("text")), lambda w, i: F.struct(i.alias("win"), w.alias("text")))))
    split = split.withColumn("win", F.col("w.win")).withColumn("text", F.col("w.text")).drop("w")
    found = classify_windows(split, rules, squeezed=True).where(F.col("score") >= min_score)
    if query:
        hay = T.fold_yo(F.concat_ws(" ", "text", "category", "filename", F.coalesce("section_title", F.lit("")), F.array_join("matched_terms", " "), F.array_join("reason_codes", " ")))
        found = found.where(F.contains(hay, F.lit(query.lower().replace("ё", "е"))))
    own = Window.partitionBy("document_id", "section_id", F.lower("text")).orderBy("ord", "win")
    found = found.withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn")
    order = Window.partitionBy("document_id").orderBy(F.col("score").desc(), F.size("matched_terms").desc(), F.col("filename").desc(), "ord", "win")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= max_per_document) if max_per_document else found


def clean_rows(rows: Column) -> Column:
    """Squeezed cells, empty ends of rows cut, empty rows dropped."""
    flat = F.transform(rows, lambda r: F.transform(r, T.squeeze))
    trimmed = F.transform(flat, lambda r: F.slice(r, 1, F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(c != "", i + 1))), F.lit(0))))
    return F.filter(trimmed, lambda r: F.size(r) > 0)


def is_numeric_like(cell: Column) -> Column:
    plain = F.regexp_replace(F.replace(cell, F.lit(","), F.lit(".")), " ", "")
    return plain.rlike(r"^[+-]?(?:(?:\d(?:_?\d)*)?\.?(?:\d(?:_?\d)*)?(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$") & plain.rlike(r"\d|(?i)inf|nan")


def headers(rows: Column) -> Column:
    """The first row where it names columns: half its cells have letters and at most a third are numbers."""
    first = F.get(rows, F.lit(0))
    filled = F.filter(first, lambda c: c != "")
    alpha = F.size(F.filter(filled, lambda c: c.rlike(r"\p{L}")))
    numeric = F.size(F.filter(filled, is_numeric_like))
    good = (alpha >= F.greatest(F.lit(1), F.floor(F.size(filled) / 2))) & (numeric <= F.floor(F.size(filled) / 3))
    none = F.array().cast("array<string>")
    return F.when(F.size(rows) < 1, none).when((F.size(rows) == 1) | good, first).otherwise(none)


def table_text(rows: Column) -> Column:
    return T.squeeze(F.array_join(F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | ")), " "))


def table_evidence(tables: DataFrame, rules: Rules) -> DataFrame:
    """Evidence records of tables (document_id, filename, table_id, section_title, rows)."""
    t = tables.withColumn("rows", clean_rows(F.col("rows"))).withColumn("headers", headers(F.col("rows")))
    has = F.size("headers") > 0
    body = F.when(has & (F.size("rows") > 1), F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).otherwise(F.col("rows"))
    t = t.withColumn("head_text", F.array_join("headers", " ")).withColumn("body_text", table_text(body))
    t = t.withColumn("_head", T.match_form(F.col("head_text"))).withColumn("_rest", T.match_form(F.col("body_text")))
    head, rest = F.col("_head"), F.col("_rest")
    per, matched = [], []
    for category, terms in rules.tables.items():
        forms = [F.lit(" ".join(x.split()).lower().replace("ё", "е")) for x in terms]
        gains = [F.when(F.contains(head, f), 0.34).when(F.contains(rest, f), 0.14).otherwise(0.0) for f in forms]
        total = F.round(sum(gains[1:], gains[0]), 2) if gains else F.lit(0.0)
        per.append(F.struct(total.alias("score"), F.lit(category).alias("category")))
        matched += [F.when(F.contains(head, f) | F.contains(rest, f), F.lit(x)) for f, x in zip(forms, terms, strict=True)]
    t = t.withColumn("per", F.array(*per)).withColumn("matched_terms", F.array_sort(F.array_distinct(F.array_compact(F.array(*matched)))))
    top = F.array_max(F.transform("per", lambda p: p["score"]))
    t = t.withColumn("best", top).withColumn("category", F.when(top > 0, F.get(F.filter("per", lambda p: p["score"] == F.col("best")), F.lit(0))["category"]).otherwise("unknown"))
    tags = F.array_sort(F.transform(F.filter("per", lambda p: p["score"] > 0), lambda p: p["category"]))
    t = t.withColumn("tags", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unknown"))))
    n_rows, n_cols = F.size("rows"), F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    hinted = F.exists(literals(SECTION_TABLE_HINTS), lambda h: F.contains(T.match_form(F.col("section_title")), h))
    score = (
        0.08 + F.least(F.col("best"), F.lit(0.68)) + F.when(has, 0.12).otherwise(0.0) + F.when(n_rows >= 2, 0.06).otherwise(0.0)
        + F.when(n_cols >= 2, 0.04).otherwise(0.0) + F.when(hinted, 0.04).otherwise(0.0)
    )
    whole = F.concat_ws(" ", "head_text", "body_text")
    return t.withColumn("row_count", n_rows).withColumn("column_count", n_cols).withColumn("score", F.round(F.least(score, F.lit(0.95)), 2)).withColumn("snippet", T.preview(whole, 280)).drop("per", "best", "head_text", "body_text", "_head", "_rest")


def rank_tables(records: DataFrame, min_score: float = 0.25, max_tables: int | None = None, category: str | None = None) -> DataFrame:
    """Distinct records at or over a score, in one global order."""
    r = records.where(F.col("score") >= min_score)
    if category:
        r = r.where((F.col("category") == category) | F.array_contains("tags", category))
    own = Window.partitionBy("document_id", "table_id", F.lower("snippet")).orderBy(F.col("score").desc(), F.col("row_count").desc(), F.md5(F.to_json("rows").cast("binary")))
    r = r.withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn")
    r = r.orderBy(F.col("score").desc(), F.size("matched_terms").desc(), F.col("row_count").desc(), F.lower("filename").desc(), F.col("table_id").desc())
    return r.limit(max_tables) if max_tables else r


def row_texts(tables: DataFrame) -> DataFrame:
    """A chunk for each data row of a table (table_id, table_title, sheet_name, section_path, rows), with its columns named."""
    t = tables.withColumn("filled", F.filter("rows", lambda r: F.exists(r, lambda c: T.squeeze(c) != "")))
    many = F.size("filled") > 1
    t = t.withColumn("header", F.when(many, F.transform(F.get("filled", F.lit(0)), T.squeeze)).otherwise(F.array().cast("array<string>")))
    data = F.when(many, F.slice("filled", 2, F.greatest(F.size("filled"), F.lit(1)))).otherwise(F.col("filled"))
    t = t.withColumn("first", F.when(many, 2).otherwise(1)).select("*", F.posexplode(data).alias("pos", "row"))
    cells = F.transform("row", lambda c, i: F.struct(T.squeeze(F.get("header", i)).alias("h"), T.squeeze(c).alias("v")))
    t = t.withColumn("cells", F.filter(cells, lambda x: x["v"] != ""))
    named = F.transform(F.filter("cells", lambda x: x["h"] != ""), lambda x: F.concat(x["h"], F.lit(": "), x["v"]))
    bare = F.transform(F.filter("cells", lambda x: x["h"] == ""), lambda x: x["v"])
    context = F.concat_ws(". ", F.concat(F.lit("Таблица "), "table_id"), F.concat(F.lit("Лист: "), "sheet_name"), F.concat(F.lit("Раздел: "), F.array_join("section_path", " > ")))
    index = F.col("first") + F.col("pos")
    body = F.concat_ws(
        "\n", context, F.concat(F.lit("Строка "), index.cast("string"), F.lit(" из "), F.size("rows").cast("string"), F.lit(".")),
        F.when(F.size(named) > 0, F.concat(F.lit("Колонки: "), F.array_join(named, "; "))), F.when(F.size(bare) > 0, F.concat(F.lit("Значения строки: "), F.array_join(bare, "; "))),
    )
    return t.select("table_id", index.alias("row_index"), F.size("rows").alias("row_count"), F.size("header").alias("column_count"), body.alias("text"), "cells")
