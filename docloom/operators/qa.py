"""Question rows evaluated against the index, all questions as one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

from .search import search
from .staging import staged

# Words, phrases and units that ask for a table.
TABLE_WORDS = ("таблица", "строка", "столбец", "графа", "ячейка", "значение", "показатель", "концентрация", "концентрации", "координаты")
TABLE_PHRASES = ("расчетная точка", "изав №", "изав no", "изав n", "параметры выбросов")
TABLE_UNITS = ("г/с", "т/год", "мг/м3", "мг/м³")


def is_table_question(text: Column) -> Column:
    low = T.match_form(text)
    words = F.array(*[F.lit(w) for w in TABLE_WORDS])
    parts = F.array(*[F.lit(w) for w in (*TABLE_PHRASES, *TABLE_UNITS)])
    source = F.array_contains(T.tokens(text), "источник") & (F.contains(low, F.lit("№")) | F.contains(low, F.lit("номер")))
    return F.arrays_overlap(T.tokens(text), words) | F.exists(parts, lambda p: F.contains(low, p)) | source


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def benchmark_rows(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, query, expected): queries with the file of the first document that holds their whole text, if one does.

    White space counts as one blank. A text's words other than its ends stand in a holder as whole words, so documents are looked
    up by the rarest of them; texts of one or two words have none and are compared with every document.
    """
    flat = T.squeeze(F.col("query"))
    q = queries.select("query_id", "query", flat.alias("flat"), F.split(flat, " ").alias("words"))
    docs = chunks.select("entry_ord", "filename", T.squeeze(F.col("text")).alias("held"))
    asked = q.where(F.size("words") > 2).select("query_id", F.explode(F.array_distinct(F.slice("words", 2, F.size("words") - 2))).alias("w"))
    words = docs.select("entry_ord", F.explode(F.array_distinct(F.split("held", " "))).alias("w")).join(F.broadcast(asked.select("w").distinct()), "w", "left_semi")
    rare = asked.join(words.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("query_id").agg(F.min(F.struct("n", "w"))["w"].alias("w"), F.count("*").alias("found"))
    # a word that no document has rules its text out
    rare = staged(rare.join(asked.groupBy("query_id").agg(F.count("*").alias("of")), "query_id").where("found = of").select("query_id", "w"), "rare-words")
    # the words go to the documents, whose texts stay where they are read
    some = docs.crossJoin(F.broadcast(rare.agg(F.collect_set("w").alias("rare")))).withColumn("w", F.explode(F.array_intersect(F.split("held", " "), "rare")))
    long = some.join(F.broadcast(rare), "w").join(F.broadcast(q.select("query_id", "flat")), "query_id").where(F.contains("held", F.col("flat")))
    short = docs.join(F.broadcast(q.where("size(words) <= 2 and flat <> ''")), F.contains("held", F.col("flat")))
    hit = long.select("query_id", "entry_ord", "filename").unionByName(short.select("query_id", "entry_ord", "filename"))
    first = hit.groupBy("query_id").agg(F.min_by("filename", "entry_ord").alias("expected"))
    return q.select("query_id", "query").join(first, "query_id", "left")


def retrieval(rows: DataFrame, entries: DataFrame, top_k: int = 5) -> DataFrame:
    """Per query: hits, best rank of the expected file, status."""
    rows = staged(rows, "questions")  # read several times
    hits = search(rows.select("query_id", "query"), entries, top_k).join(rows.select("query_id", "expected"), "query_id")
    key, want = T.document_key(F.col("filename")), T.document_key(F.col("expected"))
    ok = (want != "") & ((key == want) | F.contains(key, want) | ((key != "") & F.contains(want, key)))
    per = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.min(F.when(ok, F.col("rank"))).alias("best_rank"))
    out = rows.select("query_id", "expected").join(per, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    status = F.when(F.col("n_hits") == 0, "no_results").when(F.col("expected").isNull(), "passed").when(F.col("best_rank").isNotNull(), "passed").otherwise("expected_not_found")
    return out.select("query_id", F.coalesce("expected", F.lit("")).alias("expected"), "n_hits", F.coalesce("best_rank", F.lit(0)).alias("best_rank"), status.alias("status"))


def evaluate(rows: DataFrame, entries: DataFrame, top_k: int = 5) -> DataFrame:
    """One row of hit rates over all questions; rows without an expected source count among hits only."""
    r = retrieval(rows, entries, top_k)
    known = F.col("expected") != ""
    at = lambda k: F.count_if(known & F.col("best_rank").between(1, min(k, top_k)))
    return r.agg(
        F.count("*").alias("questions"), F.count_if(known).alias("with_source"), at(1).alias("hit_at_1"), at(3).alias("hit_at_3"), at(5).alias("hit_at_5"),
        F.round(F.coalesce(F.try_divide(at(5), F.count_if(known)), F.lit(0.0)), 4).alias("source_hit_rate"), F.count_if(F.col("n_hits") == 0).alias("no_hits"),
    )


CATEGORIES = ("no_expected_source", "no_hits", "expected_document_not_retrieved", "expected_document_low_rank", "passed")


def taxonomy(evaluated: DataFrame) -> DataFrame:
    """Counts over the fixed categories, those without rows too."""
    category = (
        F.when(F.col("expected") == "", CATEGORIES[0]).when(F.col("n_hits") == 0, CATEGORIES[1]).when(F.col("best_rank") == 0, CATEGORIES[2])
        .when(F.col("best_rank") > 1, CATEGORIES[3]).otherwise(CATEGORIES[4])
    )
    counts = evaluated.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    every = evaluated.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


# Categories of failed questions, and words that speak of tables and of scans.
FAILURES = (
    "no_expected_source_in_qa_row", "expected_document_missing_in_dataset", "expected_document_ambiguous_in_dataset", "expected_document_unsupported_format",
    "expected_document_not_processed", "processed_but_not_retrieved", "retrieved_different_document", "answer_overlap_low",
    "table_like_question_no_table_evidence", "scanned_pdf_or_ocr_out_of_scope", "evaluator_no_hits", "unknown_or_needs_manual_review",
)
TABLE_STEMS = ("таблиц", "строк", "столб", "граф", "ячейк", "значени", "показател", "концентрац", "координат", "г/с", "т/год", "мг/м", "м3/с", "м3/ч")
SCAN_STEMS = ("скан", "ocr", "распознаван", "изображени", "pdf-скан", "scanned")


def diagnose(items: DataFrame, audit: DataFrame, workspace: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Items with ``failure``: the first category that applies.

    items: question, expected_document, reason, hit_files array, answer_overlap, table_like. audit: document_key, finding
    (missing, ambiguous, unsupported). workspace: document_key, selected, processed, skipped_reason. Both sides are joined by
    normalized key; of repeated keys the greatest row counts.
    """
    a = audit.groupBy(F.col("document_key").alias("_key")).agg(F.max("finding").alias("_finding"))
    w = workspace.groupBy(F.col("document_key").alias("_key")).agg(
        F.max("selected").alias("_selected"), F.max("processed").alias("_processed"), F.max("skipped_reason").alias("_skipped")
    )
    key = T.document_key(F.col("expected_document"))
    i = items.withColumn("_key", key).join(a, "_key", "left").join(w, "_key", "left")
    words = T.match_form(F.concat_ws(" ", "question", "expected_document"))
    some = lambda stems: F.exists(F.array(*[F.lit(s) for s in stems]), lambda s: F.contains(words, s))
    keys = F.filter(F.transform(F.coalesce("hit_files", F.array().cast("array<string>")), T.document_key), lambda k: k != "")
    found = (F.col("_key") != "") & F.exists(keys, lambda k: F.contains(k, F.col("_key")) | F.contains(F.col("_key"), k))
    hit = F.size(F.coalesce("hit_files", F.array().cast("array<string>"))) > 0
    low = F.col("answer_overlap") < threshold
    reason = F.coalesce("reason", F.lit(""))
    evidence = F.exists(keys, lambda k: F.contains(k, F.lit("table")) | F.contains(k, F.lit("табли")))
    done = F.coalesce("_processed", F.lit(False))
    failure = (
        F.when(reason.isin("missing_expected_source", "no_expected_source", "missing_source") | (T.squeeze(F.col("expected_document")) == ""), FAILURES[0])
        .when(F.col("_finding") == "missing", FAILURES[1]).when(F.col("_finding") == "ambiguous", FAILURES[2]).when(F.col("_finding") == "unsupported", FAILURES[3])
        .when(F.col("_skipped") == "missing", FAILURES[1]).when(F.col("_skipped").startswith("ambiguous"), FAILURES[2]).when(F.contains("_skipped", F.lit("unsupported")), FAILURES[3])
        .when(F.col("_selected") & ~done, FAILURES[4])
        .when(some(SCAN_STEMS), FAILURES[9])
        .when((F.coalesce("table_like", F.lit(False)) | some(TABLE_STEMS)) & ~evidence & (F.col("answer_overlap").isNull() | low | ~found), FAILURES[8])
        .when(reason.isin("no_results", "no_hits", "evaluator_no_hits") | ~hit, FAILURES[10])
        .when(low & found, FAILURES[7])
        .when((reason.isin("expected_source_not_found", "expected_document_not_found") | ~found) & done, FAILURES[5])
        .when((reason.isin("expected_source_not_found", "expected_document_not_found") | ~found) & hit, FAILURES[6])
        .otherwise(FAILURES[11])
    )
    return i.withColumn("failure", failure).drop("_key", "_finding", "_selected", "_processed", "_skipped")


def failure_counts(diagnosed: DataFrame) -> DataFrame:
    """Counts over all categories, in their order, with shares of the diagnosed items."""
    every = diagnosed.sparkSession.createDataFrame(list(enumerate(FAILURES)), "place int, failure string")
    counts = diagnosed.groupBy("failure").agg(F.count("*").alias("n"))
    return every.join(counts, "failure", "left").select("place", "failure", F.coalesce("n", F.lit(0)).alias("n"))
