"""Read-only audits of chunks and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions import text as T

SHORT, LONG, COMPACT = 120, 3000, 250
ISSUES = (
    "empty_or_whitespace_text", "short_chunk", "long_chunk", "missing_section", "missing_page", "table_like_text_without_rich_context",
    "unknown_content_type", "heading_only_or_low_context", "duplicate_or_repeated_text", "image_or_ocr_limited",
)
# Signals of compact texts.
SERVICE_TERMS = (
    "утверждаю", "утверждено", "согласовано", "согласовал", "подпись", "должность", "коммерческий директор", "ф.и.о", "фио", "разработал", "проверил",
    "лист согласования", "(число)", "(месяц)", "approval", "signature",
)
FORMULA_TERMS = ("расчет", "расчёт", "формула", "коэффициент", "удельн", "мг/м3", "мг/м³")
POLLUTANT_TERMS = ("загрязняющ", "вещество", "выброс", "источник", "оборудован", "котел", "труба")
TOC_PATTERN = r"(?:^|\s)\d+(?:\.\d+)+\.?\s+\S+|\.{3,}\s*\d+\s*$"
EDGE = r"[^\p{L}\p{N}_]"
FORMULA_PATTERN = rf"[=<>±×*/]|(?:^|{EDGE})\d+(?:[.,]\d+)?\s*(?:мг/м3|мг/м³|т/год|г/с|кг/ч|м3/ч|м³/ч)"
SYMBOL_PATTERN = rf"(?:^|{EDGE})(?:nox|so2|co)(?:{EDGE}|$)"


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def quality_flags(chunks: DataFrame) -> DataFrame:
    """Chunks with ``quality_flags`` (sorted) and ``handoff_notes``; needs text, section_id, page_start, content_type, table_id."""
    staged = chunks.withColumn("_flat", T.squeeze(F.col("text")))  # a column of its own: what is used twice is worked out once
    flat = F.col("_flat")
    flags = F.array_sort(
        F.array_compact(
            F.array(
                F.when(flat == "", "empty_or_whitespace_text").when(F.length(flat) < SHORT, "short_chunk"), F.when(F.col("section_id").isNull(), "missing_section"),
                F.when(F.col("page_start").isNull(), "missing_page"), F.when(Q.is_table_like(flat, squeezed=True), "table_like_text"),
                F.when(F.col("content_type") == "unknown", "unknown_content_type"), F.when(F.col("content_type") == "image", "image_or_ocr_limited"),
            )
        )
    )
    has = lambda f: F.array_contains("quality_flags", f)
    notes = F.array_compact(
        F.array(
            F.when(has("missing_section"), "section context is missing or cannot be resolved"),
            F.when(has("missing_page"), "page context is not available in linked blocks"),
            F.when(has("short_chunk"), "chunk is short and may need neighboring context"),
            F.when(has("table_like_text") & F.col("table_id").isNull(), "text looks table-like, but table_id could not be resolved"),
            F.when((F.col("content_type") == "image") | has("image_or_ocr_limited"), "image/OCR-limited source context; no OCR text is inferred here"),
            F.when(F.col("content_type") == "unknown", "content type could not be classified from current metadata"),
        )
    )
    return staged.withColumn("quality_flags", flags).withColumn("handoff_notes", notes).drop("_flat")


def issue_codes(chunks: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Flagged chunks with ``issues``, in order of ISSUES. Repeats are counted by text digest, not by text."""
    if not 0 <= short <= long:
        raise ValueError("thresholds are 0 or more and in order")
    flat = F.col("_flat")
    c = chunks.withColumn("_flat", T.squeeze(F.col("text")))
    measured = {"digest": F.sha2(flat.cast("binary"), 256), "_n": F.length(flat), "_words": F.regexp_count(flat, F.lit("[^ ]+")), "_colon": flat.endswith(":")}
    c = c.withColumns(measured).drop("_flat")
    repeated = c.select("digest").groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    c = c.join(repeated, "digest", "left")
    n, words = F.col("_n"), F.col("_words")
    rich = F.col("content_type").isin("table", "table_row") & F.col("table_id").isNotNull()
    has = lambda f: F.array_contains("quality_flags", f)
    low = (n > 0) & ((F.col("content_type") == "heading") | ((n <= short) & (words <= 6)) | ((words <= 8) & F.col("_colon")))
    tests = [
        n == 0, (n > 0) & (n < short), n > long, has("missing_section") | F.col("section_id").isNull(), has("missing_page") | F.col("page_start").isNull(),
        has("table_like_text") & ~rich, has("unknown_content_type") | (F.col("content_type") == "unknown"), low, F.col("copies").isNotNull() & (n > 0),
        has("image_or_ocr_limited"),
    ]
    return c.withColumn("issues", F.array_compact(F.array(*[F.when(t, i) for t, i in zip(tests, ISSUES, strict=True)]))).drop("digest", "copies", "_n", "_words", "_colon")


def issue_counts(issued: DataFrame) -> DataFrame:
    return issued.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def compact_bucket(text: Column, content_type: Column, section_title: Column) -> Column:
    """Bucket of a short text chunk; null for others."""
    flat = T.squeeze(text)
    low = F.replace(F.lower(flat), F.lit("ß"), F.lit("ss"))
    words = F.regexp_count(flat, F.lit(T.WORD))
    title = T.is_upper(flat) | (T.casefold_form(section_title) == F.regexp_replace(low, r"^[ .:;]+|[ .:;]+$", ""))
    return F.when((content_type == "text") & (flat != "") & (F.length(flat) < COMPACT), (
        F.when(_any(low, SERVICE_TERMS), "service_or_boilerplate")
        .when(_any(low, ("содержание", "оглавление", "table of contents")) | flat.rlike(TOC_PATTERN), "toc_or_list_fragment")
        .when(low.rlike(FORMULA_PATTERN) | _any(low, FORMULA_TERMS), "formula_or_calculation_micro_evidence")
        .when(low.rlike(SYMBOL_PATTERN) | _any(low, POLLUTANT_TERMS), "pollutant_or_equipment_micro_evidence")
        .when((words <= 8) & F.coalesce(title, F.lit(False)), "title_or_cover_fragment")
        .when(F.length(flat) < SHORT, "real_low_value_tail")
        .otherwise("other_compact_text")
    ))


def length_summary(chunks: DataFrame) -> DataFrame:
    n = F.length(T.squeeze(F.col("text")))
    return chunks.agg(F.count("*").alias("total"), F.round(F.avg(n), 2).alias("avg_len"), F.median(n).alias("median_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"))


def corpus_audit(documents: DataFrame, manifest: DataFrame, low_text: int = 500, min_chunks: int = 1) -> DataFrame:
    """Documents (document_id, filename, text, n_chunks) with status and problem tags against manifest and index ids."""
    known = manifest.select("document_id", "status", F.lit(True).alias("indexed")).dropDuplicates(["document_id"])
    d = documents.join(known, "document_id", "left")
    n = F.length(F.coalesce("text", F.lit("")))
    tags = F.array_compact(F.array(F.when(n < low_text, "low_text"), F.when(F.col("n_chunks") < min_chunks, "no_chunks"), F.when(F.col("indexed").isNull(), "missing_from_index"), F.when(F.col("text").isNull(), "null_text_metrics")))
    return d.select("document_id", "filename", F.coalesce("status", F.lit("unknown")).alias("status"), n.alias("text_chars"), tags.alias("problems"))


def document_top_issues(issued: DataFrame, n: int = 10) -> DataFrame:
    """Files with most issues."""
    per = issued.groupBy("filename").agg(F.sum(F.size("issues")).alias("issues"), F.count("*").alias("chunks"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("issues").desc(), "filename"))).where(F.col("rank") <= n)


HEADING_LINE = r"^(?:(?i:\d+(?:\.\d+)*\.?|[ivxlc]+\.?))\s+\S+"


def splitter_flags(chunks: DataFrame) -> DataFrame:
    """What a splitter should not leave behind, a flag each: chunks (text, content_type, section_title, section_path, table_id, page_start)."""
    stripped = T.strip(F.coalesce("text", F.lit("")))
    lines = F.filter(F.transform(F.split(stripped, "\n"), T.strip), lambda x: x != "")
    c = chunks.withColumn("_lines", lines).withColumn("_flat", T.casefold_form(F.col("text"))).withColumn("_s", stripped)
    title = F.coalesce("section_title", F.element_at("section_path", -1))
    words = F.regexp_count("_s", F.lit(T.WORD))
    service = _any(F.col("_flat"), SERVICE_TERMS)
    first, second = (T.casefold_form(F.get("_lines", F.lit(i))) for i in (0, 1))
    short = (F.size("_lines") <= 2) & (F.length("_s") <= 120) & (words <= 10)
    alone = (F.size("_lines") == 1) & (F.col("_s").rlike(HEADING_LINE) | (T.is_upper(F.col("_s")) & (words <= 8)))
    named = (T.heading_key(title) != "") & (T.heading_key(F.col("_s")) == T.heading_key(title))
    textual = F.coalesce("content_type", F.lit("text")).isin("text", "heading", "unknown", "")
    path = F.filter(F.transform(F.coalesce("section_path", F.array().cast("array<string>")), T.heading_key), lambda x: x != "")
    toc = lambda x: x.isin("содержание", "оглавление", "table of contents")
    at = F.array_position(F.transform(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), toc), True)
    table = F.col("content_type").isin("table", "table_row") | F.col("table_id").isNotNull()
    return c.select(
        *chunks.columns,
        ((at > 0) & ~toc(F.element_at(path, -1))).alias("toc_parent"),
        ((F.size("_lines") >= 2) & (first != "") & (first == second)).alias("duplicate_heading"),
        ((F.col("_s") != "") & textual & ~toc(T.heading_key(title)) & ~service & short & (named | alone)).alias("heading_only"),
        (table & service).alias("service_table"),
        F.col("page_start").isNull().alias("no_page"),
    ).na.fill(False, ["toc_parent", "duplicate_heading", "heading_only", "service_table"])


def splitter_summary(flagged: DataFrame) -> DataFrame:
    """Counts of each flag, and documents that have one other than heading_only."""
    count = lambda c: F.count_if(F.col(c))
    per = flagged.groupBy("document_id").agg(*[count(c).alias(c) for c in ("toc_parent", "duplicate_heading", "heading_only", "service_table", "no_page")])
    fails = (F.col("toc_parent") > 0) | (F.col("duplicate_heading") > 0) | (F.col("service_table") > 0)
    sums = [F.sum(c).alias(c) for c in ("toc_parent", "duplicate_heading", "heading_only", "service_table", "no_page")]
    return per.agg(F.count("*").alias("documents"), *sums, F.count_if(fails).alias("documents_with_failures"))


def snapshot(documents: DataFrame) -> DataFrame:
    """One row about nested documents: how many, and how many have tables, images and chunks."""
    some = lambda c: F.count_if(F.size(c) > 0)
    return documents.agg(F.count("*").alias("documents"), some("tables").alias("with_tables"), some("images").alias("with_images"), some("chunks").alias("with_chunks"), F.sum(F.size("chunks")).alias("chunks"))
