"""Chunk export: a hand-off record for every chunk of processed documents, old payloads included.

What a chunk says itself holds; the rest is worked out from its section, its blocks and its table. All lookups are inside one
document's row: no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions import text as T

SHORT = 120
# Notes of the hand-off, by the flag or kind that calls for them.
NOTES = {
    "missing_section": "section context is missing or cannot be resolved",
    "missing_page": "page context is not available in linked blocks",
    "short_chunk": "chunk is short and may need neighboring context",
    "table_like": "text looks table-like, but table_id could not be resolved",
    "image": "image/OCR-limited source context; no OCR text is inferred here",
    "unknown": "content type could not be classified from current metadata",
}


def _stated(text: Column) -> Column:
    """A squeezed text, null where it is empty."""
    flat = T.squeeze(text)
    return F.when(flat != "", flat)


def _clean(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.squeeze), lambda x: x != "")


def _by_id(items: Column, field: str) -> Column:
    """Items by their squeezed id; of equal ids the last."""
    pairs = F.transform(items, lambda x: F.struct(T.squeeze(x[field]).alias("key"), x.alias("value")))
    n = F.size(pairs)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda later: later["key"] == p["key"]))
    return F.map_from_entries(last)


def _path(section_id: Column, sections: Column, bound: Column) -> Column:
    """Titles from the root to a section, a step for each section at most; a walk that meets a section again ends."""
    start = F.struct(section_id.alias("at"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("path"))

    def up(state: Column, _: Column) -> Column:
        here = F.try_element_at(sections, state["at"])
        go = state["at"].isNotNull() & (state["at"] != "") & ~F.array_contains(state["seen"], state["at"]) & here.isNotNull()
        title = T.squeeze(here["title"])
        path = F.when(title != "", F.concat(F.array(title), state["path"])).otherwise(state["path"])
        moved = F.struct(here["parent_id"].alias("at"), F.concat(state["seen"], F.array(state["at"])).alias("seen"), path.alias("path"))
        return F.when(go, moved).otherwise(F.struct(F.lit(None).cast("string").alias("at"), state["seen"].alias("seen"), state["path"].alias("path")))

    return F.aggregate(F.sequence(F.lit(0), bound), start, up)["path"]


def chunk_records(documents: DataFrame, max_chunks: int | None = None, include_text: bool = False, preview_chars: int = 300) -> DataFrame:
    """Hand-off records of the chunks of typed processed documents (``sources.processed``), in their order."""
    d = documents.select("metadata", "source", "processing_info", "sections", "blocks", "tables", "chunks")
    d = d.withColumn("_sections", _by_id(F.col("sections"), "section_id")).withColumn("_blocks", _by_id(F.col("blocks"), "block_id"))
    chunks = F.slice("chunks", 1, max_chunks) if max_chunks is not None else F.col("chunks")
    c = d.select("*", F.posexplode(chunks).alias("pos", "c"))
    c = c.withColumn("section_id", _stated(F.col("c.section_id"))).withColumn("section", F.try_element_at("_sections", F.coalesce("section_id", F.lit(""))))
    c = c.withColumn("source_block_ids", _clean(F.col("c.block_ids")))
    c = c.withColumn("linked", F.filter(F.transform("source_block_ids", lambda i: F.try_element_at(F.col("_blocks"), i)), lambda b: b.isNotNull()))
    pages = F.flatten(F.transform("linked", lambda b: F.array(b["page_num"], b["page_start"], b["page_end"], b["metadata"]["page_num"], b["metadata"]["page_start"], b["metadata"]["page_end"])))
    c = c.withColumn("page_start", F.coalesce("c.page_start", F.array_min(pages))).withColumn("page_end", F.coalesce("c.page_end", F.array_max(pages)))
    named = F.filter(F.transform("linked", lambda b: F.coalesce(_stated(b["metadata"]["table_id"]), _stated(b["table_id"]))), lambda x: x.isNotNull())
    known = F.array_distinct(F.filter(F.transform("tables", lambda t: _stated(t["table_id"])), lambda x: x.isNotNull()))
    sole = F.when((F.size(known) == 1) & F.exists("linked", lambda b: b["type"] == "table"), F.get(known, F.lit(0)))
    c = c.withColumn("table_id", F.coalesce(_stated(F.col("c.table_id")), F.get(named, F.lit(0)), sole))
    kinds = F.transform("linked", lambda b: T.squeeze(b["type"]))
    low = F.lower(T.squeeze(F.col("c.text")))
    derived = (
        F.when(F.array_contains(kinds, "image"), "image")
        .when(F.array_contains(kinds, "table") | F.col("table_id").isNotNull(), F.when(F.contains(low, F.lit("строка")) | F.contains(low, F.lit("row")), "table_row").otherwise("table"))
        .when(F.arrays_overlap(kinds, F.array(*map(F.lit, ("paragraph", "heading", "list_item", "text")))), "text")
        .otherwise("unknown")
    )
    c = c.withColumn("content_type", F.coalesce(_stated(F.col("c.content_type")), derived))
    c = c.withColumn("tabular", F.col("content_type").isin("table", "table_row") | F.col("table_id").isNotNull())
    of_table = lambda x: F.when(F.col("tabular"), x)
    c = c.withColumn("table", of_table(F.get(F.filter("tables", lambda t: T.squeeze(t["table_id"]) == F.col("table_id")), F.lit(0))))
    rows = F.filter(F.transform(F.coalesce("table.rows", F.array().cast("array<array<string>>")), lambda r: F.transform(r, T.squeeze)), lambda r: F.exists(r, lambda x: x != ""))
    c = c.withColumn("_rows", rows).withColumn("_said", _clean(F.col("c.table_headers")))
    read = F.when(F.size("_rows") > 1, F.filter(F.get("_rows", F.lit(0)), lambda h: h != "")).otherwise(F.array().cast("array<string>"))
    c = c.withColumn("table_headers", F.when(F.size("_said") > 0, F.col("_said")).otherwise(read))
    sheet = F.get(F.filter(F.transform("linked", lambda b: _stated(b["metadata"]["sheet_name"])), lambda x: x.isNotNull()), F.lit(0))
    titled = _stated(F.col("section.title"))
    c = c.withColumn("table_title", of_table(F.coalesce(_stated(F.col("c.table_title")), sheet, F.when(titled != "Document", titled))))
    c = c.withColumn("section_title", F.coalesce(_stated(F.col("c.section_title")), F.when(F.col("section").isNotNull(), T.squeeze(F.col("section.title")))))
    c = c.withColumn("_own_path", _clean(F.col("c.section_path")))
    c = c.withColumn("section_path", F.when(F.size("_own_path") > 0, F.col("_own_path")).otherwise(_path(F.col("section_id"), F.col("_sections"), F.size("sections"))))
    c = c.withColumn("table_row_index", of_table(F.col("c.table_row_index"))).withColumn("source_filename", F.coalesce(_stated(F.col("c.source_filename")), T.squeeze(F.col("source.filename"))))
    label = T.location_label(F.col("source_filename"), F.col("section_path"), F.col("section_title"), F.col("page_start"), F.col("page_end"), F.col("table_id"), F.col("table_row_index"))
    c = c.withColumn("location_label", label)
    text = F.coalesce("c.text", F.lit(""))
    flat = T.squeeze(text)
    bare = F.exists("linked", lambda b: (b["type"] == "image") & (T.squeeze(b["text"]) == ""))
    unread = F.coalesce(F.col("processing_info.ocr_candidate"), F.lit(False)) & (F.coalesce("processing_info.text_char_count", F.lit(0)) == 0)
    flags = F.array_compact(
        F.array(
            F.when(flat == "", "empty_or_whitespace_text").when(F.length(flat) < SHORT, "short_chunk"), F.when(F.col("section").isNull(), "missing_section"), F.when(F.col("page_start").isNull(), "missing_page"),
            F.when(Q.is_table_like(text), "table_like_text"), F.when(F.col("content_type") == "unknown", "unknown_content_type"), F.when(bare | unread, "image_or_ocr_limited"),
        )
    )
    c = c.withColumn("quality_flags", F.array_sort(flags))
    has = lambda f: F.array_contains("quality_flags", f)
    notes = F.array_compact(
        F.array(
            F.when(has("missing_section"), NOTES["missing_section"]), F.when(has("missing_page"), NOTES["missing_page"]), F.when(has("short_chunk"), NOTES["short_chunk"]),
            F.when(has("table_like_text") & F.col("table_id").isNull(), NOTES["table_like"]), F.when((F.col("content_type") == "image") | has("image_or_ocr_limited"), NOTES["image"]),
            F.when(F.col("content_type") == "unknown", NOTES["unknown"]),
        )
    )
    values = F.map_filter(F.transform_values(F.coalesce("c.table_column_values", F.create_map().cast("map<string,string>")), lambda k, v: T.squeeze(v)), lambda k, v: (T.squeeze(k) != "") & (v != ""))
    out = c.select(
        F.coalesce(_stated(F.col("c.document_id")), T.squeeze(F.col("metadata.document_id"))).alias("document_id"), F.col("source_filename").alias("filename"), "source_filename",
        F.coalesce(_stated(F.col("c.source_type")), F.regexp_replace(T.squeeze(F.col("source.extension")), r"^\.+", "")).alias("source_type"), T.squeeze(F.col("metadata.title")).alias("title"),
        T.squeeze(F.col("c.chunk_id")).alias("chunk_id"), F.col("c.order").alias("order"), F.col("c.order").alias("chunk_order"), "content_type", "section_id", "section_title", "section_path",
        "page_start", "page_end", "source_block_ids", "table_id", "table_title", "table_headers", "table_row_index",
        F.when(F.col("tabular"), values).otherwise(F.create_map().cast("map<string,string>")).alias("table_column_values"), of_table(_stated(F.col("c.table_context"))).alias("table_context"),
        of_table(F.coalesce("c.row_count", "table.n_rows")).alias("row_count"), of_table(F.coalesce("c.column_count", "table.n_cols")).alias("column_count"), "location_label",
        F.col("location_label").alias("citation_label"), F.substring(flat, 1, max(0, preview_chars)).alias("text_preview"), "quality_flags", notes.alias("handoff_notes"),
        *([text.alias("text")] if include_text else []),
    )
    return out
