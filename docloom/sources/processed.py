"""Processed documents as JSON files: a strict scan, a tolerant one, and one that collects warnings; typed with missing parts empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a processed document. Whatever a file lacks, or holds in another type, is null.
SCHEMA = (
    "metadata struct<document_id:string,title:string,language:string>, "
    "source struct<filename:string,extension:string,checksum_sha256:string,size_bytes:bigint>, "
    "processing_info struct<text_char_count:bigint,ocr_candidate:boolean,ocr_candidate_reason:string,warnings:array<string>,encoding:string,extractor:string,page_count:int>, "
    "sections array<struct<section_id:string,title:string,level:int,parent_id:string,page_start:int,page_end:int>>, "
    "blocks array<struct<block_id:string,type:string,text:string,section_id:string,page_num:int,page_start:int,page_end:int,table_id:string,"
    "metadata:struct<table_id:string,sheet_name:string,page_num:int,page_start:int,page_end:int>>>, "
    "tables array<struct<table_id:string,section_id:string,page_num:int,n_rows:int,n_cols:int,rows:array<array<string>>>>, "
    "chunks array<struct<chunk_id:string,document_id:string,section_id:string,section_title:string,section_path:array<string>,block_ids:array<string>,order:int,text:string,"
    "page_start:int,page_end:int,content_type:string,table_id:string,table_title:string,table_headers:array<string>,table_row_index:int,table_column_values:map<string,string>,"
    "table_context:string,row_count:int,column_count:int,source_filename:string,source_type:string>>"
)
LISTS = ("sections", "blocks", "tables", "chunks")
MODES = ("strict", "tolerant", "collect")


def _read(kind: str):
    return lambda v: F.from_json(F.to_json(v), kind)


def typed(raw: DataFrame, json: str = "json") -> DataFrame:
    """JSON texts as columns of ``SCHEMA``: members that are missing or of another type are null, lists empty, list items that
    are no objects are left out."""
    whole = F.try_parse_json(F.regexp_replace(json, "^﻿", ""))
    out = raw.withColumn("_v", whole)
    fields = {f.name: f.dataType.simpleString() for f in raw.sparkSession.createDataFrame([], SCHEMA).schema.fields}
    for name, kind in fields.items():
        if name in LISTS:
            items = F.coalesce(F.try_variant_get("_v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
            objects = F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
            # an item at a time: a member of another type costs the item that member, not the whole list
            out = out.withColumn(name, F.transform(objects, _read(kind.removeprefix("array<")[:-1])))
        else:
            out = out.withColumn(name, F.from_json(F.to_json(F.try_variant_get("_v", f"$.{name}", "variant")), kind))
    return out.withColumn("is_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))).drop("_v", json)


def read_processed(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    """Processed documents of a folder's ``*.json`` files: path, the columns of ``SCHEMA`` and, collecting, ``warning``.

    ``strict`` fails on the first file that is no JSON object, ``tolerant`` leaves such files out, ``collect`` returns them with a
    warning and empty columns. A missing folder is an error in every mode.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        raise ValueError(f"no such folder: {folder}")
    if not files.getFileStatus(where).isDirectory():
        raise ValueError(f"not a folder: {folder}")
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    found = typed(raw)
    if mode == "strict":
        fault = F.raise_error(F.concat(F.lit("no processed document: "), "path"))
        return found.where(F.when(F.col("is_object"), True).otherwise(fault.cast("boolean"))).drop("is_object")
    if mode == "tolerant":
        return found.where("is_object").drop("is_object")
    warning = F.when(~F.col("is_object"), F.concat(F.lit("cannot parse processed JSON "), "path"))
    return found.withColumn("warning", warning).drop("is_object")


def document(found: DataFrame, document_id: str) -> DataFrame:
    return found.where(F.col("metadata.document_id") == document_id)


def ocr_candidates(found: DataFrame) -> DataFrame:
    """Which documents need text recognition, why, and by what signs (document_id, ocr_candidate, reason, signals).

    A stated flag holds; an image without text is one; so is a PDF with two of no text, no blocks and no chunks.
    """
    low = F.lower(F.regexp_replace(F.coalesce("source.extension", F.regexp_extract("source.filename", r"(\.[^.]+)$", 1), F.lit("")), r"^\.", ""))
    chars = F.coalesce("processing_info.text_char_count", F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + F.length(F.trim(F.coalesce(b["text"], F.lit(""))))))
    signals = F.array_compact(F.array(F.when(chars == 0, "no_text"), F.when(F.size("blocks") == 0, "no_blocks"), F.when(F.size("chunks") == 0, "no_chunks")))
    image = low.isin("jpg", "jpeg", "png", "tif", "tiff", "bmp") & (chars == 0)
    pdf = (low == "pdf") & (F.size(signals) >= 2)
    stated = F.coalesce("processing_info.ocr_candidate", F.lit(False))
    reason = F.when(stated, F.coalesce("processing_info.ocr_candidate_reason", F.lit("stated"))).when(image, "image_without_text").when(pdf, "pdf_without_text")
    return found.select(F.col("metadata.document_id").alias("document_id"), reason.isNotNull().alias("ocr_candidate"), reason.alias("reason"), signals.alias("signals"))


def ocr_summary(records: DataFrame) -> DataFrame:
    """One row of recognition records (status, text): files, statuses, mean length of the texts of successes."""
    ok = F.col("status") == "success"
    return records.agg(
        F.count("*").alias("files"), F.count_if(ok).alias("success"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "unsupported").alias("unsupported"),
        F.count_if(~F.col("status").isin("success", "empty", "unsupported")).alias("failed"), F.round(F.coalesce(F.avg(F.when(ok, F.length("text"))), F.lit(0.0)), 2).alias("avg_text_chars"),
    )
