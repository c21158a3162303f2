"""The driver's tables in the roles of the corpus: documents as chunks, benchmark items as queries, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.vocabulary import Rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The built-in vocabularies are Russian; these words occur in the tables at hand.
RULES = Rules().extended(
    {
        "requirements": {"additional_category_terms": {"obligation": ["license", "password"], "monitoring_or_control": ["tion"], "calculation_or_reporting": ["nicht", "pour"]}},
        "tables": {"additional_category_terms": {"costs_or_resources": ["price", "total"], "sources_or_equipment": ["quantity", "steel", "brass"], "emissions": ["green"]}},
    }
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document; section and page are known for some sources only."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("entry_ord"), F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("filename"),
        F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("section_id"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Part "), "lang")).alias("section_title"), F.col("source").alias("title"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 7 + 1).cast("int")).alias("page_start"), F.lit(None).cast("string").alias("table_id"),
        F.when(F.col("doc_id") % 11 == 0, "unknown").when(F.col("doc_id") % 13 == 0, "heading").otherwise("text").alias("content_type"), "text",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of requirement windows."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("filename"), F.col("doc_id").alias("ord"), F.lit("block").alias("source_type"),
        F.col("lang").alias("section_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("section_title"), F.lit(1).alias("page"), "text",
    )


#: Part keys of one sheet: bounds the rows that are collected into one table, at any number of parts.
SHEET_KEYS = 25_000


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part in a table of its brand and range of keys: a header row, then a row a part. A brand's first sheet has its name."""
    p = table(spark, sf_dir, "part")
    head = F.array(*[F.lit(c) for c in ("part name", "type", "size", "retail price", "")])
    row = F.array(F.coalesce("p_name", F.lit("")), F.coalesce("p_type", F.lit("")), F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" "))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"])
    sheet = F.floor(F.col("p_partkey") / SHEET_KEYS) + 1
    t = p.groupBy("p_brand", sheet.alias("sheet")).agg(rows.alias("body"))
    return t.select(
        F.when(F.col("sheet") == 1, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_brand", "sheet")).alias("table_id"), F.col("p_brand").alias("document_id"), F.col("p_brand").alias("filename"), F.lit(None).cast("string").alias("section_title"),
        F.concat_ws(" ", F.lit("Sheet"), "sheet").alias("sheet_name"), F.array(F.lit("Document"), F.lit("Parts")).alias("section_path"), F.concat(F.array(head), "body").alias("rows"),
    )
