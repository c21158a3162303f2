"""One object for a corpus folder: ingest, index, search, answer, extract evidence, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.vocabulary import Rules
from docloom.operators import audit, evidence, export, search, structure
from docloom.sources import files, processed

#: Fields of a processed chunk that chunks of this engine leave to be worked out.
UNSAID = {
    "document_id": "string", "table_title": "string", "table_headers": "array<string>", "table_column_values": "map<string,string>", "table_context": "string", "row_count": "int",
    "column_count": "int", "source_filename": "string", "source_type": "string",
}


class Engine:
    """Tables below ``root``: documents (nested), index entries and errors, as Parquet."""

    def __init__(self, spark: SparkSession, root: str, rules: Rules | None = None, readers: dict | None = None):
        self.spark, self.root, self.rules, self.readers = spark, root.rstrip("/"), rules or Rules(), readers or {}

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def ingest(self, folder: str) -> DataFrame:
        """Read a folder's new files into documents; returns path, status and error of every file."""
        found = files.read_files(self.spark, folder, self.readers)
        own = Window.partitionBy("document_id").orderBy("path")
        found = found.withColumn("copy", F.row_number().over(own))
        known = self._read("documents")
        if known is not None:
            found = found.join(known.select("document_id", F.lit(True).alias("known")), "document_id", "left")
        else:
            found = found.withColumn("known", F.lit(None).cast("boolean"))
        status = F.when(F.col("error_code").isNotNull(), "error").when(F.col("known") | (F.col("copy") > 1), "duplicate").otherwise("processed")
        staged = f"{self.root}/ingest-{self.spark.sparkContext.applicationId}-{self.spark.range(1).select(F.expr('uuid()')).first()[0]}"
        found.withColumn("status", F.coalesce(status, F.lit("processed"))).write.parquet(staged)
        found = self.spark.read.parquet(staged)
        new = found.where("status = 'processed'")
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        built = structure.build(new).join(new.select("document_id", name.alias("filename"), "page_count", "encoding", "warnings"), "document_id")
        lead = F.get(F.filter("sections", lambda s: s["level"] > 0), F.lit(0))["title"]
        built = built.withColumn("title", F.coalesce(lead, F.regexp_replace("filename", r"\.[^.]+$", ""))).withColumn("ingested", F.current_timestamp())
        built.write.mode("append").parquet(f"{self.root}/documents")
        return found.select("path", "status", "error_code", "error")

    def documents(self) -> DataFrame:
        found = self._read("documents")
        if found is None:
            raise ValueError("nothing ingested yet")
        return found

    def document(self, document_id: str) -> DataFrame:
        """One document, nested; an unknown id is a ``KeyError``."""
        found = self.documents().where(F.col("document_id") == document_id)
        if found.isEmpty():
            raise KeyError(f"no document {document_id}")
        return found

    def list_documents(self, limit: int = 50, after: str | None = None) -> DataFrame:
        """A page of documents by id: those after ``after``, with their counts."""
        if not 1 <= limit <= 1000:
            raise ValueError("limit is 1 to 1000")
        d = self.documents().where(F.col("document_id") > after) if after else self.documents()
        counts = [F.size(c).alias(f"n_{c}") for c in ("sections", "blocks", "tables", "images", "chunks")]
        return d.select("document_id", "filename", "title", "page_count", "encoding", *counts).orderBy("document_id").limit(limit)

    def processed(self) -> DataFrame:
        """Documents in the shape of processed JSON (``sources.processed``)."""
        null = lambda t: F.lit(None).cast(t)
        blocks = F.transform(
            "blocks",
            lambda b: F.struct(
                b["block_id"].alias("block_id"), b["type"].alias("type"), b["text"].alias("text"), b["section_id"].alias("section_id"), b["page_num"].alias("page_num"), null("int").alias("page_start"),
                null("int").alias("page_end"), F.when(b["type"] == "table", b["ref"]).alias("table_id"),
                F.struct(null("string").alias("table_id"), null("string").alias("sheet_name"), null("int").alias("page_num"), null("int").alias("page_start"), null("int").alias("page_end")).alias("metadata"),
            ),
        )
        chunks = F.transform(
            "chunks",
            lambda c: F.struct(
                *[c[f].alias(f) for f in ("chunk_id", "section_id", "section_title", "section_path", "block_ids", "text", "page_start", "page_end", "content_type", "table_id", "table_row_index")],
                c["chunk_order"].alias("order"), *[null(t).alias(f) for f, t in UNSAID.items()],
            ),
        )
        extension = F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))
        chars = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.length(F.coalesce(b["text"], F.lit(""))))
        return self.documents().select(
            F.struct("document_id", "title", null("string").alias("language")).alias("metadata"),
            F.struct("filename", extension.alias("extension"), F.col("document_id").alias("checksum_sha256"), null("bigint").alias("size_bytes")).alias("source"),
            F.struct(chars.alias("text_char_count"), null("boolean").alias("ocr_candidate"), null("string").alias("ocr_candidate_reason"), "warnings", "encoding", extension.alias("extractor"), "page_count").alias("processing_info"),
            "sections", blocks.alias("blocks"), "tables", chunks.alias("chunks"),
        )

    def chunk_records(self, max_chunks: int | None = None, include_text: bool = False) -> DataFrame:
        """Hand-off records of all chunks."""
        return export.chunk_records(self.processed(), max_chunks, include_text)

    def ocr_candidates(self) -> DataFrame:
        return processed.ocr_candidates(self.processed())

    def chunks(self) -> DataFrame:
        """Chunks with their place in the corpus, ``entry_ord``: by ingest, file name, document and order in the document."""
        c = self.documents().select("document_id", "filename", "title", "ingested", F.explode("chunks").alias("c"))
        place = F.concat_ws("|", F.date_format("ingested", "yyyyMMddHHmmssSSSSSS"), "filename", "document_id", F.lpad(F.col("c.chunk_order").cast("string"), 9, "0"))
        return c.select(place.alias("entry_ord"), "document_id", "filename", F.col("document_id").alias("checksum"), "title", "c.*")

    def reindex(self) -> DataFrame:
        """Write the index anew: of chunks of one source and section that start alike the first, in order of place."""
        key = [F.lower("filename"), F.col("checksum"), F.col("section_id"), T.phrase_form(F.substring("text", 1, 200))]
        kept = search.first_wins(self.chunks(), key, [F.col("entry_ord")])
        search.index_entries(kept).write.mode("overwrite").parquet(f"{self.root}/index")
        return self.corpus_stats()

    def entries(self) -> DataFrame:
        found = self._read("index")
        if found is None:
            self.reindex()
            found = self._read("index")
        return found

    def corpus_stats(self) -> DataFrame:
        return search.corpus_stats(self.entries())

    def manifest(self) -> DataFrame:
        return self.documents().select("document_id", "filename", "title", "encoding", "warnings", F.lit("processed").alias("status"))

    def search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        return search.search(queries.where(F.length("query") >= 2), self.entries(), top_k)

    def ask(self, questions: DataFrame, top_k: int = 5, max_sentences: int = 4) -> DataFrame:
        return search.ask(questions.where(F.length("query") >= 3), self.entries(), top_k, max_sentences)

    def requirements(self, min_score: float = 0.45, max_per_document: int | None = None, query: str | None = None) -> DataFrame:
        """Candidates of blocks, chunks and tables, in that order of sources; ``source_id`` is the block, chunk or table."""
        d = self.documents()
        titles = F.map_from_entries(F.transform("sections", lambda s: F.struct(s["section_id"], s["title"])))
        d = d.withColumn("_titles", titles)
        table_text = F.transform("tables", lambda t: F.struct(t["table_id"].alias("id"), t["section_id"].alias("section_id"), t["page_num"].alias("page"), evidence.table_text(evidence.clean_rows(t["rows"])).alias("text")))
        kinds = {
            "block": (0, F.transform("blocks", lambda b: F.struct(b["block_id"].alias("id"), b["section_id"].alias("section_id"), b["page_num"].alias("page"), b["text"].alias("text")))),
            "chunk": (1, F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("id"), c["section_id"].alias("section_id"), F.lit(None).cast("int").alias("page"), c["text"].alias("text")))),
            "table": (2, table_text),
        }
        out = None
        for kind, (rank, items) in kinds.items():
            s = d.select("document_id", "filename", "_titles", F.posexplode(items).alias("pos", "x"))
            s = s.select(
                "document_id", "filename", (F.lit(rank) * 1_000_000_000 + F.col("pos")).alias("ord"), F.lit(kind).alias("source_type"), F.col("x.id").alias("source_id"), "x.section_id",
                F.col("_titles")[F.col("x.section_id")].alias("section_title"), "x.page", "x.text",
            )
            out = s if out is None else out.unionByName(s)
        return evidence.requirements(out.where("text is not null"), self.rules, min_score, max_per_document, query)

    def table_evidence(self, min_score: float = 0.25, max_tables: int | None = None, category: str | None = None) -> DataFrame:
        titles = F.map_from_entries(F.transform("sections", lambda s: F.struct(s["section_id"], s["title"])))
        t = self.documents().select("document_id", "filename", titles.alias("_titles"), F.explode("tables").alias("t"))
        t = t.select("document_id", "filename", "t.table_id", F.col("_titles")[F.col("t.section_id")].alias("section_title"), "t.rows")
        return evidence.rank_tables(evidence.table_evidence(t, self.rules), min_score, max_tables, category)

    def chunk_audit(self) -> DataFrame:
        return audit.issue_codes(audit.quality_flags(self.chunks()))

    def splitter_audit(self) -> DataFrame:
        return audit.splitter_summary(audit.splitter_flags(self.chunks()))

    def snapshot(self) -> DataFrame:
        return audit.snapshot(self.documents())
