"""Command line: ``python -m docloom ingest|search|ask|stats|requirements|tables|audit|inventory|export ... --root R ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from docloom.engine import Engine
from docloom.functions.vocabulary import Rules
from docloom.sources import reports
from docloom.sources.files import inventory


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="docloom")
    p.add_argument("command", choices=["ingest", "reindex", "search", "ask", "stats", "manifest", "requirements", "tables", "audit", "splitter", "inventory", "list", "export", "ocr", "inspect"])
    p.add_argument("text", nargs="?", help="folder to ingest, query or question")
    p.add_argument("--root", required=True)
    p.add_argument("--rules")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--max-sentences", type=int, default=4)
    p.add_argument("--min-score", type=float)
    p.add_argument("--limit", type=int)
    p.add_argument("--out", help="report file (.json or .md) besides the printed table")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    e = Engine(spark, a.root, Rules.load(a.rules))
    asked = spark.createDataFrame([(1, a.text or "")], "query_id long, query string")
    run = {
        "ingest": lambda: e.ingest(a.text), "reindex": e.reindex, "search": lambda: e.search(asked, a.top_k), "ask": lambda: e.ask(asked, a.top_k, a.max_sentences),
        "stats": e.corpus_stats, "manifest": e.manifest, "requirements": lambda: e.requirements(0.45 if a.min_score is None else a.min_score, a.limit),
        "tables": lambda: e.table_evidence(0.25 if a.min_score is None else a.min_score, a.limit), "audit": e.chunk_audit, "splitter": e.splitter_audit,
        "inventory": lambda: inventory(spark, a.text), "list": lambda: e.list_documents(a.limit or 50, a.text), "export": lambda: e.chunk_records(include_text=True), "ocr": e.ocr_candidates,
        "inspect": lambda: e.document(a.text).selectExpr("explode(blocks) as b").select("b.*"),
    }
    found = run[a.command]()
    found.show(a.limit or 50, truncate=120)
    if a.out:
        reports.safe_workspace(spark, a.out, [a.root])
        payload = {"command": a.command, **reports.payload_of({"rows": found}, a.limit or reports.LIMIT)}
        if a.out.endswith(".md"):
            reports.write_markdown(spark, a.out, f"docloom {a.command}", payload)
        else:
            reports.write_json(spark, a.out, payload)


if __name__ == "__main__":
    main()
