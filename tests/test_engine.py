"""Search, structure, sources, matching, streaming and the registry."""

import io
import math
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import matching, search, structure
from docloom.sources import files
from docloom.sources.questions import read_query_specs, read_questions
from docloom.streaming import ingest

CHUNKS = "entry_ord long, document_id string, filename string, checksum string, section_id string, section_title string, title string, text string"
ROWS = [
    (0, "d0", "a.txt", "c0", "s", "Alpha", "a", "alpha beta gamma beta. Delta words follow here."),
    (1, "d1", "b.txt", "c1", "s", None, "b", "beta only once here with some other words and more words"),
    (2, "d2", "c.txt", "c2", "s", None, "c", "nothing shared at all"),
    (3, "d0", "a.txt", "c0", "s", "Alpha", "a", "alpha beta gamma beta. Delta words follow here."),
]


def test_bm25_by_hand(spark):
    entries = search.index_entries(spark.createDataFrame(ROWS, CHUNKS))
    queries = spark.createDataFrame([(1, "beta beta alpha"), (2, "zzz")], "query_id long, query string")
    got = {(r.query_id, r.entry_ord): (r.bm25, r.overlap) for r in search.bm25(queries, entries).collect()}
    docs = [r[-1].replace(".", "").lower().split() for r in ROWS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in ("alpha", "beta")}
    want = {}
    for i, d in enumerate(docs):
        tf, s = Counter(d), 0.0
        for t in ("beta", "beta", "alpha"):
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            s += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s:
            want[1, i] = s
    assert set(got) == set(want) and all(abs(got[k][0] - v) < 1e-9 for k, v in want.items())


def test_search_drops_repeats_and_ask_answers(spark):
    entries = search.index_entries(spark.createDataFrame(ROWS, CHUNKS))
    queries = spark.createDataFrame([(1, "beta alpha"), (2, "zzz")], "query_id long, query string")
    hits = search.search(queries, entries).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.rank, h.entry_ord) for h in hits] == [(1, 1, 0), (1, 2, 1)]
    answers = {r.query_id: (r.answer, r.n_sources) for r in search.ask(queries, entries).collect()}
    assert answers[2] == ("нет информации в корпусе", 0) and answers[1][0].startswith("alpha beta gamma beta.") and answers[1][1] == 2
    with pytest.raises(ValueError):
        search.search(queries, entries, 21)


def raw(kind, text=None, page=None, data=None, style=None, sheet=None):
    return {"kind": kind, "text": text, "page_num": page, "style_hint": style, "data": data, "sheet_name": sheet}


def test_structure_of_headings_and_tables():
    d = structure.build_document([raw("paragraph", "1. Introduction", 1), raw("paragraph", "Body text", 1), raw("table", None, 1, [["A", "B"], ["1", "2"]])])
    assert [s["title"] for s in d["sections"]] == ["Document", "1. Introduction"] and len(d["tables"]) == 1
    assert [c["content_type"] for c in d["chunks"]] == ["text", "table_row"] and d["chunks"][1]["table_row_index"] == 2


def test_structure_pages_tail_and_overlap():
    long = ["Слово " * 48 + f"конец {i}." for i in range(3)]
    d = structure.build_document([raw("paragraph", "1. Раздел", 1), *[raw("paragraph", t, i + 2) for i, t in enumerate(long)], raw("paragraph", "Короткий финальный вывод.", 5)])
    assert len(d["chunks"]) == 1
    c = d["chunks"][0]
    assert c["block_ids"] == [f"blk-{i}" for i in range(1, 6)] and (c["page_start"], c["page_end"]) == (1, 5)


def test_structure_toc_and_titles():
    d = structure.build_document([raw("paragraph", "СОДЕРЖАНИЕ", 1), raw("paragraph", "1. ОБЩИЕ СВЕДЕНИЯ", 2), raw("paragraph", "Текст раздела.", 2)])
    assert d["sections"][2]["parent_id"] == "sec-0"
    assert structure.build_document([raw("paragraph", "ВВЕДЕНИЕ", 1)])["chunks"] == []
    assert structure.build_document([raw("paragraph", "ПРОЕКТ", 1)])["chunks"] == []
    assert structure.build_document([])["sections"][0]["section_id"] == "sec-0"
    signed = structure.build_document([raw("table", None, 1, [["УТВЕРЖДАЮ", "Директор"], ["подпись", "____"]])])
    assert signed["tables"] == [] and signed["blocks"][0]["classification"] == "service_text"


def test_structure_runs_on_frames(spark):
    df = spark.createDataFrame([(1, "1. Head\nbody of it"), (2, None), (3, "")], "doc_id long, text string")
    rows = structure.build(structure.text_blocks(df)).select("document_id", F.size("chunks").alias("n")).collect()
    assert sorted((r.document_id, r.n) for r in rows) == [("1", 1), ("2", 0), ("3", 0)]


W = 'xmlns:w="http://w"'


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files_to_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет мир\r\n\r\nвторой".encode("cp1251"))
    (tmp_path / "b.docx").write_bytes(
        office({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>- item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>'})
    )
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c/></row></sheetData></worksheet>'
    (tmp_path / "c.XLSX").write_bytes(
        office({"xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></R>', "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>"})
    )
    (tmp_path / "d.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}One \'e9\par Two}")
    (tmp_path / "e.heic").write_bytes(b"x")
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.pdf").write_bytes(b"%PDF")
    got = {r.path[-6:]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    kinds = lambda k: [(b.kind, b.text) for b in got[k].raw_blocks]
    assert kinds("/a.txt") == [("paragraph", "Привет мир"), ("paragraph", "второй")] and got["/a.txt"].encoding == "cp1251" and got["/a.txt"].warnings
    assert kinds("b.docx") == [("heading", "Head"), ("list_item", "- item"), ("table", None)]
    assert kinds("c.XLSX") == [("heading", "S1"), ("table", None)] and got["c.XLSX"].raw_blocks[1].data == [["name", "7"]]
    assert [t for _, t in kinds("/d.rtf")] == ["One й", "Two"]
    assert got["e.heic"].error_code == "unsupported_image_format" and got["f.docx"].error_code == "extract_failed"
    assert got["/g.pdf"].error_code in ("missing_dependency", "extract_failed")
    counts = Counter(r.category for r in files.inventory(spark, str(tmp_path)).collect())
    assert counts == {"supported": 6, "unsupported_image": 1}


def test_question_tables(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Вопрос;Ответ;Источник\nПервый?;да;a.pdf\n;пусто;b\nВторой?;;\n", encoding="utf-8")
    rows = read_questions(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.row_number, r.question, r.expected_answer, r.expected_document) for r in rows] == [(2, "Первый?", "да", "a.pdf"), (4, "Второй?", "", "")]
    (tmp_path / "s.json").write_text('[{"query": "Hello, World"}, {"id": "x", "query": "y", "must_have_results": false}]')
    specs = read_query_specs(spark, str(tmp_path / "s.json")).collect()
    assert [(s.id, s.must_have_results, s.expected_files) for s in specs] == [("hello_world", True, []), ("x", False, [])]


def test_match_tiers(spark):
    names = ["report 2024.pdf", "Проект ПДВ.docx", "Книга 1 Инвентаризация Эко Агро.pdf", "x.zip", "same.txt", "same.doc"]
    f = spark.createDataFrame(list(enumerate(names)), "file_id long, filename string")
    asked = ["Report 2024.PDF", "Проект - ПДВ", "Инвентаризация Эко Агро", "Агро по Эко Инвентаризация", "nothing here", "same", ""]
    got = {r.expected: (r.status, r.method) for r in matching.match_files(spark.createDataFrame([(a,) for a in asked], "expected string"), f).collect()}
    assert got["Report 2024.PDF"] == ("matched", "exact_filename") and got["Проект - ПДВ"] == ("matched", "normalized_filename_or_stem")
    assert got["Инвентаризация Эко Агро"] == ("matched", "bounded_contains") and got["same"] == ("ambiguous", "normalized_filename_or_stem")
    assert got["nothing here"][0] == got[""][0] == "missing"


def test_stream_replaces_entries_of_a_source(spark, tmp_path):
    schema = CHUNKS + ", version long"
    src, index = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([(*r, 1) for r in ROWS[:3]], schema).write.parquet(src)

    def run():
        q = ingest.start(spark.readStream.schema(schema).parquet(src), index, str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    run()
    changed = (*ROWS[1][:-1], "replaced text of this source", 2)
    spark.createDataFrame([changed], schema).write.mode("append").parquet(src)
    run()
    got = {r.checksum: r.text for r in ingest.read_index(spark, index).collect()}
    assert len(got) == 3 and got["c1"] == "replaced text of this source" and got["c0"] == ROWS[0][-1]


def test_a_failed_upsert_leaves_the_old_state(spark, tmp_path, monkeypatch):
    schema, index = CHUNKS + ", version long", str(tmp_path / "index")
    assert ingest.read_index(spark, index) is None
    ingest.upsert(spark.createDataFrame([(*r, 1) for r in ROWS[:3]], schema), index)
    before = sorted(r.text for r in ingest.read_index(spark, index).collect())
    monkeypatch.setattr(ingest, "_replace_current", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest.upsert(spark.createDataFrame([(*ROWS[0][:-1], "half written", 2)], schema), index)
    assert sorted(r.text for r in ingest.read_index(spark, index).collect()) == before


def test_mixed_chunks_are_text_and_table_chunks_are_tables():
    d = structure.build_document([raw("paragraph", "Text before the table.", 1), raw("table", "A caption", 1, [["A", "B"], ["1", "2"]])])
    assert [c["content_type"] for c in d["chunks"]] == ["text", "table_row"]
    d = structure.build_document([raw("table", "A caption", 1, [["A", "B"], ["1", "2"]])])
    assert [c["content_type"] for c in d["chunks"]] == ["table", "table_row"] and d["chunks"][0]["table_id"] == "tbl-1"


def test_parts_of_long_blocks():
    s = ["Word " * 30 + "end.", "Second one.", "x" * 700 + ".", "Tail of it."]
    text = " ".join(s)
    assert structure.parts_of("short") == ["short"] and structure.parts_of("y" * 400) == ["y" * 320, "y" * 80]
    assert structure.parts_of(text) == [" ".join(s[:2]), "x" * 320, "x" * 320, "x" * 60 + ".", "Tail of it."]


def test_section_paths_of_deep_trees_and_cycles(spark):
    rows = [("d", f"s{i}", f"s{i - 1}" if i else None, f"t{i}") for i in range(23)] + [("c", "a", "b", "A"), ("c", "b", "a", "B"), ("c", "x", "a", "X"), ("c", "me", "me", "M"), ("e", "o", "gone", "O")]
    got = {(r.document_id, r.section_id): r.path for r in structure.section_paths(spark.createDataFrame(rows, "document_id string, section_id string, parent_id string, title string")).collect()}
    assert got["d", "s22"] == [f"t{i}" for i in range(23)] and got["d", "s0"] == ["t0"]
    assert got["c", "a"] == ["B", "A"] and got["c", "x"] == ["B", "A", "X"] and got["c", "me"] == ["M"] and got["e", "o"] == ["O"]


def test_registry_has_sql_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 50


def test_engine_end_to_end(spark, tmp_path):
    from docloom.engine import Engine

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("1. Нормы\n\nПроект должен содержать раздел о выбросах. Расчет требуется приложить.", encoding="utf-8")
    (src / "b.txt").write_text("Other text about beta and gamma words.", encoding="utf-8")
    (src / "c.txt").write_text("Other text about beta and gamma words.", encoding="utf-8")
    (src / "d.zip").write_bytes(b"x")
    e = Engine(spark, str(tmp_path / "root"))
    assert sorted((r.path[-5:], r.status) for r in e.ingest(str(src)).collect()) == [("a.txt", "processed"), ("b.txt", "processed"), ("c.txt", "duplicate"), ("d.zip", "error")]
    assert {r.status for r in e.ingest(str(src)).collect()} == {"duplicate", "error"}
    assert e.documents().count() == 2 and e.reindex().first().document_count == 2
    asked = spark.createDataFrame([(1, "выбросы проекта")], "query_id long, query string")
    assert e.search(asked).first().filename == "a.txt" and "выбросах" in e.ask(asked).first().answer
    assert {r.category for r in e.requirements().collect()} == {"obligation"}
    assert e.table_evidence().count() == 0 and e.snapshot().first().documents == 2
    assert e.splitter_audit().first().documents == 2 and e.chunk_audit().count() >= 2 and e.manifest().count() == 2
    assert [r.filename for r in e.list_documents().orderBy("filename").collect()] == ["a.txt", "b.txt"] and e.list_documents(1).count() == 1
    first = e.list_documents(1).first().document_id
    assert e.list_documents(5, first).count() == 1 and e.document(first).count() == 1
    with pytest.raises(KeyError):
        e.document("none")
    records = {r.filename: r for r in e.chunk_records().collect()}
    assert records["a.txt"].section_path == ["Document", "1. Нормы"] and records["a.txt"].content_type == "text" and records["a.txt"].source_type == "txt"
    assert not any(r.ocr_candidate for r in e.ocr_candidates().collect())
    places = [r.entry_ord for r in e.chunks().orderBy("entry_ord").collect()]
    assert len(set(places)) == len(places) and {r.source_id[:3] for r in e.requirements().collect()} <= {"blk", "chk", "tbl"}
