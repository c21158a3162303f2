"""Processed documents, chunk records, report sinks, workspace guards and the gates of extracted files."""

import json

import pytest

from docloom.operators import export
from docloom.sources import files, processed, reports

DOCUMENT = {
    "metadata": {"document_id": "d1", "title": " A  title "}, "source": {"filename": "a.docx", "extension": ".docx"},
    "sections": [{"section_id": "s1", "title": "Document", "level": 0}, {"section_id": "s2", "title": "One", "parent_id": "s1"}, 7, {"section_id": "s3", "title": "Two", "parent_id": "s2"}],
    "blocks": [{"block_id": "b1", "type": "table", "page_num": 4, "metadata": {"table_id": "t1", "sheet_name": "Sheet"}}, {"block_id": "b2", "type": "paragraph", "text": "x", "page_num": "wrong"}],
    "tables": [{"table_id": "t1", "n_rows": 3, "n_cols": 2, "rows": [["", ""], ["H1", " H2 "], ["1", "2"]]}],
    "chunks": [
        {"chunk_id": "c1", "section_id": "s3", "block_ids": ["b1", "gone"], "text": "A row of it", "order": 0},
        {"chunk_id": "c2", "section_id": "lost", "block_ids": ["b2"], "text": "words " * 30, "page_start": 9, "content_type": "text", "section_path": ["Own", " path "], "order": 1},
        {"chunk_id": "c3", "text": "", "order": 2},
    ],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps(DOCUMENT), encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken", encoding="utf-8")
    (tmp_path / "c.json").write_text("[1]", encoding="utf-8")
    (tmp_path / "d.json").write_text('{"sections": "none", "chunks": [{"chunk_id": "z"}], "metadata": 5}', encoding="utf-8")
    (tmp_path / "e.txt").write_text("no document", encoding="utf-8")
    return str(tmp_path)


def test_processed_scans(spark, folder):
    found = processed.read_processed(spark, folder, "collect").orderBy("path").collect()
    assert [r.path[-6:] for r in found] == ["a.json", "b.json", "c.json", "d.json"] and [r.warning is None for r in found] == [True, False, False, True]
    assert len(found[0].sections) == 3 and found[0].blocks[0].page_num == 4 and found[3].sections == [] and found[3].chunks[0].chunk_id == "z" and found[3].metadata.document_id is None
    tolerant = processed.read_processed(spark, folder, "tolerant")
    assert tolerant.count() == 2 and processed.document(tolerant, "d1").count() == 1
    with pytest.raises(Exception, match="no processed document"):
        processed.read_processed(spark, folder).collect()
    for wrong in (folder + "/none", folder + "/a.json"):
        with pytest.raises(ValueError):
            processed.read_processed(spark, wrong)
    with pytest.raises(ValueError):
        processed.read_processed(spark, folder, "other")


def test_chunk_records(spark, folder):
    got = {r.chunk_id: r for r in export.chunk_records(processed.read_processed(spark, folder, "tolerant"), include_text=True).collect()}
    a = got["c1"]
    assert (a.document_id, a.title, a.content_type, a.table_id, a.table_title, a.table_headers) == ("d1", "A title", "table_row", "t1", "Sheet", ["H1", "H2"])
    assert (a.page_start, a.page_end, a.row_count, a.column_count, a.section_path, a.source_block_ids) == (4, 4, 3, 2, ["Document", "One", "Two"], ["b1", "gone"])
    assert a.quality_flags == ["short_chunk", "table_like_text"] and a.location_label == "a.docx - table t1 - page 4" and a.text == "A row of it" and a.source_type == "docx"
    b = got["c2"]
    assert (b.content_type, b.page_start, b.page_end, b.section_title, b.section_path, b.table_id) == ("text", 9, None, None, ["Own", "path"], None)
    assert b.quality_flags == ["missing_section"] and len(b.handoff_notes) == 1
    assert got["c3"].quality_flags == ["empty_or_whitespace_text", "missing_page", "missing_section", "unknown_content_type"] and got["z"].document_id == ""
    assert len(export.chunk_records(processed.read_processed(spark, folder, "tolerant"), max_chunks=1).collect()) == 2


def test_reports_replace_whole_files(spark, tmp_path):
    path = str(tmp_path / "r.json")
    reports.write_json(spark, path, {"a": 1})
    reports.write_json(spark, path, {"b": "ё", "rows": [{"x": 1}]})
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"b": "ё", "rows": [{"x": 1}]} and "ё" in (tmp_path / "r.json").read_text(encoding="utf-8")
    reports.write_markdown(spark, str(tmp_path / "r.md"), "T", {"n": 2, "part": {"k": "v"}, "rows": [{"x": "a|b", "y": None}], "none": []})
    assert (tmp_path / "r.md").read_text().splitlines()[:3] == ["# T", "", "- n: 2"] and "| a\\|b |  |" in (tmp_path / "r.md").read_text()
    assert not [f for f in tmp_path.iterdir() if f.suffix == ".tmp"]
    assert reports.payload_of({"t": spark.range(5)}, 2)["t"] == [{"id": 0}, {"id": 1}] and reports.read_file(spark, str(tmp_path / "none")) is None


def test_workspaces_stay_out_of_production(spark, tmp_path):
    production = str(tmp_path / "store")
    for wrong in ("/", production, production + "/inside", str(tmp_path)):
        with pytest.raises(ValueError):
            reports.safe_workspace(spark, wrong, [production])
    own = tmp_path / "work"
    reports.prepare_workspace(spark, str(own), [production])
    (own / "left").write_text("x")
    reports.prepare_workspace(spark, str(own), [production])
    assert (own / "left").exists()
    reports.prepare_workspace(spark, str(own), [production], clean=True)
    assert own.is_dir() and not (own / "left").exists()


def test_gates_of_extracted_files(spark, tmp_path):
    (tmp_path / "good.rtf").write_text(r"{\rtf1 Plain words of a text that is read as it is.\par And more of them here.}")
    (tmp_path / "bad.rtf").write_text(r"{\rtf1 " + "#@~^`" * 60 + "}")
    cids = "(cid:1)(cid:2)(cid:3)(cid:4)"

    def fake_pdf(content):
        return [files.block("paragraph", cids, 1), files.block("paragraph", "Readable words.", 1), files.block("paragraph", "Readable words.", 2)], 2, None, []

    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    got = {r.path[-8:]: r for r in files.read_files(spark, str(tmp_path), {".pdf": fake_pdf}).collect()}
    assert len(got["good.rtf"].raw_blocks) == 2 and not [w for w in got["good.rtf"].warnings if "skipped" in w]
    assert got["/bad.rtf"].raw_blocks == [] and "RTF text skipped" in got["/bad.rtf"].warnings[-1]
    pdf = next(r for p, r in got.items() if p.endswith("x.pdf"))
    assert [b.text for b in pdf.raw_blocks] == ["Readable words."] * 2 and "cid_artifact_dominated_fragment" in pdf.warnings[0]
