"""Files to raw blocks: one ``binaryFile`` scan, routed by suffix; what can't be read becomes an error row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions.vocabulary import KNOWN_IMAGE_SUFFIXES, SUPPORTED_SUFFIXES

ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "cp866")
SCHEMA = (
    "document_id string, path string, extractor string, page_count int, encoding string, warnings array<string>, error_code string, error string, "
    "raw_blocks array<struct<kind:string,text:string,page_num:int,style_hint:string,data:array<array<string>>,sheet_name:string>>"
)
Extracted = tuple[list[dict], int | None, str | None, list[str]]


class SourceError(Exception):
    """A file that a source can't read, with a code for the error row."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def block(kind: str, text: str | None = None, page: int | None = None, data: list | None = None, sheet: str | None = None, style: str | None = None) -> dict:
    return {"kind": kind, "text": text, "page_num": page, "style_hint": style, "data": data, "sheet_name": sheet}


def decode(content: bytes) -> tuple[str, str, list[str]]:
    """Text, encoding and warnings: the first encoding that fits, line ends as LF."""
    for encoding in ENCODINGS:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        warnings = [] if encoding == "utf-8" else [f"Text decoded with fallback encoding: {encoding}"]
        return text.replace("\r\n", "\n").replace("\r", "\n").strip(), encoding, warnings
    return content.decode("latin-1").strip(), "latin-1", ["Text decoded with fallback encoding: latin-1"]


def paragraphs(text: str) -> list[dict]:
    return [block("paragraph", p.strip(), 1) for p in text.split("\n\n") if p.strip()]


def read_txt(content: bytes) -> Extracted:
    text, encoding, warnings = decode(content)
    return paragraphs(text), 1, encoding, warnings


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\??|\\(par|line|tab)\b ?|\\([a-zA-Z]+)-?\d* ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SILENT = frozenset("fonttbl colortbl stylesheet info pict generator header footer listtable themedata".split())


def rtf_text(source: str) -> str:
    """Plain text of RTF: groups, escapes and paragraph marks; destinations without text are left out."""
    out, stack, silent = [], [], False
    for m in _RTF.finditer(source):
        byte, code, mark, word, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(silent)
        elif brace == "}":
            silent = stack.pop() if stack else False
        elif sign == "*" or word in _RTF_SILENT:
            silent = True
        elif not silent:
            if byte:
                out.append(bytes([int(byte, 16)]).decode("cp1251", "replace"))
            elif code:
                out.append(chr(int(code) % 65536))
            elif mark:
                out.append("\t" if mark == "tab" else "\n\n" if mark == "par" else "\n")
            elif sign in ("\\", "{", "}", "~"):
                out.append(" " if sign == "~" else sign)
            elif plain:
                out.append(plain)
    return "".join(out).strip()


def read_rtf(content: bytes) -> Extracted:
    text, encoding, warnings = decode(content)
    return paragraphs(rtf_text(text)), 1, encoding, warnings


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _name(x.tag) == name)


def _attribute(node: ElementTree.Element | None, name: str) -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if _name(k) == name), None)


def read_docx(content: bytes) -> Extracted:
    """Body children in order: headings by style, list items by numbering or mark, paragraphs, images, tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(_find(ElementTree.fromstring(z.read("word/document.xml")), "body"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in _find(ElementTree.fromstring(z.read("word/styles.xml")), "style"):
                styles[_attribute(s, "styleId")] = _attribute(next(_find(s, "name"), None), "val")
    line = lambda p: "".join(t.text or "" for t in _find(p, "t")).strip()
    blocks: list[dict] = []
    for child in body:
        kind = _name(child.tag)
        if kind == "tbl":
            rows = [[" ".join(x for x in (line(p) for p in _find(cell, "p")) if x) for cell in row if _name(cell.tag) == "tc"] for row in _find(child, "tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                blocks.append(block("table", None, None, rows))
        elif kind == "p":
            blocks += [block("image") for _ in _find(child, "blip")]
            text = line(child)
            style = _attribute(next(_find(child, "pStyle"), None), "val")
            style = styles.get(style) or style or ""
            if text:
                listed = next(_find(child, "numPr"), None) is not None or text[0] in "-*•"
                blocks.append(block("heading" if style.lower().startswith("heading") else "list_item" if listed else "paragraph", text, style=style or None))
    return blocks, None, None, []


def read_xlsx(content: bytes) -> Extracted:
    """A heading and a table for each sheet in workbook order; cells are strings, empty rows are dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in _find(s, "t")) for s in _find(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        blocks: list[dict] = []
        for i, sheet in enumerate(_find(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"), 1):
            title = sheet.attrib.get("name") or f"Sheet {i}"
            rid = next((v for k, v in sheet.attrib.items() if _name(k) == "id" and k != "id"), None)
            path = "xl/" + (targets.get(rid) or f"worksheets/sheet{i}.xml").lstrip("/").removeprefix("xl/")
            rows = []
            for row in _find(ElementTree.fromstring(z.read(path)), "row"):
                cells = []
                for c in (x for x in row if _name(x.tag) == "c"):
                    value = next((v.text or "" for v in _find(c, "v")), "")
                    if c.attrib.get("t") == "s" and value.isdigit():
                        value = shared[int(value)] if int(value) < len(shared) else ""
                    elif c.attrib.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in _find(c, "t"))
                    cells.append(value.strip())
                if any(cells):
                    rows.append(cells)
            blocks.append(block("heading", title, sheet=title))
            if rows:
                blocks.append(block("table", None, i, rows, title))
    return blocks, None, None, []


def read_image(content: bytes) -> Extracted:
    return [block("image", "", 1)], 1, None, ["Image is present; its text is not read"]


def unavailable(library: str) -> Callable[[bytes], Extracted]:
    def read(content: bytes) -> Extracted:
        raise SourceError("missing_dependency", f"{library} is not installed")

    return read


def read_pdf(content: bytes) -> Extracted:
    try:
        import pdfplumber
    except ImportError:
        raise SourceError("missing_dependency", "pdfplumber is not installed") from None
    blocks: list[dict] = []
    warnings: list[str] = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            blocks += [block("paragraph", p.strip(), n) for p in (page.extract_text() or "").split("\n\n") if p.strip()]
            try:
                tables = page.extract_tables() or []
            except Exception:  # a page's tables may be beyond the library; its text is not
                tables = []
                warnings.append(f"Table extraction failed on page {n}.")
            for rows in tables:
                rows = [[(c or "").strip() for c in r] for r in rows]
                if any(any(r) for r in rows):
                    blocks.append(block("table", None, n, rows))
            blocks += [block("image", None, n) for _ in page.images]
        return blocks, len(pdf.pages), None, warnings


def read_xls(content: bytes) -> Extracted:
    if content[:2] == b"PK":
        return read_xlsx(content)
    return unavailable("xlrd")(content)


#: Readers by suffix; callers add or replace entries, OCR and office converters among them.
READERS: dict[str, Callable[[bytes], Extracted]] = {
    ".txt": read_txt, ".rtf": read_rtf, ".docx": read_docx, ".xlsx": read_xlsx, ".xls": read_xls, ".pdf": read_pdf, ".doc": unavailable("a converter for .doc"),
    ".jpg": read_image, ".jpeg": read_image, ".png": read_image,
}


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder: path, filename, extension, size and class; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(ext.isin(*SUPPORTED_SUFFIXES), "supported").when(ext.isin(*KNOWN_IMAGE_SUFFIXES), "unsupported_image").otherwise("unknown_unsupported")
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), ext.alias("extension"), F.col("length").alias("size_bytes"), kind.alias("category"))


def read_files(spark: SparkSession, folder: str, readers: dict | None = None) -> DataFrame:
    """Documents of a folder with their raw blocks, or an error code and message."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return extract(files, readers)


def extract(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Raw blocks of files (path, content). A document's id is a digest of its content, so equal files have equal ids."""
    table = {**READERS, **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document_id, path, content in zip(batch["document_id"], batch["path"], batch["content"], strict=True):
                found = re.search(r"\.[^./]+$", path)
                suffix = found[0].lower() if found else ""
                row = {"document_id": document_id, "path": path, "extractor": suffix.lstrip("."), "page_count": None, "encoding": None, "warnings": [], "error_code": None, "error": None, "raw_blocks": []}
                try:
                    if suffix not in table:
                        raise SourceError("unsupported_image_format" if suffix in KNOWN_IMAGE_SUFFIXES else "unsupported_format", f"no reader for {suffix or 'files without suffix'}")
                    row["raw_blocks"], row["page_count"], row["encoding"], row["warnings"] = table[suffix](bytes(content))
                except SourceError as e:
                    row["error_code"], row["error"] = e.code, str(e)
                except Exception as e:  # a broken file is a row, not the end of the job
                    row["error_code"], row["error"] = "extract_failed", f"{type(e).__name__}: {e}"
                rows.append(row)
            out = pd.DataFrame(rows)
            out["page_count"] = out["page_count"].astype("Int32")
            yield out

    return gated(files.select(F.sha2("content", 256).alias("document_id"), "path", "content").mapInPandas(run, SCHEMA))


def gated(found: DataFrame) -> DataFrame:
    """Extracted files with the quality gates applied: RTF texts that are noise lose their blocks, PDF paragraphs of glyph numbers
    go; both leave a warning, and so does a PDF without any text."""
    rtf, pdf = F.col("extractor") == "rtf", F.col("extractor") == "pdf"
    text = F.array_join(F.transform("raw_blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")
    noise = Q.rtf_issue(Q.rtf_metrics(F.col("_text")))
    out = found.withColumn("_text", F.when(rtf, text)).withColumn("_noise", F.when(rtf & (F.col("_text") != ""), noise))
    bad = F.filter("raw_blocks", lambda b: (b["kind"] == "paragraph") & Q.cid_issue(b["text"])[1].isNotNull())
    out = out.withColumn("_bad", F.when(pdf, bad))
    out = out.withColumn(
        "raw_blocks",
        F.when(F.col("_noise").isNotNull(), F.slice("raw_blocks", 1, 0)).when(pdf, F.filter("raw_blocks", lambda b: (b["kind"] != "paragraph") | Q.cid_issue(b["text"])[1].isNull())).otherwise(F.col("raw_blocks")),
    )
    lost = F.transform(F.col("_bad"), lambda b: F.concat(F.lit("PDF text fragment skipped: "), Q.cid_issue(b["text"])[1]))
    bare = pdf & F.col("error_code").isNull() & ~F.exists("raw_blocks", lambda b: b["kind"] == "paragraph")
    none = F.array().cast("array<string>")
    warnings = F.concat(
        F.coalesce("warnings", none), F.when(F.col("_noise").isNotNull(), F.array(F.concat(F.lit("RTF text skipped: "), "_noise"))).otherwise(none), F.coalesce(lost, none),
        F.when(bare, F.array(F.lit("PDF text extraction produced empty text; OCR may be required."))).otherwise(none),
    )
    return out.withColumn("warnings", warnings).drop("_text", "_noise", "_bad")
