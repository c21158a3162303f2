"""Scalar functions and gates against plain Python."""

import re

from pyspark.sql import functions as F

from docloom.functions import quality as Q
from docloom.functions import text as T
from docloom.functions.vocabulary import STEM_SUFFIXES, Rules
from docloom.operators import audit, evidence, qa
from docloom.sources.questions import choose_delimiter


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", f(F.col("x"))).collect())]


def test_stems_and_tokens(spark):
    words = ["выбросами", "выброс", "выбросы", "допустимые", "допустимы", "кот", "ЁЛКА", "м³", "a_b1"]
    stem = lambda w: next((w[: -len(s)] for s in sorted(STEM_SUFFIXES, key=len, reverse=True) if len(w) > 4 and w.endswith(s) and len(w) - len(s) >= 4), w)
    got = col(spark, words, lambda x: F.get(F.transform(T.tokens(x), T.stem), F.lit(0)))
    assert got == [stem(w.lower().replace("ё", "е")) for w in words]
    assert got[0] == got[1] == got[2] and got[3] == got[4]
    assert col(spark, ["И в выбросах не проекта a"], T.phrase_form) == ["выброс проект"]


def test_white_space(spark):
    values = ["a  b\r\n\r\n\r\n\r\nc\t d ", "", None, " x\u0085y"]
    assert col(spark, values, T.squeeze) == [" ".join((v or "").split()) for v in values]
    assert col(spark, values[:1], T.normalize_lines) == ["a  b\n\nc d"]


def test_sentences_preview_labels(spark):
    assert col(spark, ["A b. C d! E\n\nf; g"], lambda x: F.array_join(T.sentences(x), "|")) == ["A b.|C d!|E|f;|g"]
    assert col(spark, ["x" * 300, "short"], lambda x: T.preview(x, 240)) == ["x" * 237 + "...", "short"]
    row = spark.range(1).select(
        T.location_label(F.lit("direct.pdf"), F.array(F.lit("A")), F.lit(None), F.lit(7), F.lit(8), F.lit("tbl-direct"), F.lit(None).cast("int")).alias("a"),
        T.location_label(F.lit("test.pdf"), F.array(), F.lit(None), F.lit(3), F.lit(3), F.lit("tbl-1"), F.lit(2)).alias("b"),
        T.location_label(F.lit("test.pdf"), F.array(F.lit("Document"), F.lit("1. Main"), F.lit("1.1 Detail")), F.lit("t"), F.lit(None), F.lit(None), F.lit(None), F.lit(None).cast("int")).alias("c"),
    ).first()
    assert tuple(row) == ("direct.pdf - table tbl-direct - pages 7-8", "test.pdf - table tbl-1 - row 2 - page 3", "test.pdf - Document > 1. Main > 1.1 Detail")


def test_keys_and_placeholders(spark):
    assert col(spark, ["Report 2024.PDF", "Проект «ПДВ».docx"], T.document_key) == ["report 2024", "проект пдв"]
    assert col(spark, ["Нет", "нет.", "", "—", "n/a", "не указано", "src1"], T.is_placeholder) == [True] * 6 + [False]


def test_snippet_window(spark):
    text = " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame([(text,)], "text string").withColumn("clean", F.col("text"))
    got = df.select(T.snippet(F.col("clean"), F.array(F.lit("word150")))).first()[0]
    at = len(" ".join(f"word{i}" for i in range(150)))
    start = max(0, at - 106)
    assert got == "..." + text[start : start + 320].strip() + "..."


def test_clean_lines(spark):
    df = spark.createDataFrame([("aa bb\naa  bb\n\ncc\naa bb",), ("one two three one two three",), (None,)], "text string")
    assert [r.clean for r in T.with_clean(df).select("clean").collect()] == ["aa bb cc aa bb", "one two three", ""]


def test_gates(spark):
    assert col(spark, ["(cid:1)(cid:22)(cid:3) x", "plain"], lambda x: Q.cid_issue(x)[1]) == ["cid_artifact_dominated_fragment", None]
    assert col(spark, ["\x01" * 30 + "abcdefghij" * 2, "", "Normal text of words. " * 5], lambda x: Q.rtf_issue(Q.rtf_metrics(x))) == ["low_printable_ratio", "empty_text", None]
    assert col(spark, ["abc12 de345", "", "Обычный текст"], Q.ocr_issue) == ["suspicious_latinized_ru_ocr", "ocr_empty_text", None]
    kinds = ["1. Introduction", "ВВЕДЕНИЕ", "- item", "THREE UPPER WORDS", "TWO WORDS", "text of it", " "]
    assert col(spark, kinds, Q.block_kind) == ["heading", "heading", "list_item", "heading", "paragraph", "paragraph", "text"]
    assert col(spark, ["1. A", "1 A", "1.1 A", "1.1.1.1.1.1.1 A", "A"], Q.heading_level) == [2, 1, 2, 6, 1]


def test_windows_equal_a_plain_fold(spark):
    def plain(text, limit=700):
        out, held = [], ""
        for s in [x for x in re.split(r"(?<=[.!?;])\s+", " ".join(text.split())) if x]:
            if len(s) > limit:
                out += [held] if held else []
                held = ""
                out += [s[i : i + limit].strip() for i in range(0, len(s), limit)]
            elif held and len(held) + 1 + len(s) > limit:
                out.append(held)
                held = s
            else:
                held = f"{held} {s}" if held else s
        return out + ([held] if held else [])

    texts = ["", "one. two.", "x" * 1500, ("word " * 60 + ". ") * 8, "a. " + "y" * 800 + ". b."]
    got = col(spark, texts, lambda x: F.to_json(evidence.windows(x)))
    import json

    assert [json.loads(g) for g in got] == [plain(t) for t in texts]


def test_requirement_scores(spark):
    src = [("d", "f", 0, "block", "s", "Norms", 1, "Проект должен содержать раздел. Расчет требуется приложить."), ("d", "f", 1, "block", "s", None, 1, "Не допускается сброс. ПДК норматив лимит."), ("d", "f", 2, "block", "s", None, 1, "Просто текст.")]
    df = spark.createDataFrame(src, "document_id string, filename string, ord int, source_type string, section_id string, section_title string, page int, text string")
    got = {r.ord: r for r in evidence.requirements(df, Rules()).collect()}
    assert set(got) == {0, 1}
    assert (got[0].category, got[0].score, got[0].matched_terms) == ("obligation", 0.8, ["должен", "расчет", "требуется"])
    assert got[1].category == "prohibition" and got[1].score == 0.93


def test_rules_config(tmp_path):
    import json

    import pytest

    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"tables": {"category_terms": {"emissions": ["x"]}, "additional_category_terms": {"pollutants": ["код", "y"]}}}))
    rules = Rules.load(str(path))
    assert rules.tables["emissions"] == ("x",) and rules.tables["pollutants"][-1] == "y" and len(rules.tables["pollutants"]) == 4
    path.write_text(json.dumps({"tables": {"category_terms": {"nothing": ["x"]}}}))
    with pytest.warns(RuntimeWarning):
        assert Rules.load(str(path)) == Rules()


def test_table_evidence_and_rows(spark):
    rows = [["Источник", "Оборудование", " "], ["труба", "котел 1"], ["", ""]]
    df = spark.createDataFrame([("d", "f", "tbl-1", None, None, ["Document"], rows)], "document_id string, filename string, table_id string, section_title string, sheet_name string, section_path array<string>, rows array<array<string>>")
    r = evidence.table_evidence(df, Rules()).first()
    assert (r.category, r.row_count, r.column_count, r.headers) == ("sources_or_equipment", 2, 2, ["Источник", "Оборудование"]) and r.score == 0.08 + 0.68 + 0.12 + 0.06 + 0.01 or r.score == 0.95
    t = evidence.row_texts(df).collect()
    assert len(t) == 1 and t[0].row_index == 2 and "Колонки: Источник: труба; Оборудование: котел 1" in t[0].text
    assert col(spark, ["1,5", "-2e3", "1 000", "x", "nan", "", "1_0", "."], evidence.is_numeric_like) == [True, True, True, False, True, False, True, False]


def test_compact_buckets_and_questions(spark):
    values = ["Утверждаю", "1.2.3 Расчет выбросов ......… 15", "Расчет M = C * Q, выброс 0,12 г/с.", "Загрязняющее вещество NOx", "КРАТКО", "остаток", "z " * 70]
    got = col(spark, values, lambda x: audit.compact_bucket(x, F.lit("text"), F.lit("t")))
    assert got == ["service_or_boilerplate", "toc_or_list_fragment", "formula_or_calculation_micro_evidence", "pollutant_or_equipment_micro_evidence", "title_or_cover_fragment", "real_low_value_tail", "other_compact_text"]
    assert col(spark, ["Какая концентрация?", "Источник № 5", "Кто автор?"], qa.is_table_question) == [True, True, False]


def test_delimiters():
    assert choose_delimiter("Вопрос;Ответ;Источник\nа, б;в;г\n") == ";"
    assert choose_delimiter("№ п/п\tВопрос\tОтвет\tДокумент\n1\ta\tb\tc\n") == "\t"
    assert choose_delimiter("question,answer\na,b\n", "tab") == "\t"
