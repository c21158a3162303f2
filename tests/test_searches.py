"""Scores of whole tables: pairs of queries and entries are made where entries are read."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import qa, scoring, search, texts
from docloom.operators.staging import staged
from docloom.plans import queries as plans

SEARCHES = ["rnk03_search_top_k", "rnk02_composite", "rnk04_ask", "rnk09_top_hits", "str11_snippets", "agg07_qa_summary", "agg08_retrieval_eval", "qae02_failure_taxonomy", "rnk07_hit_at_k"]


@pytest.mark.parametrize("name", SEARCHES)
def test_no_pair_is_dealt_out(spark, sf_dir, name):
    plan = plans.REGISTRY[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(terms" not in plan


#: Searches that write no index.
NARROW = ["qae02_failure_taxonomy", "rnk02_composite", "rnk04_ask", "rnk07_hit_at_k", "rnk09_top_hits", "str11_snippets"]


@pytest.mark.parametrize("name", NARROW)
def test_the_words_of_the_corpus_are_not_written(spark, sf_dir, name, monkeypatch):
    written = []
    for module in (search, qa, plans):
        monkeypatch.setattr(module, "staged", lambda df, label: written.append(set(df.columns)) or staged(df, label))
    plans.REGISTRY[name](spark, sf_dir)
    assert any("found" in c for c in written) and not any(c & {"terms", "clean", "text"} for c in written)


def rows():
    texts = ["alpha beta gamma", "Alpha, beta gamma delta!", "xalpha beta gammay", None, "", "beta " * 30, "alpha beta gamma", "ALPHA\nalpha beta"]
    return [(f"e{i:02}", f"d{i % 3}", f"f{i % 2}.txt", f"c{i % 3}", f"s{i % 2}", ["Alpha beta gamma", None, "", "Beta"][i % 4], "The gamma file", texts[i % 8]) for i in range(40)]


CHUNKS = "entry_ord string, document_id string, filename string, checksum string, section_id string, section_title string, title string, text string"
QUERIES = [("a", "alpha beta gamma"), ("b", "beta beta"), ("c", "zzz"), ("d", ""), ("e", "gamma"), ("f", "the alpha gamma beta"), (None, "alpha")]


def test_scores_equal_joined_ones(spark):
    entries = search.index_entries(spark.createDataFrame(rows(), CHUNKS))
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    got, want = ({(r.query_id, r.entry_ord): (round(r.bm25, 7), r.overlap, round(r.score, 7)) for r in f(queries, entries).collect()} for f in (search.composite, search.joined))
    assert got == want and len(got) > 60


def test_hits_of_small_batches_are_those_of_the_whole(spark):
    chunks = spark.createDataFrame(rows(), CHUNKS)
    entries, queries = search.index_entries(chunks), spark.createDataFrame(QUERIES, "query_id string, query string")
    whole = sorted(tuple(r) for r in search.search(queries, entries.coalesce(1), 4).collect())
    assert whole == sorted(tuple(r) for r in search.search(queries, entries.repartition(23), 4).collect())
    pairs = [r for r in search.joined(queries, entries).collect() if r.query_id == "b"]
    hits, seen, sources = [], set(), []
    for r in sorted(pairs, key=lambda r: (-r.score, r.entry_ord)):
        if r.same not in seen and sources.count(r.checksum) < 3:
            sources.append(r.checksum)
            hits.append(r.entry_ord)
        seen.add(r.same)
    assert [r[2] for r in whole if r[0] == "b"] == hits[:4]


def test_entries_that_share_a_place_count_together(spark):
    entries = search.index_entries(spark.createDataFrame([*rows(), *rows()[:3]], CHUNKS))
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    got, want = (sorted(map(str, f(queries, entries).select("query_id", "entry_ord", "overlap", F.round("score", 6)).collect())) for f in (search.composite, search.joined))
    assert got == want


@pytest.mark.parametrize("more", [0, 3])
def test_chunks_give_what_their_index_gives(spark, more):
    chunks = spark.createDataFrame([*rows(), *rows()[:more]], CHUNKS).repartition(3)
    two = [("g", "alpha bet"), ("h", "lpha beta gamma"), ("i", "beta gamm"), ("j", "АЛЬФА")]
    queries, index = spark.createDataFrame([*QUERIES, *two], "query_id string, query string"), staged(search.index_entries(chunks), "whole")
    for f in (search.composite, search.search, search.ask):
        got, want = ([r.asDict() for r in f(queries, e).collect()] for e in (chunks, index))
        short = lambda found: sorted(str({k: round(v, 7) if isinstance(v, float) else v for k, v in r.items()}) for r in found)
        assert short(got) == short(want) and got


@pytest.mark.parametrize("cells", [1, 50, 400_000])
def test_found_words_in_slices(monkeypatch, cells):
    monkeypatch.setattr(scoring, "CELLS", cells)
    own = scoring.batch_of([("a", "x y z", 3), ("b", "y", 1), ("c", "q", 1)], [("a", "x", 1), ("a", "y", 1), ("a", "z", 1), ("b", "y", 2), ("c", "q", 1)], {}, 1.0, 1.5, 0.75, 3)
    said = pa.array([["ax", "y", "zz", "y"], None, [], ["y", "x"], ["x", "y", "z"]] * 40, pa.list_(pa.string()))
    got = {k: v.to_pylist() for k, v in scoring.found(said.slice(5), own, pa.array(own.terms)).items()}
    want = {"found": [[2], [], [], [1, 2], [1, 2, 3]], "counts": [[2], [], [], [1, 1], [1, 1, 1]], "dl": [4, 0, 0, 2, 3], "held": [[0, 1], [], [], [1], [0, 1]]}
    assert got == {k: v * 39 for k, v in want.items()}


def test_words_of_an_index_take_no_lambda_each(spark):
    plan = search.index_entries(spark.createDataFrame(rows(), CHUNKS)).select("terms", "clean")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_forms_of_one_pass_are_the_columns(spark):
    odd = [
        None, "", " \t\n", "a", "Ёлка\u00a0ёлки\r\nёлка ЁЛКИ\x85\u2028x", "one two three one two three", "one two one two one two one two one two one two", "--- \n*** \n--- a", "İstanbul ΑΣ ΑΣΑ Straße_1 ²³ Ⅷ ¾",
        "wait wait waiting and more\nwait wait waiting and more!\nwait wait waiting and other", "the of\nand\nlong lines", "caf\u0065\u0301 \U0001d400\U0001e900 \u200bword \ufeffx", "x " * 30 + "y " + "x " * 30 + "y", "a\x1cb\x1dc\x1ed\x1fe\x0bf\x0cg\rh",
    ]
    every = ["".join(f"{chr(c)}a{chr(c)} b" for c in range(lo, min(lo + 512, 0x110000)) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x33000, 512)]
    df = spark.createDataFrame([(t,) for t in [*odd, *every]], "text string").repartition(4)
    own = T.with_clean(df.withColumn("n_tokens", F.size(T.tokens(F.col("text")))).withColumn("terms", T.search_tokens(F.col("text"))), mirrored="mirrored")
    own = own.withColumn("again", F.col("mirrored") & T.is_mirrored(F.col("clean"))).withColumn("p", texts.parts(F.col("text")))
    got = staged(own, "forms").collect()
    names = ("terms", "n_tokens", "clean", "mirrored", "again")
    assert [r.text for r in got if any(r[n] != r.p[n] for n in names)] == []
    assert any(r.mirrored and not r.again for r in got) and any(r.again for r in got) and len(got) == len(odd) + len(every)


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select cast(unhex('61FF6220776F7264') as string) as text")
    assert df.select(texts.parts(F.col("text")).alias("p")).first().p.terms == ["word"]
