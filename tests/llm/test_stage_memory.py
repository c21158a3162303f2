"""Stages of the pipeline start with what the executors have free, not with the heap that earlier stages filled."""

import numpy as np
import pytest

from docloom.llm import sentencepiece_codec


def test_a_stage_starts_without_earlier_stages_garbage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.range(2).selectExpr("id as doc_id", "'a b' as text")
    _, stage = corpus_pipeline.STAGES[-1]
    stage(spark, docs, "")  # what it loads may make the JVM collect by itself
    garbage = spark._jvm.java.lang.ref.WeakReference("held by nothing else")
    stage(spark, docs, "")
    assert garbage.get() is None


def test_mixing_starts_no_python_workers_of_a_second_kind(spark, monkeypatch):
    from pyspark import SparkContext

    from docloom.llm import mixing

    def parallelize(*args, **kwargs):
        raise AssertionError("an RDD of Python rows")

    docs = spark.range(20).selectExpr("id as doc_id", "'a b c' as text", "cast(id % 3 as string) as source")
    monkeypatch.setattr(SparkContext, "parallelize", parallelize)
    assert mixing.mix(docs).count() == 20
    assert mixing.mix(docs.limit(0)).count() == 0


def test_ids_do_not_depend_on_characters_indexed_together(monkeypatch):
    from docloom.llm.queries import tokenizer_path

    words = ["".join(map(chr, np.random.default_rng(i).integers(97, 123, 9))) for i in range(300)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 300, 20)]
    whole = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model")).encode_batch(texts)
    monkeypatch.setattr(sentencepiece_codec, "BATCH_CHARS", 50)
    assert sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model")).encode_batch(texts) == whole
