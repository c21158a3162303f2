"""Corpus pipeline over ``documents``: toxicity, near-duplicates, personal data, mixing, SentencePiece ids.

Every stage reads all that its predecessor kept. Between stages the table is written and read again, so a lost executor costs
a re-read of one table and each stage plans on exact sizes. A stage's result must be written before the next stage is called:
each one first deletes the tables that its predecessors left in the shared folder, except those that its ``docs`` read.

Of all stages: null and empty texts are documents like others and stay (they are never toxic, never copies, hold no personal
data and no words, and have no ids); null ids stay; extra columns of ``documents`` are kept by no stage, and missing ones among
``COLUMNS`` other than doc_id and text are null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, release_unread, shrink_executors, table
from docloom.llm.mixing import mix
from docloom.llm.ngram_join import MAX_BROADCAST_IDS, jaccard_components
from docloom.llm.pii import deployment_key, pseudonymize
from docloom.llm.queries import tokenizer_path
from docloom.llm.sentencepiece_codec import encode_decode
from docloom.llm.toxicity import fit, score

TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
COLUMNS = list(TYPES)


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, and nothing that earlier stages left behind, on disk or in the executors' heaps."""
    release_unread(docs)
    shrink_executors(docs.sparkSession)
    have = set(docs.columns)
    return docs.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in TYPES.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learned from the labels outside the held-out fold, doesn't reject.

    Repeated rows are judged alike; without toxic labels nothing is rejected.
    """
    docs = _columns(docs)
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the n-gram Jaccard join.

    Rows without an id stay. Where an id stands for several rows, equal texts are one, and different ones all stay if the id
    is the smallest of its component.
    """
    docs = _columns(docs)
    members = materialize(jaccard_components(docs), "members")
    kept = materialize(members.where("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    ids = F.broadcast(kept) if kept.count() <= MAX_BROADCAST_IDS else kept
    stay = docs.join(ids, "doc_id", "left_semi")
    if not members.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        others = [c for c in COLUMNS if c not in ("doc_id", "text")]
        stay = stay.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest")).select("doc_id", "text", "rest.*").select(*COLUMNS)
    return stay.union(docs.where("doc_id is null"))


def pseudonymize_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by format-preserving pseudonyms; repeated rows stay repeated."""
    done = pseudonymize(_columns(docs), deployment_key(spark))
    return done.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words by its size, rounded; documents of no words stay once.

    Rows that share an id are taken as often as the id's words are taken; a null source is a source of its own.
    """
    docs = _columns(docs)
    taken = mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    taken = materialize(taken.select(F.col("doc_id").alias("mixed_id"), times.alias("times")).where("times > 0"), "mix-times")
    side = F.broadcast(taken) if taken.count() <= MAX_BROADCAST_IDS else taken
    repeated = docs.join(side, F.col("doc_id").eqNullSafe(F.col("mixed_id")))
    return repeated.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with what they decode to described; repeated rows have equal ids."""
    return encode_decode(_columns(docs), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", pseudonymize_pii),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece_ids),
]
#: Learned lexicons, byte-pair segmentation and keyed permutations are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
