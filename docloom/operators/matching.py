"""Expected documents matched to files in tiers: exact name, normalized name, containment, token subset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Words that name a part of a source and not the source.
REFERENCE_WORDS = ("book", "chapter", "section", "table", "книга", "раздел", "таблица", "том")
MIN_CONTAINED, MIN_TOKENS = 8, 3
GRAM = 4


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(c, s) of all strings ``inner.c`` that stand somewhere in a string ``outer.s``; both distinct and not empty.

    A string of four characters or more is looked up by its rarest gram of four, a shorter one as a whole; what is found is
    compared. Nothing is compared with everything.
    """
    grams = lambda x, size: F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, F.lit(size)))
    postings = outer.where(F.length("s") >= GRAM).select("s", F.explode(F.array_distinct(grams(F.col("s"), GRAM))).alias("g"))
    asked = inner.where(F.length("c") >= GRAM).select("c", F.explode(F.array_distinct(grams(F.col("c"), GRAM))).alias("g"))
    often = postings.groupBy("g").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "g", "left").groupBy("c").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0")
    long = rarest.select("c", F.col("r.g").alias("g")).join(postings, "g").where(F.contains("s", F.col("c"))).select("c", "s")
    pieces = None
    for size in range(1, GRAM):
        own = outer.where(F.length("s") >= size).select("s", F.explode(F.array_distinct(grams(F.col("s"), size))).alias("c"))
        pieces = own if pieces is None else pieces.union(own)
    return long.union(pieces.join(inner.where(F.length("c") < GRAM), "c").select("c", "s"))


def match_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Status of each expected name: matched (one file), ambiguous (several) or missing, with the first tier that finds any.

    Names without a key, in any spelling, are missing by method ``empty``. Containment holds either way, of any key, for names
    one of whose keys has eight characters. The equality tiers are equi-joins, containment joins on grams, the subset tier on
    the longest word of the expected key. Files without a key match by their exact name only.
    """
    e = expected.select("expected").distinct().withColumn("key", T.document_key(F.col("expected"))).withColumn("low", F.lower(F.trim("expected")))
    e = e.withColumn("alt", T.document_key(F.regexp_extract("expected", r"^([^,]+)", 1)))
    f = files.select("file_id", "filename").withColumn("fkey", T.document_key(F.col("filename"))).withColumn("flow", F.lower("filename"))
    exact = e.where("low <> ''").join(f, e["low"] == f["flow"]).select("expected", "file_id", F.lit(1).alias("tier"))
    keys = e.select("expected", F.greatest(F.length("key"), F.length("alt")).alias("longest"), F.explode(F.array_distinct(F.array("key", "alt"))).alias("k")).where("k <> ''")
    same = keys.join(f, keys["k"] == f["fkey"]).select("expected", "file_id", F.lit(2).alias("tier"))
    wide = keys.where(F.col("longest") >= MIN_CONTAINED)
    ours, theirs = wide.select("k").distinct(), f.where("fkey <> ''").select("fkey").distinct()
    pairs = contained(ours.select(F.col("k").alias("c")), theirs.select(F.col("fkey").alias("s"))).select(F.col("c").alias("k"), F.col("s").alias("fkey"))
    back = contained(theirs.select(F.col("fkey").alias("c")), ours.select(F.col("k").alias("s"))).select(F.col("s").alias("k"), F.col("c").alias("fkey"))
    within = wide.join(pairs.union(back).distinct(), "k").join(f, "fkey").select("expected", "file_id", F.lit(3).alias("tier"))
    fw = f.where("fkey <> ''").withColumn("ftok", F.split("fkey", " "))
    longest = lambda c: F.array_max(F.transform(c, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    et = keys.withColumn("need", F.array_except(F.split("k", " "), F.array(*[F.lit(w) for w in REFERENCE_WORDS]))).where(F.size("need") >= MIN_TOKENS)
    subset = et.withColumn("w", longest(F.col("need"))).join(fw.select("file_id", "ftok", F.explode(F.array_distinct("ftok")).alias("w")), "w")
    subset = subset.where(F.size(F.array_except("need", "ftok")) == 0).select("expected", "file_id", F.lit(4).alias("tier"))
    found = exact.union(same).union(within).union(subset).distinct()
    best = found.join(found.groupBy("expected").agg(F.min("tier").alias("tier")), ["expected", "tier"])
    n = best.groupBy("expected", "tier").agg(F.count_distinct("file_id").alias("n_files"))
    names = ("exact_filename", "normalized_filename_or_stem", "bounded_contains", "token_subset")
    out = e.join(n, "expected", "left")
    method = F.coalesce(*[F.when(F.col("tier") == i, m) for i, m in enumerate(names, 1)], F.when((F.col("key") == "") & (F.col("alt") == ""), "empty"), F.lit("none"))
    status = F.when(F.col("n_files").isNull(), "missing").when(F.col("n_files") == 1, "matched").otherwise("ambiguous")
    return out.select("expected", status.alias("status"), method.alias("method"), F.coalesce("n_files", F.lit(0)).alias("n_files"))
