"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import DOCUMENT_EXTENSIONS, PLACEHOLDERS, STEM_SUFFIXES, STOP_WORDS

#: White space of every script and the separators that Java's \s leaves out.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Runs of it that are not one blank already.
RUN = r"(?: [\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}&&[^ ]][\s\x1c-\x1f\x85\p{Z}]*)"
WORD = r"[\p{L}\p{N}_]+"
#: The last letter is looked at first, as most words of other languages end in none of these.
STEM = f"^(?=.*[{''.join(sorted({x[-1] for x in STEM_SUFFIXES}))}]$)(.{{4,}}?)(?:{'|'.join(STEM_SUFFIXES)})$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_lines(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one, three and more line ends to two, ends stripped."""
    one = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(one, "\n{3,}", "\n\n"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\s\x1c-\x1f\x85\p{Z}]+")))


def squeeze(text: Column) -> Column:
    """All white space, no-break spaces too, to single blanks; null to the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " "))


def fold_yo(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def match_form(text: Column) -> Column:
    return fold_yo(squeeze(text))


def casefold_form(text: Column) -> Column:
    return F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))


def heading_key(text: Column) -> Column:
    return F.regexp_replace(casefold_form(text), r"^[ .:;]+|[ .:;]+$", "")


def source_form(text: Column) -> Column:
    """Form in which a stated source is compared: ends stripped of sentence signs."""
    return F.regexp_replace(match_form(text), r"[.!?,;: ]+$", "")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1)), fold_yo)


def stem(word: Column) -> Column:
    """The word without its longest listed suffix, if four letters stay."""
    return F.regexp_replace(word, STEM, "$1")


def search_tokens(text: Column) -> Column:
    """Stems of the words that are neither stop words nor single letters, in order, with repeats."""
    return terms_of(tokens(text))


def terms_of(words: Column) -> Column:
    return F.transform(F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)), stem)


def phrase_form(text: Column) -> Column:
    return F.array_join(search_tokens(text), " ")


def sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?;]){SPACE}+|\n+")
    return F.filter(F.transform(parts, squeeze), lambda s: s != "")


def preview(text: Column, limit: int) -> Column:
    flat = squeeze(text)
    cut = F.regexp_replace(F.substring(flat, 1, limit - 3), r"\s+$", "")
    return F.when(F.length(flat) > limit, F.concat(cut, F.lit("..."))).otherwise(flat)


def document_key(text: Column) -> Column:
    """Name without extension, punctuation and case."""
    base = F.regexp_replace(match_form(text), rf"\.({'|'.join(DOCUMENT_EXTENSIONS)})$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_]+", " "), " +", " "))


def page_label(start: Column, end: Column) -> Column:
    many = F.concat(F.lit("pages "), start.cast("string"), F.lit("-"), end.cast("string"))
    one = F.concat(F.lit("page "), F.coalesce(start, end).cast("string"))
    return F.when(start.isNotNull() & end.isNotNull() & (start != end), many).when(start.isNotNull() | end.isNotNull(), one)


def _some(text: Column) -> Column:
    flat = squeeze(text)
    return F.when(flat != "", flat)


def location_label(filename: Column, section_path: Column, section_title: Column, page_start: Column, page_end: Column, table_id: Column, row_index: Column) -> Column:
    table = F.concat_ws(" - ", F.concat(F.lit("table "), _some(table_id)), F.concat(F.lit("row "), row_index.cast("string")))
    path = F.array_join(F.filter(F.transform(F.coalesce(section_path, F.array().cast("array<string>")), squeeze), lambda p: p != ""), " > ")
    middle = F.when(_some(table_id).isNotNull(), table).when(path != "", path).otherwise(_some(section_title))
    label = F.concat_ws(" - ", _some(filename), middle, page_label(page_start, page_end))
    return F.when(label != "", label)


def is_placeholder(text: Column) -> Column:
    form = source_form(text)
    return (form == "") | form.isin(*PLACEHOLDERS)


def token_recall(expected: Column, actual: Column) -> Column:
    want, have = F.array_distinct(search_tokens(expected)), F.array_distinct(search_tokens(actual))
    share = F.try_divide(F.size(F.array_intersect(want, have)).cast("double"), F.size(want))
    return F.coalesce(F.round(share, 4), F.lit(0.0))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def with_clean(df: DataFrame, text: str = "text", out: str = "clean", mirrored: str | None = None) -> DataFrame:
    """``df`` with squeezed lines as one line: blanks and consecutive repeats dropped, of two equal halves the first; with
    ``mirrored`` also a column of that name, whether there were two.

    Array functions are interpreted and evaluated wherever they stand, so each step is a column of its own.
    """
    keep, mirrored = mirrored is not None, mirrored or "_mirrored"
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), squeeze), lambda s: s != "")
    # forms of whole lines are costly: lines that start alike are compared, the first with the empty form
    df = df.withColumn("_lines", lines).withColumn("_starts", F.transform("_lines", lambda s: search_tokens(F.substring_index(s, " ", 4))))
    before = lambda i: F.coalesce(F.get("_lines", i - 1), F.lit(""))
    new = F.filter("_lines", lambda s, i: ((i > 0) & ~alike(F.get("_starts", i), F.get("_starts", i - 1))) | (phrase_form(s) != phrase_form(before(i))))
    joined = F.when(F.size("_kept") > 0, F.array_join("_kept", " ")).otherwise(squeeze(F.col(text)))
    df = df.withColumn("_kept", new).withColumn("_joined", joined).withColumn("_words", F.split("_joined", " "))
    df = df.withColumn(mirrored, is_mirrored(F.col("_joined"), F.col("_words")))
    df = df.withColumn(out, F.when(F.col(mirrored), halves(F.col("_words"))[0]).otherwise(F.col("_joined")))
    return df.drop("_lines", "_starts", "_kept", "_joined", "_words", *([] if keep else [mirrored]))


def is_mirrored(flat: Column, words: Column | None = None) -> Column:
    """Six words or more whose halves have the same phrase form. ``words``: the text at its blanks, if it is at hand."""
    words = F.split(flat, " ") if words is None else words
    left, right = halves(words)
    # most texts differ in the first words of their halves already, and forms of whole texts are costly
    a, b = (search_tokens(part) for part in halves(words, 24))
    return (F.size(words) >= 6) & alike(a, b) & (phrase_form(left) == phrase_form(right))


def alike(a: Column, b: Column) -> Column:
    """One list is the start of the other."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n) == F.slice(b, 1, n)


def halves(words: Column, limit: int | None = None) -> tuple[Column, Column]:
    """Both halves of a text's words, or the first ``limit`` words of each."""
    half = F.floor(F.size(words) / 2).cast("int")
    short = lambda n: n if limit is None else F.least(n, F.lit(limit))
    return F.array_join(F.slice(words, 1, short(half)), " "), F.array_join(F.slice(words, half + 1, short(F.size(words))), " ")


def snippet(clean: Column, terms: Column, window: int = 320) -> Column:
    """A window of sanitised text around the first word that a query term names."""
    words = F.split(clean, " ")
    stems = F.transform(words, lambda w: stem(F.regexp_replace(F.lower(w), r"""^[.,:;!?()\[\]{}"']+|[.,:;!?()\[\]{}"']+$""", "")))
    hits = F.filter(F.transform(stems, lambda s, i: F.when(F.array_contains(terms, s), i)), lambda i: i.isNotNull())
    at = F.coalesce(F.get(hits, F.lit(0)), F.lit(0))
    offset = F.length(F.array_join(F.slice(words, 1, at), " "))
    start = F.greatest(F.lit(0), offset - window // 3)
    end = F.least(F.length(clean), start + window)
    body = F.trim(F.substring(clean, start + 1, end - start))
    return squeeze(F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(clean), "...").otherwise("")))
