"""Text quality gates and block rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, casefold_form, heading_key, is_upper, normalize_lines, squeeze
from .vocabulary import STANDALONE_TITLES, TABLE_LIKE_TERMS, TOC_TITLES

# Punctuation that counts as no noise, and character classes of the gates.
COMMON_PUNCTUATION = r""".,;:!?()\[\]{}"'\-/\\№%+=<>|"""
OCR_PUNCTUATION = r""".,;:!?()\[\]{}"'\-/№"""
TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
SUSPICIOUS = "(?iu)curyanuoumas|kapra|c[rt]p?a[pb]k[aа]|k[o0][mм][a-zа-яё0-9]*4[eе]?[cс][tт][bв][eе]"
NOISE = rf"[^\p{{L}}\p{{N}}\s\x1c-\x1f\x85\p{{Z}}{COMMON_PUNCTUATION}]"
CONTROL = r"[\p{C}&&[^\n\r\t]]"
UNPRINTABLE = r"[\p{C}&&[^\t\n\x0b\x0c\r\x1c-\x1f\x85]]"
OCR_NOISE = rf"[^\p{{L}}\p{{N}}\s\x1c-\x1f\x85\p{{Z}}{OCR_PUNCTUATION}]"
RUN = r"([^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}])\1{7,}"


def share(text: Column, pattern: str) -> Column:
    """Share of the characters that match, to three places."""
    return F.round(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1)), 3)


def rtf_metrics(text: Column, normalized: bool = False) -> dict[str, Column]:
    """Measures of a text; seven expressions read it, so a caller with a normalised column at hand says so."""
    clean = text if normalized else normalize_lines(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(clean, F.lit(f"({TOKEN})"), F.lit(1))
    words = F.filter(tokens, lambda t: (F.length(t) >= 2) & t.rlike(r"\p{L}"))
    return {
        "char_count": F.length(clean),
        "printable_ratio": F.round(F.lit(1.0) - F.regexp_count(clean, F.lit(UNPRINTABLE)) / F.greatest(F.length(clean), F.lit(1)), 3),
        "control_ratio": share(clean, CONTROL),
        "symbol_noise_ratio": share(clean, NOISE),
        "alpha_ratio": share(clean, r"\p{L}"),
        "word_like_token_ratio": F.coalesce(F.round(F.try_divide(F.size(words), F.size(tokens)), 3), F.lit(0.0)),
        "repeated_symbol_run_count": F.regexp_count(clean, F.lit(RUN)),
    }


def rtf_issue(m: dict[str, Column]) -> Column:
    n = m["char_count"]
    return (
        F.when(n == 0, "empty_text")
        .when((n >= 40) & (m["printable_ratio"] < 0.88), "low_printable_ratio")
        .when((n >= 40) & (m["control_ratio"] >= 0.06), "excessive_control_chars")
        .when((n >= 80) & (m["symbol_noise_ratio"] >= 0.35) & (m["alpha_ratio"] < 0.35), "binary_like_symbol_density")
        .when((n >= 80) & (m["word_like_token_ratio"] < 0.18) & (m["symbol_noise_ratio"] >= 0.22), "low_word_quality")
        .when((n >= 80) & (m["repeated_symbol_run_count"] >= 2) & (m["symbol_noise_ratio"] >= 0.18), "suspicious_symbol_repetition")
    )


def cid_issue(text: Column) -> tuple[Column, Column]:
    """Number of character-id artefacts, and what is wrong with the fragment, if anything."""
    clean = normalize_lines(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(clean, F.lit(r"(?i)(\(cid:\d+\))"), F.lit(1))
    chars, n = F.length(F.array_join(found, "")), F.greatest(F.length(clean), F.lit(1))
    issue = F.when((F.size(found) >= 3) & (chars / n >= 0.35), "cid_artifact_dominated_fragment").when(
        (F.size(found) >= 8) & (F.size(found) / n * 100 >= 8), "excessive_cid_artifact_density"
    )
    return F.size(found), issue


def is_toc_title(text: Column) -> Column:
    return heading_key(text).isin(*TOC_TITLES)


def block_kind(text: Column) -> Column:
    """Kind of a text block without style hints: heading, list_item, paragraph or text (empty)."""
    flat = squeeze(text)
    words = F.regexp_count(flat, F.lit(r"[^ ]+"))
    return (
        F.when(flat == "", "text")
        .when(heading_key(text).isin(*STANDALONE_TITLES), "heading")
        .when(flat.rlike(r"^(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.?)\s+.+$"), "heading")
        .when(flat.rlike(r"^(?:[-*•]|\d+\.)\s+.+$"), "list_item")
        .when(is_upper(flat) & words.between(3, 12), "heading")
        .otherwise("paragraph")
    )


def heading_level(text: Column) -> Column:
    mark = F.regexp_extract(squeeze(text), r"^(\d+(?:\.\d+)*\.?)\s", 1)
    return F.when(mark != "", F.least(F.length(F.regexp_replace(mark, r"[^.]", "")) + 1, F.lit(6))).otherwise(1)


def is_table_like(text: Column, squeezed: bool = False) -> Column:
    low = F.lower(text if squeezed else squeeze(text))
    shape = low.rlike(r"\|.+\||;.*;|(?:^|[^\p{L}\p{N}_])(?:row|column) +\d+(?:[^\p{L}\p{N}_]|$)")
    return (low != "") & (shape | reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in TABLE_LIKE_TERMS]))


def ocr_issue(text: Column) -> Column:
    """First matching fault of recognised text, by its noise, scripts and odd mixed words."""
    clean = normalize_lines(F.coalesce(text, F.lit("")))
    n, safe = F.length(clean), F.greatest(F.length(clean), F.lit(1))
    alpha = F.regexp_count(clean, F.lit(r"\p{L}"))
    printable = F.lit(1.0) - F.regexp_count(clean, F.lit(UNPRINTABLE)) / safe
    cyrillic = F.coalesce(F.try_divide(F.regexp_count(clean, F.lit(r"[\x{0400}-\x{04FF}]")), alpha), F.lit(0.0))
    noise = F.regexp_count(clean, F.lit(OCR_NOISE)) / safe
    words = F.regexp_extract_all(clean, F.lit(f"({TOKEN})"), F.lit(1))
    latin, digit, other = (lambda p: lambda w: w.rlike(p))("[A-Za-z]"), (lambda w: w.rlike("[0-9]")), (lambda w: w.rlike(r"[\x{0400}-\x{04FF}]"))
    mixed = F.size(F.filter(words, lambda w: (latin(w) & other(w)) | ((F.length(w) >= 5) & latin(w) & digit(w))))
    odd = F.filter(words, lambda w: (F.length(w) >= 5) & (w.rlike(SUSPICIOUS) | (latin(w) & digit(w) & ~other(w))))
    latinized = (cyrillic < 0.15) & ((F.size(odd) >= 2) | ((n <= 80) & F.exists(odd, digit)))
    return (
        F.when(n == 0, "ocr_empty_text")
        .when((n >= 8) & (printable < 0.85), "low_printable_ratio")
        .when((n >= 20) & (noise >= 0.3) & (alpha / safe < 0.7), "excessive_mixed_symbol_noise")
        .when(latinized, "suspicious_latinized_ru_ocr")
        .when((n >= 12) & (F.coalesce(F.try_divide(mixed, F.size(words)), F.lit(0.0)) >= 0.5) & (noise >= 0.18), "excessive_mixed_symbol_noise")
    )


__all__ = ["SPACE", "casefold_form", "rtf_metrics", "rtf_issue", "cid_issue", "block_kind", "heading_level", "is_table_like", "is_toc_title", "ocr_issue"]
