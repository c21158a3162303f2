"""Terms and sanitised forms of whole texts: one narrow Arrow pass, as an index needs all of them of every text.

The forms are those of ``functions.text`` (``terms_of``, ``with_clean``, ``is_mirrored``), where array functions call their lambdas
for every word; here a word is folded and stemmed once while it is remembered, and a text's lines are taken apart once for all forms.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.vocabulary import STOP_WORDS

from . import scoring

#: Words remembered by a worker; beyond them it starts anew.
MEMORY = 200_000
#: Letters and digits of Unicode 14 and 15, which the JVM's classes (Java 17: Unicode 13) leave out.
NEWER = (
    r"\u0870-\u0887\u0889-\u088e\u08b5\u08c8-\u08c9\u0c5d\u0cdd\u170d\u171f"
    r"\u1b4c\u2c2f\u2c5f\u9ffd-\u9fff\ua7c0-\ua7c1\ua7d0-\ua7d1\ua7d3\ua7d5-\ua7d9"
    r"\ua7f2-\ua7f4\U00010570-\U0001057a\U0001057c-\U0001058a\U0001058c-\U00010592\U00010594-\U00010595\U00010597-\U000105a1\U000105a3-\U000105b1\U000105b3-\U000105b9"
    r"\U000105bb-\U000105bc\U00010780-\U00010785\U00010787-\U000107b0\U000107b2-\U000107ba\U00010f70-\U00010f81\U00011071-\U00011072\U00011075\U0001123f-\U00011240"
    r"\U00011740-\U00011746\U00011ab0-\U00011abf\U00011f02\U00011f04-\U00011f10\U00011f12-\U00011f33\U00011f50-\U00011f59\U00012f90-\U00012ff0\U0001342f"
    r"\U00013441-\U00013446\U00016a70-\U00016abe\U00016ac0-\U00016ac9\U0001aff0-\U0001aff3\U0001aff5-\U0001affb\U0001affd-\U0001affe\U0001b11f-\U0001b122\U0001b132"
    r"\U0001b155\U0001d2c0-\U0001d2d3\U0001df00-\U0001df1e\U0001df25-\U0001df2a\U0001e030-\U0001e06d\U0001e290-\U0001e2ad\U0001e4d0-\U0001e4eb\U0001e4f0-\U0001e4f9"
    r"\U0001e7e0-\U0001e7e6\U0001e7e8-\U0001e7eb\U0001e7ed-\U0001e7ee\U0001e7f0-\U0001e7fe\U0002a6de-\U0002a6df\U0002b735-\U0002b739\U0002ebf0-\U0002ee5d\U00031350-\U000323af"
)
PARTS = "struct<terms array<string>, n_tokens int, clean string, mirrored boolean, again boolean>"
ASKED = f"{scoring.FOUND}, n_tokens int, again boolean"
_PLAIN, _OTHER, _STEM, _STOP = re.compile(r"\w+").findall, re.compile(rf"[^\W{NEWER}]+").findall, re.compile(T.STEM).sub, frozenset(STOP_WORDS)


#: Bytes that no character of three or four bytes has.
_NARROW = bytes(range(0xE0))


def _words(text: str) -> list[str]:
    return (_PLAIN if text.isascii() else _OTHER)(text)


class _Terms(dict):
    """The term of a word as it stands in a text, empty for words that are none."""

    def __missing__(self, word: str) -> str:
        if len(self) >= MEMORY:
            self.clear()
        low = word.lower().replace("ё", "е")
        self[word] = out = "" if len(low) < 2 or low in _STOP else _STEM(r"\1", low)
        return out


_term = _Terms().__getitem__


def _form(text: str, find=_words) -> list[str]:
    return list(filter(None, map(_term, find(text))))


def _mirrored(words: list[str], find=_words) -> bool:
    """Six words or more whose halves have the same terms; most texts differ in the first words of their halves."""
    half, own = len(words) // 2, len(words) >= 6
    if not own:
        return False
    a, b = (_form(" ".join(words[i : i + min(24, half)]), find) for i in (0, half))
    n = min(len(a), len(b))
    return a[:n] == b[:n] and _form(" ".join(words[:half]), find) == _form(" ".join(words[half:]), find)


def read(text: str, find=_words) -> tuple[list[str], int, str, bool, bool]:
    """Terms, number of words, sanitised text, whether it was two equal halves, whether its half is again."""
    terms, n_tokens, kept, before = [], 0, [], []
    for line in text.splitlines():
        if not (line := " ".join(line.split())):
            continue
        words = find(line)
        n_tokens += len(words)
        own = list(filter(None, map(_term, words)))
        terms += own
        if own != before:
            kept.append(line)
        before = own
    clean = " ".join(kept) if kept else " ".join(text.split())
    words = clean.split(" ")
    if not _mirrored(words, find):
        return terms, n_tokens, clean, False, False
    words = words[: len(words) // 2]
    return terms, n_tokens, " ".join(words), True, _mirrored(words, find)


def _parts(texts: pa.Array) -> pa.Array:
    flat: list[str] = []
    ends, counts, clean, mirrored, again = [0], [], [], [], []
    for raw in texts:
        raw = raw.as_py() or b""
        # letters that may be newer take three bytes at least
        terms, n, c, m, a = read(raw.decode("utf-8", "replace"), _words if raw.translate(None, _NARROW) else _PLAIN)
        flat += terms
        ends.append(len(flat))
        for to, x in ((counts, n), (clean, c), (mirrored, m), (again, a)):
            to.append(x)
    lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat, pa.string()))
    return pa.StructArray.from_arrays(
        [lists, pa.array(counts, pa.int32()), pa.array(clean, pa.string()), pa.array(mirrored, pa.bool_()), pa.array(again, pa.bool_())],
        ["terms", "n_tokens", "clean", "mirrored", "again"],
    )


def parts(text: Column) -> Column:
    """``PARTS`` of each text, those of the empty text for null."""
    return F.arrow_udf(_parts, PARTS)(text.cast("binary"))


def asked_parts(text: Column, side) -> Column:
    """Of each text what the queries of ``side`` (a broadcast ``scoring.Batch``) need of its terms, and ``n_tokens`` and ``again`` of ``parts``:
    terms and forms stay in the worker."""

    def some(texts: pa.Array, own: scoring.Batch, terms: pa.Array) -> pa.Array:
        all_of = _parts(texts)
        few = scoring.found(all_of.field("terms"), own, terms) | {c: all_of.field(c) for c in ("n_tokens", "again")}
        return pa.StructArray.from_arrays(list(few.values()), list(few))

    def run(texts: pa.Array) -> pa.Array:
        own = side.value
        terms = pa.array(own.terms, pa.string())
        return pa.concat_arrays([some(texts.slice(lo, scoring.ROWS), own, terms) for lo in range(0, max(1, len(texts)), scoring.ROWS)])

    return F.arrow_udf(run, ASKED)(text.cast("binary"))
