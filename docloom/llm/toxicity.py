"""Operator 1: toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits that stand for letters) and matched by one Aho-Corasick
automaton of weighted terms and exception phrases. A match counts at the start of a word only; a term inside a matched
exception phrase counts nothing. The weights that a text collects, as they are and normalised by its length, give the score.

Terms are whole words or word stems, learned from labelled rows outside the held-out fold. Fitting reads a bounded sample of
those rows (``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` expected rows, chosen by hash); scoring reads every row once, without an
exchange.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_others, give_back, held_out, materialize, tidied

#: Bounds of the fitting sample: labelled rows of each kind, in expectation.
SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 10_000
#: Toxic rows of the sample that must hold a term, and their share.
MIN_DOCS, MIN_SHARE = 3, 0.005
#: A term's share among toxic rows must be so many times its share among clean rows.
MIN_RATIO = 8.0
STEM_LENGTHS = range(4, 9)

# Digits and signs that stand for letters, and letters of other scripts that look Latin.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Everyday phrases in which an insulting word is none.
EXCEPTIONS = (
    "trash can", "trash bin", "trash collection", "pond scum", "circus clown", "clown fish", "sore loser policy", "stupid simple",
    "idiot proof", "pathetic fallacy", "worthless check", "recycle trash", "take out the trash",
)

_WORD = re.compile(r"[^\W_]+")


class _Folding(dict):
    """Code point to folded text, worked out on first use."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = LEET.get(c)
        if out is None:
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
            out = "".join(HOMOGLYPHS.get(x, x) for x in base)
            if not out.isalnum():
                out = " " if not unicodedata.combining(c) else ""
        self[point] = out
        return out


_FOLD = _Folding()


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """Weighted terms, exception phrases and the score's coefficients. A term that ends in a space is a whole word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 2.5, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(" " + term, (len(term), w))
            for phrase in self.exceptions:
                p = fold(phrase)[1:]
                a.add_word(" " + p, (len(p), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def collect(self, folded: str) -> tuple[int, float]:
        """Matches that count, and their weight: the heaviest of the terms that start at a place."""
        if not self.weights:
            return 0, 0.0
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(folded):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if excused:
            excused.sort()
            opens = [a for a, _ in excused]
            reach = list(accumulate((b for _, b in excused), max))  # how far the phrases that start up to here go
            found = {s: w for s, w in found.items() if (k := bisect_right(opens, s)) == 0 or reach[k - 1] < s}
        return len(found), float(sum(found.values()))

    def features(self, text: str | None) -> tuple[int, float, float]:
        folded = fold(text or "")
        hits, weight = self.collect(folded)
        words = folded.count(" ") - 1
        return hits, math.log1p(weight), 10.0 * weight / (words + 20.0)

    def score(self, text: str | None) -> tuple[int, float]:
        hits, total, rate = self.features(text)
        a, b, c = self.coefficients
        return hits, 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * total + c * rate))))


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {w + " " for w in words if len(w) >= 3} | {w[:n] for w in words if not w.isdigit() for n in STEM_LENGTHS if n < len(w)}


def _count_terms(known: frozenset[str] | None):
    """Documents that hold each term, summed where the rows are; only ``known`` terms where given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                terms = _terms(fold(text or ""))
                counts.update(terms if known is None else terms & known)
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pd.DataFrame({"term": [t for t, _ in part], "n": [n for _, n in part]})

    return run


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds weights of terms that mark toxic rows; stems only where they gather several words, else the words."""
    ratio = {t: ((n + 0.1) / (n_toxic + 0.2)) / ((clean.get(t, 0) + 0.1) / (n_clean + 0.2)) for t, n in toxic.items()}
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * n_toxic))
    strong = {t for t, n in toxic.items() if n >= least and ratio[t] >= MIN_RATIO and n >= 3 * clean.get(t, 0)}
    kept: dict[str, float] = {}
    for term in sorted(strong, key=lambda t: (len(t.strip()), t)):
        if any(term[:n] in kept for n in range(4, len(term))):
            continue
        if not term.endswith(" "):
            inside = max((toxic[w] for w in strong if w.endswith(" ") and w.startswith(term)), default=0)
            if inside >= 0.8 * toxic[term]:
                continue  # one word makes the stem: the word itself is surer
        kept[term] = math.log(ratio[term])
    return {t: min(kept[t], 8.0) for t in sorted(kept)}


def fit_coefficients(rows: Iterable[tuple[tuple[int, float, float], int]]) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on collected weight and weight by length, by Newton's method."""
    rows = list(rows)
    if len({y for _, y in rows}) < 2:
        return (-3.0, 2.5, 1.0)
    x = np.array([[1.0, f[1], f[2]] for f, _ in rows])
    y = np.array([float(v) for _, v in rows])
    beta, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn terms and coefficients from labelled rows outside the held-out fold.

    Edge cases: labels that are null or neither 0 nor 1 teach nothing; of conflicting labels of one id the toxic one holds; a
    null id joins no document; a label of an id that several rows share teaches all of them; without toxic rows the lexicon is
    empty. Ties between terms are broken by the term, so equal tables teach equal lexicons.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("y"))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {1: min(1.0, SAMPLE_TOXIC / max(1, sizes.get(1, 0))), 0: min(1.0, SAMPLE_CLEAN / max(1, sizes.get(0, 0)))}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6
    chosen = usable.where(place < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    # the sample is bounded by its parameters, so its ids may be sent to every executor
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return Lexicon({})
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * n[1]))
    in_toxic = sample.where("y = 1").select("text").mapInPandas(tidied(_count_terms(None)), "term string, n long")
    toxic = {r["term"]: r["n"] for r in in_toxic.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    known = frozenset(toxic)
    in_clean = sample.where("y = 0").select("text").mapInPandas(tidied(_count_terms(known)), "term string, n long")
    clean = {r["term"]: r["n"] for r in in_clean.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    lexicon = Lexicon(choose_terms(toxic, clean, n[1], n.get(0, 0)))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"hits": [x[0] for x in f], "total": [x[1] for x in f], "rate": [x[2] for x in f], "y": batch["y"]})

    rows = sample.select("text", "y").mapInPandas(tidied(features), "hits long, total double, rate double, y int").collect()
    lexicon.coefficients = fit_coefficients(((r["hits"], r["total"], r["rate"]), r["y"]) for r in rows)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Score every text: all columns of ``docs`` plus ``score`` (0 to 1), ``predicted`` (1 from 0.5) and ``n_hits``.

    Edge cases: null and empty texts have no hits and the score of a text without any; null ids count as held out like the
    empty string; repeated rows score alike; an empty table gives an empty result; a corpus without toxic labels gives an
    empty lexicon and one low score for all. Input columns of these names are replaced.
    """
    scored = F.pandas_udf(_scorer(lexicon), "score double, n_hits long")
    keep = [c for c in docs.columns if c not in ("score", "predicted", "n_hits", "_tox")]
    out = docs.select(*keep).withColumn("_tox", scored(F.col("text")))
    return out.select(*keep, F.col("_tox.score").alias("score"), (F.col("_tox.score") >= 0.5).cast("int").alias("predicted"), F.col("_tox.n_hits").alias("n_hits"))


def _scorer(lexicon: Lexicon):
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [lexicon.score(t) for t in texts]
        forget_others(__name__)
        give_back()
        return pd.DataFrame({"score": [s for _, s in rows], "n_hits": [h for h, _ in rows]})

    return run
