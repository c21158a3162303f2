"""Composite scores of batches of index entries against all queries: one narrow Arrow pass.

A pair of a query and an entry needs the entry and the queries' words alone, so an entry meets all queries where it is read:
pairs are never dealt out, and of a search only those leave a batch that can be among its hits. What a task holds is a slice of
entries by the queries (``CELLS`` numbers) and the queries' words, which the driver sends to each executor. Of an entry's words a
batch of queries needs no more than ``FOUND``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs and entries worked on at once.
CELLS, ROWS = 400_000, 1_000
#: Of an entry's words: places of those that queries ask for, how often each is there, the number of all, queries whose phrase they hold.
FOUND = "found array<int>, counts array<int>, dl int, held array<int>"


class Batch(NamedTuple):
    """Queries, one column each, and the weights of their words: ``columns`` and ``weights`` of term ``t`` stand at ``opens[t]``
    to ``opens[t + 1]``."""

    ids: list
    phrases: list[str]
    asked: np.ndarray
    terms: list[str]
    opens: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    average: float
    k1: float
    b: float
    per_source: int


def batch_of(queries: list[tuple], terms: list[tuple], weight: dict, average: float, k1: float, b: float, per_source: int) -> Batch:
    """queries: (id, phrase, distinct words). terms: (id, term, occurrences in the query). weight: of each term in the corpus."""
    place = {t: i for i, t in enumerate(sorted({t for _, t, _ in terms}))}
    own: dict = {}
    for i, t, n in terms:
        own.setdefault(i, []).append((place[t], n * weight.get(t, 0.0)))
    rows = sorted((t, c, w) for c, q in enumerate(queries) for t, w in own.get(q[0], ()))
    opens = np.searchsorted([t for t, _, _ in rows], np.arange(len(place) + 1)).astype(np.int64)
    columns, weights = np.array([c for _, c, _ in rows], np.int64), np.array([w for _, _, w in rows], float)
    return Batch([q[0] for q in queries], [q[1] for q in queries], np.array([q[2] for q in queries], np.int64), list(place), opens, columns, weights, average, k1, b, per_source)


def _occurrences(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the words that queries ask for, and the length of each row's list."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    hit = term >= 0
    key, count = np.unique(row[hit] * max(1, len(terms)) + term[hit], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), count, size


def _cells(row: np.ndarray, term: np.ndarray, own: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence once for each query that asks for its term: the occurrence, the weight's place, the pair."""
    times = own.opens[term + 1] - own.opens[term]
    which = np.repeat(np.arange(len(row)), times)
    at = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(own.opens[term], times)
    return which, at, row[which] * len(own.ids) + own.columns[at]


def _shared(lists: pa.Array, terms: pa.Array, own: Batch) -> np.ndarray:
    """Distinct words that each pair shares."""
    row, term, _, _ = _occurrences(lists, terms)
    return np.bincount(_cells(row, term, own)[2], minlength=len(lists) * len(own.ids))


def _holds(lists: pa.Array, shared: np.ndarray, row: np.ndarray, column: np.ndarray, own: Batch) -> np.ndarray:
    """Pairs whose words hold the whole phrase: all its words but its first and last, which may be parts of longer ones, are shared."""
    out = np.zeros(len(row), bool)
    said: dict[int, str] = {}
    spoken = np.array([p != "" for p in own.phrases], bool)
    for i in np.flatnonzero(spoken[column] & (shared >= own.asked[column] - 2)).tolist():
        r = int(row[i])
        if r not in said:
            said[r] = " ".join(lists[r].as_py() or ())
        out[i] = own.phrases[column[i]] in said[r]
    return out


def _step(own: Batch) -> int:
    """Entries worked on at once."""
    return max(1, min(ROWS, CELLS // max(1, len(own.ids))))


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """``n`` lists of values that stand in order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))


def found(lists: pa.Array, own: Batch, terms: pa.Array) -> dict[str, pa.Array]:
    """``FOUND`` of each list of words."""
    row, term, count, size = _occurrences(lists, terms)
    width, step, held = len(own.ids), _step(own), [np.empty(0, np.int64)]
    for lo in range(0, len(lists) if width else 0, step):
        part, (a, b) = lists.slice(lo, step), np.searchsorted(row, (lo, lo + step))
        shared = np.bincount(_cells(row[a:b] - lo, term[a:b], own)[2], minlength=len(part) * width)
        pair = np.flatnonzero(shared)
        held.append(lo * width + pair[_holds(part, shared[pair], pair // width, pair % width, own)])
    pairs = np.concatenate(held)
    n, width = len(lists), max(1, width)
    return {"found": _lists(row, term, n), "counts": _lists(row, count, n), "dl": pa.array(size, pa.int32()), "held": _lists(pairs // width, pairs % width, n)}


def _found(part: pa.RecordBatch, own: Batch, terms: pa.Array) -> dict[str, pa.Array]:
    """``FOUND`` as it stands in a batch, or of its words."""
    return found(part.column("terms"), own, terms) if "terms" in part.schema.names else {c: part.column(c) for c in ("found", "counts", "dl", "held")}


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each number in lists."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _within(key: np.ndarray) -> np.ndarray:
    """Place of each row among those of its key, in the order they stand."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    opens = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(opens, np.diff(np.r_[opens, len(s)]))
    return out


def candidates(part: pa.RecordBatch, row: np.ndarray, column: np.ndarray, score: np.ndarray, own: Batch, top_k: int) -> np.ndarray:
    """Pairs that can be hits of the whole corpus, best first: what these rules drop here has as many rivals of at least its place
    there, as repeats share their source."""
    place = np.empty(part.num_rows, np.int64)
    place[pc.sort_indices(part.column("entry_ord")).to_numpy()] = np.arange(part.num_rows)
    keep = np.lexsort((place[row], -score, column))
    keep = keep[_within(column[keep] * part.num_rows + _codes(part.column("same"))[row[keep]]) == 0]
    keep = keep[_within(column[keep] * part.num_rows + _codes(part.column("checksum"))[row[keep]]) < own.per_source]
    return keep[_within(column[keep]) < top_k]


def _scored(part: pa.RecordBatch, own: Batch, terms: pa.Array, ids: pa.Array, top_k: int | None) -> pa.RecordBatch:
    x, width = _found(part, own, terms), len(own.ids)
    (row, term), count, size = _flat(x["found"]), _flat(x["counts"])[1], x["dl"].to_numpy(zero_copy_only=False)
    which, at, cell = _cells(row, term, own)
    gain = count * (own.k1 + 1) / (count + own.k1 * (1 - own.b + own.b * size[row] / own.average))
    overlap = np.bincount(cell, minlength=part.num_rows * width)
    at_row, asking = _flat(x["held"])
    held = np.zeros(part.num_rows * width, bool)
    held[at_row * width + asking] = True
    pair = np.flatnonzero(overlap)
    bm25 = np.bincount(cell, own.weights[at] * gain[which], part.num_rows * width)[pair]
    overlap, row, column = overlap[pair], pair // max(1, width), pair % max(1, width)
    bonus = 0.45 * overlap + 2.0 * held[pair]
    for name, whole, each in (("section_terms", 1.0, 0.25), ("title_terms", 0.8, 0.15)):
        shared = _shared(part.column(name), terms, own)[pair]
        bonus += whole * _holds(part.column(name), shared, row, column, own) + each * shared
    penalty = part.column("penalty").to_numpy(zero_copy_only=False)[row]
    # sums of doubles depend on the order of words: places are compared as far as they are sure
    score = np.round((bm25 + bonus) * penalty + np.where(size[row] >= 25, 0.35, 0.0), 8)
    keep = np.flatnonzero(score > 0)
    if top_k is not None:
        keep = keep[candidates(part, row[keep], column[keep], score[keep], own, top_k)]
    at_row = pa.array(row[keep])
    out = {"query_id": ids.take(pa.array(column[keep])), "entry_ord": part.column("entry_ord").take(at_row)}
    if top_k is None:
        out |= {"bm25": pa.array(bm25[keep]), "overlap": pa.array(overlap[keep])}
    else:
        out |= {c: part.column(c).take(at_row) for c in ("filename", "checksum", "same")}
    return pa.RecordBatch.from_pydict(out | {"score": pa.array(score[keep])})


def counter(side):
    """A function of batches of words or of what is found of them: (term, df), the entries of a batch that hold each of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(side.value.terms, pa.string())
        for batch in batches:
            term = _occurrences(batch.column(0), terms)[1] if batch.schema.names == ["terms"] else _flat(batch.column(0))[1]
            n = np.bincount(term, minlength=len(terms))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"term": terms.take(pa.array(at)), "df": pa.array(n[at], pa.int64())})

    return run


def scorer(side, top_k: int | None = None):
    """A function of batches of entries: all pairs with a score, or with ``top_k`` those that can be among so many hits of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Batch = side.value
        terms, ids = pa.array(own.terms, pa.string()), pa.array(own.ids)
        step = _step(own)
        for batch in batches:
            for lo in range(0, batch.num_rows if own.ids else 0, step):
                yield _scored(batch.slice(lo, step), own, terms, ids, top_k)

    return run
