"""Operators 2, 4, 7 and 8 against brute force, with the awkward rows of each contract."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from docloom.llm import mixing
from docloom.llm.components import connected_components
from docloom.llm.embeddings import bucket_codes, hadamard, near_duplicates
from docloom.llm.grouping import local_roots
from docloom.llm.mixing import fill_targets, mix
from docloom.llm.ngram_join import jaccard_components, shingles
from docloom.llm.substrings import COVER, PERIOD, minimizers, remove_repeats

DOCS = "doc_id long, text string, lang string, source string, bits string"


def word_sets(text):
    w = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [word_sets(t) for _, t in rows]
    a, b = [], []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a.append(i)
            b.append(j)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    root = local_roots(len(rows), np.array([place[x] for x in a], int), np.array([place[x] for x in b], int))
    return {rows[i][0]: rows[order[root[place[i]]]][0] for i in range(len(rows))}, {r[0]: len(s) for r, s in zip(rows, sets)}


def near_copies(n_groups=12, seed=3):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(400)]
    rows, k = [], 0
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    for g in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 20, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words) + (" " + shared if rng.random() < 0.3 else "")
            rows.append((1000 - k, text.lower() if rng.random() < 0.2 else text))
            k += 1
    return rows


def test_jaccard_components_equal_brute_force(spark):
    rows = near_copies() + [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "one"), (2005, "ONE"), (2006, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], DOCS)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_components(df).collect()}
    comp, size = brute_components(rows)
    assert got == {i: (comp[i], size[i]) for i, _ in rows}


def test_jaccard_components_of_repeated_and_null_ids(spark):
    t = "a b c d e f g"
    rows = [(1, t), (1, t), (1, "other words that are not the same at all"), (2, "other words that are not the same at all"), (None, t), (5, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (5, 5)]
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_at_the_threshold(spark):
    # nine shared shingles of a union of ten and eleven: 0.9 and 0.82; eight of eleven: below
    words = [f"w{i}" for i in range(14)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:14])), (3, " ".join(words[:10])), (4, " ".join(["z"] + words[1:13]))]
    comp, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        text = (t or "").encode()
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for k in range(len(text)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé \n") for _ in range(500)) for _ in range(3)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 200)
            parts.append(rng.choice(base)[a : a + rng.choice([60, 98, 99, 100, 101, 150, 280])] if rng.random() < 0.7 else rng.choice("xy") * rng.randint(0, 260))
        rows.append((i * 3, "".join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, base[0]), (1003, base[0]), (1004, "z" * 5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeat_removal_equals_brute_force(spark, seed):
    rows = repeated_rows(seed)
    df = spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == brute_removal(rows)


def test_repeat_removal_in_crowded_buckets(spark, monkeypatch):
    from docloom.llm import substrings

    monkeypatch.setattr(substrings, "SUB_BUCKET", 3)
    rows = repeated_rows(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removal(rows)


def test_grams_that_occur_once_are_not_crowded_in_much_text(spark, monkeypatch):
    from docloom.llm import substrings

    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(97, 123, 500_000, np.uint8).tobytes().decode()) for i in range(16)]
    dealt, write = [], substrings.materialize

    def recorded(df, label):
        out = write(df, label)
        dealt.append((label, out.count()))
        return out

    monkeypatch.setattr(substrings, "materialize", recorded)
    monkeypatch.setattr(substrings, "CROWD", 10)  # 8 MB have 190,000 grams for a million counters
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_bytes, r.n_removed) for r in got} == {(500_000, 0)} and dict(dealt)["repeated-grams"] == 0


def test_text_that_repeats_throughout_is_dealt_out_in_rounds(spark, monkeypatch):
    from docloom.llm import substrings

    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[: rng.randint(2500, 2900)] + f"own end {i}") for i in range(40)]
    dealt, write = [], substrings.materialize

    def recorded(df, label):
        out = write(df, label)
        dealt.append(label)
        return out

    monkeypatch.setattr(substrings, "materialize", recorded)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removal(rows) and dealt.count("sorted-blocks") >= 3


def test_repeat_removal_without_own_ids(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(150))
    df = spark.createDataFrame([(None, t), (7, t), (7, t + "!"), (8, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(-1, 0), (7, 150), (7, 150), (8, 0)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_is_a_perfect_difference_set():
    assert sorted((a - b) % PERIOD for a in COVER for b in COVER if a != b) == list(range(1, PERIOD))


def test_minimizers_stand_for_every_window_once():
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 101) for _ in range(3000))
    at, _, first, last = minimizers(text)
    assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(len(text) - 99))
    assert all(b <= a and a + 16 <= f + 100 for a, f, b in zip(at, first, last)) and len(at) < 200


def texts_of_all_lengths():
    rng = random.Random(6)
    size = [0, 99, 100, 0, 101, 5000, 3, 250, *(rng.randint(0, 400) for _ in range(300)), 0]
    return [bytes(rng.randrange(97, 100) for _ in range(n)) for n in size]


def test_minimizers_of_joined_texts_are_those_of_each_text(monkeypatch):
    from docloom.llm import substrings

    texts = texts_of_all_lengths()
    alone = [(k, *row) for k, t in enumerate(texts) for row in zip(*(x.tolist() for x in minimizers(t)), strict=True)]
    for piece, portion in ((1 << 15, 1 << 20), (100, 1 << 20), (1, 700), (333, 1)):
        monkeypatch.setattr(substrings, "PIECE", piece)
        monkeypatch.setattr(substrings, "PORTION", portion)
        assert list(zip(*(x.tolist() for x in substrings.minimizers_of(texts)), strict=True)) == alone
    assert [len(x) for x in substrings.minimizers_of([])] == [0] * 5


def test_short_documents_are_hashed_and_dealt_out_together(monkeypatch):
    import pyarrow as pa

    from docloom.llm import substrings

    texts, calls, scramble = texts_of_all_lengths(), [], substrings._scramble
    monkeypatch.setattr(substrings, "_scramble", lambda x: calls.append(len(x)) or scramble(x))
    list(substrings._sketch([pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts])], ["text"])]))
    assert len(calls) < 20  # two for each text: 469

    found = [[{"gram": int(h), "start": a, "span": (a - f) << 8 | (a - l), "subs": 0} for a, h, f, l in zip(*(x.tolist() for x in minimizers(t)), strict=True)] for t in texts]
    for row in (r for f in found for r in f):
        row["gram"] -= 1 << 63
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("start", pa.int64()), ("span", pa.int32()), ("subs", pa.int32())]))
    ids = [7 * k - 50 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.decode() for t in texts]), pa.array(found, kind)], ["doc_id", "text", "grams"])
    dealt = list(substrings._contexts([batch, batch.slice(5, 100)]))
    rows = [r for b in dealt for r in b.to_pylist()]
    want = [
        (i, r["gram"], r["start"] - (r["span"] >> 8), r["span"] >> 8, t[r["start"] - (r["span"] >> 8) : r["start"] - (r["span"] & 255) + 100])
        for a, z in ((0, len(texts)), (5, 105)) for i, t, own in zip(ids[a:z], texts[a:z], found[a:z], strict=True) for r in own
    ]
    assert [(r["doc_id"], r["gram"], r["first"], r["anchor"], r["context"]) for r in rows] == want
    assert len(dealt) == 2  # one document at a time: 300


@pytest.mark.parametrize("classes", [1 << 24, 3])
def test_sorted_blocks_equal_brute_force(monkeypatch, classes):
    from docloom.llm import substrings

    monkeypatch.setattr(substrings, "CLASSES", classes)
    rng = random.Random(9)
    contexts, anchor, bucket, first = [], [], [], []
    for b in range(40):  # texts alike around the minimizer, which stands at another place in each
        base = bytes(rng.randrange(0, 3) for _ in range(184))
        for _ in range(rng.choice([2, 3, 9])):
            text = bytearray(base)
            if rng.random() < 0.7:
                text[rng.randrange(184)] ^= 4
            a = rng.randint(0, 84)
            contexts.append(bytes(text[84 - a : 184 - rng.randint(0, a)]))
            anchor.append(a)
            bucket.append(b)
            first.append(rng.randint(0, 1 << 30))
    doc = [rng.randint(-5, 5) for _ in contexts]
    owner, inner, repeated = substrings.sort_block(contexts, np.array(anchor), np.array(bucket), np.array(doc), np.array(first))
    windows = list(zip(owner.tolist(), inner.tolist(), strict=True))
    assert windows == [(o, i) for o, c in enumerate(contexts) for i in range(len(c) - 99)]
    key = [(bucket[o], anchor[o] - i, contexts[o][i : i + 100]) for o, i in windows]
    when = [(doc[o], first[o] + i) for o, i in windows]
    least = {}
    for k, w in zip(key, when, strict=True):
        least[k] = min(w, least.get(k, w))
    assert repeated.tolist() == [w > least[k] for k, w in zip(key, when, strict=True)] and repeated.any()
    assert _sorted_on_rows_that_are_tied(substrings._ordered)


def _sorted_on_rows_that_are_tied(ordered):
    rng, read = np.random.default_rng(2), []
    keys = rng.integers(0, [[40], [3], [3]], (3, 60)).astype(np.uint64)
    order, new = ordered(keys[0], *(lambda rows, k=k: read.append(sorted(rows.tolist())) or k[rows] for k in keys[1:]))
    rows = [tuple(keys[:, i]) for i in order]
    assert rows == sorted(rows) and new.tolist() == [not i or rows[i] != rows[i - 1] for i in range(60)]
    alike = [[i for i in range(60) if (keys[:n] == keys[:n, [i]]).all(axis=0).sum() > 1] for n in (1, 2)]
    return read == alike and 0 < len(read[1]) < len(read[0]) < 60


def clustered_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        c = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 12))):
            v = c + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.14, 0.2]) * np.linalg.norm(c) / math.sqrt(32)
            rows.append((len(rows) * 2, [float(x) for x in v.astype(np.float32)], g % 3))
    return rows


def test_embedding_links_equal_brute_force(spark):
    rows = clustered_vectors()
    extra = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, rows[0][1], None), (904, rows[0][1][:16], 0), (905, [None] + rows[0][1][1:], 0), (906, [], 0)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    root = local_roots(len(rows), *np.nonzero(close))
    links = sum(v[0] for v in got.values())
    assert all(got[r[0]][0] <= close[i].sum() for i, r in enumerate(rows))
    assert links >= 0.9 * close.sum()
    if links == close.sum():
        assert all(got[r[0]] == (close[i].sum(), rows[root[i]][0], rows[root[i]][0] == r[0]) for i, r in enumerate(rows))
    assert all(got[e[0]] == (0, e[0], True) for e in extra)


def test_embedding_copies_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(3, v, 1), (1, v, 1), (1, v, 1), (2, v, 2), (None, v, 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0) for r in near_duplicates(df).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 2, 1)]
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard_is_orthogonal_and_probes_differ():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    codes = bucket_codes(x, 2, 2, 3)
    assert codes.shape == (5, 6) and all(len(set(r)) == 6 for r in codes.tolist())


@pytest.mark.parametrize(("dim", "hashes"), [(64, 1), (64, 3), (64, 4), (768, 3), (768, 4)])
def test_near_vectors_meet_in_buckets_of_any_number_of_hashes(dim, hashes):
    from docloom.llm.embeddings import layout

    n = next(10**k for k in range(3, 20) if layout(10**k, dim, 64)[0] == hashes)
    tables = layout(n, dim, 64)[1]
    rng = np.random.default_rng(dim + hashes)
    x = rng.normal(size=(300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.981 * x + math.sqrt(1 - 0.981**2) * z
    a, b = (bucket_codes(v, tables, hashes, 2) for v in (x, y))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.95


def test_embeddings_of_any_size_with_clashing_columns(spark):
    rows = [(1, [1e200, 2e200, 3e200], 1, 5, 6), (2, [1e-200, 2e-200, 3e-200], 1, 5, 6), (3, [3.0, 2.0, 1.0], 1, 5, 6), (4, [float("inf"), 1.0, 1.0], 1, 5, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int, component_id int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_targets_stop_at_their_cap():
    assert fill_targets({"a": 1000, "b": 10, "c": 500}, {"a": 1, "b": 2, "c": 3}) == {"a": 370.0, "b": 30.0, "c": 1110.0}
    assert fill_targets({"a": 0, None: 7}, {"a": 1, None: 2}) == {"a": 0.0, None: 7.0}


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 400])), f"s{min(rng.randint(0, 9), 4)}") for i in range(600)]
    rows += [(601, None, "s1"), (602, "a b", None), (None, "c d e", None), (603, "a b", "s1"), (603, "a b", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        own = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        own[0] += r.size
        own[1] += r.taken
    assert all(v[0] == v[3] for v in by.values())
    assert all(abs(v[1] - v[2]) <= 6 * mixing.MIN_BLOCK + 0.01 * v[2] for v in by.values())
    again = {(r.doc_id, r.size): r.taken for r in mix(df.repartition(7)).collect() if r.doc_id is not None and r.doc_id != 603}
    assert all(again[r.doc_id, r.size] == r.taken for r in got if r.doc_id is not None and r.doc_id != 603)
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_shingles_lower_only_ascii_and_split_only_on_ascii_white_space():
    assert len(shingles("Ä b c d e".encode())) == 1
    assert shingles("É b c d e".encode()).tolist() != shingles("é b c d e".encode()).tolist()
    assert len(shingles("a b c d e\x0bf".encode())) == 2


def test_cells_find_every_similar_pair(monkeypatch):
    from docloom.llm import ngram_join as nj

    monkeypatch.setattr(nj, "LEAF", 6)
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(25):  # clusters of near copies, far from each other, and members of other sizes
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 400))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 25))):
            s = base.copy()
            swap = rng.random(len(s)) < rng.choice([0.0, 0.03, 0.08, 0.2])
            s[swap] = rng.integers(0, 1 << 63, int(swap.sum())).astype(np.uint64)
            sets.append(np.unique(s[: int(len(s) * rng.choice([1.0, 0.9]))]))
    n = np.array([len(s) for s in sets])
    cells = nj.Cells(np.arange(len(sets)) * 7, n, np.arange(len(sets)), np.ones(len(sets), bool), np.full(len(sets), -1), [nj.bitmap(s) for s in sets])
    found = {tuple(p) for p in cells.pairs(False).tolist()}
    links = {
        (7 * i, 7 * j) for i, j in itertools.combinations(range(len(sets)), 2)
        if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - k)
    }
    assert len(links) > 500 and links <= found and len(found) < 2 * len(links)
    near = cells.pairs(True)
    assert len(near) and set(near.ravel().tolist()) <= {7 * i for i in range(len(sets))}


def test_jaccard_components_of_a_crowded_region(spark):
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(90)]
    rows = []
    for k in range(150):  # all share the passage, which is most of each; some are near copies of others
        tail = [rng.choice(vocab) for _ in range(rng.choice([4, 12, 30]))]
        rows.append((k, " ".join(passage + tail)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(passage[:-1] + ["zz"] + tail)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    comp, size = brute_components(rows)
    assert got == {i: (comp[i], size[i]) for i, _ in rows}


def test_jaccard_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        jaccard_components(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))
