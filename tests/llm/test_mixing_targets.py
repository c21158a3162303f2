"""Operator 8 meets each source's target, however small the source and however long the schedule."""

from docloom.llm import mixing


def test_mix_meets_every_target_to_a_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SLOTS", 50, raising=False)  # a cap on the schedule, where there is one, coarsens blocks here
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 37, raising=False)
    of = {"a": [400, 37, 1000, 3], "b": [5], "c": [17, 2], "d": [900, 800], "e": [1], "f": [33, 1], "g": [700, 0]}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, ns in of.items() for n in ns)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size
        by[r.source] = (by.get(r.source, (0, 0))[0] + r.taken, r.target)
    assert len(got) == len(rows) and {s: t for s, (t, _) in by.items()} == {s: int(t + 0.5) for s, (_, t) in by.items()}
    for s in of:  # a document goes round as often as its source does, once more at most
        full = int(by[s][1] + 0.5) // sum(of[s])
        assert all(full * r.size <= r.taken <= (full + 1) * r.size for r in got if r.source == s)
