"""What lies on disk at once: sets beside pairs and in blocks go in rounds, and what is done is let go."""

from __future__ import annotations

import weakref

import numpy as np

from beaconlake.llm import setjoin
from beaconlake.llm.components import connected_components
from beaconlake.llm.scratch import Scratch


def test_rounds_bound_what_is_laid_out_and_lose_no_link(spark, monkeypatch):
    """Short lists and a long one of 40 sets, in rounds of a few pairs: the components of one round, and no round has much more than its share."""
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << 62, 60, dtype=np.uint64) for _ in range(8)]
    sets = {}
    for cls in range(120):
        tokens = bases[cls % 8].copy()
        tokens[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 62, 60, dtype=np.uint64)[:1]
        sets[cls] = np.unique(tokens)
    rows = [(100 + k, cls, len(sets[cls]), 0, cls, 1.0) for k in range(40) for cls in sorted({int(c) for c in rng.integers(40, 120, 5)})]
    rows += [(1, cls, len(sets[cls]), 0, cls, 1.0) for cls in range(40)]
    postings = spark.createDataFrame(rows, "token bigint, cls bigint, n int, pos int, gid bigint, rank double")
    held = spark.createDataFrame([(c, s.tobytes()) for c, s in sets.items()], "_k bigint, data binary")

    def load(ids):
        return ids.join(held, ids.cls == held._k).drop("_k")

    met = [[cls for t, cls, *_ in rows if t == token] for token in {r[0] for r in rows}]
    near = [(a, b) for group in met for a in group for b in group if a < b and 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))]
    want = {r.node: r.component for r in connected_components(spark.createDataFrame(near, "a bigint, b bigint"), Scratch(spark, "w")).collect()}
    assert len(set(want.values())) > 4

    seen = []
    beside = setjoin._beside
    monkeypatch.setattr(setjoin, "_beside", lambda pairs, *args: (seen.append(pairs.count()), beside(pairs, *args))[1])
    monkeypatch.setattr(setjoin, "ROUND_BYTES", 4_000, raising=False)
    got = {r.node: r.component for r in setjoin.JaccardComponents(load, setjoin.packed_tokens, Scratch(spark, "t")).of(postings).collect()}
    assert {c: got.get(c, c) for c in sets} == {c: want.get(c, c) for c in sets}
    assert len(seen) > 3 and max(seen) < sum(seen) / 3


def test_a_brief_bitmap_never_rules_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 62, rng.integers(1, 100), dtype=np.uint64))))
        brief = [setjoin.bitmap(x, setjoin.BRIEF, 64) for x in (a, b)]
        assert setjoin.overlap_bound(*brief, len(a), len(b)) >= len(np.intersect1d(a, b))
    assert len(setjoin.bitmap(np.arange(300, dtype=np.uint64), setjoin.BRIEF, 64)) == 64

def test_free_lets_go_of_cycles(spark):
    """A DataFrame that only a cycle holds keeps its shuffle files until Python collects it too."""

    class Held:
        pass

    held = Held()
    held.df, held.self = spark.range(3).groupBy("id").count(), held
    left = weakref.ref(held.df)
    del held
    Scratch(spark, "t").free()
    assert left() is None
