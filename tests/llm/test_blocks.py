"""Blocks of band keys, pairs and groups of sets against plain Python."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from beaconlake.llm import kernels, line_dedup, setjoin
from beaconlake.llm.scratch import Scratch
from tests.llm import brute


@pytest.mark.parametrize("limit", [1 << 20, 60, 10])
def test_shared_keys(monkeypatch, limit):
    """Keys that two lines hold, whatever a task may hold at once, one key of a third of all rows among them."""
    monkeypatch.setattr(line_dedup, "KEYS_AT_ONCE", limit)
    rng = np.random.default_rng(1)
    token = rng.integers(0, 400, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    token[:900] = 7
    line = rng.integers(0, 50, 3000)
    blocks = pa.Table.from_batches([line_dedup._blocks(token[i : i + 100], line[i : i + 100], 5) for i in range(0, 3000, 100)]).sort_by("part")
    got = {pair for b in line_dedup._shared_keys(iter(blocks.to_batches(max_chunksize=7))) for pair in zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_pylist())}
    held = defaultdict(set)
    for t, h in zip(token.tolist(), line.tolist()):
        held[t].add(h)
    assert got == {(t, h) for t, lines in held.items() if len(lines) > 1 for h in lines}


def test_shared_keys_settle_seldom(monkeypatch):
    """Different keys of one part: the keys sorted stay within a few times those that come."""
    monkeypatch.setattr(line_dedup, "KEYS_AT_ONCE", 1 << 10)
    sorted_keys = []
    settled = line_dedup._settled
    monkeypatch.setattr(line_dedup, "_settled", lambda token, line, shared: (sorted_keys.append(sum(map(len, token))), settled(token, line, shared))[1])
    n = 1 << 18
    token = np.random.default_rng(4).permutation(n).astype(np.uint64) << np.uint64(20)
    blocks = [line_dedup._blocks(token[i : i + 1024], np.arange(i, i + 1024), 1) for i in range(0, n, 1024)]
    assert sum(b.num_rows for b in line_dedup._shared_keys(iter(blocks))) == 0
    assert sum(sorted_keys) <= 5 * n


def test_no_keys():
    assert sum(b.num_rows for b in line_dedup._shared_keys(iter([]))) == 0


def test_pair_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, int(n)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for n in rng.integers(0, 120, 60)]
    left, right = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    n, both = setjoin._pair_overlaps([sets[i].tobytes() for i in left], [sets[i].tobytes() for i in right], setjoin.packed_tokens)
    assert n.tolist() == [len(sets[i]) + len(sets[j]) for i, j in zip(left, right)]
    assert both.tolist() == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(left, right)]


def test_components_of_long_lists(spark, monkeypatch):
    """Groups around a base that drift apart, in lists far longer than SHORT_LIST and blocks of eight, equal brute force."""
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    rng = np.random.default_rng(7)
    sets = []
    for group in range(3):
        base = list(range(group * 1000, group * 1000 + 60))
        for i in range(40):
            s = list(base)
            for at in rng.choice(60, int(rng.integers(0, 14)), replace=False):
                s[at] = 100_000 + int(rng.integers(0, 40)) + group * 1000
            sets.append(sorted(set(s)))
    rows = [(k, kernels.mix64(np.array(s, np.uint64)).tobytes(), len(s)) for k, s in enumerate(sets)]  # tokens are hashes
    table = spark.createDataFrame(rows, "cls bigint, data binary, n int")
    postings = [(t, k, len(s), 0, k, float(len(s) % 7)) for k, s in enumerate(sets) for t in s[:16]]
    postings = spark.createDataFrame(postings, "token bigint, cls bigint, n int, pos int, gid bigint, rank double")
    load = lambda ids: table.join(ids, "cls", "left_semi").select("cls", "data")
    got = {r.node: r.component for r in setjoin.JaccardComponents(load, setjoin.packed_tokens, Scratch(spark, "t")).of(postings).collect()}
    want = brute.components(list(range(len(sets))), [frozenset(s) for s in sets])
    assert {k: got.get(k, k) for k in range(len(sets))} == dict(enumerate(want))
    assert len(set(want)) > 10
