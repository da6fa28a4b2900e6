"""A sweep of scenes reads as far as its seed reaches, and holds no more."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from beaconlake.operators import scenes

KEYS = ("town", "stretch", "scene", "from_ms", "to_ms", "lat", "lon", "address", "words", "loose")


def test_a_long_stretch_is_swept_as_it_comes(spark, monkeypatch):
    """60,000 scenes of one stretch, half of them seeds: a task holds those of a reach, not the stretch."""
    n, step = 60_000, 10_000
    kinds = {"lat": pa.float64(), "lon": pa.float64(), "address": pa.string(), "words": pa.list_(pa.string()), "from_ms": pa.int64(), "to_ms": pa.int64(), "loose": pa.bool_()}

    def batches():
        for at in range(0, n, 1000):
            rows = [("t", 1, f"{i:08}", i * step, i * step + 500, 42.0 + i // 2 % 5000 * 0.01, -71.0, None, [], False) for i in range(at, at + 1000)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(k)) for k, x in zip(KEYS, zip(*rows))], names=list(KEYS))

    ran = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: ran.append(run))
    scenes.merged(spark.createDataFrame([], "town string, scene string, from_ms bigint, to_ms bigint, lat double, lon double, address string, words array<string>, loose boolean"))
    tracemalloc.start()
    got, most = 0, 0
    for batch in ran[0](batches()):
        got += batch.num_rows
        assert all(int(s) - int(into) == int(s) % 2 for s, into in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert got == n and most < 25_000_000


def test_a_sweep_reads_as_far_as_a_seed_reaches():
    read = 0

    def rows():
        nonlocal read
        for i in range(20_000):
            read += 1
            yield {"scene": f"{i:06}", "from_ms": i * 1000, "to_ms": i * 1000, "lat": 42.0 + i % 60 * 0.01, "lon": -71.0, "address": None, "words": set(), "loose": i % 7 == 0}

    lead = [read - told for told, _ in enumerate(scenes.swept(rows()))]
    assert len(lead) == 20_000 and max(lead) < 2 * scenes.MERGE_MS // 1000 + 100
