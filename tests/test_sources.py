"""Pushed envelopes, polled sources, published sets, files that a window opens, rows with maps."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from beaconlake.sources import archive, cached, published, relay

T0 = datetime(2024, 3, 5, 12, 0)


def push(root, machine, n, body):
    folder = root / machine
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{n}.json").write_text(body if isinstance(body, str) else json.dumps({"machine": machine} | body))


def item(seq, text="a long message", **more):
    return {"seq": seq, "src": "s", "city": "Ayr", "text": text, "at": "2024-03-05T12:00:00Z"} | more


def test_relay_batch(spark, tmp_path):
    relay.register(spark)
    token = hashlib.sha256(b"yes").hexdigest()
    push(tmp_path, "m1", 0, {"token": "yes", "items": [item(1), item(2, " ab "), item("x", "x" * 5000, at="never", clip=7), "no"], "health": [{"id": "f1", "status": "up", "age": 3}, {"id": "f2"}]})
    push(tmp_path, "m1", 1, {"token": "yes", "items": [item(i) for i in range(201)]})
    push(tmp_path, "m2", 0, {"token": "no", "items": [item(1)]})
    push(tmp_path, "m2", 1, "{broken")
    push(tmp_path, "m2", 2, {"token": "yes", "items": [item(i) for i in range(200)]})
    (tmp_path / "m2" / "note.txt").write_text("no envelope")
    read = lambda table: spark.read.format("relay").option("table", table).option("tokens", token).load(str(tmp_path)).collect()
    items = read("items")
    assert sorted((r.machine, r.envelope, r.place, r.seq) for r in items if r.machine == "m1") == [("m1", 0, 0, 1), ("m1", 0, 2, None)] and sum(r.machine == "m2" for r in items) == 200
    long = next(r for r in items if r.place == 2 and r.machine == "m1")
    assert (len(long.text), long.at, long.clip) == (4000, None, "7") and items[0].at is not None
    assert sorted((r.id, r.status, r.report) for r in read("health")) == [("f1", "up", '{"age": 3, "id": "f1", "status": "up"}'), ("f2", None, '{"id": "f2"}')]
    assert sorted((r.machine, r.envelope, r.why, r["items"]) for r in read("refused")) == [("m1", 1, "too many items", 201), ("m2", 0, "unknown token", 1), ("m2", 1, "not a JSON object", 0)]
    assert spark.read.format("relay").load(str(tmp_path / "none")).collect() == []


def test_relay_stream_over_restarts(spark, tmp_path):
    """Envelopes that come out of order, with gaps, between restarts: each item once."""
    relay.register(spark)
    box = tmp_path / "in"
    sent = {("m1", n): [item(n * 10 + i) for i in range(3)] for n in range(6)} | {("m2", n): [item(n)] for n in range(3)}
    waves = [[("m1", 0), ("m1", 2), ("m2", 0)], [("m1", 1)], [], [("m1", 4), ("m2", 2), ("m2", 1)], [("m1", 3), ("m1", 5)]]
    want = [{("m1", 0), ("m2", 0)}, {("m1", 1), ("m1", 2)}, set(), {("m2", 1), ("m2", 2)}, {("m1", 3), ("m1", 4), ("m1", 5)}]
    seen: set = set()
    for wave, new in zip(waves, want):
        for machine, n in wave:
            push(box, machine, n, {"items": sent[machine, n]})
        box.mkdir(exist_ok=True)
        stream = spark.readStream.format("relay").option("path", str(box)).load()
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        run.processAllAvailable()
        run.stop()
        rows = [(r.machine, r.envelope) for r in spark.read.schema(relay.SCHEMAS["items"]).parquet(f"{tmp_path}/out").collect()]
        seen |= new
        assert sorted(rows) == sorted(k for k in seen for _ in sent[k])


def test_cached_source(spark, tmp_path):
    path, now, calls = str(tmp_path / "c"), datetime(2024, 3, 5, tzinfo=timezone.utc), []

    def refresh(value=None):
        def run():
            calls.append(value)
            if value is None:
                raise TimeoutError("no answer")
            return spark.createDataFrame([(value,)], "v int")

        return run

    ask = lambda minutes, value=None: cached.cached(spark, path, refresh(value), timedelta(minutes=5), now + timedelta(minutes=minutes)).first()
    with pytest.raises(TimeoutError):
        ask(0)
    assert (ask(0, 1).v, ask(4, 2).v, ask(5, 3).v) == (1, 1, 3) and calls == [None, 1, 3]
    down = ask(10)
    assert (down.v, down.stale, down.error) == (3, True, "TimeoutError: no answer")
    assert ask(14, 4).v == 3 and ask(15, 5).v == 5 and not ask(16).stale
    ask(20)
    with pytest.raises(LookupError):
        ask(76)


def test_cached_source_that_fails_while_rows_are_written(spark, tmp_path):
    now = datetime(2024, 3, 5, tzinfo=timezone.utc)
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("half way")).cast("string").alias("v"))
    good = lambda: spark.createDataFrame([("a",)], "v string")
    ask = lambda fn, m: cached.cached(spark, str(tmp_path / "c"), fn, timedelta(minutes=1), now + timedelta(minutes=m)).collect()
    assert [r.v for r in ask(good, 0)] == ["a"]
    assert [(r.v, r.stale) for r in ask(broken, 2)] == [("a", True)]


def test_published_sets_survive_a_killed_writer(spark, tmp_path, monkeypatch):
    """Killed between any two steps, a writer of five tables leaves the whole old set or the whole new one."""
    make = lambda v: {f"t{i}": spark.createDataFrame([(v if i % 2 else 0, i)], "v int, i int") for i in range(5)}
    steps = ("signature", "swap_pointer", "exists")
    for killed_at in range(12):
        path = f"{tmp_path}/{killed_at}"
        published.publish(make(1), path)
        count = [0]
        with monkeypatch.context() as m:
            for step in steps:
                real = getattr(published, step)

                def wrapped(*a, real=real):
                    count[0] += 1
                    if count[0] > killed_at:
                        raise KeyboardInterrupt
                    return real(*a)

                m.setattr(published, step, wrapped)
            try:
                published.publish(make(2), path)
                done = True
            except KeyboardInterrupt:
                done = False
        values = {n: df.first().v for n, df in published.current(spark, path).items()}
        assert values == {f"t{i}": ((2 if done else 1) if i % 2 else 0) for i in range(5)}
        if killed_at == 5:
            assert published.publish(make(3), path) == {f"t{i}": bool(i % 2) for i in range(5)}
    assert published.publish(make(2), path) == {f"t{i}": False for i in range(5)} and published.clean(spark, path, 0) == 2
    assert {n: df.first().v for n, df in published.current(spark, path).items()} == values


def test_a_window_opens_only_files_that_can_hold_it(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = lambda lo, hi: spark.createDataFrame([(i, T0 + timedelta(minutes=i)) for i in range(lo, hi)], "id int, at timestamp")
    for lo, hi in ((0, 240), (100, 110), (300, 600)):
        archive.append(rows(lo, hi).coalesce(1), path)
    files = len(spark.read.parquet(f"{path}/pieces").inputFiles())
    window = T0 + timedelta(minutes=120), T0 + timedelta(minutes=180)
    got = archive.read_window(spark, path, *window)
    assert sorted(r.id for r in got.collect()) == list(range(120, 180))
    assert len(got.inputFiles()) == 1 < files
    archive.compact(spark, path, T0 + timedelta(hours=4))
    got = archive.read_window(spark, path, *window)
    assert sorted(r.id for r in got.collect()) == list(range(120, 180)) and len([f for f in got.inputFiles() if "/hours/" in f]) == 1
    # A file that is not indexed yet is opened.
    archive.with_hours(rows(1000, 1001)).write.mode("append").partitionBy("day", "hour").parquet(f"{path}/pieces")
    got = archive.read_window(spark, path, T0 + timedelta(minutes=990), T0 + timedelta(minutes=1010))
    assert [r.id for r in got.collect()] == [1000]
    assert archive.index_files(spark, path) == 1 and archive.index_files(spark, path) == 0
    everything = archive.read_window(spark, path, T0, T0 + timedelta(days=1))
    assert sorted(r.id for r in everything.collect()) == [*range(240), *range(300, 600), 1000]


def test_rows_with_maps_at_any_depth(spark):
    make = "SELECT {k} AS k, map({m}) AS m, array(named_struct('x', map({m}), 'y', 1)) AS a, named_struct('d', map('o', map({m}))) AS s, parse_json('{v}') AS v"
    one = make.format(k=1, m="'a', 1, 'b', 2", v='{"p": 1, "q": [1, 2]}')
    other = make.format(k=1, m="'b', 2, 'a', 1", v='{"q": [1, 2], "p": 1}')
    third = make.format(k=1, m="'b', 2, 'a', 3", v='{"q": [2, 1], "p": 1}')
    null = "SELECT 2 AS k, CAST(NULL AS map<string,int>) AS m, CAST(NULL AS array<struct<x:map<string,int>,y:int>>) AS a, CAST(NULL AS struct<d:map<string,map<string,int>>>) AS s, CAST(NULL AS variant) AS v"
    df = spark.sql(" UNION ALL ".join([one, other, third, one, null, null]))
    got = archive.canonical(df)
    assert got.columns == df.columns and sorted(r.k for r in got.select("k").collect()) == [1, 1, 2]
