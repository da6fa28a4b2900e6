"""Archive and streams."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from beaconlake.sources import archive
from beaconlake.streaming import ingest

T0 = datetime(2024, 3, 5, 12, 0)


def rows(spark, items):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m)) for i, m in items], "id int, at timestamp")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    archive.append(rows(spark, [(1, 0), (2, 30), (3, 70), (3, 70), (4, 200)]), path)
    whole = lambda: ids(archive.read_window(spark, path, T0, T0 + timedelta(hours=5)))
    assert whole() == [1, 2, 3, 4]
    archive.compact(spark, path, T0 + timedelta(hours=2))
    assert whole() == [1, 2, 3, 4]
    archive.append(rows(spark, [(5, 40), (6, 210), (1, 0)]), path)
    assert whole() == [1, 2, 3, 4, 6]  # hour 12 is settled; its late piece waits
    archive.compact(spark, path, T0 + timedelta(hours=2))
    assert whole() == [1, 2, 3, 4, 5, 6]
    assert ids(archive.read_window(spark, path, T0 + timedelta(minutes=30), T0 + timedelta(minutes=70))) == [2, 5]
    cover = archive.coverage(archive.read_window(spark, path, T0, T0 + timedelta(hours=5)), T0, T0 + timedelta(hours=5), bad=0).first()
    assert (cover.rows, cover.complete) == (6, True)
    assert not archive.coverage(rows(spark, []), T0, T0).first().complete and archive.coverage(rows(spark, []), T0, T0, bad=0).first().complete
    assert archive.expire(spark, path, "2024-03-05") == 0 and archive.expire(spark, path, "2024-03-06") == 2


def test_window_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    archive.append(rows(spark, [(i, i * 60) for i in range(96)]), path)
    df = archive.read_window(spark, path, T0, T0 + timedelta(hours=2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and ids(df) == [0, 1]


def test_canonical_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 1 AS x UNION ALL SELECT map('b', 2, 'a', 1), 1 UNION ALL SELECT map('a', 1), 1")
    assert archive.canonical(df).count() == 2


def test_publish(spark, tmp_path):
    df = rows(spark, [(1, 0), (2, 1)])
    assert archive.publish(df, str(tmp_path / "b"))
    assert not archive.publish(df.repartition(3), str(tmp_path / "b"))
    assert archive.publish(rows(spark, [(1, 0)]), str(tmp_path / "b"))
    assert archive.publish(rows(spark, []), str(tmp_path / "b")) and not archive.publish(rows(spark, []), str(tmp_path / "b"))


def drop(folder, name, items):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(i) for i in items))


def drain(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def item(seq, minute, text="a long message", **more):
    return {"machine": "m1", "seq": seq, "src": "s1", "text": text, "at": (T0 + timedelta(minutes=minute)).isoformat(), **more}


def test_ingest(spark, tmp_path):
    landing = tmp_path / "in"
    drop(landing, "a.json", [item(1, 0, towns="Ayr, Bury ,"), item(1, 0), item(None, 1), item(None, 1), item(2, 2, "hi"), item(3, 3, "x" * 5000, src="")])
    drop(landing, "b.json", [item(1, 0), item(4, 4)])
    (landing / "c.json").write_text("not json\n")
    got = drain(ingest.claim_once(ingest.normalize(ingest.read_landing(spark, str(landing), 1))), "claimed", spark)
    assert sorted((r.seq or 0) for r in got) == [0, 0, 1, 3, 4]
    assert {(r.src, len(r.text)) for r in got if r.seq == 3} == {("unknown", 4000)}


def test_hours_are_sealed_once(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    batches = [[item(i, i) for i in range(50)], [item(100, 65), item(101, 80)], [item(102, 200), item(103, 59)], [item(104, 400)]]
    for name, batch in zip("abcd", batches):
        drop(landing, f"{name}.json", batch)
        counts = ingest.hourly_counts(ingest.normalize(ingest.read_landing(spark, str(landing))))
        counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.hour, r.n) for r in spark.read.parquet(out).collect()]
    assert sorted(got)[:2] == [(T0, 50), (T0 + timedelta(hours=1), 2)]  # the last message came after its hour was sealed
    assert len({hour for hour, _ in got}) == len(got)


def test_stream_to_archive(spark, tmp_path):
    landing = tmp_path / "in"
    drop(landing, "a.json", [item(i, i) for i in range(5)])
    ingest.to_archive(ingest.normalize(ingest.read_landing(spark, str(landing))).drop("towns"), str(tmp_path / "arc"), str(tmp_path / "ck")).awaitTermination(120)
    assert archive.read_window(spark, str(tmp_path / "arc"), T0, T0 + timedelta(hours=1)).count() == 5
