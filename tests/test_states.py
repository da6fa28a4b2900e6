"""Operators whose next step depends on the last: tracks, scenes, stops, threads, alerts, ages of bursts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from beaconlake.functions import localtime, scoring, spoken, text as tx
from beaconlake.operators import ordered, questions, scenes, spaced, tracks
from beaconlake.plans import desk
from beaconlake.sources import archive
from beaconlake.streaming import ingest, stops, threads

T0 = 1_700_000_000_000
MIN = 60_000
FIX = "key string, seq int, at_ms bigint, lat double, lon double, alt double"


def taken(rows):
    return {(r.key, r.seq): (r.taken, r.cut, r.verdict) for r in rows}


def test_track_gate(spark):
    step = 0.002  # about 220 m of latitude
    fixes = [("a", 0, T0, 42.0, -71.0), ("a", 1, T0 - 5, 42.0, -71.0), ("a", 2, T0 + 500, 42.0, -71.0), ("a", 3, T0 + 10_000, 42.0 + step, -71.0), ("a", 4, T0 + 20_000, 42.0 + step, -71.0), ("a", 5, T0 + 56_000, 42.0 + step, -71.0)]
    fixes += [("a", 6 + i, T0 + 60_000 + i * 2_000, 43.0, -71.0) for i in range(4)] + [("a", 10, T0 + 70_000 + tracks.GAP_MS, 43.1, -71.0), ("a", 11, T0 + 80_000 + tracks.GAP_MS, 0.0, 0.0), ("b", 0, T0, 91.0, 0.0)]
    got = taken(tracks.gated(spark.createDataFrame([(*f, None) for f in fixes], FIX)).collect())
    assert got == {
        ("a", 0): (True, True, "begins"), ("a", 1): (False, False, "early"), ("a", 2): (False, False, "crowded"), ("a", 3): (True, False, "moves"), ("a", 4): (False, False, "rests"), ("a", 5): (True, False, "beats"),
        ("a", 6): (False, False, "leaps"), ("a", 7): (False, False, "leaps"), ("a", 8): (False, False, "leaps"), ("a", 9): (True, True, "lands"), ("a", 10): (True, True, "resumes"),
    }


def test_runs_do_not_change_the_walk(spark):
    """Splitting at gaps gives what one walk over everything gives."""
    rng = random.Random(3)
    rows, at = [], T0
    for i in range(400):
        at += rng.choice([500, 3_000, 20_000, 60_000, 200_000, -4_000])
        rows.append(("k", i, at, 42.0 + rng.random() * rng.choice([0.001, 0.02, 1.0]), -71.0, None))
    pdf = spark.createDataFrame(rows, FIX).toPandas()
    whole = tracks.walk(pdf)
    got = taken(tracks.gated(spark.createDataFrame(rows, FIX)).collect())
    assert [got["k", s][:2] for s in whole.seq] == list(zip(whole.taken.tolist(), whole.cut.tolist()))
    assert any(w == "resumes" for *_, w in got.values())


def test_legs_and_circles(spark):
    ring = [("c", i, T0 + i * 20_000, 42.0 + 0.01 * (i % 2), -71.0 + 0.005 * (i % 3), 1500.0) for i in range(12)]
    line = [("l", i, T0 + i * 20_000, 42.0 + 0.008 * i, -71.0, 1500.0) for i in range(12)]
    high = [("h", i, T0 + i * 20_000, 42.0 + 0.001 * (i % 2), -71.0, 9000.0) for i in range(12)]
    known = tracks.gated(spark.createDataFrame(ring + line + high, FIX))
    now = T0 + 12 * 20_000
    got = {r.key: (r.circles, r.for_ms) for r in tracks.circling(known, now).collect()}
    assert got == {"c": (True, 220_000), "l": (False, 0), "h": (False, 0)}
    legs = tracks.legs(known, now).collect()
    assert {r.key for r in legs} == {"c", "l", "h"} and sum(r.tip for r in legs if r.key == "l") == 7


SCENE = "town string, scene string, from_ms bigint, to_ms bigint, lat double, lon double, address string, words array<string>, loose boolean"


def test_star_merge(spark):
    """A meets B and B meets C, but C lies beyond A's seed: two events.  Bursts never meet bursts."""
    d = 0.0012  # about 133 m
    rows = [("t", "A", T0, T0 + MIN, 42.0, -71.0, None, [], False), ("t", "B", T0 + 5 * MIN, T0 + 6 * MIN, 42.0 + d, -71.0, None, [], False), ("t", "C", T0 + 9 * MIN, T0 + 9 * MIN, 42.0 + 2 * d, -71.0, None, [], False)]
    rows += [("u", "D", T0, T0, None, None, "5 elm st", [], False), ("u", "E", T0 + 39 * MIN, T0 + 40 * MIN, None, None, "5 elm st", [], False), ("u", "F", T0 + 41 * MIN, T0 + 41 * MIN, None, None, "5 elm st", [], False)]
    rows += [("v", "G", T0, T0, None, None, None, ["a", "b"], True), ("v", "H", T0, T0, None, None, None, ["a", "b"], True), ("v", "I", T0 + MIN, T0 + MIN, None, None, None, ["b", "a", "c"], False), (None, "J", T0, T0, None, None, None, None, False)]
    got = {r.scene: r["into"] for r in scenes.merged(spark.createDataFrame(rows, SCENE).repartition(3)).collect()}
    assert got == {"A": "A", "B": "A", "C": "C", "D": "D", "E": "D", "F": "F", "G": "I", "H": "I", "I": "I", "J": "J"}


def test_aged_bursts(spark):
    """Gaps up to 12 minutes, an age of at most 20: a channel busy for an hour is several bursts."""
    minutes = [0, 5, 12, 24, 36, 48.01, 61, 61, 80]
    rows = [("f", int(m * MIN), i) for i, m in enumerate(minutes)]
    got = {r.tie: r.burst_start for r in ordered.aged_bursts(spark.createDataFrame(rows, "feed string, at bigint, tie int"), "feed", "at", 12 * MIN, 20 * MIN, "tie").collect()}
    want, began, last = {}, None, None
    for _, at, tie in rows:
        if began is None or at - last > 12 * MIN or at - began > 20 * MIN:
            began = at
        want[tie], last = began, at
    assert got == want


def lines(spark, rows):
    return [{"message": f"m{i}", "at_ms": T0 + int(m * MIN), "feed": f, "unit": u, "text": t, "plate_key": p} for i, (m, f, u, t, p) in enumerate(rows)]


def test_stops():
    state = {"open": {}}
    out = []
    rows = [
        (0, "f1", "U1", "traffic stop, black honda with two occupants", None), (1, "f1", None, "operator has a warning on file", None), (2, "f1", "U2", "vehicle stop at the square", None), (3, "f1", None, "registration comes back", None),
        (4, "f1", "U1", "issuing a citation, clear of the stop", "abc"), (5, "f1", "U3", "on patrol", None), (30, "f2", None, "plate check", None), (90, "f1", "U9", "traffic stop", None),
    ]
    for m in lines(None, rows):
        out += stops.hear(state, m)
    by = {s["unit"]: s for s in out}
    assert by["U1"] | {"last": 0} == {"stop": "s-m0", "unit": "U1", "feed": "f1", "start": T0, "last": 0, "lines": 3, "inferred": 1, "outcome": "citation", "vehicle": "black honda", "occupants": 2, "plate_key": "abc", "event": "closed", "end": T0 + 4 * MIN}
    assert by["U2"]["event"] == "stale" and by["U2"]["inferred"] == 0  # two stops were open: nobody's line
    assert list(state["open"]) == ["U9"]
    assert stops.vehicle("silver, no wait, a red one right here it is the ford") == "red ford" or stops.vehicle("red ford") == "red ford"
    assert stops.occupants("three on board") == 3 and stops.occupants("nobody") is None


def test_stop_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 3, 5, 12, 0) + timedelta(minutes=m)
    schema = "dept string, message string, at timestamp, feed string, unit string, text string, plate string"
    batches = [[("d", "a", at(0), "f", "U1", "traffic stop", "12-AB"), ("d", "b", at(2), "f", "U1", "back in service", None)], [("d", "c", at(10), "f", "U2", "car stop", "12 ab")], [("e", "z", at(200), "f", None, "quiet", None)], [("e", "y", at(260), "f", None, "quiet", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = stops.stops(stream).writeStream.format("memory").queryName("stops_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert q.exception() is None
    out = spark.table("stops_out")
    assert {(r.unit, r.event, r.seconds, r.heard_for) for r in out.collect()} == {("U1", "closed", 120, None), ("U2", "stale", None, 0)}
    again = {r.unit: (r.visit, r.prior) for r in stops.repeats(out).collect()}
    assert again == {"U1": (1, []), "U2": (2, ["s-a"])}


def board(spark, rows):
    return spark.createDataFrame(rows, threads.BOARD)


def test_threads(spark):
    now = T0 + 100 * MIN
    b = board(spark, [
        ("s1", "fire", "House fire", 42.0, -71.0, "normal", "developing", ["f1"], T0, now - 5 * MIN, 3), ("s2", "crash", "Crash", 42.5, -71.0, "high", "closed", ["f2"], T0, now - 25 * MIN, 1),
        ("s3", "fire", "Old fire", 42.2, -71.0, "normal", "developing", [], T0, now - 41 * MIN, 1), ("s4", "search", "Search", None, None, "normal", "developing", [], T0, now - 10 * MIN, 1),
    ])
    report = "report string, kind string, headline string, lat double, lon double, priority string, feeds array<string>, updates string, related string"
    r = spark.createDataFrame([
        ("r1", "Fire", "Bigger fire", 42.001, -71.0, "high", ["f3"], None, None), ("r2", "crash", "Again", 42.5, -71.0, "normal", ["f2", "f4"], "s2", None), ("r3", "bag", "A bag", 43.0, -70.0, "normal", [], None, "s4"), ("r4", "fire", "Far fire", 42.01, -71.0, "normal", ["f9", "f9"], None, None),
        ("r5", "fire", "Kept apart", 42.0, -71.0, "normal", [], None, None), ("r6", "x", "Forced", 10.0, 10.0, "normal", [], None, None), ("r7", "crash", "Too far", 43.0, -71.0, "normal", [], "s2", None), ("r8", "fire", "Not s1", 42.0, -71.0, "normal", [], "s1", None),
    ], report)
    log = spark.createDataFrame([(1, now, "r5", "split", None), (2, now, "r6", "merge", "m1"), (3, now, "m1", "merge", "s4"), (4, now, "r8", "split", "s1"), (5, now, "r1", "merge", "s2"), (6, now, "r1", "undo", None), (7, now - 8 * 86_400_000, "r2", "split", None)], "seq int, at_ms bigint, handle string, action string, target string")
    rules = threads.latest_rules(log, now)
    assert {x.handle for x in rules.collect()} == {"r5", "r6", "m1", "r8"}
    got = {x.report: (x.parent, x.how) for x in threads.threaded(b, r, rules, now).collect()}
    assert got == {"r1": ("s1", "place"), "r2": ("s2", "update"), "r3": ("s4", "related"), "r4": (None, "new"), "r5": (None, "new"), "r6": ("s4", "forced"), "r7": (None, "new"), "r8": (None, "new")}
    after = {x.id: x for x in threads.reconcile(b, r, rules, now).collect()}
    assert after.keys() >= {"s1", "s2", "s4"} and "s3" not in after and len(after) == 7
    assert (after["s1"].headline, after["s1"].priority, after["s1"].feeds, after["s1"].beats, after["s1"].lat) == ("Bigger fire", "high", ["f1", "f3"], 4, 42.001)
    assert (after["s2"].status, after["s2"].priority, after["s2"].headline) == ("developing", "high", "Again") and (after["s4"].headline, after["s4"].beats) == ("Search", 3)
    quiet = {x.id: x.status for x in threads.reconcile(b, r.limit(0), rules, now + 20 * MIN).collect()}
    assert quiet == {"s1": "closed", "s4": "closed"}


def test_alerts(spark):
    hour = 3_600_000
    rows = [(T0, "old", "high", "confirmed"), (T0 + 1000, "old", "high", "confirmed"), (T0 + 1000, "new", "normal", None), (T0 + 2000, "new", "normal", None), (T0 + 2000, "high", "high", "reported"), (T0 + 2000, "mist", "high", "unclear"), (T0 + 7 * hour, "old", "high", "x"), (T0 + 7 * hour, "new", "normal", "x"), (T0 + 8 * hour, "new", "normal", "x")]
    fired = threads.alerts(spark.createDataFrame(rows, "board_ms bigint, alert_key string, priority string, confidence string"))
    assert sorted((r.alert_key, (r.board_ms - T0) // 1000) for r in fired.collect()) == [("high", 2), ("new", 1), ("new", 7 * 3600), ("old", 7 * 3600)]
    assert sorted(((r.board_ms - T0) // 1000, r.cue) for r in threads.sounds(fired).collect()) == [(1, "new"), (7 * 3600, "high")]


def one_by_one(times, floor):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= floor:
            kept.append(t)
    return kept


@pytest.mark.parametrize("chunk,n", [(4_000, 2_000), (60_000, 10_000), (3_600_000, 2_000), (None, 5), (None, 0)])
def test_spaced_is_one_fold(spark, chunk, n):
    """Board after board, dense and with gaps, over several levels of chunks; keys of their own, one of them null."""
    rng = random.Random(n)
    rows, at = [], T0 - 777
    for _ in range(n):
        at += rng.choice([0, 1, 900, 1500, 3999, 4000, 4001, rng.randrange(6000), 90_000 * (rng.random() < 0.01)])
        rows.append((at, rng.choice(["a", "b", "b", None])))
    df = spark.createDataFrame(rows, "t bigint, k string").repartition(4)
    assert sorted(r.t for r in spaced.spaced(df, [], "t", 4000, chunk).collect()) == one_by_one([t for t, _ in rows], 4000)
    got = spaced.spaced(df, ["k"], "t", 4000, chunk).collect()
    for key in ("a", "b", None):
        assert sorted(r.t for r in got if r.k == key) == one_by_one([t for t, k in rows if k == key], 4000)


def test_sounds_against_the_last_sound(spark):
    """Boards three seconds apart sound every second time, over the edge of a chunk too; modes leave boards out."""
    at = [3_600_000 * 6 - 6000 + 3000 * i for i in range(5)] + [3_600_000 * 30 + 2000 * i for i in range(4)]
    fired = spark.createDataFrame([("k", t, int(t % 9000 == 0)) for t in at], "alert_key string, board_ms bigint, high int")
    assert sorted(r.board_ms for r in threads.sounds(fired).collect()) == [at[0], at[2], at[4], at[5], at[7]]
    assert sorted((r.board_ms, r.cue) for r in threads.sounds(fired, "high").collect()) == [(t, "high") for t in one_by_one([t for t in at if t % 9000 == 0], 4000)]
    assert threads.sounds(fired, "off").collect() == []


def test_stale_once(spark):
    m = 60_000
    rows = [(0, False, None), (2 * m, False, None), (4 * m, False, None), (5 * m, None, None), (6 * m, True, None), (8 * m, False, None), (10 * m, False, None), (11 * m, False, None), (12 * m, True, 11 * m), (13 * m, True, 9 * m), (14 * m, True, 9 * m)]
    rows += [(2000 * m, False, None), (2001 * m, True, 2001 * m), (4500 * m, False, None)]
    got = threads.stale(spark.createDataFrame(rows, "poll_ms bigint, ok boolean, board_ms bigint")).collect()
    assert sorted((r.poll_ms // m, r.since_ms and r.since_ms // m) for r in got) == [(4, None), (10, 6), (13, 12), (4500, 2001)]


VOCABULARY = questions.Vocabulary(
    kinds={"death": "bod(?:y|ies)", "shooting": "shots? fired", "stabbing": "stabbing", "fire": "fires?"}, kin={"stabbing": ("medical",)}, big="big(?:gest)?", suffixes={"street": "st"},
    filler=frozenset("any the near what happened".split()),
)
NOW = datetime(2024, 3, 13, 14, 30, tzinfo=questions.ZONE)  # a Wednesday afternoon, three days after the clocks went forward


@pytest.mark.parametrize(
    ("said", "start", "end", "label"),
    [
        ("fire last night", "03-12 18:00", "03-13 06:00", "last night"), ("anything overnight", "03-12 18:00", "03-13 06:00", "last night"), ("tonight", "03-12 18:00", "03-13 06:00", "last night"), ("yesterday afternoon", "03-12 12:00", "03-12 18:00", "yesterday afternoon"),
        ("yesterday morning", "03-12 00:00", "03-12 12:00", "yesterday morning"), ("yesterday", "03-12 00:00", "03-13 00:00", "yesterday"), ("this morning", "03-13 00:00", "03-13 12:00", "this morning"), ("this afternoon", "03-13 12:00", "03-13 14:30", "this afternoon"),
        ("since midnight", "03-13 00:00", "03-13 14:30", "today"), ("over the weekend", "03-09 00:00", "03-11 00:00", "the weekend"), ("last week", "03-06 13:30", "03-13 14:30", "the last week"), ("past month", "02-12 13:30", "03-13 14:30", "the last month"),
        ("last 6 hours", "03-13 08:30", "03-13 14:30", "the last 6 hours"), ("past ninety days", "03-11 14:30", "03-13 14:30", "the last two days"), ("last few minutes", "03-13 14:27", "03-13 14:30", "the last few minutes"), ("last couple of days", "03-11 14:30", "03-13 14:30", "the last couple of days"),
        ("right now", "03-13 13:30", "03-13 14:30", "the last hour"), ("on 2024-03-10", "03-10 00:00", "03-11 00:00", "2024-03-10"), ("March 10th", "03-10 00:00", "03-11 00:00", "mar 10"), ("3/1", "03-01 00:00", "03-02 00:00", "mar 1"),
        ("wednesday the 12th", "03-12 00:00", "03-13 00:00", "mar 12"), ("the 20th", "02-20 00:00", "02-21 00:00", "feb 20"), ("monday", "03-11 00:00", "03-12 00:00", "monday"), ("wednesday", "03-13 00:00", "03-14 00:00", "wednesday"), ("nothing said", "03-11 14:30", "03-13 14:30", "the last two days"),
    ],
)
def test_time_phrases(said, start, end, label):
    span = questions.time_span(said, NOW)
    assert (span.start.strftime("%m-%d %H:%M"), span.end.strftime("%m-%d %H:%M"), span.label) == (start, end, label)
    assert span.named == (label != "the last two days")


def test_time_phrases_at_other_hours():
    late, early = NOW.replace(hour=23), NOW.replace(hour=2)
    assert questions.time_span("tonight", late).start.strftime("%d %H") == "13 18" and questions.time_span("tonight", early).label == "tonight"
    assert questions.time_span("last night", early).start.strftime("%d %H") == "12 18"
    assert questions.time_span("dec 31", NOW).start.year == 2023 and questions.time_span("10th", NOW).start.utcoffset() == timedelta(hours=-5)
    assert questions.time_span("yesterday", datetime(2024, 3, 11, 12, tzinfo=questions.ZONE)).end.strftime("%m-%d %H:%M") == "03-11 00:00"  # a day of 23 hours


def test_questions():
    bridge, quay = questions.Place(("north bridge", "the bridge"), 1.0, 2.0, 10.0), questions.Place(("north",), 1.0, 2.0, 10.0)
    q = questions.parse("any big shots fired on Lancaster Street near the bridge last night, blue van?", NOW, [quay], [bridge], VOCABULARY)
    assert (q.kind, q.landmark, q.place, q.big, q.phrases, q.words) == ("shooting", bridge, None, True, (("lancaster street", "lancaster st"),), ("blue", "van"))
    assert q.count == 5
    assert questions.parse("what happened", NOW, vocabulary=VOCABULARY).count == 0
    assert questions.parse("a body on monday the 4th", NOW, vocabulary=VOCABULARY).kind == "death"


def test_score(spark):
    row = lambda text, label="x", k=0: spark.createDataFrame([(text, label, 42.0, -71.0, k)], "text string, label string, lat double, lon double, k int")

    def points(question, df, **known):
        asked = questions.parse(question, NOW, vocabulary=VOCABULARY, **known)
        c = F.col
        s = questions.score(asked, hay=c("text"), words=tx.with_stems(tx.tokens(c("text"))), label=c("label"), lat=c("lat"), lon=c("lon"), vague=F.lit(False), high=c("k") > 0, tier=c("k"), alarm=F.lit(0))
        return df.select(s.alias("s")).first().s

    near = questions.Place(("elm hill",), 42.0, -71.0, 500.0)
    assert points("fires", row("x", "fire")) == 10 * 2 and points("fires", row("a fire here")) == 5 * 2 and points("fires", row("calm")) == 0
    assert points("stabbing at elm street", row("elm street run", "medical")) == (8 + 1) * 1.5 and points("stabbing at elm street", row("oak", "medical")) == 0
    assert points("elm hill", row("said elm hill"), places=[near]) == 5 * 2 and points("elm hill", row("x"), places=[near]) == 4 * 2 and points("elm hill", row("x"), landmarks=[near]) == 6 * 2
    assert points("dorchester tower", row("towers of dorchestor")) == (3 + 2) * 2 and points("fire blue", row("a fire", "fire")) == 0
    assert points("biggest", row("x", k=3)) == 1 + 3 + 2 + 2 and points("what happened", row("x")) == 1


def test_lists_cut_to_a_budget(spark):
    import json

    def plain(lists, budget):
        lists = [{"feed": f, "events": list(e)} for f, e in lists]
        size = lambda: len(json.dumps(lists, separators=(",", ":")))
        while size() > budget and max(len(x["events"]) for x in lists) > 1:
            longest = max(lists, key=lambda x: len(x["events"]))
            longest["events"] = longest["events"][(len(longest["events"]) + 1) // 2 :]
        return lists

    cases = [[("a", range(5)), ("b", range(9)), ("c", range(9))], [("a", range(100))], [("a", "x"), ("b", "y")], [("a", range(40)), ("b", range(39)), ("c", [])]]
    for lists in cases:
        lists = [(f, [str(x) for x in e]) for f, e in lists]
        for budget in (10, 90, 200):
            df = spark.createDataFrame([([{"feed": f, "events": e} for f, e in lists],)], "each array<struct<feed:string,events:array<string>>>")
            got = df.select(desk.fitted(F.col("each"), budget).alias("x")).first().x
            assert [r.asDict() for r in got] == plain(lists, budget)


def test_phrases_and_curves(spark):
    ages = [(-3, "0s"), (75, "75s"), (89.4, "89s"), (90, "2m"), (5369, "89m"), (5400, "1.5h"), (172_000, "47.8h"), (172_800, "2d"), (300_000, "3d")]
    df = spark.createDataFrame([(float(s), w) for s, w in ages], "s double, want string")
    assert [r.got for r in df.select(scoring.age_phrase(F.col("s")).alias("got"), "s").orderBy("s").collect()] == [w for _, w in sorted(ages)]
    curve = [(-91, 0.0, "pending"), (-90, 0.0, "building"), (-45, 0.425, "building"), (0, 0.85, "peak"), (12, 0.925, "peak"), (24, 1.0, "peak"), (120, 1.0, "peak"), (142.5, 0.5, "dispersing"), (165, 0.0, "ended")]
    got = spark.createDataFrame([(float(m), s, p) for m, s, p in curve], "m double, s double, p string").select("s", "p", scoring.crowd_share(F.col("m"), F.lit(120.0)).alias("c")).collect()
    assert all(abs(r.s - r.c.share) < 1e-9 and r.p == r.c.phase for r in got)
    days = [("2024-02-29", True), ("2023-02-29", False), ("2024-2-3", False), ("x", False)]
    assert all(r.want == r.got for r in spark.createDataFrame(days, "d string, want boolean").select("want", localtime.is_calendar_day(F.col("d")).alias("got")).collect())
    clocks = spark.range(1).select(tx.clock_minutes(F.lit("at 9:05 pm, 12:00 am and 23:59")).alias("c")).first().c
    assert clocks == [21 * 60 + 5, 0, 23 * 60 + 59]


def test_late_pieces_are_read(spark, tmp_path):
    """A piece that comes for a compacted hour long after it is read again once compaction looks at new pieces."""
    t0 = datetime(2024, 3, 5, 12, 0)
    make = lambda i, m: spark.createDataFrame([(i, t0 + timedelta(minutes=m))], "id int, at timestamp")
    path = str(tmp_path / "a")
    archive.append(make(1, 0), path)
    archive.compact(spark, path, t0 + timedelta(hours=2))
    archive.append(make(2, 10), path)
    archive.append(make(3, 60 * 72), path)
    archive.compact(spark, path, t0 + timedelta(hours=80))
    ids = sorted(r.id for r in archive.read_window(spark, path, t0, t0 + timedelta(hours=90)).collect())
    assert ids == [1, 2, 3]


def test_spelled_runs(spark):
    cases = [
        ("plate is adam boy three four X ray niner thank you", [("AB34X9", 6, 3, 6)], 1), ("hello i m 22 i m 22", [("IM22IM22", 6, 0, 0)], 0), ("one two", [], 0), ("alpha, bravo. charlie!", [("ABC", 3, 3, 3)], 0),
        ("respond to 1426 elm then kilo one two three lima out", [("K123L", 5, 2, 5)], 1), (None, [], 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string").select("i", spoken.spelled_runs(F.col("t")).alias("r"), F.size(spoken.plate_keys(F.col("t"))).alias("n"))
    got = {r.i: ([tuple(x) for x in r.r], r.n) for r in df.collect()}
    assert got == {i: (runs, n) for i, (_, runs, n) in enumerate(cases)}


def test_raw_fallback_and_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = '{"machine": "m", "seq": 1, "src": "s", "text": "a long message", "at": "2024-03-05T12:00:00"}'
    (tmp_path / "in" / "a.json").write_text(good + "\nnot json\n" + good.replace("1,", "2,") + "\n")
    bad = ingest.bad_lines(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("bad_out").trigger(availableNow=True).start()
    bad.awaitTermination(120)
    assert [r.line for r in spark.table("bad_out").collect()] == ["not json"]

    def broken(batch):
        return batch.withColumn("text", F.raise_error(F.lit("enrichment is down")).cast("string"))

    for name, enrich in (("ok", lambda b: b.withColumn("by", F.lit("rules"))), ("down", broken)):
        q = ingest.to_archive(ingest.normalize(ingest.read_landing(spark, f"{tmp_path}/in")), f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}", enrich)
        q.awaitTermination(120)
        rows = spark.read.parquet(f"{tmp_path}/{name}/pieces").select("seq", "by").collect()
        assert sorted((r.seq, r.by) for r in rows) == [(1, "rules" if name == "ok" else "raw-fallback"), (2, "rules" if name == "ok" else "raw-fallback")]


def test_bursts_over_stretches(spark):
    """Numbered as one walk over each source numbers them, with times at the edges of stretches, ties and nulls."""
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([0, 1, 9, 10, 11, 100, 640])
        rows.append((rng.choice(["f", "g", None]), at if rng.random() > 0.05 else None, i))
    got = {r.tie: r.burst for r in ordered.gap_bursts(spark.createDataFrame(rows, "feed string, at bigint, tie int").repartition(5), "feed", "at", 10, "tie", chunk=3).collect()}
    want = {}
    for feed in ("f", "g", None):
        last, n = None, 0
        for _, at, tie in sorted((r for r in rows if r[0] == feed), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            n += n == 0 or (at is not None and (last is None or at - last > 10))
            want[tie], last = n, at
    assert got == want
