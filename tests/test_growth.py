"""Steps whose work must grow with their input and no faster."""

from __future__ import annotations

import re
from datetime import datetime
from glob import glob
from random import Random
from time import perf_counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from beaconlake.operators import edits, gazetteer, joins, model, retrieval, scenes, tracks
from beaconlake.plans import desk, search
from beaconlake.streaming import incidents

T0 = datetime(2024, 3, 5, 17, 0)


class Skeptic:
    def ask(self, task, payload):
        return {"supported": True, "quote": payload["lines"][:9], "refutes": str(len(payload["lines"]))}


def test_answers_are_written_without_lines(spark):
    """A run's lines go to the skeptic, cut, and not into what is written for every claim of the run."""
    claims = spark.createDataFrame([(1, f"s{i}", "h", "s", "reported", False, None) for i in range(5)] + [(2, "t", "h", "s", "reported", False, None)], "run int, id string, headline string, summary string, confidence string, held boolean, held_why string")
    lines = spark.createDataFrame([(1, T0, "x" * 30)] * 4, "run int, at timestamp, text string")
    told = model.verified(claims, lines, [Skeptic()], most_chars=40)
    assert {(r.id, r.verified, r.quote, r.held_why) for r in told.collect()} == {(f"s{i}", True, "x" * 9, None) for i in range(5)} | {("t", False, None, "no lines behind this claim")}
    (folder,) = {f.rsplit("/", 1)[0] for f in told.inputFiles()}
    written = spark.read.parquet(folder)
    assert not [c for c in written.columns if "lines" in c] and '"refutes": "40"' in written.filter("id = 's0'").first().answer


def test_undo_of_a_large_merge():
    """Twenty thousand beats come back in time that grows with their number, not with its square; each goes home from where it is."""
    board, n = edits.Board(), 20_000
    for i in range(n):
        board.edit(i, i, "hear", "a" if i % 2 else "b", None, n - i)
    at = perf_counter()
    for i in range(10):
        assert board.edit(n, n, "merge", "a", "b", None) == ("ok", "b") and board.edit(n, n, "undo", "a", None, None) == ("ok", "a")
    assert perf_counter() - at < 5
    assert board.cards == {"a": list(range(1, n, 2)), "b": list(range(2, n + 1, 2))} and board.edit(n, n, "undo", "a", None, None)[0] == "nothing to undo"


def test_undo_takes_the_first_of_equal_beats():
    assert edits._without([1, 2, 2, 3, 2], [2, 2]) == ([1, 3, 2], [])
    assert edits._without([2, 5], [5, 2, 7, 2, 5]) == ([2], [7, 5])  # the last that goes stays, as often as it is asked for
    assert edits._without([4], [5]) == ([4], [5])


def test_sweep_of_a_busy_town():
    """Scenes at many places are swept in time that grows with their number; the seeds are those of a plain sweep."""
    rows = [{"scene": f"{i:06}", "from_ms": i * 1000, "to_ms": i * 1000, "lat": 42.0 + i % 60 * 0.01, "lon": -71.0, "address": None, "words": set(), "loose": False} for i in range(30_000)]
    at = perf_counter()
    into = scenes.sweep(rows)
    assert perf_counter() - at < 10
    heads, want = {}, {}
    for r in rows:
        head = heads.get(r["lat"])
        if head is None or r["from_ms"] - head["to_ms"] > scenes.MERGE_MS:
            head = heads[r["lat"]] = r
        want[r["scene"]] = head["scene"]
    assert into == want


def test_alert_cells_keep_short_words(spark, sf):
    """Only stop words leave a headline's key, not every word of three letters or fewer."""
    keys = {r.alert_key for r in desk.alert_cells(spark, sf).filter("alert_key LIKE '%|nowhere|%'").collect()}
    words = {w for k in keys for w in k.split("|")[2].split("-")}
    assert {w for w in words if w and len(w) <= 3} and not words & {"the", "a", "at", "on", "of", "near"}


class Held:
    """A map of the state store that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def updateValue(self, key, value):
        self.held[key], self.calls = value, self.calls + 1

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]
        self.calls += 1

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))

    def exists(self):
        return False

    def update(self, value):
        pass


def test_waiting_messages_share_the_values_of_the_store(spark):
    """A thousand messages of an hour are a few values of the state store, and are heard once each in order of time."""
    maps = {name: Held() for name in ("waiting", "scenes", "units", "chunks")}
    handle = SimpleNamespace(getMapState=lambda name, *_: maps[name], getValueState=lambda name, *_: maps[name], registerTimer=lambda at: None)
    town = incidents._Correlator({})
    town.init(handle)
    base = dict.fromkeys(incidents._MESSAGE)
    rows = [Row(**base | {"at_ms": i % 60 * 60_000, "message": f"m{i:04}", "units": ["E1"], "call_type": "fire"}) for i in range(1000)]
    list(town.handleInputRows(("t",), iter(rows + rows[:5]), None))
    told = list(town.handleExpiredTimer(("t",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3_600_000), None))
    assert [r.message for r in told] == [m for _, m in sorted((r.at_ms, r.message) for r in rows)]
    assert maps["waiting"].calls <= 30 and not maps["waiting"].held


def test_citations_compare_sets_of_evidence(spark):
    """As a plain comparison of every piece of prose with every line of its scope; lines that say the same are compared once."""
    rng = Random(5)
    words = ["alder", "fire", "at", "engine", "smoke", "12", "409", "ladder", "7"]
    say = lambda: " ".join(rng.choices(words, k=rng.randrange(6)))
    prose = [(i, rng.choice("xyz"), " ".join([say(), *(f"{m // 60}:{m % 60:02}" for m in rng.sample(range(600, 612), rng.randrange(3)))])) for i in range(40)]
    lines = [(i, rng.choice("xyz"), rng.randrange(90), 600 + rng.randrange(12), say()) for i in range(800)]
    told = {i: (scope, set(t.split()) & {"alder", "fire", "engine", "smoke", "ladder", "12", "409"}, {int(w[:2]) * 60 + int(w[3:]) for w in t.split() if ":" in w}) for i, scope, t in prose}
    want = {}
    for i, (scope, a, clocks) in told.items():
        met = []
        for line, s, at, minute, t in lines:
            both = a & set(t.split())
            score, plain = sum(5 if w.isdigit() else 1 for w in both) + 8 * (minute in clocks), sum(not w.isdigit() for w in both)
            if s == scope and (score >= 5 or plain >= 3):
                met.append((-score, at, line))
        if met:
            best = sorted(met)[:12]
            want[i] = (len(best), [n for _, _, n in sorted(best, key=lambda x: x[1:])], -sum(x[0] for x in best))
    before = set(glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/citations-*"))
    got = retrieval.citations(spark.createDataFrame(prose, "item int, scope string, text string"), spark.createDataFrame(lines, "line int, scope string, at bigint, minute int, text string"))
    assert {r["item"]: (r.n, r.cited, r.score) for r in got.collect()} == want
    (folder,) = set(glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/citations-*")) - before
    sets = len({frozenset(a) for _, a, _ in told.values()}), len({frozenset(set(t.split()) - {"at", "7"}) for *_, t in lines})
    assert spark.read.parquet(f"{folder}/pairs").count() <= sets[0] * sets[1]


def test_topk_meets_as_many_rows_as_it_may_take(spark):
    """Against a plain search, with ties and repeats of times; an anchor meets 2 (k + 1) numbered rows, however dense they lie."""
    rng = Random(3)
    rows = [(i, rng.choice(["f", "g", None]), rng.choice([None, *[rng.randrange(40)] * 20])) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, feed string, at bigint")
    got = {(r.anchor, r.id, r.gap, r.place) for r in joins.interval_topk(frame.filter("id % 7 = 0"), frame, "feed", "at", "id", 3, 20).collect()}
    want = set()
    for a, feed, at in rows:
        if a % 7 == 0 and None not in (feed, at):
            near = sorted((abs(t - at), i) for i, f, t in rows if f == feed and t is not None and i != a and abs(t - at) <= 3)
            want |= {(a, i, gap, n + 1) for n, (gap, i) in enumerate(near[:20])}
    assert got == want
    dense = spark.range(3000).selectExpr("id", "'f' AS feed", "id AS at")
    found = joins.interval_topk(dense.filter("id % 10 = 0"), dense, "feed", "at", "id", 10_000, 3)
    assert found.count() == 900


def test_rows_of_one_point_meet_places_once(spark):
    """Ten thousand rows at four points: pairs are of points; each row has the nearest place, the least of equally near ones."""
    rows = spark.range(10_000).selectExpr("id", "42.0 + id % 4 * 0.01 AS lat", "-71.0D AS lon")
    places = spark.createDataFrame([(9, 42.0, -71.0), (7, 42.0, -71.0), (5, 42.011, -71.0), (6, 42.009, -71.0)], "place int, lat double, lon double")
    assert joins.near_points(rows.selectExpr("id", "CAST(lat AS DOUBLE) AS lat", "lon"), places, 200.0).count() == 3
    found = joins.nearest_place(rows.selectExpr("id", "CAST(lat AS DOUBLE) AS lat", "lon"), places, "place", 200.0).groupBy("place").agg(F.count("*").alias("n"), F.round(F.max("metres")).alias("m"))
    assert {(r.place, r.n, r.m) for r in found.collect()} == {(7, 2500, 0.0), (5, 2500, 111.0)}


def test_runs_go_through_one_call(spark):
    """Runs one after another, cut by batches anywhere, are walked as each by itself; runs cost no call each."""
    rng = Random(4)
    runs = []
    for r in range(30):
        at = sorted(rng.randrange(400_000) for _ in range(rng.randrange(1, 9)))
        runs.append(pd.DataFrame({"key": f"k{r}", "seq": range(len(at)), "at_ms": at, "lat": [42 + rng.randrange(4) * 0.002 for _ in at], "lon": -71.0, "_s": [1] + [0] * (len(at) - 1)}))
    whole = pd.concat(runs, ignore_index=True)
    want = [v for r in runs for v in tracks.walk(r).verdict]
    got = [v for pdf in tracks.walk_all(iter([whole[:7], whole[7:8], whole[8:100], whole[100:]])) for v in pdf.verdict]
    assert got == want and len(set(want)) > 3


def test_lines_meet_two_intervals_each(spark):
    """The nearest interval of a plain search is among at most two, with equal ends, starts and names apart, however many lie there."""
    rng = Random(8)
    spans = [(rng.choice("pq"), i, s, s + rng.choice([0, 0, 3, 9, 30])) for i in range(120) for s in [rng.randrange(150)]]
    lines = [(i, rng.choice("pqr"), rng.randrange(-5, 190)) for i in range(300)]
    found = joins.nearest_intervals(spark.createDataFrame(lines, "id int, place string, at int"), spark.createDataFrame(spans, "place string, scene int, f int, t int"), ["place"], "id", "at", "scene", "f", "t")
    gap = lambda f, t, at: max(0, f - at, at - t)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((gap(r.f, r.t, r["at"]), r.f, r.scene))
    want = {i: min((gap(f, t, at), f, s) for p, s, f, t in spans if p == place) for i, place, at in lines if place != "r"}
    assert {i: min(v) for i, v in got.items()} == want and max(map(len, got.values())) == 2


def test_words_are_cut_only_if_asked_for(spark, sf):
    """The stems of all words, which cost most of a search, are made for a question that asks for words, and for no other."""
    plan = lambda q: search.scored_calls(spark, sf, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan(search.QUESTION) and "flatten" in plan("any fires by corvane last month?")
    assert search.scored_calls(spark, sf, "any fires by corvane last month?").count() > 0


def test_context_meets_the_next_calls_of_an_anchor(spark, monkeypatch):
    """As a plain search with ties, by street and by unit; calls that lie dense at one street are not all met."""
    rng = Random(6)
    kinds = "event_id bigint, at_us bigint, street string, unit string"
    rows = [(i, rng.randrange(40) * search.MINUTE * 30, rng.choice("st"), rng.choice("uvwxyz")) for i in range(400)]
    hits = [(*r, float(rng.randrange(5, 11))) for r in rows if r[0] % 5 == 0]
    monkeypatch.setattr(search, "calls", lambda *_: spark.createDataFrame(rows, kinds))
    monkeypatch.setattr(search, "scored_calls", lambda *_: spark.createDataFrame(hits, kinds + ", score double"))
    frame = search.search_context(spark, "")
    want = {}
    for a, t, street, unit, score in hits:
        if score >= 6:
            near = sorted((abs(at - t), i, "street" if s == street else "unit") for i, at, s, u in rows if i != a and abs(at - t) <= 360 * search.MINUTE and (s == street or u == unit))
            for gap, i, why in near[:30]:
                want[i] = min(want.get(i, (0, 0, 0, "")), (-score, a, gap, why))
    assert {(r.event_id, r.anchor, r.gap, r.why) for r in frame.collect()} == {(i, a, gap, why) for i, (_, a, gap, why) in want.items()}
    assert not re.search(r"Join Inner, .*_street|Join Inner, .*_unit", frame._jdf.queryExecution().optimizedPlan().toString())  # calls of a street and a slot are no pairs


def test_a_name_of_many_places_is_one_row(spark):
    """A name takes the best of its places, in scope or the least, before rows are ranked, and they are sorted once."""
    places = spark.createDataFrame([("elm hall", f"p{i:03}", "hall", f"t{i % 60}", 0.0, 0.0) for i in range(300)], "alias string, place string, kind string, town string, lat double, lon double")
    texts = spark.createDataFrame([(i, "smoke at elm hall", [f"t{i}"] if i < 70 else None) for i in range(90)], "id int, text string, towns array<string>")
    found = gazetteer.scan(texts, places)
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort [_key") == 1
    assert {(r["id"], r.place, r.scoped) for r in found.collect()} == {(i, f"p{i:03}" if i < 60 else "p000", i < 60) for i in range(90)}
