"""The incident state machine against a plain fold over the messages in order of time."""

from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from beaconlake.plans import live
from beaconlake.streaming import incidents
from beaconlake.streaming.replay import keyed_state

T0 = datetime(2024, 3, 5, 12, 0)
MIN = 60_000
SCHEMA = f"town string, message string, at timestamp, {incidents.MESSAGE}"
RANKS = {"fire": 3, "crash": 2, "bag": 1}


def plain(rows):
    """(town, event, message, incident, how, at_ms, kind, messages, units) of messages (dicts), each town by itself."""
    out = []
    for town in {r["town"] for r in rows}:
        book = []  # every incident, in order of its begin
        for m in sorted((r for r in rows if r["town"] == town), key=lambda r: (r["ms"], r["message"])):
            out += [(town, *e) for e in aged(book, m["ms"])]
            out += [(town, *e) for e in heard(book, m)]
        out += [(town, *e) for e in aged(book, math.inf)]
    return out


def state(i):
    return i["kind"], i["n"], len(i["units"])


def aged(book, now):
    out = []
    for i in book:
        if i["over"] is None and i["last"] + 90 * MIN < now:
            i["over"] = i["last"] + 90 * MIN
            i["mine"] = set()
            out.append(("cleared", None, i["id"], None, i["over"], *state(i)))
        if i["over"] is not None and not i["filed"] and i["over"] + 180 * MIN < now:
            i["filed"] = True
            out.append(("archived", None, i["id"], None, i["over"] + 180 * MIN, *state(i)))
    return out


def metres(a, m):
    return math.hypot((m["lat"] - a["lat"]) * 111194.92664455873, (m["lon"] - a["lon"]) * 111194.92664455873 * math.cos(math.radians((m["lat"] + a["lat"]) / 2)))


def heard(book, m):
    ms, units, placed = m["ms"], [u.lower() for u in m["units"] or []], m["lat"] is not None and m["lon"] is not None
    venue, spot, precision, matched = (m["venue"], m["spot"], m["precision"], m["matched"]) if placed else (None,) * 4
    live_ = [i for i in book if i["over"] is None]
    apart = lambda i: bool(spot and i["spot"] and spot != i["spot"])
    hit, how = None, None
    for u in units:
        on = [i for i in live_ if u in i["mine"] and ms - i["last"] < 45 * MIN and len(i["units"]) < 24]
        if on:
            hit, how = on[0], "unit"
            if venue and hit["venue"] == venue and apart(hit):
                hit = None
            break
    if hit is None and placed and precision in ("exact", "approx"):
        if venue:
            fits = [i for i in live_ if i["venue"] == venue and not apart(i) and ((ms - i["last"] < 25 * MIN and i["kind"] in (None, m["call_type"])) if m["call_type"] else (ms - i["last"] < 4 * MIN and i["feed"] == m["feed"]))]
            best = max(((bool(spot and i["spot"] == spot), i["last"], -k) for k, i in enumerate(fits)), default=None)
            hit, how = (fits[-best[2]], "venue") if best else (None, None)
        else:
            near = [i for i in live_ if i["precision"] == "exact" and not i["venue"] and ms - i["last"] < 120 * MIN]
            same = [i for i in near if matched and i["matched"] == matched]
            close = sorted((metres(i, m), k) for k, i in enumerate(near) if metres(i, m) < (200 if precision == "exact" else 90))
            hit, how = (same[0], "address") if same else (near[close[0][1]], "near") if close else (None, None)
    if hit is None:
        if placed:
            start = not (precision == "weak" and not (units and m["call_type"])) and not m["inherited"] and not (venue and not m["call_type"] and not (units and spot))
        else:
            start = bool(units and m["call_type"]) and m["role"] != "field" and not m["clear"]
        if not start:
            return [("message", m["message"], None, "loose", ms, None, None, None)]
        hit, how = {"id": "i-" + m["message"], "last": ms, "over": None, "filed": False, "kind": None, "n": 0, "units": [], "mine": set(), "feed": m["feed"], "lat": m["lat"], "lon": m["lon"], "precision": precision, "matched": matched, "venue": venue, "spot": None}, "new"
        book.append(hit)
    hit["last"] = ms
    hit["n"] += 1
    if m["call_type"] and (hit["kind"] is None or RANKS.get(m["call_type"], 0) > RANKS.get(hit["kind"], 0)):
        hit["kind"] = m["call_type"]
    level = ["weak", "approx", "exact"]
    if precision and (hit["precision"] is None or level.index(precision) > level.index(hit["precision"])):
        hit |= {"lat": m["lat"], "lon": m["lon"], "precision": precision, "matched": matched}
    if venue and spot and hit["venue"] == venue:
        hit["spot"] = spot
    for u in units:
        if u not in hit["units"]:
            hit["units"].append(u)
        for i in book:
            i["mine"].discard(u)
        hit["mine"].add(u)
    out = [("message", m["message"], hit["id"], how, ms, *state(hit))]
    if m["clear"]:
        hit["over"], hit["mine"] = ms, set()
        out.append(("cleared", None, hit["id"], None, ms, *state(hit)))
    return out


def messages(seed, n):
    rng = random.Random(seed)
    out, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 3, 5, 10, 20] + [200] * (i % 40 == 0)) * MIN
        place = rng.randrange(4)
        precision = rng.choice(["exact", "exact", "approx", "weak", None])
        hall = rng.random() < 0.3
        out.append({
            "town": rng.choice(["a", "b", None]), "message": f"m{i:04}", "ms": int(T0.timestamp() * 1000) + at, "feed": rng.choice("fg"), "units": rng.choice([None, [], ["E1"], ["e1", "L2"], [f"U{rng.randrange(6)}"]]),
            "call_type": rng.choice([None, "fire", "crash", "bag"]), "role": rng.choice(["field", "dispatch", None]), "clear": rng.random() < 0.1, "inherited": rng.random() < 0.1,
            "lat": 42 + place * 0.0011 + rng.random() * 0.0005 if precision else None, "lon": -71.0 if precision else None, "precision": precision, "matched": rng.choice([None, f"{place} elm"]),
            "venue": rng.choice(["hall", "dome"]) if hall else None, "spot": rng.choice([None, "gate 1", "gate 2"]) if hall else None,
        })
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(datetime.fromtimestamp(r["ms"] / 1000) if c.split(" ")[0] == "at" else r[c.split(" ")[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture()
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stream_with_restarts(spark, tmp_path, few_partitions):
    """Batches of disorder up to ten minutes, a restart after each but one, a message sent twice: as one fold in order."""
    rows = messages(1, 360)
    rng = random.Random(2)
    sent = sorted(rows, key=lambda r: r["ms"] + rng.randrange(9 * MIN))
    end = [dict(rows[0], town="end", message="end", ms=rows[-1]["ms"] + 2 * 86_400_000)]
    batches = [sent[:100], sent[100:101] + sent[100:220], sent[220:], end]
    for i, batch in enumerate(batches):
        frame(spark, batch).coalesce(1).write.json(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/*")
        with keyed_state(spark):
            run = incidents.incidents(stream, ranks=RANKS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            run.awaitTermination(240)
        assert run.exception() is None
    got = order(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == order(plain(rows))
    assert {r[4] for r in got if r[1] == "message"} == {"unit", "venue", "address", "near", "new", "loose"}


def test_replay_of_events(spark, sf, few_partitions):
    """The registered query over its whole table."""
    global RANKS
    rows = [r.asDict() | {"ms": r.at_ms} for r in live.talk(spark, sf).withColumn("at_ms", F.unix_millis("at")).collect()]
    got = order(tuple(r) for r in live.incident_states(spark, sf).collect())
    held, RANKS = RANKS, live.KINDS
    want = order(plain(rows))
    RANKS = held
    assert got == want


def test_rules():
    at = lambda minute, name, **more: {"message": name, "at_ms": minute * MIN, "feed": "f", "units": ["E1"], "call_type": "fire", "role": None, "clear": False, "inherited": False, "lat": 42.0, "lon": -71.0, "precision": "exact", "matched": None, "venue": None, "spot": None} | more
    town = incidents.Town({}, {}, RANKS)
    for m in [at(0, "a"), at(44, "b", lat=50.0), at(50, "c", clear=True), at(51, "d", lat=43.0), at(60, "e", units=["E2"], venue="hall", spot="x", lat=44.0), at(61, "f", units=["E2"], venue="hall", spot="y", lat=44.0), at(62, "g", units=["E3"], venue="hall", spot="x", lat=44.0)]:
        town.hear(m)
    assert [(r["message"], r["incident"], r["how"]) for r in town.out if r["event"] == "message"] == [("a", "i-a", "new"), ("b", "i-a", "unit"), ("c", "i-a", "unit"), ("d", "i-d", "new"), ("e", "i-e", "new"), ("f", "i-f", "new"), ("g", "i-e", "venue")]
    town.pass_time(1000 * MIN)
    assert [(r["incident"], r["at_ms"] // MIN) for r in town.out if r["event"] == "cleared"] == [("i-a", 50), ("i-d", 141), ("i-f", 151), ("i-e", 152)]
    assert [(r["incident"], r["at_ms"] // MIN) for r in town.out if r["event"] == "archived"] == [("i-a", 230), ("i-d", 321), ("i-f", 331), ("i-e", 332)]
    assert not town.units and not town.scenes


